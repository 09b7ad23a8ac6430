"""Amounts that a model gave, held against the evidence of the page (Arrow: the evidence is read by the scanner of amounts).

A snippet speaks of money if it has an amount with a currency or a scale, or names a currency. Without such a snippet all
amounts go; so do bounds whose snippet speaks of something else in which no range is found, and bounds without any range in
all the evidence. Weak evidence keeps amounts and asks for a look. A budget that is a year goes. Null lists and texts are
empty; a record without amounts passes as it is."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .money import CURRENCIES, SCALES, _is_phone, _NUMBER, _scale_behind, _sign_before, _tells_date, _tells_share, money_range

# What numbers may speak of beside money, words of money, reasons and errors.
OTHER_WORDS = ("tender number", "bid number", "rfp", "rfq", "procurement", "telephone", "phone", "fax", "postal code", "postcode", "trl", "technology readiness level")
MONEY_WORDS = ("fund", "funding", "grant", "loan", "equity", "investment", "capital", "ticket", "amount", "budget", "finance")
CODES = ("zar", "usd", "eur", "gbp")
INVALID, WEAK = "invalid_money_context", "weak_money_evidence"
ERRORS = {INVALID: "invalid money evidence context", WEAK: "money amount could not be validated from evidence"}
SURE_FROM = 0.7


def _words(text: str) -> str:
    return " " + " ".join("".join(c if c.isalnum() else " " for c in text.lower()).split()) + " "


def _has(words: str, terms: tuple[str, ...]) -> bool:
    return any(f" {t} " in words for t in terms)


def _is_year(text: str) -> bool:
    return len(text) == 4 and text.isdigit() and text[:2] in ("19", "20")


def speaks_of_money(text: str) -> bool:
    if _has(_words(text), CODES):
        return True
    for m in _NUMBER.finditer(text):
        sign = _sign_before(text, m.start())
        if sign in CURRENCIES and sign in ("R", "$", "£") or _scale_behind(text, m.end())[0] in SCALES:
            return True
    return False


def has_other_number(text: str) -> bool:
    """Numbers of a snippet may be of something else: a share, a phone, a date, a year, or what its words say."""
    words = _words(text)
    phones = any(_is_phone(m[0]) or sum(c.isdigit() for c in m[0]) >= 7 for m in _NUMBER.finditer(text.replace("-", " ").replace("(", " ").replace(")", " ")))
    return _has(words, OTHER_WORDS) or _tells_date(text) or _tells_share(text) or phones or any(_is_year(w) for w in words.split())


def speaks_of_other(text: str) -> bool:
    """A snippet as a whole speaks of something else than money."""
    words = _words(text)
    if _has(words, OTHER_WORDS) or _tells_share(text) or _is_phone(text.strip()):
        return True
    return not _has(words, MONEY_WORDS) and (_tells_date(text) or _is_year(text.strip()))


def checked(snippets: list[str] | None, title: str | None, low, high, budget, currency: str | None) -> tuple:
    """(low, high, budget, currency, reason, error) after the check."""
    held = [" ".join(s.split()) for s in ([] if snippets is None else snippets) if s and s.strip()]
    low, high, budget = (None if v is None or v != v else float(v) for v in (low, high, budget))
    if low is None and high is None and budget is None:
        return low, high, budget, currency, None, None
    spoken = [s for s in held if speaks_of_money(s)]
    if not spoken:
        reason = INVALID if any(has_other_number(s) for s in held) else WEAK
        return None, None, None, currency, reason, ERRORS[reason]
    if any(speaks_of_other(s) and money_range(s, currency)[3] is None for s in spoken):
        kept = budget if any("budget" in s.lower() for s in held) else None
        return None, None, kept, currency, INVALID, ERRORS[INVALID]
    least, most, told, _, sure = money_range(" ".join([title or "", *spoken]), currency)
    bounded = low is not None or high is not None
    if bounded and least is None and most is None:
        return None, None, budget, currency, WEAK, ERRORS[WEAK]
    reason = WEAK if bounded and 0 < sure < SURE_FROM else None
    if budget is not None and budget.is_integer() and _is_year(str(int(budget))):
        budget, reason = None, INVALID
    return low, high, budget, currency or told, reason, None


CHECKED = StructType([StructField(c, DoubleType()) for c in ("low", "high", "budget")] + [StructField(c, StringType()) for c in ("currency", "reason", "error")])


@F.pandas_udf(CHECKED)
def checked_amounts(snippets: pd.Series, title: pd.Series, low: pd.Series, high: pd.Series, budget: pd.Series, currency: pd.Series) -> pd.DataFrame:
    rows = [checked(*r) for r in zip(snippets, title, low, high, budget, currency, strict=True)]
    return pd.DataFrame(rows, columns=[f.name for f in CHECKED]).astype({"low": float, "high": float, "budget": float})
