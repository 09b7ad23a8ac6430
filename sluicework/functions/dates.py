"""Deadlines in text: open, rolling or a fixed date, by an own reader of written dates (Arrow UDF; Spark has no such grammar)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

# Wording of open and rolling intakes, and cues of a sentence that tells a deadline.
OPEN_WORDING = (
    "open year-round", "open year round", "accept applications anytime", "accepting applications anytime", "applications are open", "always open",
    "apply anytime",
)
ROLLING_WORDING = ("rolling basis", "rolling applications", "applications are considered on a rolling basis", "reviewed on a rolling basis")
DEADLINE_CUES = ("deadline", "applications close", "closing date", "closes on", "close on", "submissions close")
FIRST_SENTENCES = 12
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH_OF = {name[:n]: i + 1 for i, name in enumerate(_MONTHS) for n in range(3, len(name) + 1) if n in (3, len(name))} | {"sept": 9}
_PIECES = re.compile(r"[a-z]+|\d+|[^\sa-z\d]")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")


def _year(text: str) -> int:
    return int(text) + (2000 if len(text) == 2 and int(text) < 70 else 1900 if len(text) == 2 else 0)


def _made(year: int, month: int, day: int) -> date | None:
    try:
        return date(year, month, day)
    except ValueError:
        return None


def _coming(month: int, day: int, today: date) -> date | None:
    """The next such day: a date without a year lies ahead."""
    found = _made(today.year, month, day)
    return found if found is None or found >= today else _made(today.year + 1, month, day)


def dates_in(text: str, today: date) -> Iterator[date]:
    """Dates of a sentence in order: y-m-d, d/m/y (day first), d Month y, Month d y, and those two without a year."""
    parts = _PIECES.findall(text.lower())
    number = lambda k, most: k < len(parts) and parts[k].isdigit() and len(parts[k]) <= most
    month = lambda k: _MONTH_OF.get(parts[k]) if k < len(parts) else None
    k = 0
    while k < len(parts):
        found, used = None, 1
        if number(k, 4):
            rest = k + 1
            if rest < len(parts) and parts[rest] in ("st", "nd", "rd", "th"):
                rest += 1
            if rest < len(parts) and parts[rest] == "of":
                rest += 1
            if len(parts[k]) <= 2 and month(rest):
                after = rest + 1 + (rest + 1 < len(parts) and parts[rest + 1] == ",")
                if number(after, 4) and len(parts[after]) == 4:
                    found, used = _made(int(parts[after]), month(rest), int(parts[k])), after + 1 - k
                else:
                    found, used = _coming(month(rest), int(parts[k]), today), rest + 1 - k
            elif k + 4 < len(parts) and parts[k + 1] in ("-", "/") and parts[k + 3] == parts[k + 1] and number(k + 2, 2) and number(k + 4, 4):
                if len(parts[k]) == 4:
                    found = _made(int(parts[k]), int(parts[k + 2]), int(parts[k + 4]))
                elif len(parts[k]) <= 2 and len(parts[k + 4]) in (2, 4):
                    found = _made(_year(parts[k + 4]), int(parts[k + 2]), int(parts[k])) or _made(_year(parts[k + 4]), int(parts[k]), int(parts[k + 2]))
                used = 5
        elif month(k) and number(k + 1, 2):
            after = k + 2
            if after < len(parts) and parts[after] in ("st", "nd", "rd", "th"):
                after += 1
            if after < len(parts) and parts[after] == ",":
                after += 1
            if number(after, 4) and len(parts[after]) == 4:
                found, used = _made(int(parts[after]), month(k), int(parts[k + 1])), after + 1 - k
            else:
                found, used = _coming(month(k), int(parts[k + 1]), today), 2
        if found is not None:
            yield found
        k += used


def deadline(text: str | None, today: date) -> tuple[str, date | None, str | None, float]:
    """(kind, day, snippet, confidence): open before rolling before the first date of a sentence with a cue, or without any
    such sentence of the first twelve."""
    clean = " ".join((text or "").split())
    low = clean.lower()
    for kind, words, sure in (("Open", OPEN_WORDING, 0.9), ("Rolling", ROLLING_WORDING, 0.88)):
        for w in words:
            if w in low:
                return kind, None, w, sure
    sentences = [s for s in (x.strip() for x in _SENTENCES.split(clean)) if s]
    cued = [s for s in sentences if any(c in s.lower() for c in DEADLINE_CUES)]
    for s in cued or sentences[:FIRST_SENTENCES]:
        for day in dates_in(s, today):
            return "FixedDate", day, s, 0.9 if cued else 0.72
    return "Unknown", None, None, 0.0


DEADLINE = StructType([StructField("kind", StringType()), StructField("day", DateType()), StructField("snippet", StringType()), StructField("confidence", DoubleType())])


@F.pandas_udf(DEADLINE)
def deadline_of(text: pd.Series, today: pd.Series) -> pd.DataFrame:
    """``deadline`` of a text, as seen on a day."""
    rows = [deadline(t, d if isinstance(d, date) else date(1970, 1, 1) + timedelta(days=int(d))) for t, d in zip(text, today, strict=True)]
    return pd.DataFrame(rows, columns=["kind", "day", "snippet", "confidence"])
