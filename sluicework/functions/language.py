"""Languages by common words, letters and scripts, without a model: rates per language, best first."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

# Frequent words of each language, and the letters of its alphabet.
COMMON_WORDS = {
    "en": ("the", "and", "for", "are", "with", "this", "that", "from", "have", "will"),
    "af": ("die", "van", "en", "is", "vir", "met", "wat", "het", "word", "sal"),
    "zu": ("ukuthi", "futhi", "ngoba", "uma", "ukuba", "noma", "kodwa", "ngakho"),
    "xh": ("ukuba", "kwaye", "okanye", "kodwa", "ngoba", "ukuze", "xa"),
    "fr": ("le", "la", "les", "de", "et", "pour", "dans", "avec", "que", "qui"),
    "es": ("el", "la", "los", "las", "de", "y", "para", "con", "que", "por"),
    "pt": ("o", "a", "os", "as", "de", "e", "para", "com", "que", "por"),
    "de": ("der", "die", "das", "und", "für", "mit", "von", "zu", "auf", "ist"),
    "ar": ("في", "من", "على", "إلى", "هذا", "التي", "أن", "كان"),
    "zh": ("的", "是", "在", "和", "有", "了", "人", "我", "他", "这"),
}
_LATIN = "abcdefghijklmnopqrstuvwxyz"
LETTERS = {
    "en": _LATIN, "af": _LATIN + "êëïôûáéíóú", "zu": _LATIN, "xh": _LATIN, "fr": _LATIN + "àâäæçéèêëïîôùûüÿœ", "es": _LATIN + "áéíóúüñ¿¡",
    "pt": _LATIN + "áàâãéêíóôõúüç", "de": _LATIN + "äöüß", "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "zh": "",
}
SCRIPTS = {"zh": ("\u4e00", "\u9fff"), "ar": ("\u0600", "\u06ff")}
LEAST = 10
_LANGS = list(COMMON_WORDS)
_WORDS: dict[str, list[int]] = {}
for _i, _lang in enumerate(_LANGS):
    for _w in COMMON_WORDS[_lang]:
        _WORDS.setdefault(_w, []).append(_i)
_WORD = re.compile(r"\w+")
RANKED = ArrayType(StructType([StructField("score", DoubleType()), StructField("lang", StringType())]))


def half_up(x: float, digits: int) -> float:
    """A number of no sign rounded half up after scaling in doubles, as SQL rounds."""
    scaled = x * 10**digits
    low = math.floor(scaled)
    return (low + (scaled - low >= 0.5)) / 10**digits


def ranked_languages(text: str | None, top: int = 3) -> list[tuple[float, str]]:
    """(score, language), best first: ten times the rate of common words, five times the share of letters, ten more for a
    script of its own, over the best. Languages without a point are left out; equal scores keep the order above; short texts
    are English by half."""
    clean = " ".join((text or "").split()).lower()
    if len(clean) < LEAST:
        return [(0.5, "en")]
    common = [0] * len(_LANGS)  # counts, not sums of rates: those depend on the order of words
    words = max(1, clean.count(" ") + 1)
    for w, n in Counter(_WORD.findall(clean)).items():
        for i in _WORDS.get(w, ()):
            common[i] += n
    chars = Counter(clean)
    score = []
    for i, lang in enumerate(_LANGS):
        letters = LETTERS[lang]
        score.append(common[i] / words * 10 + sum(n for c, n in chars.items() if c in letters) / len(clean) * 5)
        if lang in SCRIPTS and any(SCRIPTS[lang][0] <= c <= SCRIPTS[lang][1] for c in chars):
            score[i] += 10.0
    order = [i for i in sorted(range(len(_LANGS)), key=lambda i: (-score[i], i)) if score[i] > 0]
    return [(half_up(score[i] / score[order[0]], 4), _LANGS[i]) for i in order[:top]] or [(0.5, "en")]


@F.pandas_udf(RANKED)
def languages_of(texts: pd.Series) -> pd.Series:
    """``ranked_languages`` of a column (Arrow UDF: one pass counts words and letters for all languages)."""
    return texts.map(lambda t: [{"score": s, "lang": lang} for s, lang in ranked_languages(t)])


def languages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``languages``: up to three structs of (score, lang), best first."""
    return df.withColumn("languages", languages_of(text_col))


def multilingual(languages: Column, least: float = 0.3) -> Column:
    """Whether a second language has a share of its own."""
    return F.coalesce(F.try_element_at(languages, F.lit(2))["score"] >= least, F.lit(False))
