"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Terms (words, and stems: beginnings of 3 to 9 letters of longer words) that mark toxic texts are mined on one half of a
bounded sample of labelled rows. Each strong term is a voter that says toxic or abstains; further voters
look at how many terms a text holds, at insistent punctuation and at shouting; the label itself is one
more voter. The label model is a mixture of two classes fitted by expectation maximisation: it estimates
how often each voter says what in each class (its accuracy), then how far voters agree beyond what the
class explains (their correlation), and counts correlated voters less. Its posterior labels of the whole
sample train a linear classifier on the presence of terms. Scoring looks at each distinct word of the whole
text; the terms of a chunk are kept in a bounded cache per worker.

Cases: null counts as empty; an empty text gets the score of a text without terms; without labelled rows
of both classes no term is learnt and the score is the share of toxic rows (0 without any).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

TOXIC_ROWS, CLEAN_ROWS = 1500, 3000
"""Labelled rows of either class, at most about, that the models are fitted on."""
LEARN_CHARS = 48_000_000
"""Characters of those rows, at most about; with longer texts there are fewer rows, each whole."""
TERMS, VOTERS = 400, 64
CACHE = 400_000
_WORD = re.compile(r"\w+")


PAIR = 0x9E3779B9
"""Mixed into a stem's number for the term that two or more words share it."""


def terms_of(word: str) -> list[int]:
    """Numbers (32-bit hashes) of a word, and of its beginnings that go on (stems)."""
    data = word.encode("utf-8", "surrogatepass")
    out = [zlib.crc32(b"=" + data)]
    if word.isascii():
        out += [zlib.crc32(data[:n]) for n in range(3, min(9, len(word) - 1) + 1)]
    else:
        out += [zlib.crc32(word[:n].encode("utf-8", "surrogatepass")) for n in range(3, min(9, len(word) - 1) + 1)]
    return out


def counted(found: Iterable[int]) -> set[int]:
    """Terms of a text: those of its distinct words, and the mixed number of each stem that two or more share."""
    times = Counter(found)
    return set(times).union(t ^ PAIR for t, n in times.items() if n > 1)


def term_set(text: str) -> np.ndarray:
    """Sorted numbers of all terms of a text: an array, as sets of a whole sample would not fit the driver."""
    ids, times = np.unique(np.array([t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)], dtype=np.uint32), return_counts=True)
    return np.unique(np.concatenate([ids, ids[times > 1] ^ np.uint32(PAIR)]))


def _tail(a: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """-log of a bound on the chance that a of n independent rows are toxic (Chernoff); 0 below the mean."""
    q = np.clip(a / n, 1e-12, 1 - 1e-12)
    bound = n * (q * np.log(q / share) + (1 - q) * np.log((1 - q) / (1 - share)))
    return np.where(q > share, bound, 0.0)


def mine(sets: list[np.ndarray], y: np.ndarray, most: int = TERMS) -> list[int]:
    """Terms that mark toxic texts, strongest first.

    A term counts if its rows are toxic more often than chance allows among that many terms; one whose
    toxic rows are nearly all those of a stronger term adds nothing and is left out.
    """
    count = lambda k: np.unique(np.concatenate([np.zeros(0, np.uint32), *(s for s, x in zip(sets, y, strict=True) if x == k)]), return_counts=True)
    (ids, a), (others, b) = count(1), count(0)
    enough = a >= 3
    if not enough.any():
        return []
    need = np.log(len(ids) + len(others)) + 2
    ids, a = ids[enough], a[enough].astype(float)
    at = np.minimum(np.searchsorted(others, ids), max(0, len(others) - 1))
    against = np.where(others[at] == ids, b[at], 0) if len(others) else np.zeros(len(ids))
    strength = _tail(a, a + against, float(np.clip(y.mean(), 1e-6, 1 - 1e-6)))
    # where a stem and its longer forms are in the same rows, fewer rows against decide, then the number
    order = np.lexsort((ids, against, -np.round(strength, 6)))
    ranked = ids[[i for i in order[: 50 * most].tolist() if strength[i] > need]]
    rows: dict[int, set[int]] = {int(t): set() for t in ranked}
    listed = np.sort(ranked)
    for i, (s, k) in enumerate(zip(sets, y.tolist(), strict=True)):
        if k:
            for t in np.intersect1d(listed, s, assume_unique=True).tolist():
                rows[t].add(i)
    kept: list[int] = []
    for t in ranked.tolist():
        if all(len(rows[t] & rows[k]) < 0.9 * len(rows[t]) for k in kept):
            kept.append(t)
            if len(kept) == most:
                break
    return kept


def unlike(texts: list[str]) -> list[int]:
    """Positions of texts without those that nearly repeat an earlier one (by minima of hashed word triples).

    Copies would make every rare word of a text look like a marker."""
    out, seen = [], set()
    for i, text in enumerate(texts):
        words = text.lower().split()
        grams = np.array([zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))], dtype=np.uint64)
        keys = {(j, int(((grams * m) & np.uint64(0xFFFFFFFF)).min())) for j, m in enumerate(_MIXERS)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


_MIXERS = tuple(np.uint64(x) for x in (2654435761, 2246822519, 3266489917, 668265263))


def votes_of(found: set[int], text: str, voters: list[int]) -> list[int]:
    """1 toxic, 0 clean, -1 abstains: one vote per strong term, then the pattern voters."""
    hits = sum(t in found for t in voters)
    marks = text.count("!") + text.count("?")
    words = len(text) / 6 + 1
    return [1 if t in found else -1 for t in voters] + [
        1 if hits >= 4 else -1,
        1 if hits >= 2 else (0 if hits == 0 else -1),
        1 if hits else 0,
        1 if marks > 0.2 * words and hits else -1,
        0 if marks == 0 and not hits else -1,
        1 if text.isupper() and hits else -1,
        0 if not text.strip() else -1,
    ]


class LabelModel:
    """Two-class mixture over votes in {-1, 0, 1} with down-weighted correlated voters.

    The last voter is the given label, of fixed accuracy."""

    def __init__(self, votes: np.ndarray, prior: float, rounds: int = 25) -> None:
        # before the classes are known, agreement alone keeps a block of copies from outvoting the rest
        self.weights = 1 / self._agreement(votes, np.full(len(votes), 0.5), 0.9)
        self.weights[-1] = 1
        first = np.where((votes == 1) @ self.weights > (votes == 0) @ self.weights, 0.9, 0.1)
        p = self._fit(votes, first, prior, rounds)
        self.weights = 1 / self._agreement(votes, p)
        self.weights[-1] = 1
        self.posterior = self._fit(votes, p, prior, rounds)

    def _fit(self, votes: np.ndarray, p: np.ndarray, prior: float, rounds: int) -> np.ndarray:
        for _ in range(rounds):
            self.prior = float(np.clip((p.sum() + 20 * prior) / (len(p) + 20), 1e-3, 1 - 1e-3))
            log = np.full((len(votes), 2), np.log([1 - self.prior, self.prior]))
            self.rates = []
            for k, q in enumerate((1 - p, p)):
                share = np.stack([(q[:, None] * (votes == v)).sum(axis=0) + 0.5 for v in (-1, 0, 1)])
                share /= share.sum(axis=0)
                share[:, -1] = (0.01, 0.01 + 0.98 * (k == 0), 0.01 + 0.98 * (k == 1))  # the label's voter
                share[:, -1] /= share[:, -1].sum()
                self.rates.append(share)
                cells = np.log(share)[votes + 1, np.arange(votes.shape[1])]
                log[:, k] += cells @ self.weights
            new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
            if np.abs(new - p).max() < 1e-6:
                return new
            p = new
        return p

    def _agreement(self, votes: np.ndarray, p: np.ndarray, least: float = 0.1) -> np.ndarray:
        """1 + the correlations (from ``least``) of each voter with the others, given the class."""
        self.correlation = np.zeros((votes.shape[1],) * 2)
        for q in (1 - p, p):
            if q.sum() < 2:
                continue
            x = (votes == 1).astype(float) - (votes == 0)
            x = x - (q @ x) / q.sum()
            cov = (x * q[:, None]).T @ x / q.sum()
            scale = np.sqrt(np.diag(cov)) + 1e-6
            self.correlation = np.maximum(self.correlation, np.abs(cov / np.outer(scale, scale)))
        np.fill_diagonal(self.correlation, 0)
        return 1 + np.where(self.correlation > least, self.correlation, 0).sum(axis=1)


class Model:
    """Weights of terms (by number) and a bias."""

    def __init__(self, weights: dict[int, float], bias: float) -> None:
        self.weights, self.bias = weights, bias


def train_linear(sets: list[np.ndarray], target: np.ndarray, terms: list[int], rounds: int = 30, ridge: float = 0.005) -> Model:
    """Ridge logistic regression on the presence of terms, on posterior labels, by Newton steps."""
    at = {t: i for i, t in enumerate(terms)}
    x = np.zeros((len(sets), len(terms) + 1))
    listed = np.array(terms, dtype=np.uint32)
    x[:, -1] = 1
    for i, s in enumerate(sets):
        x[i, [at[t] for t in s[np.isin(s, listed)].tolist()]] = 1
    x, back = np.unique(x, axis=0, return_inverse=True)  # most rows hold no term
    count = np.bincount(back.ravel(), minlength=len(x)).astype(float)
    share = np.bincount(back.ravel(), weights=target, minlength=len(x)) / count
    w = np.zeros(len(terms) + 1)
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (count * (share - p)) - pull * w
        curve = (x.T * (count * np.maximum(p * (1 - p), 1e-6))) @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        w += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Model({t: float(v) for t, v in zip(terms, w[:-1], strict=True) if abs(v) > 1e-3}, float(w[-1]))


def train(texts: list[str], toxic: list[int], seed: int = 5) -> Model:
    """The classifier from labelled texts, by way of voters and label model."""
    y = np.array(toxic, dtype=np.int64)
    if not len(y):
        return Model({}, -50.0)
    pick = unlike(texts)
    texts, y = [texts[i] for i in pick], y[pick]
    if y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
        return Model({}, float(np.log(share / (1 - share))))
    sets = [term_set(t) for t in texts]
    half = np.random.default_rng(seed).random(len(y)) < 0.5
    if y[half].min() == y[half].max():
        half[:] = True
    mined = mine([s for s, h in zip(sets, half, strict=True) if h], y[half], VOTERS)
    listed = np.array(mined, dtype=np.uint32)
    votes = np.array([[*votes_of(set(s[np.isin(s, listed)].tolist()), t, mined), int(k)] for s, t, k in zip(sets, texts, y, strict=True)])
    labels = LabelModel(votes, float(y.mean())).posterior
    terms = mine(sets, (labels > 0.5).astype(np.int64)) if (labels > 0.5).any() else mined
    return train_linear(sets, labels, terms)


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on a sample of labelled rows: about TOXIC_ROWS and CLEAN_ROWS, picked by a hash of the id."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    marks = marks.groupBy("id").agg(F.max("label").alias("label"))
    counts = dict(marks.groupBy("label").count().collect())
    share = F.when(F.col("label") == 1, min(1.0, TOXIC_ROWS / counts.get(1, 1))).otherwise(min(1.0, CLEAN_ROWS / counts.get(0, 1)))
    luck = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003.0
    picked = marks.filter(luck < share).limit(2 * (TOXIC_ROWS + CLEAN_ROWS))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # the sample of ids is broadcast: it is bounded by the limit above
    rows = texts.join(F.broadcast(picked), "id")
    held = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if held > LEARN_CHARS:  # long texts: fewer of them, each whole
        rows = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_003)) / 1_000_003.0 < LEARN_CHARS / held)
    rows = rows.limit(4 * (TOXIC_ROWS + CLEAN_ROWS)).toPandas().sort_values(["id", "text"])
    rows = rows.drop_duplicates("id")
    return train([t or "" for t in rows["text"]], rows["label"].tolist())


class Scorer:
    """Scores texts by the weighted terms among their distinct words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, tuple[tuple[str, int], ...]] = {}

    def score(self, text: str) -> float:
        words = set(text.lower().split())
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = words
        weights = self.model.weights
        for w in new:
            self.known[w] = tuple((x, t) for x in _WORD.findall(w) for t in terms_of(x) if t in weights or t ^ PAIR in weights)
        found = counted(t for _, t in {pair for hit in map(self.known.__getitem__, words) if hit for pair in hit})
        z = self.model.bias + sum(weights.get(t, 0.0) for t in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text", below: float | None = None) -> DataFrame:
    """The columns ``keep`` of every row, then ``score``; the model is broadcast, nothing is shuffled.

    With ``below``, only the rows with a lower score, and without the score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text_col) if text_col in keep else len(keep)
    names = [*keep, *([] if text_col in keep else [text_col])]
    source = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(names)])

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [scorer.score(t.as_py() or "") for t in part.column(at)]
                if below is None:
                    cols = [*part.columns[: len(keep)], pa.array(found, type=pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names[: len(keep)], "score"])
                else:
                    yield part.filter(pa.array([z < below for z in found], type=pa.bool_())).select(range(len(keep)))

    extra = [StructField("score", DoubleType())] if below is None else []
    out = source.mapInArrow(run, StructType([*source.schema[: len(keep)], *extra]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[x.name for x in extra])
