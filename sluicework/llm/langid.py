"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its subwords (each word between < and >, its character n-grams of
2 to 4), hashed into a fixed table; a linear softmax over that mean gives the languages. Embeddings and
softmax are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows, cut into
windows of whole words that cover each text. A temperature is fitted on rows set aside, and with it the
score below which a text is rejected. As mean and softmax are linear, each white-space chunk has one
vector of logits, kept in a bounded cache per worker; whole texts are scored.

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected; rows without a language
teach nothing; with no labelled row at all every text is ``und``; ties go to the language first in order.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

PER_LANGUAGE, LEARN_CHARS = 250, 48_000_000
"""Labelled rows of each language, and characters of all, at most about, that the model is trained on."""
STRETCH = 4096
"""Characters of a word from which its subwords are made in parts."""
BUCKETS, DIMS, WINDOW = 1 << 16, 16, 24
CACHE = 250_000
REJECT_SHARE = 0.002
"""Share of the rows set aside that the rejection threshold may lose."""
_WORD = re.compile(r"[^\W\d_]+")


def letters(chunk: str) -> list[str]:
    """Runs of letters of a lower-cased chunk."""
    found = _WORD.findall(chunk)
    if not chunk.isascii():  # \w also has numbers such as superscripts
        found = ["".join(c for c in w if c.isalpha()) for w in found]
    return [w for w in found if w]


def subwords(chunk: str) -> list[int]:
    """Hashed subwords of the words in a chunk."""
    out = []
    for word in letters(chunk):
        data = f"<{word}>"
        out.append(zlib.crc32(data.encode()) % BUCKETS)
        for n in (2, 3, 4):
            out += [zlib.crc32(data[i : i + n].encode()) % BUCKETS for i in range(len(data) - n + 1)]
    return out


def long_subwords(chunk: str) -> Iterator[list[int]]:
    """What ``subwords`` gives, in parts of bounded size for chunks of any length."""
    for word in letters(chunk):
        data = f"<{word}>"
        yield [zlib.crc32(data.encode()) % BUCKETS]
        for lo in range(0, len(data), STRETCH):
            here = data[lo : lo + STRETCH + 3]
            yield [zlib.crc32(here[i : i + n].encode()) % BUCKETS for n in (2, 3, 4) for i in range(min(STRETCH, len(here) - n + 1))]


class Model:
    """Logits of each hashed subword, names of the languages, temperature and rejection threshold."""

    def __init__(self, names: list[str], logits: np.ndarray, bias: np.ndarray) -> None:
        self.names, self.logits, self.bias = names, logits, bias
        self.temperature, self.reject_below = 1.0, 0.0

    def probabilities(self, mean_logits: np.ndarray) -> np.ndarray:
        z = (mean_logits + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], epochs: int = 2, rate: float = 0.5, seed: int = 11) -> Model | None:
    """A model from labelled texts; None where there are none."""
    names = sorted(set(langs))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    aside = rng.random(len(texts)) < 0.2 if len(texts) >= 50 else np.zeros(len(texts), dtype=bool)
    seen: dict[str, list[int]] = {}
    windows, target, whole = [], [], []
    for i, text in enumerate(texts):
        words = text.lower().split()
        for w in words:
            if w not in seen:
                seen[w] = subwords(w)
        if aside[i]:
            whole.append((np.array([s for w in words for s in seen[w]], dtype=np.int64), y[i]))
            continue
        for lo in range(0, len(words), WINDOW):
            if ids := [s for w in words[lo : lo + WINDOW] for s in seen[w]]:
                windows.append(np.array(ids, dtype=np.int32))
                target.append(y[i])
    if not windows:
        return None
    target = np.array(target)
    weight = (len(target) / (len(names) * np.maximum(np.bincount(target, minlength=len(names)), 1)))[target]
    emb = rng.normal(0, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
    out = np.zeros((DIMS, len(names)), dtype=np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    steps, total = 0, epochs * -(-len(windows) // 64)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            sizes = np.array([len(windows[k]) for k in pick])
            flat = np.concatenate([windows[k] for k in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[flat], starts, axis=0) / sizes[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), target[pick]] -= 1
            p *= weight[pick][:, None]
            step = rate * (1 - steps / total)
            back = (p @ out.T) / sizes[:, None]
            out -= step * (mean.T @ p).astype(np.float32) / 8
            bias -= step * p.mean(axis=0).astype(np.float32)
            np.add.at(emb, flat, np.repeat(-step * 8 * back, sizes, axis=0).astype(np.float32))
            steps += 1
    model = Model(names, emb @ out, bias)
    _calibrate(model, [(ids, k) for ids, k in whole if len(ids)])
    return model


def _calibrate(model: Model, whole: list[tuple[np.ndarray, int]]) -> None:
    """Temperature of least log loss, and the threshold that loses REJECT_SHARE of the rows set aside."""
    if len(whole) < 10:
        return
    z = np.array([model.logits[ids].mean(axis=0) for ids, _ in whole])
    k = np.array([k for _, k in whole])
    best = None
    for t in np.geomspace(0.1, 10, 41):
        model.temperature = float(t)
        loss = -np.log(np.maximum(model.probabilities(z)[np.arange(len(k)), k], 1e-9)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(t))
    model.temperature = best[1]
    top = model.probabilities(z).max(axis=1)
    model.reject_below = float(min(0.5, np.quantile(top, REJECT_SHARE)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_label: int = PER_LANGUAGE) -> Model | None:
    """Trains on a sample of the labelled rows: about ``per_label`` of each, picked by a hash of the id."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    rows = rows.filter("label is not null and text is not null")
    found = rows.groupBy("label").agg(F.count(F.lit(1)), F.sum(F.length("text"))).collect()
    if not found:
        return None
    counts = {k: n for k, n, _ in found}
    most = LEARN_CHARS / len(found)  # so the labels together stay within it
    shares = {k: min(1.0, per_label / n, most / max(size, 1)) for k, n, size in found}
    share = F.create_map(*[x for k, s in shares.items() for x in (F.lit(k), F.lit(s))])
    luck = F.pmod(F.xxhash64("id", F.length("text")), F.lit(1_000_003)) / 1_000_003.0
    picked = rows.filter(luck < share[F.col("label")]).limit(2 * per_label * len(counts))
    sample = picked.select("id", "text", "label").toPandas().sort_values(["id", "text"])
    return train(sample["text"].tolist(), sample["label"].tolist())


class Scorer:
    """Scores texts by the logits of their chunks."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.at: dict[str, int] = {}
        self.table = np.zeros((CACHE + 1, len(model.names) + 1), dtype=np.float32)

    def _row(self, chunk: str) -> np.ndarray:
        row = np.zeros(self.table.shape[1], dtype=np.float64)
        for ids in long_subwords(chunk):
            row[:-1] += self.model.logits[ids].sum(axis=0)
            row[-1] += len(ids)
        return row

    def score(self, text: str) -> tuple[str, float, bool]:
        """(language, calibrated score, rejected)."""
        words = text.lower().split()
        extra = np.zeros(self.table.shape[1])
        if len(text) > STRETCH and max(map(len, words), default=0) > STRETCH:  # long chunks are not kept
            for w in [w for w in words if len(w) > STRETCH]:
                extra += self._row(w)
            words = [w for w in words if len(w) <= STRETCH]
        elif len(text) > 500 * (len(words) + 1):  # nor those of texts with hardly any white space
            for w in [w for w in words if len(w) > 64]:
                extra += self._row(w)
            words = [w for w in words if len(w) <= 64]
        total = extra
        for lo in range(0, len(words), CACHE // 2):
            part = words[lo : lo + CACHE // 2]
            new = set(part).difference(self.at)
            if len(self.at) + len(new) > CACHE:
                self.at.clear()
                new = set(part)
            if new:
                ids = [subwords(w) for w in new]
                first = len(self.at)
                self.at.update(zip(new, range(first, first + len(new)), strict=True))
                sizes = np.array([len(x) for x in ids])
                rows = np.zeros((len(new), self.table.shape[1]), dtype=np.float32)
                if sizes.any():
                    flat = np.array([i for x in ids for i in x])
                    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
                    rows[sizes > 0, :-1] = np.add.reduceat(self.model.logits[flat], starts, axis=0)
                rows[:, -1] = sizes
                self.table[first : first + len(new)] = rows
            at = np.fromiter(map(self.at.__getitem__, part), dtype=np.int64, count=len(part))
            total = total + self.table[at].sum(axis=0, dtype=np.float64)
        if total[-1] == 0:
            return "und", 0.0, True
        p = self.model.probabilities(total[:-1] / total[-1])
        k = int(np.argmax(p))
        return self.model.names[k], float(p[k]), bool(p[k] < self.model.reject_below)


def identify(df: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", accepted_only: bool = False) -> DataFrame:
    """The columns ``keep`` of every row, then ``lang_pred, score, rejected``; nothing is shuffled.

    With ``accepted_only``, only the rows that are not rejected, and only the columns ``keep``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = keep.index(text_col) if text_col in keep else len(keep)
    names = [*keep, *([] if text_col in keep else [text_col])]
    source = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(names)])
    kinds = (("lang_pred", pa.string(), StringType()), ("score", pa.float64(), DoubleType()), ("rejected", pa.bool_(), BooleanType()))

    def run(batches):
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [x.as_py() for x in part.column(at)]
                found = [scorer.score(t) if scorer is not None and t else ("und", 0.0, True) for t in texts]
                if accepted_only:
                    yield part.filter(pa.array([not f[2] for f in found], type=pa.bool_())).select(range(len(keep)))
                else:
                    cols = [pa.array([f[i] for f in found], type=k[1]) for i, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[: len(keep)], *cols], names=[*part.schema.names[: len(keep)], *(k[0] for k in kinds)]
                    )

    extra = [] if accepted_only else [StructField(k[0], k[2]) for k in kinds]
    out = source.mapInArrow(run, StructType([*source.schema[: len(keep)], *extra]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[x.name for x in extra])


def held_out(id_col):
    """True for rows kept for testing: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
