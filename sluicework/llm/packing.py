"""Best-fit packing of documents into sequences of bounded length, in bulk-synchronous steps.

Documents are tokenised, ended with an end id and, only where longer than a sequence, cut into pieces. The pieces
are range-sorted by length over the cluster, longest first, which gives each its rank. Free space is a table of gaps
(sequence, size), which every step leaves sorted by size and numbered in that order.

A step takes the pieces of one range of lengths, from (capacity / 2, capacity] down by halves, with the gaps that are
large enough for any of them; smaller gaps wait unread. Pieces and gaps are dealt over tasks by rank, so every task
holds a like share of all lengths and sizes, and no gap is offered twice. A task sweeps through its pieces: each takes
the smallest gap that is large enough (its successor), of several that want one the first in rank; the gap is updated
at once and may serve again. Pieces without a successor are dealt anew, over few tasks, with all gaps that are left,
and swept again; only those that still find none open new sequences. The step writes its placed pieces and its gaps,
and the next range follows: at most two sweeps for each of LEVELS ranges, whatever the size of the input. A step that
fits one task equals best-fit decreasing done piece by piece.

Cases: null text is empty, and an empty document is its end id alone; rows that repeat an id are packed
each; ties of length are ordered by id and piece; other columns, clashing names included, are left out; an empty
table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _held, _source
from .common import reused, written
from .vocab import CONTRACTIONS, LETTER, NUMBER, ODD

CACHE = 1_000_000
"""Pre-tokens whose ids a worker keeps at most."""


class LibraryIds:
    """Ids that the tokenizers library gives, with the pre-tokens it has seen kept.

    The library merges within pre-tokens, so the ids of a text are those of its pre-tokens in a row. Texts
    of common characters are cut into pre-tokens here; other texts, and those that may hold added tokens, go
    to the library whole.
    """

    def __init__(self, data: bytes) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.cut = re.compile(f"{CONTRACTIONS}|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+").findall
        self.kept: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        lowered = [t.lower() for t in texts]
        split = [self.cut(low) if ODD.search(t) is None and "<|" not in low else None for t, low in zip(texts, lowered, strict=True)]
        new = set().union(*(s for s in split if s)).difference(self.kept)
        if len(self.kept) + len(new) > CACHE:
            self.kept.clear()
            new = set().union(*(s for s in split if s))
        listed = list(new)
        for lo in range(0, len(listed), 4096):
            part = listed[lo : lo + 4096]
            self.kept.update(zip(part, self._encode(part), strict=True))
        get = self.kept.__getitem__
        return [b"".join(map(get, s)) if s is not None else self._encode([t])[0] for s, t in zip(split, texts, strict=True)]


def pieces(df: DataFrame, vocab_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: documents in ids, cut only where longer than ``capacity``."""
    data = df.sparkSession.sparkContext.broadcast(open(vocab_path, "rb").read())

    def run(batches):
        library = reused(f"LibraryIds {zlib.crc32(data.value)}", lambda: LibraryIds(data.value))
        end = np.array([end_id], dtype="<u4").tobytes()
        for held in _held(batches):
            rows = []
            for (ident, _), ids in zip(held, library.many([t for _, t in held]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((ident, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"]
            )

    return _source(df, id_col, text_col).mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


LEVELS = 7
"""Ranges of lengths: halves of the capacity down to the last, which reaches to 1."""
SEQUENCES, ROWS = 256, 200_000
"""Sequences' worth of tokens, and pieces, of one task in a sweep; where sequences are opened, four times as much, since
each of those tasks may leave its last sequence part empty."""


def level_of(length, capacity: int):
    """Range of a piece's length (a number or an array of them)."""
    return np.minimum(np.log2(capacity // length).astype(np.int32), LEVELS - 1)


class Gaps:
    """Gaps by size, with the successor of a length in a few operations on one long integer."""

    def __init__(self, capacity: int) -> None:
        self.held: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.sizes = 0  # bit n: there are gaps of size n

    def add(self, size: int, sequence: int) -> None:
        if size:
            self.held[size].append(sequence)
            self.sizes |= 1 << size

    def take(self, length: int) -> tuple[int, int] | None:
        """(size, sequence) of the smallest gap of at least ``length``."""
        above = self.sizes >> length
        if not above:
            return None
        size = length + (above & -above).bit_length() - 1
        sequence = self.held[size].pop()
        if not self.held[size]:
            self.sizes ^= 1 << size
        return size, sequence

    def rows(self) -> list[tuple[int, int]]:
        """(size, sequence), largest first."""
        return [(n, s) for n in range(len(self.held) - 1, 0, -1) for s in self.held[n]]


GAP, PIECE, PLACED = 0, 1, 2
STATE = "kind int, id long, piece int, start long, length long, ids_crc32 long, turn long, sequence_id long, offset long"
_STATE = [f.split()[0] for f in STATE.split(", ")]
_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _state(kind: int, *columns) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(columns[0]), kind)).cast(pa.int32()), *columns]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, _KINDS, strict=True)], names=_STATE)


def sweep(pieces_: DataFrame, gaps: DataFrame | None, capacity: int, tasks: int, step: int, opens: bool) -> DataFrame:
    """State after one sweep: placed pieces, pieces without a successor (none if it ``opens`` sequences), and gaps."""

    def run(batches):
        now, free, opened = None, Gaps(capacity), 0

        def close():
            rows = free.rows()
            if rows:
                n = len(rows)
                turn = np.arange(n) * tasks + now
                none = pa.nulls(n, pa.int64())
                yield _state(GAP, none, pa.nulls(n, pa.int32()), none, [r[0] for r in rows], none, turn, [r[1] for r in rows], none)

        for batch in batches:
            if not batch.num_rows:
                continue
            deal = batch.column(0).to_numpy()
            cuts = np.flatnonzero(deal[1:] != deal[:-1]) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(deal)], strict=True):
                if deal[lo] != now:
                    if now is not None:
                        yield from close()
                    now, free, opened = int(deal[lo]), Gaps(capacity), 0
                part = batch.slice(lo, hi - lo)
                kinds, lengths = part.column(1).to_numpy(), part.column(5).to_numpy()
                first = int(np.searchsorted(kinds, PIECE))
                for size, sequence in zip(lengths[:first].tolist(), part.column(8).to_pylist()[:first], strict=True):
                    free.add(size, sequence)
                where, offsets = [], []
                for length in lengths[first:].tolist():
                    found = free.take(length)
                    if found is None and opens:
                        found = (capacity, step << 56 | now << 32 | opened)
                        opened += 1
                    if found is None:
                        where.append(-1)
                        offsets.append(0)
                        continue
                    size, sequence = found
                    free.add(size - length, sequence)
                    where.append(sequence)
                    offsets.append(capacity - size)
                if not where:
                    continue
                where, offsets = np.array(where), np.array(offsets)
                for kind, at in ((PLACED, np.flatnonzero(where >= 0)), (PIECE, np.flatnonzero(where < 0))):
                    if len(at):
                        rest = part.take(pa.array(at + first))
                        yield _state(kind, *rest.columns[2:8], where[at], offsets[at])
        if now is not None:
            yield from close()

    columns = [F.col(c) for c in _STATE]
    rows = pieces_.select(*columns)
    if gaps is not None:
        rows = rows.unionByName(gaps.select(*columns))
    deal = F.pmod(F.col("turn"), F.lit(tasks)).alias("deal")
    rows = rows.select(deal, *columns).repartition("deal").sortWithinPartitions("deal", "kind", F.desc("length"), "id", "piece", "ids_crc32", "sequence_id")
    return rows.mapInArrow(run, STATE)


def _union(frames: list[DataFrame]) -> DataFrame | None:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def pack(
    df: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: ``id, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = written(pieces(df, vocab_path, capacity, end_id, id_col, text_col), "pieces")
    order = [F.desc("length"), F.col("id"), F.col("piece"), F.col("ids_crc32")]
    ordered = cut.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches):
        from pyspark import TaskContext

        seen = TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            length = batch.column(3).to_numpy()
            state = _state(PIECE, *batch.columns, np.arange(seen, seen + n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([*state.columns, pa.array(level_of(length, capacity))], names=[*_STATE, "level"])
            seen += n

    ranked = written(ordered.mapInArrow(number, f"{STATE}, level int"), "ranked-pieces")
    levels = {r[0]: (r[1], r[2]) for r in ranked.groupBy("level").agg(F.count(F.lit(1)), F.sum("length")).collect()}  # LEVELS rows
    tasks = lambda rows, tokens, times: max(1, -(-tokens // (SEQUENCES * capacity * times)), -(-rows // (ROWS * times)))
    done: list[DataFrame] = []
    gaps: list[tuple[DataFrame, int]] = []  # tables of gaps, and the size from which each has been read already
    step = 0

    def swept(waiting: DataFrame, held: list[DataFrame], many: int, opens: bool) -> DataFrame:
        nonlocal step
        step += 1
        out = written(sweep(waiting, _union(held), capacity, many, step, opens), "sweep")
        done.append(out.filter(F.col("kind") == PLACED))
        return out

    for level in sorted(levels):
        least = capacity // 2 ** (level + 1) + 1 if level < LEVELS - 1 else 1
        held = [t.filter((F.col("length") >= least) & (F.col("length") < upto)) for t, upto in gaps]
        gaps = [(t, min(upto, least)) for t, upto in gaps]
        many = tasks(*levels[level], 1)
        waiting = ranked.filter(F.col("level") == level)
        out = swept(waiting, held, many, opens=many == 1 or not held)
        left = out.filter(F.col("kind") == PIECE)
        free = out.filter(F.col("kind") == GAP)
        if many > 1 and held:
            rows, tokens, open_gaps = out.agg(
                F.count_if(F.col("kind") == PIECE), F.coalesce(F.sum(F.when(F.col("kind") == PIECE, F.col("length"))), F.lit(0)), F.count_if((F.col("kind") == GAP) & (F.col("length") >= least))
            ).first()
            if rows:
                again = swept(left, [free.filter(F.col("length") >= least)], max(tasks(rows, tokens, 4), -(-open_gaps // (4 * ROWS))), opens=True)
                gaps.append((free, least))
                free = again.filter(F.col("kind") == GAP)
        gaps.append((free, capacity + 1))
    columns = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = _union([t.select(*columns) for t in done])
    return out if out is not None else ranked.select(*columns)
