"""Chosen-path set similarity join: documents whose sets of word shingles have at least a given Jaccard similarity.

A set is told by TOKENS minwise tokens: two sets share a token with a probability of their similarity. A tree sorts
documents by paths of chosen tokens: at a node, its own name chooses one token place or two (1 / similarity on average, so
that an alike pair is expected to go on together), and a document goes on to the child named by its token there. A path
depends on names and tokens only, so it is walked for each document by itself, a level is one count of names, and no
document meets another before a node is small. Nodes of up to LEAF documents are compared exhaustively on bytes of their
tokens. Nodes that stay large because their documents are alike (they keep most of two levels above) aren't split for
ever: all of a node are compared with one of them, and later only those of other components with all, dealt in blocks.
Independent trees are repeated until a pair is met with TARGET probability.

Candidates are then tested on the whole sets. Each document is verified against the candidate most alike and against its
reference: of its candidates and itself the one that most documents are most alike to, or that one's own reference. Verified
links make components.
The difference of a set to its reference, what it has more and what it has less, stands for the whole set: two documents of
one reference are compared exactly by their differences, in the nodes where they meet, as one product of small matrices,
and only links leave the task. What remains, candidates of different references and components, is verified in pairs, in
rounds: for each document and component the most alike not tested yet, then MORE times as many, until none is left. No
unverified link joins anything, and no link between different texts is lost that a tree has met.

Cases: null and empty texts, and texts without words, have no set: linked with nothing, ``n_shingles`` 0; a text of fewer
words than a shingle is one shingle; texts of equal sets are one member from the start, however many; rows that repeat an
id are documents each; null ids never name a component, and a component of null ids only has a null name; texts of any
length are read whole; other columns, clashing names included, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_map, digest_place, dropped, in_map, map_size, written
from .components import components, spanning
from .exactdedup import _batches
from .simhash import shingle_digests

TOKENS = 128
LEAF = 256
"""Documents of a node up to which it is compared exhaustively."""
DEPTH = 24
"""Levels after which a node counts as one of alike documents whatever it keeps."""
ALIKE = 0.7
"""Share of the documents two levels above from which a large node counts as one of alike documents."""
TARGET, MEETS = 0.99999, 3
"""Probability that a pair of just the similarity sought meets in some tree, if its nodes are small after MEETS levels."""
ERRORS = 5
"""Standard errors that a candidate's estimated similarity may lie under the one sought."""
HOPS = 2
"""Times that a document may take over the reference of another."""
MORE = 16
"""Factor by which a round of pairs grows."""
STEP = 16_384
"""Rows of whole small nodes that a task compares at once."""

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Hash of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TIMES = mixed(np.arange(1, TOKENS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def minwise(hashes: np.ndarray) -> np.ndarray:
    """TOKENS 32-bit tokens of a set of 64-bit hashes."""
    low = np.full(TOKENS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), 2048):
        np.minimum(low, (hashes[lo : lo + 2048, None] * _TIMES[None, :]).min(axis=0), out=low)
    return (mixed(low) >> _U(32)).astype(np.uint32)


def shingles(data: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(data, width)), dtype=">u8").astype(np.uint64))


def trees_for(least: float, target: float = TARGET, levels: int = MEETS) -> int:
    """Trees in which a pair of similarity ``least`` meets with ``target`` probability at ``levels`` levels."""
    two, miss = 1 / least - 1, 0.0
    for _ in range(levels):
        step = 1 - least * (1 - miss)
        miss = (1 - two) * step + two * step * step
    return math.ceil(math.log(1 - target) / math.log(miss))


def prints(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, key, text_sha256, tokens`` of every row; ``key`` is a digest of the set."""

    def run(batches):
        for batch in batches:
            for held in _batches(batch):
                sets = [shingles(t, width) for _, t in held]
                columns = [
                    pa.array([i for i, _ in held], type=pa.int64()),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([hashlib.sha256(s.tobytes()).digest()[:16] for s in sets], type=pa.binary()),
                    pa.array([hashlib.sha256(t).hexdigest() for _, t in held], type=pa.string()),
                    pa.array([minwise(s).tobytes() if len(s) else None for s in sets], type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "key", "text_sha256", "tokens"])

    source = df.select(df[id_col].cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n long, key binary, text_sha256 string, tokens binary")


def children(tokens: np.ndarray, rows: np.ndarray, names: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``rows``) and names of the children of nodes: each node chooses one token place or two."""
    first = mixed(names ^ _U(0xA5A5)) % _U(TOKENS)
    second = mixed(names ^ _U(0x5A5A)) % _U(TOKENS - 1)
    second += second >= first
    share = _U(int((1 / least - 1) * 2**64)) if least > 0.5 else np.iinfo(np.uint64).max
    also = np.flatnonzero(mixed(names ^ _U(0xC3C3)) < share)
    at = np.concatenate([np.arange(len(rows)), also])
    place = np.concatenate([first, second[also]]).astype(np.int64)
    token = tokens[rows[at], place].astype(np.uint64)
    return at, mixed(names[at] * _U(0x9E3779B97F4A7C15) + (token << _U(7)) + place.astype(np.uint64))


def walk(nodes: DataFrame, trees: int, least: float, level: int, split: np.ndarray | None, alike: np.ndarray | None) -> DataFrame:
    """With a ``level``, ``leaf, above`` (two levels up) of each document's nodes there; else, with level 0, the nodes
    where its paths end: ``leaf, node, large``. ``split`` and ``alike`` are bit maps of large nodes."""
    maps = nodes.sparkSession.sparkContext.broadcast((split, alike))

    def run(batches):
        parted, kept = maps.value
        on = lambda m, names: in_map(m, (names % _U(8 * len(m))).astype(np.int64)) if m is not None else np.zeros(len(names), dtype=bool)
        roots = mixed(np.arange(1, trees + 1, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                node = part.column(0).to_numpy()
                tokens = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint32).reshape(-1, TOKENS)
                rows, names = np.repeat(np.arange(len(node)), trees), np.tile(roots, len(node))
                above = before = np.zeros(len(rows), dtype=np.uint64)
                for deep in range(1, DEPTH + 1):
                    at, new = children(tokens, rows, names, least)
                    rows, before, above, names = rows[at], names[at], before[at], new
                    if deep == level:
                        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(above.view(np.int64))], names=["leaf", "above"])
                        break
                    held = on(kept, names)
                    further = on(parted, names) & ~held if deep < DEPTH else np.zeros(len(names), dtype=bool)
                    if not level:
                        end = ~further
                        yield pa.RecordBatch.from_arrays([pa.array(names[end].view(np.int64)), pa.array(node[rows[end]]), pa.array(held[end])], names=["leaf", "node", "large"])
                    rows, names, before, above = rows[further], names[further], before[further], above[further]
                    if not len(rows):
                        break

    return nodes.select("node", "tokens").mapInArrow(run, "leaf long, above long" if level else "leaf long, node long, large boolean")


def _places(leaves: DataFrame, size: int) -> np.ndarray:
    """Bit map of node names; ``size`` is a power of 2, so that the remainder of a signed name is that of the unsigned one."""
    return bit_map(leaves.select(F.pmod(F.col("leaf"), F.lit(size)).alias("at")), size)


def meetings(nodes: DataFrame, trees: int, least: float) -> DataFrame:
    """``leaf, node, large``: who meets where, in nodes of two and more."""
    split = alike = None
    counts: list[DataFrame] = []
    size = 0
    for level in range(1, DEPTH + 1):
        found = walk(nodes, trees, least, level, split, alike).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("above").alias("above"))
        found = written(found.filter(F.col("n") > LEAF), "large-nodes")
        counts.append(found)
        kept = F.lit(level == DEPTH)
        if level > 2:
            found = found.join(counts[-3].select(F.col("leaf").alias("above"), F.col("n").alias("n2")), "above", "left")
            kept = kept | F.coalesce(F.col("n") >= ALIKE * F.col("n2"), F.lit(False))
        found = found.withColumn("kept", kept)
        sizes = dict(found.groupBy("kept").count().collect())  # two rows at most
        if not sizes:
            break
        size = size or map_size(4 * sum(sizes.values()))  # further levels go into the same map: a full one only lets more paths be walked
        for which in sizes:
            new = _places(found.filter(F.col("kept") == which), size)
            if which:
                alike = new if alike is None else alike | new
            else:
                split = new if split is None else split | new
    rows = written(walk(nodes, trees, least, 0, split, alike), "path-ends")
    for c in counts:
        dropped(c)

    def shared(batches):
        last, first = None, None  # the last row: its document is given out once another of its node follows
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, node = (batch.column(k).to_numpy() for k in (0, 1))
            same = np.concatenate([[leaf[0] == last], leaf[1:] == leaf[:-1]])
            out = same.copy()
            out[:-1] |= same[1:]
            names, members = leaf[out], node[out]
            if same[0] and first is not None:
                names, members = np.append(names, last), np.append(members, first)
            last, first = leaf[-1], None if same[-1] else node[-1]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(members)], names=["leaf", "node"])

    small = rows.filter(~F.col("large")).select("leaf", "node").repartition("leaf").sortWithinPartitions("leaf").mapInArrow(shared, "leaf long, node long")
    return written(small.withColumn("large", F.lit(False)).union(rows.filter("large").select("leaf", "node", "large")), "meetings")


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of token bytes."""
    return ((one == other).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def alike_enough(like: np.ndarray, n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of these sizes and this estimated similarity may have similarity ``least``."""
    loose = least - ERRORS * math.sqrt(least * (1 - least) / TOKENS)
    return (like >= loose) & (np.minimum(n, m) >= (least - 1e-9) * np.maximum(n, m))


PAIRS = "x long, y long, like double, cut boolean"


def _pairs(x: np.ndarray, y: np.ndarray, like: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()), pa.array(y, type=pa.int64()), pa.array(like, type=pa.float64()), pa.array(cut, type=pa.bool_())], names=["x", "y", "like", "cut"])


def best_of(x: np.ndarray, y: np.ndarray, like: np.ndarray, part: np.ndarray, most: int) -> pa.RecordBatch:
    """For each document ``x`` and component ``part`` the ``most`` candidates ``y`` of the highest ``like``, of equals the
    least; ``cut`` where there are more."""
    order = np.lexsort((y, -like, part, x))
    x, y, part, like = x[order], y[order], part[order], like[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (part[1:] != part[:-1])]) if len(x) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    rank = np.arange(len(x)) - starts[np.cumsum(new) - 1] if len(x) else x
    sizes = np.diff(np.append(starts, len(x)))
    cut = np.repeat(sizes > most, sizes)
    at = np.flatnonzero(rank < most)
    return _pairs(x[at], y[at], like[at], cut[at])


def _columns(table) -> tuple[np.ndarray, ...]:
    """leaf, node, part, n and the token bytes of rows."""
    numbers = [table.column(k).to_numpy() for k in range(4)]
    return *numbers, np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)


def _whole_leaves(batches, columns, step: int = STEP):
    """Columns of rows sorted by leaf, in groups of whole leaves of about ``step`` rows."""
    held, size = [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            held.append(columns(batch.slice(lo, step)))
            size += len(held[-1][0])
            if size >= step:
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))  # the last node may go on
                if cut:
                    yield [c[:cut] for c in cols]
                held, size = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _met(leaf, part, n, data, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of candidate pairs of different ``part`` within leaves, and their likeness."""
    left, right, likes = [], [], []
    at, shift = np.arange(len(leaf)), 1
    while True:
        at = at[at + shift < len(leaf)]
        at = at[leaf[at] == leaf[at + shift]]
        if not len(at):
            break
        for lo in range(0, len(at), 1 << 16):
            a = at[lo : lo + (1 << 16)]
            a = a[part[a] != part[a + shift]]
            like = likeness(data[a], data[a + shift])
            ok = alike_enough(like, n[a], n[a + shift], least)
            left.append(a[ok])
            right.append(a[ok] + shift)
            likes.append(like[ok])
        shift += 1
    if not left:
        return at, at, np.zeros(0)
    return np.concatenate(left), np.concatenate(right), np.concatenate(likes)


def small_candidates(members: DataFrame, least: float, most: int) -> DataFrame:
    """Candidates ``x, y`` of different components within small nodes (``leaf, node, part, n, bytes``): the ``most`` for
    each document and component, or with 0 the one for each document."""

    def run(batches):
        for leaf, node, part, n, data in _whole_leaves(batches, _columns):
            i, j, like = _met(leaf, part, n, data, least)
            x, y = np.concatenate([i, j]), np.concatenate([j, i])
            group = part[y] if most else np.zeros(len(y), dtype=np.int64)
            yield best_of(node[x], node[y], np.concatenate([like, like]), group, most or 1)

    return members.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, PAIRS)


def small_references(members: DataFrame, least: float) -> DataFrame:
    """``x, y, like``: for each document of small nodes, of its candidates and itself the one with the highest ``part``
    (here: how many documents are most alike to it; returned as ``like``), of equals the least."""

    def run(batches):
        for leaf, node, score, n, data in _whole_leaves(batches, _columns):
            i, j, _ = _met(leaf, np.arange(len(leaf)), n, data, least)
            own = np.arange(len(leaf))
            x, y = np.concatenate([i, j, own]), np.concatenate([j, i, own])
            yield best_of(node[x], node[y], score[y].astype(np.float64), np.zeros(len(y), dtype=np.int64), 1)

    return members.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, PAIRS)


def linked_by_difference(reference_size: int, n: np.ndarray, less: np.ndarray, items: list[np.ndarray], percent: int, upto: int | None = None) -> np.ndarray:
    """Matrix of the pairs that are alike among sets of one reference, from their differences to it; with ``upto`` only of the
    first sets with the others.

    ``items`` are the elements that a set has more or less than the reference, ``less`` the count of the latter. Of two sets,
    the common elements are the reference's that neither lacks and the others that both have."""
    m, sizes = len(n), [len(x) for x in items]
    one, other = (slice(0, m), slice(0, m)) if upto is None else (slice(0, upto), slice(upto, m))
    names, at, counts = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), sizes)
    shared = counts > 1  # what only one set has or lacks changes no pair
    number = np.cumsum(shared) - 1
    row, column = row[shared[at]], number[at[shared[at]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = reference_size - less[one, None] - less[None, other].astype(np.float64)
    width = max(1024, (1 << 22) // max(m, 1))
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, width), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += part[one] @ part[other].T
    return 100 * common >= percent * (n[one, None] + n[None, other] - common)


def small_links(members: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between documents of one reference and different components that meet in small nodes:
    ``leaf, reference, node, part, n, size, less, items``."""

    def columns(batch):
        items = batch.column(7)
        held = np.empty(batch.num_rows, dtype=object)
        for k in range(batch.num_rows):
            held[k] = items[k].values.to_numpy() if items[k].is_valid else np.zeros(0, dtype=np.int64)
        return *(batch.column(k).to_numpy() for k in range(7)), held

    def run(batches):
        for leaf, reference, node, part, n, size, less, items in _whole_leaves(batches, columns, 2048):
            cuts = np.flatnonzero(np.concatenate([[True], (leaf[1:] != leaf[:-1]) | (reference[1:] != reference[:-1]), [True]]))
            left, right = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo > 1 and (part[lo:hi] != part[lo]).any():
                    hit = linked_by_difference(int(size[lo]), n[lo:hi], less[lo:hi], list(items[lo:hi]), percent)
                    a, b = np.nonzero(np.triu(hit & (part[lo:hi, None] != part[None, lo:hi]), 1))
                    left.append(node[lo + a])
                    right.append(node[lo + b])
            if left:
                a, b = spanning(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    columns_ = ["leaf", "reference", "node", "part", "n", "size", "less", "items"]
    return members.select(*columns_).repartition("leaf").sortWithinPartitions("leaf", "reference").mapInArrow(run, "a long, b long")


def large_candidates(members: DataFrame, least: float, most: int, percent: int) -> DataFrame:
    """The same for large nodes: those outside a node's largest component are compared with all of it, in blocks; pairs of one
    reference exactly, by their differences (``like`` 2: a link), in the first round only."""
    counts = written(members.groupBy("leaf", "part").agg(F.count(F.lit(1)).alias("c")), "large-parts")
    top = counts.groupBy("leaf").agg(F.max_by("part", F.struct("c", "part")).alias("top"), F.sum("c").alias("all"), F.max("c").alias("c"))
    top = top.filter(F.col("all") > F.col("c")).select("leaf", "top", F.ceil(F.col("all") / (16 * LEAF)).alias("salts"), F.ceil((F.col("all") - F.col("c")) / LEAF).alias("blocks"))
    mixed_ = written(members.join(top, "leaf"), "large-members")
    deal = F.xxhash64("node")
    rows = mixed_.withColumn("salt", F.pmod(deal, F.col("salts"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asked = mixed_.filter("part <> top").withColumn("block", F.pmod(deal, F.col("blocks"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    columns = ["leaf", "node", "part", "n", "bytes", "reference", "size", "less", "items", "salt", "block"]

    def run(theirs: pa.Table, mine: pa.Table) -> pa.Table:
        _, node, part, n, data = _columns(theirs)
        _, own, own_part, own_n, own_data = _columns(mine)
        reference, own_reference = theirs["reference"].to_numpy(), mine["reference"].to_numpy()
        out = []
        for z, p, m, bits, r in zip(own, own_part, own_n, own_data, own_reference, strict=True):
            hit = np.flatnonzero((part != p) & (reference != r))
            like = likeness(data[hit], bits[None, :])
            ok = alike_enough(like, n[hit], m, least)
            hit, like = hit[ok], like[ok]
            out.append(best_of(np.full(len(hit), z), node[hit], like, part[hit], most))
        for r in np.unique(own_reference) if most == 1 else ():
            i, j = np.flatnonzero(own_reference == r), np.flatnonzero(reference == r)
            if not len(j):
                continue
            items = [np.array(x["items"][k].as_py(), dtype=np.int64) for x, at in ((mine, i), (theirs, j)) for k in at.tolist()]
            less = np.concatenate([mine["less"].to_numpy()[i], theirs["less"].to_numpy()[j]])
            hit = linked_by_difference(int(mine["size"][int(i[0])].as_py()), np.concatenate([own_n[i], n[j]]), less, items, percent, len(i))
            a, b = np.nonzero(hit & (own_part[i][:, None] != part[j][None, :]))
            x, y = spanning(own[i][a], node[j][b])
            out.append(_pairs(x, y, np.full(len(x), 2.0), np.zeros(len(x), dtype=bool)))
        return pa.Table.from_batches(out) if out else pa.Table.from_batches([_pairs(node[:0], node[:0], np.zeros(0), np.zeros(0, dtype=bool))])

    keys = ["leaf", "salt", "block"]
    return rows.select(*columns).groupBy(*keys).cogroup(asked.select(*columns).groupBy(*keys)).applyInArrow(run, PAIRS)


def _sets(df: DataFrame, wanted: DataFrame, width: int, text_col: str) -> DataFrame:
    """``node, items`` of the ``wanted (node, text_sha256)``. Texts are read where they lie; a bit map of the digests lets
    the others pass by, and a task gives each set once."""
    size = map_size(wanted.count())
    shared = df.sparkSession.sparkContext.broadcast(bit_map(wanted.select(digest_place(F.col("text_sha256"), size).alias("at")), size))

    def run(batches):
        on, given = shared.value, set()
        for batch in batches:
            for part in _batches(batch):
                keys = [hashlib.sha256(t).hexdigest() for _, t in part]
                hit = np.flatnonzero(in_map(on, np.array([int(k[:8], 16) % (8 * len(on)) for k in keys], dtype=np.int64))).tolist()
                hit = [i for i in hit if keys[i] not in given and not given.add(keys[i])]
                if hit:
                    sets = [shingles(part[i][1], width).view(np.int64) for i in hit]
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in hit]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets)))], names=["text_sha256", "items"])

    source = df.select(F.lit(None).cast("long").alias("id"), df[text_col].cast("string").alias("text"))
    held = source.mapInArrow(run, "text_sha256 string, items array<bigint>").join(wanted, "text_sha256")
    return held.groupBy("node").agg(F.first("items").alias("items"))


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs (a, b, ...)`` with the items of both as ``as`` and ``bs`` and how many they share."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = sets.join(ends, "node", "left_semi")  # only these sets are shuffled
    side = lambda c: own.select(F.col("node").alias(c), F.col("items").alias(f"{c}s"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.withColumn("common", F.size(F.array_intersect("as", "bs")).cast("long"))


def _is_link(percent: int):
    return 100 * F.col("common") >= percent * (F.size("as") + F.size("bs") - F.col("common"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs (a, b)`` whose whole sets have 100 * intersection >= percent * union."""
    return _with_sets(pairs, sets).filter(_is_link(percent)).select("a", "b")


def similar_groups(df: DataFrame, width: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row: the smallest id reachable over links of ``percent`` similarity."""
    least = percent / 100
    rows = written(prints(df, width, id_col, text_col), "path-prints")
    one = lambda c: F.min(c).alias(c)
    nodes = rows.filter("n > 0").groupBy("key").agg(F.min("id").alias("low"), one("n"), one("text_sha256"), one("tokens"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "path-nodes")
    met = meetings(nodes, trees_for(least), least)

    def low_bytes(batches):
        for batch in batches:
            data = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1)[:, ::4]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in data], type=pa.binary())], names=["node", "n", "bytes"])

    sketches = nodes.select("node", "n", "tokens").mapInArrow(low_bytes, "node long, n long, bytes binary")
    held = written(met.join(sketches, "node").select("leaf", "node", "n", "bytes", "large"), "path-members")
    dropped(met)
    any_large = not held.filter("large").isEmpty()
    shape = ["leaf", "node", "part", "n", "bytes"]

    def first_of_large() -> DataFrame:
        """Each document of a large node with the one of it that has the most of its common token bytes, and back (``cut``)."""
        large = held.filter("large")
        sample = large.withColumn("turn", F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("node"), "node"))).filter(F.col("turn") <= LEAF)

        def common(table: pa.Table) -> pa.Table:
            data = np.frombuffer(b"".join(table["bytes"].to_pylist()), dtype=np.uint8).reshape(-1, TOKENS)
            mode = np.array([np.bincount(data[:, k], minlength=256).argmax() for k in range(TOKENS)], dtype=np.uint8)
            return pa.table({"leaf": table["leaf"].slice(0, 1), "mode": pa.array([mode.tobytes()], type=pa.binary())})

        modes = sample.select("leaf", "bytes").groupBy("leaf").applyInArrow(common, "leaf long, mode binary")

        def near(batches):
            for batch in batches:
                one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, TOKENS) for k in (3, 4))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array((one == other).sum(axis=1).astype(np.int64))], names=["leaf", "node", "n", "bytes", "same"])

        near_mode = large.join(modes, "leaf").select("leaf", "node", "n", "bytes", "mode").mapInArrow(near, "leaf long, node long, n long, bytes binary, same long")
        first = near_mode.groupBy("leaf").agg(F.max_by(F.struct("node", "n", "bytes"), F.struct("same", -F.col("node"))).alias("f"))

        def run(batches):
            for batch in batches:
                data = [np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, TOKENS) for k in (2, 5)]
                x, n, y, m = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
                like = likeness(*data)
                at = np.flatnonzero((x != y) & alike_enough(like, n, m, least))
                yield _pairs(np.concatenate([x[at], y[at]]), np.concatenate([y[at], x[at]]), np.concatenate([like[at], like[at]]), np.arange(2 * len(at)) >= len(at))

        both = large.join(first, "leaf").select("node", "n", "bytes", F.col("f.node").alias("y"), F.col("f.n").alias("m"), F.col("f.bytes").alias("other"))
        return both.mapInArrow(run, PAIRS)

    # each document's most alike candidate, and its reference
    met_by = written(_joined(small_candidates(members_of(held, None, "node").filter(~F.col("large")).select(*shape), least, 0), first_of_large() if any_large else None), "path-candidates")
    best = written(met_by.groupBy("x").agg(F.max_by("y", F.struct("like", -F.col("y"))).alias("y")), "path-best")
    dropped(met_by)
    if best.isEmpty():
        named = nodes.select("key", F.col("low").alias("component_id"))
        return _named(rows, named)
    found = best.select(F.col("x").alias("node")).union(best.select("y")).distinct()
    busy = written(held.join(found, "node", "left_semi"), "path-busy")
    score = best.groupBy(F.col("y").alias("node")).agg(F.count(F.lit(1)).alias("part"))
    scored = busy.join(score, "node", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    owner = small_references(scored.filter(~F.col("large")).select(*shape), least).select("x", "y", "like")
    if any_large:
        owner = owner.union(first_of_large().filter(~F.col("cut")).select("x", "y", F.lit(float(1 << 40)).alias("like")))
    owner = written(owner.groupBy("x").agg(F.max_by("y", F.struct("like", -F.col("y"))).alias("y")), "path-references")
    scores = scored.select(F.col("node").alias("z"), "part").distinct()
    for _ in range(HOPS):  # a document takes the reference of its reference, or of its most alike, if more are most alike to that
        next_ = owner.union(best.select("x", "y")).join(owner.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", "z").union(owner)
        next_ = next_.toDF("x", "z").join(scores, "z")
        owner = written(next_.groupBy("x").agg(F.max_by("z", F.struct("part", -F.col("z"))).alias("y")), "path-references")
    both = best.select(F.col("x").alias("b"), F.col("y").alias("a"), F.lit(False).alias("own")).union(owner.filter("x <> y").select("x", "y", F.lit(True)))
    both = written(both.groupBy("a", "b").agg(F.max("own").alias("own")), "path-first")
    sets = _sets_of(df, both, None, nodes, width, text_col)
    more, less = F.array_except("bs", "as"), F.array_except("as", "bs")
    first = _with_sets(both, sets).select("a", "b", _is_link(percent).alias("link"), F.size("as").cast("long").alias("size"), F.size("bs").cast("long").alias("n"),
        F.when(F.col("own"), F.size("as") - F.col("common")).alias("less"), F.when(F.col("own"), F.concat(more, less)).alias("items"))
    first = written(first, "path-differences")
    links = first.filter("link").select("a", "b")
    roots = roots_of(links)
    none = F.array().cast("array<bigint>")
    apart = first.filter("less IS NOT NULL").select(F.col("b").alias("node"), F.col("a").alias("reference"), "size", "less", "items")
    itself = owner.filter("x = y").select(F.col("x").alias("node")).join(nodes.select("node", "n"), "node").select("node", F.col("node").alias("reference"), F.col("n").alias("size"), F.lit(0).cast("long").alias("less"), none.alias("items"))
    apart = written(apart.union(itself), "path-apart")

    # exact comparison of what has one reference
    members = written(_mixed(members_of(busy, roots, "node")), "path-mixed")
    more_links = small_links(members.filter(~F.col("large")).join(apart, "node"), percent)
    links = written(links.union(more_links), "path-links")
    roots = roots_of(links)

    # pairs of different references, in rounds
    tested = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    most = 1
    while True:
        members = written(_mixed(members_of(busy, roots, "node")), "path-mixed")
        small = members.filter(~F.col("large")).join(apart.select("node", "reference"), "node", "left")
        found = small_candidates_apart(small, least, most)
        if any_large:
            large = members.filter("large").join(apart, "node", "left").withColumns({"reference": F.coalesce("reference", "node"), "size": F.coalesce("size", "n"), "less": F.coalesce("less", F.lit(0).cast("long")), "items": F.coalesce("items", none)})
            found = found.union(large_candidates(large, least, most, percent))
        found = written(found, "path-candidates")
        if any_large and most == 1:
            links = written(links.union(found.filter("like > 1.5").select("x", "y")), "path-links")
            roots = roots_of(links)
        pairs = found.filter("like <= 1.5").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "path-pairs")
        dropped(members)
        if pairs.isEmpty():
            if found.filter("cut").isEmpty():
                break
            dropped(found)
            most *= MORE
            continue
        sets = _sets_of(df, pairs, sets, nodes, width, text_col)
        good = written(verified(pairs, sets, percent), "path-links")
        tested = tested.union(pairs)
        if not good.isEmpty():
            links = links.union(good)
            roots = roots_of(links)
        dropped(found)
        most *= MORE
    named = nodes.select("key", "low", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named.select("key", "low", "root"), "path-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return _named(rows, named.join(lowest, "root").select("key", "component_id"))


FEW = 1 << 20
"""Links up to which one task finds their components (16 MB); more are contracted in rounds over the cluster, to the same
components."""


def roots_of(links: DataFrame) -> DataFrame:
    """``node, root`` of the nodes in ``links (a, b)``, a written table; root is the least node of a component."""
    if links.count() > FEW:
        return components(links)

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[: len(a)], at[len(a) :]
        root = np.arange(len(node))
        while True:
            new = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], names=["node", "root"])

    return written(links.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"), "path-roots")


def _joined(one: DataFrame, other: DataFrame | None) -> DataFrame:
    return one if other is None else one.union(other)


def members_of(held: DataFrame, roots: DataFrame | None, alone: str) -> DataFrame:
    """Members of nodes with their component as ``part``."""
    if roots is None:
        return held.withColumn("part", F.col(alone))
    return held.join(roots.withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", alone))


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the nodes where several components meet."""
    several = members.groupBy("leaf").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi").select("leaf")
    return members.join(several, "leaf", "left_semi")


def small_candidates_apart(members: DataFrame, least: float, most: int) -> DataFrame:
    """Candidates of different components in small nodes whose references differ; those of one were compared exactly."""

    def columns(batch):
        return *_columns(batch), batch.column(5).to_numpy(zero_copy_only=False)

    def run(batches):
        for leaf, node, part, n, data, reference in _whole_leaves(batches, columns):
            i, j, like = _met(leaf, part, n, data, least)
            apart = reference[i] != reference[j]
            i, j, like = i[apart], j[apart], like[apart]
            x, y = np.concatenate([i, j]), np.concatenate([j, i])
            yield best_of(node[x], node[y], np.concatenate([like, like]), part[y], most)

    own = members.select("leaf", "node", "part", "n", "bytes", F.coalesce("reference", "node").alias("reference"))
    return own.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, PAIRS)


def _sets_of(df: DataFrame, pairs: DataFrame, held: DataFrame | None, nodes: DataFrame, width: int, text_col: str) -> DataFrame:
    """Sets of all ends of pairs: those ``held`` and those that are missing there."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if held is not None:
        ends = ends.join(held.select("node"), "node", "left_anti")
    wanted = written(ends.join(nodes.select("node", "text_sha256"), "node"), "path-wanted")
    if wanted.isEmpty():
        return held
    new = written(_sets(df, wanted, width, text_col), "path-sets")
    return new if held is None else held.unionByName(new)


def _named(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Every row with the component of its set; without a set it is its own."""
    linked = rows.select("id", "n", "key").filter("n > 0").join(written(named, "path-components"), "key").select("id", "n", "component_id")
    out = linked.union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select("id", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
