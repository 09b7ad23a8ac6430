"""Many terms in many texts at once: one automaton over all terms, walked once over each text, in Arrow batches.

A chain of ``contains`` or a join on them reads each text once for every term; the automaton reads it once for all. Terms
are cut into blocks of bounded size, so a broadcast automaton never grows past MOST_TERMS terms however many there are."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_TERMS = 100_000
"""Terms of one automaton."""


def automaton(terms: Sequence[str]):
    """Automaton that gives the places of the terms in ``terms``; empty ones match nothing."""
    import ahocorasick

    machine, places = ahocorasick.Automaton(), {}
    for k, term in enumerate(terms):
        if term:
            places.setdefault(term, []).append(k)
    for term, at in places.items():
        machine.add_word(term, (len(term), at))
    if places:
        machine.make_automaton()
    return machine, bool(places)


def hits_in(machine, some: bool, low: str | None, whole: bool = False) -> list[int]:
    """Places of the terms that a text holds, ascending; ``whole``: not inside longer runs of letters and digits."""
    if not low or not some:
        return []
    found: set[int] = set()
    edge = lambda k: not (0 <= k < len(low) and low[k].isascii() and low[k].isalnum())
    for end, (size, at) in machine.iter(low):
        if at[0] not in found and (not whole or (edge(end - size) and edge(end + 1))):
            found.update(at)
    return sorted(found)


def with_hits(df: DataFrame, text_col: str, terms: Sequence[str], name: str = "hits", whole: bool = False) -> DataFrame:
    """``df`` with the places of the lower-case ``terms`` that its lower-case text holds, as an array of ints.

    Only the text goes to Python; the other columns, of which some may be as long, stay in Spark."""
    shared = df.sparkSession.sparkContext.broadcast(list(terms))
    held: dict[str, tuple] = {}

    @F.arrow_udf("array<int>")
    def found(texts: pa.Array) -> pa.Array:
        if "machine" not in held:
            held["machine"] = automaton(shared.value)
        offsets, values = [0], []
        for lo in range(0, len(texts), 256):
            for t in texts.slice(lo, 256).to_pylist():
                values += hits_in(*held["machine"], t, whole)
                offsets.append(len(values))
        return pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values, type=pa.int32()))

    return df.withColumn(name, found(F.col(text_col)))
