"""Connected components of a graph held as a table of links, without ever gathering it.

A round points every node to the least of itself and its neighbours and follows the pointers once. Links are then drawn
between what their ends point to; those within one node go, so the table shrinks by half and more each round, and the
large table of the start is read only in the first. Every round's pointers and links are written to the shared folder, so
a lost executor costs one round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

FAN = 32
"""Links that a node of a spanning tree has to nodes below it; bounds the degree in the table of links."""


def tree_links(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one component: a tree of bounded degree and small depth."""
    members = np.sort(members)
    below = np.arange(1, len(members))
    return members[(below - 1) // FAN], members[below]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tree links that connect what the given pairs connect."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    order = np.argsort(label, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], np.diff(label[order]) != 0]))
    parts = [tree_links(m) for m in np.split(nodes[order], starts[1:])]
    return np.concatenate([p for p, _ in parts]), np.concatenate([q for _, q in parts])


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node in ``links (a long, b long)``; root is the least node of its component."""
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = written(links.filter("a <> b").select(*ends("a", "b")).distinct(), "links")
    roots = None
    while True:
        sides = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hooks = written(sides.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("p")), "hooks")
        up = written(hooks.join(hooks.select(F.col("node").alias("p"), F.col("p").alias("q")), "p").select("node", F.col("q").alias("p")), "pointers")
        rest = edges.join(up.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        rest = written(rest.filter("pa <> pb").select(*ends("pa", "pb")).distinct(), "links")
        if roots is None:
            new = up.withColumnRenamed("p", "root")
        else:
            moved = roots.join(up.withColumnRenamed("node", "root"), "root", "left")
            new = written(moved.select("node", F.coalesce("p", "root").alias("root")), "roots")
            dropped(roots)
            dropped(up)
        dropped(edges)
        dropped(hooks)
        # the first round's pointers are its roots, under the name of the table that they lie in
        new._sluice_path = getattr(new, "_sluice_path", None) or up._sluice_path
        roots, edges = new, rest
        if edges.isEmpty():
            dropped(edges)
            return roots.select("node", "root")
