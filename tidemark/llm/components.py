"""Connected components: each partition makes its edges stars, and large-star steps, a few shuffles over the edges each, join
the partitions' stars. Few plans matter: the driver keeps threads, classes and strings of each for a while. So do few files:
each task of a shuffle leaves some, and each of a checkpoint, however few its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_of, cut, give_back

#: Rows of one key that a shuffle puts into one task as they are. A key with more, and with over a ten-thousandth of all
#: rows, is a hub: its one row of the other side is broadcast, so there are 10,000 hubs at most.
FEW, HUBS = 64, 10_000
#: Edges that a task makes stars of at once; what has fewer for each partition is put into fewer partitions.
HELD = 250_000


def join_hubs(rows: DataFrame, per_key: DataFrame, key: str, total: int, few: int = FEW) -> DataFrame:
    """``rows`` joined with the one row that each key has in ``per_key`` (key, n, ...), where n is the number of ``rows``
    with that key and ``total`` that of all rows. Rows of hubs stay where they are; ``n`` goes. A null key joins nothing."""
    bar = max(few, total // HUBS)
    hubs = F.broadcast(per_key.where(F.col("n") > bar))
    usual = rows.join(hubs.select(key), key, "left_anti").join(per_key.where(F.col("n") <= bar), key)
    return usual.unionByName(rows.join(hubs, key)).drop("n")


def gathered(rows: DataFrame) -> DataFrame:
    """Checkpointed rows of a few numbers, in no more partitions than hold HELD of them each."""
    return rows.coalesce(max(1, -(-rows.count() // HELD)))


def _closest(pairs: DataFrame) -> DataFrame:
    """(a, n, m): the number of a's partners and the least of a and them. Aggregated before the shuffle, so a hub is no hot key here."""
    return cut(pairs.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("m")).select("a", "n", F.least("a", "m").alias("m")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return join_hubs(both, _closest(both), "a", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of these edges to the least node that they connect it to, itself left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root, before = np.arange(len(nodes)), None
    while before is None or (root != before).any():
        before = root.copy()
        least = np.minimum(root[x], root[y])
        for side in (x, y):
            np.minimum.at(root, before[side], least)
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition, HELD at a time, as stars: connected as before, no node more than once the greater one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def stars() -> pa.RecordBatch:
            a, b = _stars(*(np.concatenate([x.column(k).to_numpy() for x in held]) for k in (0, 1)))
            return batch_of(a=pa.array(a), b=pa.array(b))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield stars()
                held, size = [], 0
        if size:
            yield stars()
        held = batch = None
        give_back()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _shape(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (a, b), a > b, there are, and whether they are stars: no a twice, none that is a b too. A hub is summed
    up before the shuffle."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    total, loose = nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 1) | (F.col("ups") == 1) & (F.col("least") == 0))).first()
    return total, not loose


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (a, b): root is the least node that it reaches.

    Every step is checkpointed in the shared folder; the loop ends when all edges are stars, which HELD edges are at once. No
    edges: no rows. A node is the greater one of a few edges for each partition at most once the partitions have made stars,
    so no task gets a hub.
    """
    current = cut(_contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))))
    while True:
        total = current.count()
        current = cut(_contracted(current.coalesce(max(1, -(-total // HELD)))))
        if total <= HELD:
            break
        total, done = _shape(current)
        if done:
            break
        # All edges of a node as the greater one meet, so that stars of them are small-star steps and more.
        current = cut(_contracted(cut(_large_star(current, total)).repartition("a")))
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
