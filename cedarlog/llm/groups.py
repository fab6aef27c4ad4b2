"""Connected groups of an edge list, and reading sorted rows group by group inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cedarlog.session import materialize

#: Edges that a task contracts at a time.
EDGES_AT_A_TIME = 500_000
STARS = "a long, b long"

class Forest:
    """Union-find over any hashable nodes; the smallest node of a tree is its root."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x, y) -> bool:
        """Whether x and y were apart."""
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each connected group of some edges as a star around its smallest node."""

    def stars(forest: Forest) -> pd.DataFrame:
        nodes = list(forest.parent)
        return pd.DataFrame({"a": nodes, "b": [forest.find(x) for x in nodes]}, dtype="int64")

    forest, n = Forest(), 0
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            forest.join(a, b)
        n += len(batch)
        if n >= EDGES_AT_A_TIME:
            yield stars(forest)
            forest, n = Forest(), 0
    yield stars(forest)

def components(edges: DataFrame) -> DataFrame:
    """(a, root) for each node ``a`` of ``edges`` (a, b) that is not itself the root.

    The root is the smallest node of the group. Edges are contracted inside tasks,
    then large-star and small-star rounds alternate until nothing changes. Each
    round's edges are written to the shared folder, so a lost executor costs one task.
    """
    now = materialize(edges.mapInPandas(_contract, STARS), "group-edges")
    before = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        hop = large.join(parent, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = hop.unionByName(parent.select("a", F.col("m").alias("b"))).distinct()
        now = materialize(small, "group-edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select("a", F.col("b").alias("root"))
        before = mark

def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, from rows sorted by their first ``keys`` (integer) columns."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:], strict=False):
            key = tuple(int(c[lo]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)

def hub_blocks(members: DataFrame, block_rows: int) -> DataFrame:
    """(hub, i, j, key) from distinct (hub, key): which pairs of blocks of a hub's group a key takes part in.

    A group of up to ``block_rows`` keys is one block. A larger one is dealt into
    blocks, and each pair of blocks becomes a task's work, so no task holds more
    than two blocks however large the group is.
    """
    sizes = members.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "hub").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return dealt.select("hub", "key", "own", other.alias("other")).select(
        "hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "own"
    )

__all__ = ["Forest", "components", "hub_blocks", "sorted_groups"]
