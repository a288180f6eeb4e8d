"""Connected components by alternating large-star and small-star rounds; every round is a written table, no lineage grows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise


def connecting(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which of the edges p, q join two trees; root has each node's tree and is kept up to date."""
    used = []
    while True:
        a, b = root[p], root[q]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = np.flatnonzero(lo < hi)
        if not len(apart):
            return np.concatenate(used) if used else np.zeros(0, np.int64)
        top, first = np.unique(hi[apart], return_index=True)  # each tree joins one of smaller number: no cycles
        use = apart[first]
        used.append(use)
        root_of = np.arange(len(root))
        root_of[top] = lo[use]
        while not np.array_equal(up := root_of[root_of], root_of):
            root_of = up
        root[:] = root_of[root]


def _forest(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Of each `most` edges (a, b) at most those that connect nodes not yet connected, and loops; they have the same components."""
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        edges = pa.Table.from_batches(held)
        held.clear()
        ends = pa.concat_arrays([*edges["a"].chunks, *edges["b"].chunks]).dictionary_encode()
        a, b = ends.indices.to_numpy().reshape(2, -1)
        loops = np.flatnonzero(a == b)
        keep = np.concatenate([connecting(np.arange(len(ends.dictionary)), a, b), loops[np.unique(a[loops], return_index=True)[1]]])
        return pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(x[keep])) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(len(x) for x in held) >= most:
            yield flush()
    if held:
        yield flush()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node that can be reached. Nodes are those of the edges; self-loops are allowed, rows with
    a null end are ignored. Tasks first leave a forest of their edges. In the rounds a node's neighbours never
    meet in one task: each only takes a minimum per node, which Spark pre-aggregates."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition("a")
    e = materialise(e.mapInArrow(_forest, e.schema), "cc-edges")
    nodes = e.select("a").union(e.select("b")).distinct()
    e = e.where("a <> b")
    nodes = materialise(nodes, "cc-nodes")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "cc-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = materialise(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    labels = e.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.join(labels, "a", "left").select(F.col("a").alias("node"), F.coalesce("m", "a").alias("component"))
