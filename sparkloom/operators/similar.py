"""Similar entities: name search and alias detection within types."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import jaro_winkler, jaro_winkler_value
from sparkloom.operators.ranking import cosine


def _features(names: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths; a 0/1 column for each (character, nth time it occurs); the first four characters (0: none)."""
    length, head = np.array([len(x) for x in names], np.int64), np.zeros((len(names), 4), np.int64)
    column, rows, cols = {}, [], []
    for i, x in enumerate(names):
        seen = {}
        for k, c in enumerate(x):
            seen[c] = seen.get(c, 0) + 1
            rows.append(i)
            cols.append(column.setdefault((c, seen[c]), len(column)))
            if k < 4:
                head[i, k] = ord(c) + 1
    counts = np.zeros((len(names), len(column)), np.float32)
    counts[rows, cols] = 1
    return length, counts, head


def _may_reach(threshold: float, length: np.ndarray, counts: np.ndarray, head: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left x right: whether Jaro-Winkler can reach the threshold. At most the characters in common match, the common prefix is known, and no
    swaps are assumed: an upper bound, so no pair that reaches the threshold is lost."""
    m = counts[left] @ counts[right].T
    jaro = (m / np.maximum(length[left], 1)[:, None] + m / np.maximum(length[right], 1)[None, :] + 1) / 3
    same, prefix = np.ones(m.shape, bool), np.zeros(m.shape)
    for k in range(4):
        same &= (head[left, k][:, None] == head[right, k][None, :]) & (head[left, k] > 0)[:, None]
        prefix += same
    return np.where(m > 0, jaro + 0.1 * prefix * (1 - jaro), 0) >= threshold - 1e-6


def _unit_vectors(column: pa.ChunkedArray) -> np.ndarray | None:
    """Vectors of length 1, or 0 for null and zero vectors; None where all are null. Sizes that differ are an error."""
    vectors = column.to_pylist()
    size = {len(v) for v in vectors if v is not None}
    if not size:
        return None
    if len(size) > 1:
        raise ValueError("vectors of different sizes")
    out = np.array([[0.0] * min(size) if v is None else v for v in vectors], np.float64)
    return out / np.maximum(np.linalg.norm(out, axis=1), 1e-300)[:, None]


def aliases(entities: DataFrame, threshold: float = 0.92, blocks: int = 8, cos: float = 0.93) -> DataFrame:
    """(canonical, alias, score) among entities (name, type, mentions) of one type, or with an empty type, whose names are close by Jaro-Winkler,
    or whose description_embedding (where there is such a column) has a cosine of at least `cos`; score is the larger of the two. Null and
    zero vectors have no cosine. The one with more mentions is canonical (ties by name). All pairs are compared: rows fall into blocks by name hash, each pair of blocks
    of a type meets in one task, rows without a type meet the blocks of all others. There an upper bound from lengths, character counts and
    prefixes leaves out pairs that can't reach the threshold. A task holds two blocks, so `blocks` grows with the data. Rows without a name have no pairs."""
    kind = entities.schema["mentions"].dataType.simpleString()
    vector = F.transform("description_embedding", lambda x: x.cast("double")) if "description_embedding" in entities.columns else F.lit(None).cast("array<double>")
    vector = vector.alias("vector")
    own = entities.where("name is not null").select("name", F.coalesce("type", F.lit("")).alias("type"), "mentions", vector).distinct()
    own = own.withColumn("b", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    within = own.withColumn("o", other).select("*", F.lit(False).alias("mixed"), F.col("type").alias("t"), F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))
    untyped, typed = own.where("type = ''"), own.where("type <> ''")
    spread = lambda rows, x, y: rows.select("name", "type", "mentions", "vector", "b", "o", F.lit(True).alias("mixed"), F.lit("").alias("t"), F.col(x).alias("x"), F.col(y).alias("y"))
    mixed = spread(untyped.withColumn("o", other), "b", "o").unionByName(spread(typed.crossJoin(F.broadcast(untyped.select(F.col("b").alias("o")).distinct())), "o", "b"))

    def pairs(part: pa.Table) -> pa.Table:
        names, block = part["name"].to_pylist(), part["b"].to_numpy()
        rank = np.unique(np.array(names, object), return_inverse=True)[1]
        x, y = part["x"][0].as_py(), part["y"][0].as_py()
        if part["mixed"][0].as_py():
            no_type = np.array([t == "" for t in part["type"].to_pylist()])
            left, right, ordered = np.flatnonzero(no_type), np.flatnonzero(~no_type), False
        else:
            left, right, ordered = np.flatnonzero(block == x), np.flatnonzero(block == y), x == y
        features, unit, found = _features(names), _unit_vectors(part["vector"]), []
        step = max(1, (1 << 20) // max(1, len(right)))
        for lo in range(0, len(left), step):
            rows = left[lo : lo + step]
            r, s = rank[rows][:, None], rank[right][None, :]
            near = unit[rows] @ unit[right].T if unit is not None else np.zeros((len(rows), len(right)))
            for i, j in zip(*np.nonzero((_may_reach(threshold, *features, rows, right) | (near >= cos - 1e-12)) & (r < s if ordered else r != s)), strict=True):
                a, b = sorted((int(rows[i]), int(right[j])), key=rank.__getitem__)
                score = jaro_winkler_value(names[a], names[b])
                if score >= threshold or near[i, j] >= cos - 1e-12:
                    found.append((a, b, max(score, float(near[i, j]))))
        a, b, score = zip(*found, strict=True) if found else ((), (), ())
        a, b = part.take(pa.array(a, pa.int64())), part.take(pa.array(b, pa.int64()))
        return pa.table([a["name"], a["mentions"], b["name"], b["mentions"], pa.array(score, pa.float64())], names=["a", "ma", "b", "mb", "score"])

    scored = within.unionByName(mixed).groupBy("mixed", "t", "x", "y").applyInArrow(pairs, f"a string, ma {kind}, b string, mb {kind}, score double")
    first = F.expr("ma > mb or (ma = mb and a < b)")
    return scored.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("alias"), "score")


def find_similar(entities: DataFrame, name: str, vector: list[float] | None, k: int = 10, jw: float = 0.85, cos: float = 0.7) -> DataFrame:
    """The k entities most like a name: exact (1), Jaro-Winkler, cosine; the best of each (name, method)."""
    q = F.lit(name.upper().strip())
    own = entities.withColumn("u", F.upper(F.trim("name")))
    out = own.where(F.col("u") == q).select("name", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    near = own.where(F.col("u") != q).withColumn("score", jaro_winkler("u", q)).where(F.col("score") >= jw)
    out = out.unionByName(near.select("name", F.lit("jaro_winkler").alias("method"), "score"))
    if vector is not None:
        close = own.withColumn("score", cosine(F.col("description_embedding"), F.array(*map(F.lit, vector)))).where(F.col("score") >= cos)
        out = out.unionByName(close.select("name", F.lit("cosine").alias("method"), "score"))
    return out.groupBy("name", "method").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "name", "method").limit(k)
