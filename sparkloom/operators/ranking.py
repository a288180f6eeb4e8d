"""Vector, keyword and hybrid scoring, top-k and rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import words
from sparkloom.operators.components import connecting
from sparkloom.session import materialise


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, -1 where a vector is null. Sizes that differ are an error."""
    size = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different sizes")).cast("double"))
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(-1.0)).otherwise(F.coalesce(size, F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)))


def vector_top_k(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k rows of largest cosine (ties by id). `where` filters before the ranking, so k rows come back if k pass."""
    q = F.array(*[F.lit(float(x)) for x in query])
    kept = rows if where is None else rows.where(where)
    return kept.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), id_col).limit(k)


def similar_pairs(rows: DataFrame, threshold: float, vector: str = "embedding", id_col: str = "vec_id", block_rows: int = 16384, forest: bool = False) -> DataFrame:
    """(a, b, score) of all pairs with cosine >= threshold, a < b. Rows fall into blocks of about `block_rows` by id hash; each pair of blocks meets in
    one task as two matrices, multiplied in strips, so a task's size is fixed and the number of tasks grows with the square of the rows: all pairs are
    compared, by design. Null vectors and zero vectors have no pairs. forest: of the pairs of two blocks only those that connect rows not yet
    connected by them. These have the same connected components, and there are fewer than rows in the two blocks."""
    blocks = max(4, -(-rows.count() // block_rows))
    kind = rows.schema[id_col].dataType.simpleString()
    v = F.col(vector) if rows.schema[vector].dataType.elementType.simpleString() in ("float", "double") else F.transform(vector, lambda x: x.cast("double"))
    own = rows.select(F.col(id_col).alias("id"), v.alias("v"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("b")).where("v is not null")
    other = F.sequence(F.lit(0), F.lit(blocks - 1))
    sent = own.withColumn("o", F.explode(other)).select("id", "v", "b", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"))

    def pairs(part: pd.DataFrame) -> pd.DataFrame:
        x, y = int(part["x"].iloc[0]), int(part["y"].iloc[0])
        left, right = part[part["b"] == x], part[part["b"] == y]
        empty = pd.DataFrame({"a": [], "b": [], "score": []})
        if not len(left) or not len(right):
            return empty
        a, b = (np.stack(side["v"].to_list()).astype(np.float64) for side in (left, right))
        left, right = left["id"].to_numpy(), right["id"].to_numpy()
        del part
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        root, found, strip = np.arange(len(left) + (len(right) if x != y else 0)), [], max(1, (1 << 23) // len(b))
        for lo in range(0, len(a), strip):
            score = (a[lo : lo + strip] @ b.T) / np.maximum(na[lo : lo + strip, None] * nb[None, :], 1e-300)
            i, j = np.nonzero((score >= threshold - 1e-12) & (na[lo : lo + strip, None] > 0) & (nb[None, :] > 0))
            li, rj, c = left[lo + i], right[j], score[i, j]
            keep = np.flatnonzero(li < rj if x == y else li != rj)
            if forest:
                p, q = lo + i[keep], j[keep] + (len(left) if x != y else 0)
                keep = keep[connecting(root, p, q)]
            found.append(pd.DataFrame({"a": np.minimum(li, rj)[keep], "b": np.maximum(li, rj)[keep], "score": c[keep]}))
        return pd.concat(found, ignore_index=True)

    return sent.groupBy("x", "y").applyInPandas(pairs, f"a {kind}, b {kind}, score double")


def bm25(docs: DataFrame, query_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(id, bm25) of documents that hold a query word. query_words has one row per occurrence in the query: repeated words count again. Texts are
    split once; only lengths and the query's words leave the scan. The query's words are collected: a query is small."""
    times = {r["word"]: r["count"] for r in query_words.groupBy("word").count().collect()}
    q = docs.sparkSession.createDataFrame(list(times.items()), "word string, times long")
    known = F.array(*map(F.lit, times)) if times else F.array().cast("array<string>")
    split = docs.select(F.col(id_col).alias("id"), words(text_col).alias("w"))
    sized = materialise(split.select("id", F.size("w").alias("len"), F.filter("w", lambda x: F.array_contains(known, x)).alias("w")), "bm25")
    total = sized.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tf = sized.select("id", "len", F.explode("w").alias("word")).join(F.broadcast(q), "word").groupBy("id", "len", "word", "times").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return tf.join(F.broadcast(df), "word").join(F.broadcast(total)).groupBy("id").agg(F.sum(part).alias("bm25"))


def normalised(scores: DataFrame, *columns: str) -> DataFrame:
    """Columns divided by their maximum (0 where that isn't positive). The maxima are one row."""
    top = scores.agg(*[F.max(c).alias(f"__{c}") for c in columns])
    return scores.join(F.broadcast(top)).select(*[c for c in scores.columns if c not in columns], *[F.when(F.col(f"__{c}") > 0, F.coalesce(c, F.lit(0.0)) / F.col(f"__{c}")).otherwise(0.0).alias(c) for c in columns])


def ranked(scores: DataFrame, by: str, id_col: str = "id", keys: list[str] | None = None, keep: int | None = None) -> DataFrame:
    """Adds rank from 0 (largest score first, ties by id) within keys, such as the path. With `keep` only the first rows; without keys these are
    taken before the window. Without keys and `keep` all rows are numbered over sorted ranges."""
    if not keys and keep is None:
        from sparkloom.operators.linking import numbered

        return numbered(scores.withColumn("__by", -F.col(by)), ["__by", id_col], "rank").drop("__by")
    if not keys:
        scores = scores.orderBy(F.desc(by), id_col).limit(keep)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(by), id_col)
    out = scores.withColumn("rank", F.row_number().over(w) - 1)
    return out.where(F.col("rank") < keep) if keep else out


def fuse(lists: DataFrame, k: int = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of (path, id, rank from 0): id, score."""
    w = F.lit(1.0)
    for path, x in (weights or {}).items():
        w = F.when(F.col("path") == path, F.lit(float(x))).otherwise(w)
    return lists.groupBy("id").agg(F.sum(w / (k + F.col("rank") + 1)).alias("score"))


def fuse_gated(lists: DataFrame, gate_path: str, top: int, k: int = 60) -> DataFrame:
    """Only ids among the first `top` of one path are fused."""
    gate = lists.where((F.col("path") == gate_path) & (F.col("rank") < top)).select("id").distinct()
    return fuse(lists.join(gate, "id", "left_semi"), k)


def fuse_quorum(lists: DataFrame, k: int = 60, bonus: float = 1.5, malus: float = 0.5) -> DataFrame:
    """Ids of two paths or more get a bonus, the others a malus."""
    return lists.groupBy("id").agg((F.sum(1.0 / (k + F.col("rank") + 1)) * F.when(F.countDistinct("path") >= 2, F.lit(bonus)).otherwise(F.lit(malus))).alias("score"))


def fuse_paths(lists: DataFrame, paths: list[str], k: int = 60) -> DataFrame:
    """Only these paths are fused, such as the textual ones."""
    return fuse(lists.where(F.col("path").isin(paths)), k)


def fuse_cascade(lists: DataFrame, gate_path: str, top: int, rescue: int, k: int = 60) -> DataFrame:
    """All paths are fused; ids among the first `top` of the gate's path come through, and the `rescue` best of the others: id, score, rescued."""
    gate = lists.where((F.col("path") == gate_path) & (F.col("rank") < top)).select("id")
    return cascade(fuse(lists, k).withColumn("score", F.round("score", 12)), gate, rescue)


def community_rank(mentions: DataFrame, seeds: DataFrame, members: DataFrame, seed: float = 2.0, other: float = 0.5, within: list[str] | None = None) -> DataFrame:
    """Text units (tu) by communities: each distinct seed they mention counts `seed`, each other member of a seed's community `other`. within: as
    in `graph_keyword_rank`."""
    unit = [*(within or []), "tu"]
    own = members.join(seeds, "name", "left_semi").select("community").distinct()
    near = members.join(own, "community", "left_semi").select("name").distinct().join(seeds, "name", "left_anti")
    weight = seeds.select("name", F.lit(seed).alias("w")).unionByName(near.select("name", F.lit(other).alias("w")))
    return mentions.select(*unit, "name").distinct().join(weight, "name").groupBy(*unit).agg(F.sum("w").alias("score")).select("tu", "score")


def fuse_scores(lists: DataFrame, k: int = 60) -> DataFrame:
    """Each contribution is weighted by the row's score over the path's best."""
    best = lists.groupBy("path").agg(F.max("score").alias("best"))
    share = F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0)
    return lists.join(F.broadcast(best), "path").groupBy("id").agg(F.sum(share / (k + F.col("rank") + 1)).alias("score"))


def fuse_confident(lists: DataFrame, k: int = 60, gap: float = 0.15, boost: float = 2.0) -> DataFrame:
    """A path whose first score leads its third by more than `gap` of the first counts `boost` times."""
    lead = lists.groupBy("path").agg(F.max(F.when(F.col("rank") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("c"))
    sure = lead.select("path", F.when((F.col("a") > 0) & ((F.col("a") - F.coalesce("c", F.lit(0.0))) / F.col("a") > gap), F.lit(boost)).otherwise(F.lit(1.0)).alias("w"))
    return lists.join(F.broadcast(sure), "path").groupBy("id").agg(F.sum(F.col("w") / (k + F.col("rank") + 1)).alias("score"))


def cascade(scores: DataFrame, gate: DataFrame, rescue: int) -> DataFrame:
    """scores (id, score); gate (id). All gated ids, and the `rescue` best of the others: id, score, rescued."""
    inside = scores.join(gate.select("id").distinct(), "id", "left_semi").withColumn("rescued", F.lit(False))
    outside = scores.join(gate.select("id").distinct(), "id", "left_anti").orderBy(F.desc("score"), "id").limit(rescue).withColumn("rescued", F.lit(True))
    return inside.unionByName(outside)


def graph_keyword_rank(mentions: DataFrame, seeds: DataFrame, near: DataFrame, hits: DataFrame, seed: float = 2.0, neighbour: float = 0.5, hit: float = 3.0, within: list[str] | None = None) -> DataFrame:
    """Text units (tu) by graph and keywords: each distinct seed they mention counts `seed`, each other neighbour of a seed `neighbour`, each
    keyword hit (hits: tu, n) `hit`. Only units that mention a seed or a neighbour are ranked. within:
    columns that a unit has one value of, such as the document (hits have them, too); rows that are spread by them needn't move for units."""
    unit = [*(within or []), "tu"]
    weight = seeds.select("name", F.lit(seed).alias("w")).unionByName(near.join(seeds, "name", "left_anti").select("name", F.lit(neighbour).alias("w"))).groupBy("name").agg(F.max("w").alias("w"))
    graph = mentions.select(*unit, "name").distinct().join(weight, "name").groupBy(*unit).agg(F.sum("w").alias("graph"))
    return graph.join(hits, unit, "left").select("tu", (F.col("graph") + hit * F.coalesce("n", F.lit(0))).alias("score"))


def rerank(rows: DataFrame, scorer, k: int, id_col: str = "id", text_col: str = "text", by: str = "score", fetch: int = 3) -> DataFrame:
    """The k best of the first fetch * k rows by an injected scorer (a list of texts to a list of numbers or None, which is last)."""
    first = rows.orderBy(F.desc(by), id_col).limit(k * fetch)

    def score(text: pd.Series) -> pd.Series:
        return pd.Series([float("-inf") if x is None else float(x) for x in scorer(text.tolist())])

    return first.withColumn("rerank", F.pandas_udf(score, "double")(text_col)).orderBy(F.desc("rerank"), id_col).limit(k)


def answer_rank(lists: DataFrame, answers: DataFrame) -> DataFrame:
    """The best rank (from 1) of a right id in each path; paths without one have null."""
    right = lists.join(answers.select("id").distinct(), "id", "left_semi").groupBy("path").agg((F.min("rank") + 1).alias("rank"))
    return lists.select("path").distinct().join(right, "path", "left")
