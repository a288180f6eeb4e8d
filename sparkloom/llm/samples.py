"""Bounded samples of labelled rows for the classifiers that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise


def held_out(id_col: str | Column) -> Column:
    """One fifth of all ids, by a checksum: never used for training."""
    return F.crc32(F.coalesce(F.col(id_col) if isinstance(id_col, str) else id_col, F.lit(-1)).cast("string").cast("binary")) % 5 == 0


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", training_only: bool = True) -> DataFrame:
    """(id, y, text, weight) of at most per_class rows of either label, those of least id hash, so that the choice depends on the rows alone. A
    doubly labelled id counts with its largest label; rows without a label or an id are left out. weight: how many labels of its kind a chosen one stands
    for, 1 where all were taken; weighted rows have the labels' own mix at any size. The ids have a bound and are broadcast; only the sample is gathered
    into a few files."""
    own = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y"))
    if training_only:
        own = own.where(~held_out("__id"))
    own = own.groupBy("__id").agg(F.max("__y").alias("__y"))
    n = {r["__y"]: r["count"] for r in own.groupBy("__y").count().collect()}
    parts = [own.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class).withColumn("__weight", F.lit(max(1.0, n.get(y, 0) / per_class))) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).join(chosen, "__id")
    return materialise(rows.select("__id", "__y", "__text", "__weight").repartition(8), f"sample-{label}")
