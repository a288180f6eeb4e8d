"""A table of vectors as a store: versions behind a pointer, exact search, filters before the ranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ranking import vector_top_k
from sparkloom.sources.files import current, publish


class VectorStore:
    """Rows (id, text, vector, and others) below a root folder. A load writes a new version; readers of the older one go on undisturbed."""

    def __init__(self, spark: SparkSession, root: str, collection: str = "vectors"):
        self.spark, self.root, self.collection = spark, root, collection

    def load(self, rows: DataFrame, mode: str = "overwrite") -> None:
        """`overwrite` replaces the collection, `append` adds rows; of an id that is there the new row stays."""
        if mode not in ("overwrite", "append"):
            raise ValueError(f"unknown mode {mode}")
        if mode == "append":
            rows = rows.unionByName(self.rows().join(rows.select("id"), "id", "left_anti"), allowMissingColumns=True)
        publish({self.collection: rows}, self.root, uuid.uuid4().hex)

    def rows(self) -> DataFrame:
        return current(self.spark, self.root, self.collection)

    def filter_by_id(self, ids: list | DataFrame) -> DataFrame:
        """Rows of these ids; a list is part of the plan, a table (id) is joined."""
        return self.rows().join(ids.select("id").distinct(), "id", "left_semi") if isinstance(ids, DataFrame) else self.rows().where(F.col("id").isin(list(ids)))

    def search_by_vector(self, vector: list[float], k: int = 10, where: Column | None = None) -> DataFrame:
        """The k rows of largest cosine among those that pass `where`, ties by id: id, score and the other columns."""
        return vector_top_k(self.rows(), vector, k, "vector", "id", where)

    def search_by_text(self, text: str, embed: Callable[[list[str]], list[list[float]]], k: int = 10, where: Column | None = None) -> DataFrame:
        return self.search_by_vector(embed([text])[0], k, where)


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], text_col: str = "text", name: str = "vector", batch: int = 1024) -> DataFrame:
    """Adds the vectors of an injected client, `batch` texts at a time. A call that fails, or null texts, give null vectors."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = [None] * len(part)
            there = [i for i, x in enumerate(part) if x is not None]
            for lo in range(0, len(there), batch):
                own = there[lo : lo + batch]
                try:
                    found = embed([part.iloc[i] for i in own])
                except Exception:  # noqa: BLE001 - a client's failure leaves its batch without vectors
                    continue
                for i, v in zip(own, found, strict=True):
                    out[i] = v
            yield pd.Series(out)

    return rows.withColumn(name, F.pandas_udf(run, "array<double>", F.PandasUDFType.SCALAR_ITER)(text_col))


def naive_rag(chunks: DataFrame, vector: list[float], k: int = 5) -> DataFrame:
    """The plain baseline: the k chunks (id, text, vector) of largest cosine, numbered from 1 in that order."""
    from pyspark.sql import Window

    return vector_top_k(chunks, vector, k, "vector", "id").withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
