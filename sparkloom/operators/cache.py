"""Calls of outside services: a content-addressed cache, batches, and the summary of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_key(model: str, prompt: Column | str, **parameters) -> Column:
    """A key of model, prompt and parameters."""
    named = [F.lit(str(v)).alias(k) for k, v in sorted(parameters.items())]
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), (F.col(prompt) if isinstance(prompt, str) else prompt).alias("prompt"), *named)), 256)


def missing_requests(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests (key, prompt) that the cache (key, response) lacks."""
    return requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def call(requests: DataFrame, client: Callable[[list[str]], list[str | None]], batch: int = 1024) -> DataFrame:
    """(key, response) from an injected client, in batches within each task. A batch that fails has null responses, which aren't cached."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo : lo + batch]
                try:
                    replies = list(client(part["prompt"].tolist()))
                except Exception:  # noqa: BLE001 - an outside service
                    replies = [None] * len(part)
                yield pd.DataFrame({"key": part["key"].to_numpy(), "response": replies})

    return requests.select("key", "prompt").mapInPandas(run, "key string, response string")


def answered(requests: DataFrame, cache: DataFrame, client: Callable[[list[str]], list[str | None]]) -> tuple[DataFrame, DataFrame]:
    """(requests with their responses, new cache rows). Write the new rows before the first is used twice."""
    fresh = call(missing_requests(requests, cache), client).where("response is not null")
    both = cache.select("key", "response").unionByName(fresh)
    return requests.join(both, "key", "left"), fresh


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows, columns) of a version, for its manifest."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
