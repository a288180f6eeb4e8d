"""Context assembly under token budgets, chunking, and conversation windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_prefix(rows: DataFrame, cost: str, budget: int, order: list[Column | str], keys: list[str], fixed: int = 0) -> DataFrame:
    """The first rows in order whose costs, with `fixed`, stay within the budget, per key (one context each)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(cost).over(w) + fixed).where(F.col("used") <= budget)


def greedy_batches(rows: DataFrame, cost: str, budget: int, most: int, order: list[str], keys: list[str]) -> DataFrame:
    """Adds batch numbers: a batch closes when the next item would pass the budget or the count; its first item always enters. Rows of a key go by in
    order, one running sum is all that is held."""
    own = rows.select(*keys, *order, F.col(cost).cast("long").alias(cost))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", batch int"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, used, n, batch = None, 0, 0, 0
        for part in parts:
            out = []
            costs = part.column(part.num_columns - 1).to_pylist()
            for key, c in zip(zip(*(part.column(k).to_pylist() for k in range(len(keys))), strict=True), costs, strict=True):
                if key != here:
                    here, used, n, batch = key, 0, 0, 0
                elif used + (c or 0) > budget or n >= most:
                    used, n, batch = 0, 0, batch + 1
                used, n = used + (c or 0), n + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], names=[*part.schema.names, "batch"])

    return own.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def chunk_windows(docs: DataFrame, tokens: Column, size: int, overlap: int, id_col: str = "doc_id", glue: str = " ") -> DataFrame:
    """(id, chunk, start, n_tokens, text): windows of `size` tokens, each starting size - overlap behind the last, until one reaches the end. With
    tokens that keep their white space (`text.spaced_tokens`) and an empty glue the texts are verbatim."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    t = docs.select(F.col(id_col), tokens.alias("t")).withColumn("n", F.size("t")).where("n > 0")
    last = F.greatest(F.ceil((F.col("n") - size) / step), F.lit(0)).cast("int")
    each = t.withColumn("chunk", F.explode(F.sequence(F.lit(0), last))).withColumn("start", F.col("chunk") * step)
    part = F.slice("t", F.col("start") + 1, F.lit(size))
    return each.select(id_col, "chunk", "start", F.size(part).alias("n_tokens"), F.array_join(part, glue).alias("text"))


def interval_join(chunks: DataFrame, spans: DataFrame, bucket: int) -> DataFrame:
    """chunks (cs, ce) with spans (ds, de) that overlap, half-open. Both go into buckets of the line, so the join is an equi-join; a pair that
    shares several buckets is kept in the first."""
    a = chunks.withColumn("b", F.explode(F.sequence(F.floor(F.col("cs") / bucket), F.floor((F.col("ce") - 1) / bucket))))
    b = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("ds") / bucket), F.floor((F.col("de") - 1) / bucket))))
    both = a.join(b, "b").where("ds < ce and de > cs")
    return both.where(F.col("b") == F.floor(F.greatest("cs", "ds") / bucket)).drop("b")


def conversation_tail(turns: DataFrame, last: int, conv: str = "conv_id", turn: str = "turn", role: str = "user") -> DataFrame:
    """The last turns of a role per conversation, in order, joined by new lines."""
    w = Window.partitionBy(conv).orderBy(F.desc(turn))
    own = turns.where(F.col("role") == role).withColumn("back", F.row_number().over(w)).where(F.col("back") <= last)
    return own.groupBy(conv).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn, "text"))), lambda x: x["text"]), "\n").alias("tail"), F.count("*").alias("n_turns"))
