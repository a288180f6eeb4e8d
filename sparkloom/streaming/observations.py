"""Streams of observations: windows with watermarks, idempotent upserts, and the last folder of each entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkloom.operators.graph import entity_units
from sparkloom.operators.maintain import merge_units


def observations(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """A watermark where the rows are a stream; event times are timestamps."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type; rows later than the watermark are dropped by Spark."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    own = _timed(events, late)
    return own.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    own = _timed(events, late)
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def last_folder(events: DataFrame) -> DataFrame:
    """(user_id, event_type, ts): the latest folder of each entity, emitted when it changes."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for f in frames:
            r = f.sort_values(["ts", "event_type"]).iloc[-1]
            now = (r["ts"].isoformat(), r["event_type"])
            if best is None or now > tuple(best):
                best = now
        state.update(best)
        yield pd.DataFrame({"user_id": [key[0]], "event_type": [best[1]], "ts": [pd.Timestamp(best[0])]})

    return events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_type string, ts timestamp", "ts string, event_type string", "update", GroupStateTimeout.NoTimeout)


def upsert_stream(events: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Each batch of mentions (name, tu, type, observed_at, confidence, source) is rolled up and written below root as a folder of its own, so a batch
    that is run again overwrites only itself and nothing that is there is read or written. `upserted` merges what there is."""

    def write(batch: DataFrame, batch_id: int) -> None:
        entity_units(batch).write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, root: str) -> DataFrame:
    """The entities of all batches; where two disagree the older batch is right."""
    return merge_units(spark.read.option("basePath", root).parquet(f"{root}/batch=*").withColumnRenamed("batch", "__side"))


def compact(spark: SparkSession, root: str, last: int) -> None:
    """Writes the units of the batches up to `last` as one, then removes the others. Call it between runs of the stream. Until the old folders are gone a
    reader sees units twice, which changes no result."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root))]
    old = sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) <= last)
    if len(old) < 2:
        return
    units = spark.read.option("basePath", root).parquet(*[f"{root}/batch={k}" for k in old]).withColumnRenamed("batch", "__side")
    best = units.groupBy("name", "tu").agg(F.min(F.struct("__side", "type", "source")).alias("s"), F.max("observed_at").alias("observed_at"), F.min("confidence").alias("confidence"))
    best.select("name", "tu", "s.type", "observed_at", "confidence", "s.source").write.parquet(f"{root}/_compact")
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/batch={old[0]}"), True)
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{root}/_compact"), jvm.org.apache.hadoop.fs.Path(f"{root}/batch={old[0]}"))
    for k in old[1:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/batch={k}"), True)
