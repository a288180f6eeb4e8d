"""Usage ledger of model calls and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usage_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.count_if("cache_hit").alias("cache_hits"), F.count_if("cost_resolved").alias("resolved"), F.count_if(~F.col("cost_resolved")).alias("unresolved"),
    )


def pricing_status(resolved: Column) -> Column:
    """complete, partial or undefined, as an aggregate; no rows are complete."""
    return F.when(F.coalesce(F.every(resolved), F.lit(True)), "complete").when(F.some(resolved), "partial").otherwise("undefined")


def cost(prompt: Column, completion: Column, rate_in: Column, rate_out: Column) -> Column:
    return prompt / 1e6 * rate_in + completion / 1e6 * rate_out


def weighted_score(**scores: Column) -> Column:
    weights = {"correctness": 0.35, "completeness": 0.25, "source_grounding": 0.15, "coherence": 0.10, "no_hallucination": 0.15}
    return F.round(sum((F.lit(w) * scores[k] for k, w in weights.items()), F.lit(0.0)), 2)


def macro_average(scores: DataFrame, category: str, system: str, value: str) -> DataFrame:
    """Mean per system of its category means."""
    by = scores.groupBy(category, system).agg(F.avg(value).alias("m"))
    return by.groupBy(system).agg(F.avg("m").alias("overall"), F.count("*").alias("categories"))


def best_delta(overall: DataFrame, system: str, value: str) -> DataFrame:
    """Adds `delta`, how far each system is above the best of the others (null where it is alone). There are few systems: the two best are one row."""
    two = overall.select(F.col(value).alias("v"), F.col(system).alias("s")).orderBy(F.desc("v"), "s").limit(2).agg(F.sort_array(F.collect_list(F.struct("v", "s")), False).alias("__top"))
    first, second = F.try_element_at("__top", F.lit(1)), F.try_element_at("__top", F.lit(2))
    other = F.when(F.col(system) == first["s"], second["v"]).otherwise(first["v"])
    return overall.join(F.broadcast(two)).withColumn("delta", F.col(value) - other).drop("__top")
