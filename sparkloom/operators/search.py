"""Retrieval modes as compositions of the operators. Each returns lazy tables of context; a language model is an injected function and
is called on the driver once per question, never inside a plan."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import count_tokens, words
from sparkloom.operators import context, ranking
from sparkloom.operators.linking import surviving_communities
from sparkloom.operators.recall import RecallFilter, network_edges, relationships_within

Model = Callable[[str], str]


@dataclass
class Result:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    text: str = ""
    response: str | None = None


@dataclass
class Artifacts:
    """Conformed tables of one version."""

    documents: DataFrame
    text_units: DataFrame
    entities: DataFrame
    relationships: DataFrame
    nodes: DataFrame
    reports: DataFrame


def filtered(a: Artifacts, f: RecallFilter) -> Artifacts:
    """The tables after a filter, before any scoring: relationships need both ends, text units an allowed document where folders or tags are
    asked for."""
    if f.is_empty:
        return a
    entities, documents = a.entities.where(f.entities()), a.documents.where(f.documents())
    ids = f.candidate_text_units(a.text_units, a.documents)
    units = a.text_units if ids is None else a.text_units.join(ids, "id", "left_semi")
    return Artifacts(documents, units, entities, relationships_within(a.relationships, entities).where(f.provenance()), a.nodes, a.reports)


def recall(a: Artifacts, f: RecallFilter, limit: int = 50) -> Result:
    """The first rows of the filtered tables by id; no model is asked."""
    own = filtered(a, f)
    return Result({"entities": own.entities.orderBy("name").limit(limit), "relationships": own.relationships.orderBy("source", "target", "relationship_type").limit(limit), "documents": own.documents.orderBy("id").limit(limit), "text_units": own.text_units.orderBy("id").limit(limit)})


def seeds(a: Artifacts, vector: list[float], k: int, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The k nearest entities with forced names first, without excluded ones: name, ord."""
    near = ranking.vector_top_k(a.entities.where("description_embedding is not null"), vector, k, "description_embedding", "name").select("name", (-F.col("score")).alias("ord"))
    if include:
        near = a.entities.where(F.upper("name").isin([x.upper() for x in include])).select("name", F.lit(-10.0).alias("ord")).unionByName(near)
    near = near.groupBy("name").agg(F.min("ord").alias("ord"))
    return near.where(~F.upper("name").isin([x.upper() for x in exclude])) if exclude else near


def _fit(rows: DataFrame, text, order: list, budget: int) -> DataFrame:
    """One context: the rows that a budget could hold at all are bounded by it, so the window sees at most `budget` rows."""
    rows = rows.withColumn("line", text).orderBy(*order).limit(max(budget, 1))
    rows = rows.withColumn("cost", F.greatest(count_tokens("line"), F.lit(1).cast("long"))).withColumn("__k", F.lit(0))
    return context.budget_prefix(rows, "cost", budget, order, ["__k"]).drop("__k")


def entity_context(a: Artifacts, chosen: DataFrame, budget: int) -> DataFrame:
    rows = a.entities.join(chosen, "name")
    return _fit(rows, F.concat_ws(",", "name", "type", F.translate("description", "\n,", " ;"), F.col("degree").cast("string")), ["ord", "name"], budget)


def relationship_context(a: Artifacts, chosen: DataFrame, budget: int) -> DataFrame:
    """Edges among the seeds first, then those that leave them, each by rank."""
    inside = network_edges(a.relationships, chosen, True).withColumn("part", F.lit(0))
    outside = network_edges(a.relationships, chosen, False).withColumn("part", F.lit(1))
    text = F.concat_ws(",", "source", "target", "relationship_type", F.translate("description", "\n,", " ;"), F.col("weight").cast("string"))
    return _fit(inside.unionByName(outside), text, ["part", F.desc("rank"), "source", "target", "relationship_type"], budget)


def report_context(a: Artifacts, chosen: DataFrame, budget: int, all_if_none: bool = False) -> DataFrame:
    own = a.nodes.join(chosen, a.nodes["title"] == chosen["name"], "left_semi").select("community").distinct()
    found = a.reports.join(own, "community", "left_semi")
    if all_if_none and found.isEmpty():
        found = a.reports
    return _fit(found, F.concat_ws("\n", "title", "full_content"), [F.desc("rank"), "id"], budget)


def source_context(units: DataFrame, chosen: DataFrame, budget: int) -> DataFrame:
    """Text units by how many seeds they mention."""
    hits = units.select("id", F.explode("entity_ids").alias("name")).join(chosen, "name", "left_semi").groupBy("id").agg(F.countDistinct("name").alias("overlap"))
    return _fit(units.join(hits, "id"), F.col("text"), [F.desc("overlap"), "id"], budget)


def _finish(tables: dict[str, DataFrame], query: str, model: Model | None) -> Result:
    """Contexts are bounded by their budgets, so their lines may come to the driver."""
    text = "\n\n".join(f"-----{name}-----\n" + "\n".join(r["line"] for r in df.orderBy("used").collect()) for name, df in tables.items())
    return Result(tables, text, None if model is None else model(f"{text}\n\n{query}"))


def local_search(a: Artifacts, query: str, vector: list[float], model: Model | None = None, f: RecallFilter | None = None, k: int = 10, budget: int = 8000, community_share: float = 0.15, source_share: float = 0.5, **names) -> Result:
    a = filtered(a, f or RecallFilter())
    chosen = seeds(a, vector, k, **names)
    rest = max(1 - community_share - source_share, 0)
    entity = int(rest * budget) // 2
    tables = {"Entities": entity_context(a, chosen, entity), "Relationships": relationship_context(a, chosen, int(rest * budget) - entity), "Reports": report_context(a, chosen, int(community_share * budget)), "Sources": source_context(a.text_units, chosen, int(source_share * budget))}
    return _finish(tables, query, model)


def cascade_search(a: Artifacts, query: str, vector: list[float], unit_scores: DataFrame, model: Model | None = None, f: RecallFilter | None = None, k: int = 10, rescue: int = 5, budget: int = 8000) -> Result:
    """Text units that mention a seed, and the best others by keywords and vector (unit_scores: id, cos)."""
    a = filtered(a, f or RecallFilter())
    chosen = seeds(a, vector, k)
    spark = a.text_units.sparkSession
    q = spark.createDataFrame([(query,)], "q string").select(F.explode(words("q")).alias("word"))
    both = ranking.bm25(a.text_units, q, "id").join(unit_scores, "id", "full_outer").select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("cos", F.lit(0.0)).alias("cos"))
    scores = ranking.normalised(both, "bm25", "cos").select("id", (F.col("bm25") + F.col("cos")).alias("score"))
    gate = a.text_units.select("id", F.explode("entity_ids").alias("name")).join(chosen, "name", "left_semi").select("id")
    kept = a.text_units.join(ranking.cascade(scores, gate, rescue), "id")
    tables = {"Entities": entity_context(a, chosen, budget // 6), "Relationships": relationship_context(a, chosen, budget // 6), "Reports": report_context(a, chosen, budget // 6, True), "Sources": _fit(kept, F.col("text"), [F.desc("score"), "id"], budget // 2)}
    return _finish(tables, query, model)


def document_search(a: Artifacts, document_ids: list[str], query: str, model: Model | None = None, budget: int = 8000) -> Result:
    """Everything of the named documents: a third entities, a quarter relationships, the rest sources."""
    units = a.text_units.where(F.arrays_overlap("document_ids", F.array(*map(F.lit, document_ids))))
    names = units.select(F.explode("entity_ids").alias("name")).distinct()
    chosen = a.entities.join(names, "name", "left_semi").select("name", (-F.col("degree")).cast("double").alias("ord"))
    own = Artifacts(a.documents, units, a.entities, relationships_within(a.relationships, chosen), a.nodes, a.reports)
    tables = {"Entities": entity_context(own, chosen, budget // 3), "Relationships": relationship_context(own, chosen, budget // 4), "Sources": _fit(units, F.col("text"), ["id"], budget - budget // 3 - budget // 4)}
    return _finish(tables, query, model)


def global_search(a: Artifacts, query: str, model: Model, budget: int = 8000, top: int = 20, f: RecallFilter | None = None) -> Result:
    """Reports that fit into the budget together are answered from at once. More are packed into chunks; the model rates points of each chunk in the
    executors (`score<TAB>point` per line), the best points are answered from. A filter leaves the reports of communities with a surviving entity."""
    reports = a.reports
    if f is not None and not f.is_empty:
        kept = surviving_communities(a.nodes.select(F.col("title").alias("name"), "community"), filtered(a, f).entities)
        reports = reports.join(kept, "community", "left_semi")
    costs = reports.select("id", count_tokens("full_content").alias("cost"))
    total = costs.agg(F.sum("cost")).first()[0] or 0
    if total <= budget:
        text = "\n".join(r["full_content"] for r in reports.select("id", "full_content").orderBy("id").collect())
        return Result({"Reports": reports}, text, model(f"{text}\n\n{query}"))
    sized = costs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(1 + total // (64 * budget))))
    chunks = context.greedy_batches(sized, "cost", budget, 10_000, ["id"], ["part"]).join(reports.select("id", "full_content"), "id").groupBy("part", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "full_content"))), lambda x: x["full_content"]), "\n").alias("text"))

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [line.split("\t", 1) for t in frame["text"] for line in model(f"{t}\n\n{query}").splitlines() if "\t" in line]
            yield pd.DataFrame({"score": [float(s) for s, _ in rows], "line": [p for _, p in rows]})

    points = chunks.mapInPandas(rate, "score double, line string").orderBy(F.desc("score"), "line").limit(top)
    text = "\n".join(r["line"] for r in points.collect())
    return Result({"Points": points}, text, model(f"{text}\n\n{query}"))
