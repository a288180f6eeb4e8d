"""Building and measuring the property graph."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import clean_name, clean_type
from sparkloom.session import materialise


def parse_records(replies: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Records of extraction replies: id, ord, kind, name, type, source, target, description, weight, queries. Text before the start mark
    and behind the end mark is cut; records are split at ##, fields at <|>; a weight that is no number is 1."""
    body = F.regexp_replace(F.regexp_replace(F.col(text_col), r"(?s)^.*<extracted_data>", ""), r"(?s)</extracted_data>.*$", "")
    rec = replies.select(F.col(id_col).alias("id"), F.posexplode(F.split(body, "##")).alias("ord", "rec"))
    bare = F.regexp_replace(F.trim(F.col("rec")), r"^\(|\)$", "")
    fields = F.transform(F.split(bare, r"<\|>"), lambda x: F.regexp_replace(F.trim(x), r'^"+|"+$', ""))
    rec = rec.withColumn("f", fields).withColumn("kind", F.lower(F.col("f")[0])).where(F.col("kind").isin("entity", "relationship") & (F.size("f") >= 4))
    entity, at = F.col("kind") == "entity", lambda k: F.try_element_at("f", F.lit(k))
    a, b = clean_name(at(2)), clean_name(at(3))
    return rec.select(
        "id", "ord", "kind",
        F.when(entity, a).alias("name"),
        F.when(entity, clean_type(at(3))).otherwise(clean_type(at(4))).alias("type"),
        F.when(~entity, F.least(a, b)).alias("source"),
        F.when(~entity, F.greatest(a, b)).alias("target"),
        F.when(entity, at(4)).otherwise(at(5)).alias("description"),
        F.when(~entity, F.coalesce(at(6).try_cast("double"), F.lit(1.0))).alias("weight"),
        F.when(entity, F.filter(F.transform(F.split(at(5), ";"), F.trim), lambda x: x != "")).alias("queries"),
    )


def rollup_entities(raw: DataFrame, nested: bool = False) -> DataFrame:
    """One row per name: type and source of the first mention, latest time, least confidence, n_tu and n_doc, the numbers of distinct text units and
    documents. They are counted in two steps, so nothing is gathered for a hot name; which units they are stays as rows (see `linking.postings`).
    nested: every text unit lies in one document. Rows that are spread by document then move once, by name and already counted."""
    order = F.struct("tu", "type")
    units = raw.groupBy(*["doc"] * nested, "name", "tu").agg(F.min(F.when(F.col("type") != "", F.col("type"))).alias("type"), F.max("observed_at").alias("observed_at"), F.min("confidence").alias("confidence"), F.min(F.struct("type", "source")).alias("s"))
    if nested:
        facts = [F.max("observed_at").alias("observed_at"), F.min("confidence").alias("confidence")]
        docs = units.groupBy("doc", "name").agg(F.min(F.when(F.col("type").isNotNull(), order)).alias("t"), F.count("*").alias("n_tu"), *facts, F.min(F.struct("tu", "s")).alias("s"))
        names = docs.groupBy("name").agg(F.min("t").alias("t"), F.sum("n_tu").alias("n_tu"), F.count("*").alias("n_doc"), *facts, F.min("s").alias("s"))
        return names.select("name", "t.type", "n_tu", "n_doc", "observed_at", "confidence", "s.s.source")
    by_unit = units.groupBy("name").agg(
        F.min_by("type", F.when(F.col("type").isNotNull(), order)).alias("type"), F.count("*").alias("n_tu"), F.max("observed_at").alias("observed_at"), F.min("confidence").alias("confidence"), F.min_by(F.col("s.source"), F.struct("tu", "s.type")).alias("source")
    )
    by_doc = raw.select("name", "doc").distinct().groupBy("name").agg(F.count("*").alias("n_doc"))
    return by_unit.join(by_doc, "name").select("name", "type", "n_tu", "n_doc", "observed_at", "confidence", "source")


def rollup_relationships(raw: DataFrame, units: bool = False) -> DataFrame:
    """One row per unordered pair and type, self-loops dropped; weights are averaged. units: n_tu too, the number of distinct text units."""
    keys = ["source", "target", "relationship_type"]
    a, b = F.least("source", "target"), F.greatest("source", "target")
    own = raw.where("source <> target").select(a.alias("source"), b.alias("target"), "relationship_type", "weight", *["tu"] * units, "observed_at", "confidence")
    facts = [F.max("observed_at").alias("observed_at"), F.min("confidence").alias("confidence")]
    if not units:
        return own.groupBy(*keys).agg(F.avg("weight").alias("weight"), *facts)
    each = own.groupBy(*keys, "tu").agg(F.sum("weight").alias("w"), F.count("weight").alias("n"), *facts)
    return each.groupBy(*keys).agg((F.sum("w") / F.sum("n")).alias("weight"), F.count("*").alias("n_tu"), *facts)


def entity_units(raw: DataFrame) -> DataFrame:
    """(name, tu) once each, with type, observed_at, confidence and source: what an upsert merges row by row."""
    best = F.min(F.struct("type", "source")).alias("s")
    return raw.groupBy("name", "tu").agg(best, F.max("observed_at").alias("observed_at"), F.min("confidence").alias("confidence")).select("name", "tu", "s.type", "observed_at", "confidence", "s.source")


def degrees(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """name, degree: every (typed) edge counts at both ends."""
    return edges.select(F.explode(F.array(source, target)).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))


def rank_edges(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with source_degree, target_degree and rank, their sum."""
    d = degrees(edges, source, target)
    a, b = d.select(F.col("name").alias(source), F.col("degree").alias("source_degree")), d.select(F.col("name").alias(target), F.col("degree").alias("target_degree"))
    return edges.join(a, source, "left").join(b, target, "left").withColumn("rank", F.coalesce("source_degree", F.lit(0)) + F.coalesce("target_degree", F.lit(0)))


def simple_graph(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Undirected edges without loops; weights of parallel edges are summed."""
    return edges.where(F.col(source) != F.col(target)).groupBy(F.least(source, target).alias("source"), F.greatest(source, target).alias("target")).agg(F.sum("weight").alias("weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(a, b, weight) in both directions."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight").union(edges.select(F.col("target"), F.col("source"), "weight"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(name, hop): every node within `hops` of the seeds and its distance. The edges and every frontier are written once."""
    both = materialise(neighbours(edges.withColumn("weight", F.lit(1.0))).select("a", "b").distinct(), "hop-edges")
    reached = front = materialise(seeds.select("name", F.lit(0).alias("hop")).distinct(), "hop")
    for h in range(1, hops + 1):
        front = front.select(F.col("name").alias("a")).join(both, "a").select(F.col("b").alias("name")).distinct().join(reached, "name", "left_anti").withColumn("hop", F.lit(h))
        front = materialise(front, "hop")
        reached = reached.unionByName(front)
    return reached


def edges_within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges both of whose ends belong to the same community: members has (name, community)."""
    a, b = members.select(F.col("name").alias("source"), "community"), members.select(F.col("name").alias("target"), "community")
    return edges.join(a, "source").join(b, ["target", "community"])


def density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """community, size, edges, density = edges / (size (size - 1) / 2)."""
    size = members.groupBy("community").agg(F.countDistinct("name").alias("size"))
    inner = edges_within(simple_graph(edges), members).groupBy("community").agg(F.count("*").alias("edges"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    return size.join(inner, "community", "left").select("community", "size", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(pairs > 0, F.coalesce("edges", F.lit(0)) / pairs).otherwise(0.0).alias("density"))


def pull(edges: DataFrame, members: DataFrame) -> DataFrame:
    """For every node the community that most of its neighbours belong to: name, community, votes, neighbours, ratio."""
    votes = neighbours(simple_graph(edges)).join(members.select(F.col("name").alias("b"), "community"), "b").groupBy(F.col("a").alias("name"), "community").agg(F.count("*").alias("votes"))
    best: Column = F.max(F.struct("votes", F.col("community").alias("c")))
    return votes.groupBy("name").agg(best.alias("m"), F.sum("votes").alias("neighbours")).select("name", F.col("m.c").alias("community"), F.col("m.votes").alias("votes"), "neighbours", (F.col("m.votes") / F.col("neighbours")).alias("ratio"))


def betweenness(edges: DataFrame, most: int = 20_000) -> DataFrame:
    """(name, betweenness): the share of shortest paths between other nodes that lead through a node, of undirected unweighted graphs. Every node is a source
    of its own (Brandes), so sources are spread over tasks and each task holds the graph: graphs of more than `most` edges are refused."""
    own = [(r["source"], r["target"]) for r in simple_graph(edges).select("source", "target").limit(most + 1).collect()]
    if len(own) > most:
        raise ValueError(f"more than {most} edges")
    near: dict[str, list[str]] = {}
    for a, b in own:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    pairs = max(1, (len(near) - 1) * (len(near) - 2))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            total = dict.fromkeys(near, 0.0)
            for s in part["name"]:
                order, before, paths, hop = [], {s: []}, {s: 1.0}, {s: 0}
                queue = deque([s])
                while queue:
                    x = queue.popleft()
                    order.append(x)
                    for y in near[x]:
                        if y not in hop:
                            hop[y], paths[y], before[y] = hop[x] + 1, 0.0, []
                            queue.append(y)
                        if hop[y] == hop[x] + 1:
                            paths[y] += paths[x]
                            before[y].append(x)
                share = dict.fromkeys(order, 0.0)
                for y in reversed(order):
                    for x in before[y]:
                        share[x] += paths[x] / paths[y] * (1 + share[y])
                    if y != s:
                        total[y] += share[y]
            yield pd.DataFrame({"name": list(total), "b": [x / pairs for x in total.values()]})

    names = edges.sparkSession.createDataFrame([(x,) for x in sorted(near)], "name string")
    return names.mapInPandas(run, "name string, b double").groupBy("name").agg(F.sum("b").alias("betweenness"))


def component_summary(edges: DataFrame) -> DataFrame:
    """One row: how many connected components there are, and the size of the largest."""
    from sparkloom.operators.components import connected_components

    size = connected_components(edges, "source", "target").groupBy("component").agg(F.count("*").alias("n"))
    return size.agg(F.count("*").alias("components"), F.max("n").alias("largest"))
