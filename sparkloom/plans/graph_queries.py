"""Filters, graph building, joins, aggregations and maintenance over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import matches_category
from sparkloom.operators import communities, export, graph, ledger, maintain, ranking, recall, similar
from sparkloom.operators.components import connected_components
from sparkloom.plans.registry import query
from sparkloom.session import materialise
from sparkloom.sources import graph_tables as G
from sparkloom.sources.graph_tables import with_sql

_FILTER = recall.RecallFilter(since="1996-01-01", before="1998-01-01", min_confidence=0.95)
_SQL_FILTER = "observed_at >= '1996-01-01' AND observed_at < '1998-01-01' AND confidence >= 0.95"
_REL = "rl AS (SELECT least(source, target) AS source, greatest(source, target) AS target, relationship_type, avg(weight) AS weight, count(DISTINCT tu) AS n_tu, max(observed_at) AS observed_at, min(confidence) AS confidence FROM rr GROUP BY 1, 2, 3)"
_BOTH = "nb AS (SELECT source AS a, target AS b FROM rl UNION ALL SELECT target, source FROM rl)"
_DEG = "dg AS (SELECT a AS name, count(*) AS degree FROM nb GROUP BY a)"
_MEMBERS = "mb AS (SELECT name, category AS community FROM fo)"
#: Edges of the folder graph: a customer and a supplier of whom it ordered.
_TRADE = "tr AS (SELECT c AS source, s AS target, count(*) AS weight FROM tu GROUP BY c, s)"


def _relationships(spark, d: str, units: bool = False) -> DataFrame:
    return graph.rollup_relationships(G.raw_relationships(spark, d), units)


def _trade(spark, d: str) -> DataFrame:
    return G.text_units(spark, d).groupBy(F.col("c").alias("source"), F.col("s").alias("target")).agg(F.count("*").alias("weight"))


def _members(spark, d: str) -> DataFrame:
    return G.folders(spark, d).select("name", F.col("category").alias("community"))


@query(with_sql("tu") + f"SELECT tu, doc, observed_at, confidence FROM tu WHERE {_SQL_FILTER}")
def recall_text_units(spark, d):
    return G.text_units(spark, d).where(_FILTER.provenance()).select("tu", "doc", "observed_at", "confidence")


@query(with_sql("tu", "re") + f"SELECT DISTINCT name, type FROM re WHERE {_SQL_FILTER} AND type IN ('PART', 'SUPPLIER')")
def recall_entities(spark, d):
    f = recall.RecallFilter(_FILTER.since, _FILTER.before, types=["part", "supplier"], min_confidence=_FILTER.min_confidence)
    return G.raw_entities(spark, d).where(f.entities()).select("name", "type").distinct()


@query(with_sql("tu", "re", "rr") + f", {_REL}, ok AS (SELECT DISTINCT name FROM re WHERE {_SQL_FILTER}) SELECT source, target, relationship_type FROM rl WHERE source IN (FROM ok) AND target IN (FROM ok)")
def recall_relationships(spark, d):
    kept = G.raw_entities(spark, d).where(_FILTER.provenance())
    return recall.relationships_within(_relationships(spark, d).select("source", "target", "relationship_type"), kept)


@query("SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderkey")
def recall_documents(spark, d):
    docs = G.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed_at"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("category"), F.array("o_orderpriority").alias("tags"))
    f = recall.RecallFilter(since="1997-01-01", tags=["1-URGENT", "2-HIGH"])
    li = G.table(spark, d, "lineitem")
    return li.join(docs.where(f.documents()), li["l_orderkey"] == F.col("id"), "left_semi").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))


@query(with_sql("fo") + "SELECT name, type, category FROM fo WHERE category LIKE 'ASIA/%' OR category = 'EUROPE/NATION_3'")
def category_glob_filter(spark, d):
    f = G.folders(spark, d)
    return f.where(matches_category("ASIA/**", F.col("category")) | matches_category("EUROPE/NATION_3", F.col("category"))).select("name", "type", "category")


@query(with_sql("fo") + "SELECT name, category FROM fo WHERE tag IN ('BUILDING', 'MACHINERY')")
def tag_any_match(spark, d):
    f = recall.RecallFilter(tags=["BUILDING", "MACHINERY"])
    own = G.folders(spark, d).select("name", "category", F.lit(None).cast("string").alias("observed_at"), F.lit(None).cast("double").alias("confidence"), F.array("tag").alias("tags"))
    return own.where(f.documents()).select("name", "category")


@query(with_sql("fo") + "SELECT category, count(*) AS n FROM fo GROUP BY category")
def list_categories(spark, d):
    return G.folders(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query(with_sql("tu", "re") + "SELECT name, min(type) AS type, count(DISTINCT tu) AS n_tu, count(DISTINCT doc) AS n_doc, max(observed_at) AS observed_at, min(confidence) AS confidence, arg_min(source, tu) AS source FROM re GROUP BY name")
def entity_rollup(spark, d):
    return graph.rollup_entities(G.raw_entities(spark, d), nested=True)


@query(with_sql("tu", "rr") + f", {_REL} SELECT * REPLACE (round(weight, 6) AS weight) FROM rl")
def relationship_rollup(spark, d):
    return _relationships(spark, d, units=True).withColumn("weight", F.round("weight", 6))


@query(with_sql("tu", "rr") + f", {_REL}, {_BOTH}, {_DEG} SELECT source, target, relationship_type, x.degree AS source_degree, y.degree AS target_degree, x.degree + y.degree AS rank FROM rl JOIN dg x ON x.name = source JOIN dg y ON y.name = target")
def degree_rank(spark, d):
    return graph.rank_edges(materialise(_relationships(spark, d).select("source", "target", "relationship_type"), "relationships")).select("source", "target", "relationship_type", "source_degree", "target_degree", "rank")


@query(with_sql("tu", "re") + "SELECT type, count(DISTINCT name) AS n FROM re GROUP BY type")
def entity_type_counts(spark, d):
    return G.raw_entities(spark, d).select("type", "name").distinct().groupBy("type").agg(F.count("*").alias("n"))


@query(with_sql("fo") + "SELECT coalesce(type, 'all') AS type, coalesce(category, 'all') AS category, count(*) AS n, round(sum(value), 2) AS total FROM fo GROUP BY CUBE (type, category)")
def type_rollup_cube(spark, d):
    f = G.folders(spark, d).cube("type", "category").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(20,2)")), 2).cast("double").alias("total"))
    return f.select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("category", F.lit("all")).alias("category"), "n", "total")


@query(with_sql("fo") + "SELECT category AS community, count(*) AS size, string_agg(name, '|' ORDER BY name) AS members FROM fo GROUP BY category")
def community_sizes(spark, d):
    return _members(spark, d).groupBy("community").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("members"))


@query(with_sql("tu", "fo") + f", {_MEMBERS}, {_TRADE} SELECT tr.source, tr.target, x.community, CAST(tr.weight AS BIGINT) AS weight FROM tr JOIN mb x ON x.name = source JOIN mb y ON y.name = target AND x.community = y.community")
def community_edges(spark, d):
    return graph.edges_within(_trade(spark, d), _members(spark, d)).select("source", "target", "community", "weight")


@query(with_sql("tu", "fo") + f""", {_MEMBERS}, {_TRADE}, n AS (SELECT source AS a, target AS b FROM tr UNION ALL SELECT target, source FROM tr),
v AS (SELECT a, community, count(*) AS votes FROM n JOIN mb ON mb.name = b GROUP BY a, community),
r AS (SELECT *, sum(votes) OVER (PARTITION BY a) AS neighbours, row_number() OVER (PARTITION BY a ORDER BY votes DESC, community DESC) AS k FROM v)
SELECT a AS name, community, votes, CAST(neighbours AS BIGINT) AS neighbours, round(votes / neighbours, 6) AS ratio FROM r WHERE k = 1""")
def membership_pull(spark, d):
    return graph.pull(materialise(_trade(spark, d), "trade"), _members(spark, d)).withColumn("ratio", F.round("ratio", 6))


@query(with_sql("tu", "fo") + f""", {_MEMBERS}, {_TRADE}, s AS (SELECT community, count(*) AS size FROM mb GROUP BY community),
i AS (SELECT x.community, count(*) AS edges FROM tr JOIN mb x ON x.name = source JOIN mb y ON y.name = target AND x.community = y.community GROUP BY 1)
SELECT community, size, coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / (size * (size - 1) / 2), 6) AS density FROM s LEFT JOIN i USING (community)""")
def folder_density(spark, d):
    return graph.density(_trade(spark, d), _members(spark, d)).withColumn("density", F.round("density", 6))


@query(with_sql("tu") + f", {_TRADE}, m AS (SELECT median(weight) AS m FROM tr) SELECT source, target, CAST(weight AS BIGINT) AS weight FROM tr, m WHERE weight > m")
def edge_weight_median_filter(spark, d):
    t = _trade(spark, d)
    return t.join(F.broadcast(t.agg(F.median("weight").alias("m")))).where("weight > m").select("source", "target", "weight")


_SEEDS = "sd AS (SELECT name FROM fo WHERE type = 'SUPPLIER' AND category LIKE 'EUROPE/%')"


def _seeds(spark, d):
    return G.folders(spark, d).where((F.col("type") == "SUPPLIER") & matches_category("EUROPE/*", F.col("category"))).select("name")


@query(with_sql("tu", "re", "fo") + f", {_SEEDS} SELECT tu, count(DISTINCT name) AS overlap FROM re WHERE name IN (FROM sd) GROUP BY tu")
def mention_gate_overlap(spark, d):
    return G.raw_entities(spark, d).join(_seeds(spark, d), "name", "left_semi").select("tu", "name").distinct().groupBy("tu").agg(F.count("*").alias("overlap"))


_NET = ", g AS (SELECT name FROM fo WHERE category LIKE 'ASIA/%')"


def _asia(spark, d):
    return G.folders(spark, d).where(matches_category("ASIA/**", F.col("category"))).select("name")


@query(with_sql("tu", "fo") + f", {_TRADE}{_NET} SELECT source, target, CAST(weight AS BIGINT) AS weight FROM tr WHERE source IN (FROM g) AND target IN (FROM g)")
def in_network_edges(spark, d):
    return recall.network_edges(_trade(spark, d), _asia(spark, d), True)


@query(with_sql("tu", "fo") + f", {_TRADE}{_NET} SELECT source, target, CAST(weight AS BIGINT) AS weight FROM tr WHERE (source IN (FROM g)) <> (target IN (FROM g))")
def out_network_edges(spark, d):
    return recall.network_edges(_trade(spark, d), _asia(spark, d), False)


@query(with_sql("tu", "fo") + f""", {_TRADE}, n AS (SELECT source AS a, target AS b FROM tr UNION ALL SELECT target, source FROM tr),
s AS (SELECT 'S1' AS name), h1 AS (SELECT DISTINCT b AS name FROM n WHERE a IN (FROM s) AND b NOT IN (FROM s)),
h2 AS (SELECT DISTINCT b AS name FROM n WHERE a IN (FROM h1) AND b NOT IN (FROM s) AND b NOT IN (FROM h1))
SELECT name, 0 AS hop FROM s UNION ALL SELECT name, 1 FROM h1 UNION ALL SELECT name, 2 FROM h2""")
def khop_neighbors_2(spark, d):
    return graph.k_hop(_trade(spark, d), spark.createDataFrame([("S1",)], "name string"), 2)


@query("""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.35),
r AS (SELECT a AS node, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.node = p.a)
SELECT node, min(c) AS component FROM r GROUP BY node""")
def connected_components_of_similar(spark, d):
    return connected_components(ranking.similar_pairs(G.table(spark, d, "embeddings"), 0.35, forest=True), "a", "b")


@query(with_sql("tu", "rr") + f", {_REL}, {_BOTH}, {_DEG} SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM rl) AS edges, round(2.0 * (SELECT count(*) FROM rl) / ((SELECT count(*) FROM dg) * ((SELECT count(*) FROM dg) - 1)), 9) AS density, (SELECT max(degree) FROM dg) AS max_degree")
def graph_summary(spark, d):
    e = materialise(graph.simple_graph(_relationships(spark, d).select("source", "target", "weight")), "simple-graph")
    deg = graph.degrees(e).agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.max("degree").alias("max_degree"))
    return deg.select("nodes", "edges", F.round(2.0 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 9).alias("density"), "max_degree")


@query(with_sql("tu", "rr") + f", {_REL}, {_BOTH}, {_DEG} SELECT name, degree, round(degree / ((SELECT count(*) FROM dg) - 1), 9) AS centrality FROM dg")
def degree_centrality(spark, d):
    deg = graph.degrees(_relationships(spark, d))
    n = deg.agg(F.count("*").alias("n"))
    return deg.join(F.broadcast(n)).select("name", "degree", F.round(F.col("degree") / (F.col("n") - 1), 9).alias("centrality"))


@query(with_sql("tu", "rr") + f", {_REL}, {_BOTH}, {_DEG}, t AS (SELECT name FROM dg ORDER BY degree DESC, name LIMIT 400) SELECT source, target, relationship_type, round(weight, 6) AS weight FROM rl WHERE source IN (FROM t) AND target IN (FROM t)")
def induced_topn_subgraph(spark, d):
    e = materialise(_relationships(spark, d), "relationships")
    return maintain.induced_top(e, graph.degrees(e), 400).select("source", "target", "relationship_type", F.round("weight", 6).alias("weight"))


def _halves(spark, d):
    raw = G.raw_entities(spark, d)
    old, new = raw.where("observed_at < '1998-01-01'"), raw.where("observed_at >= '1998-01-01'")
    return graph.entity_units(old), graph.entity_units(new)


@query(with_sql("tu", "re") + "SELECT name, min(type) AS type, count(DISTINCT tu) AS n_tu, max(observed_at) AS observed_at, min(confidence) AS confidence, coalesce(arg_min(source, tu) FILTER (observed_at < '1998-01-01'), arg_min(source, tu)) AS source FROM re GROUP BY name")
def upsert_entities(spark, d):
    return maintain.upsert_entities(*_halves(spark, d))


@query(with_sql("tu", "rr") + """, x AS (SELECT least(source, target) AS source, greatest(source, target) AS target, relationship_type, avg(weight) FILTER (observed_at < '1998-01-01') AS o, avg(weight) FILTER (observed_at >= '1998-01-01') AS n, max(observed_at) AS observed_at, min(confidence) AS confidence FROM rr GROUP BY 1, 2, 3)
SELECT source, target, relationship_type, round(CASE WHEN o IS NOT NULL AND n IS NOT NULL THEN (o + n) / 2 ELSE coalesce(o, n) END, 6) AS weight, observed_at, confidence FROM x""")
def upsert_relationships(spark, d):
    raw = G.raw_relationships(spark, d)
    old, new = raw.where("observed_at < '1998-01-01'"), raw.where("observed_at >= '1998-01-01'")
    return maintain.upsert_relationships(graph.rollup_relationships(old), graph.rollup_relationships(new)).withColumn("weight", F.round("weight", 6))


@query(with_sql("tu", "re") + "SELECT name, count(DISTINCT tu) AS n_tu FROM re WHERE tu NOT IN (SELECT tu FROM re WHERE confidence < 0.95) GROUP BY name")
def strip_and_prune(spark, d):
    m = G.raw_entities(spark, d)
    return maintain.strip_and_prune(m, m.where("confidence < 0.95").select("tu")).select("name", "tu").distinct().groupBy("name").agg(F.count("*").alias("n_tu"))


@query(with_sql("tu", "rr") + f""", {_REL}, al AS (SELECT 'S' || s_suppkey AS alias, 'S' || (s_suppkey - s_suppkey % 10) AS canonical FROM supplier WHERE s_suppkey % 10 > 0),
x AS (SELECT coalesce(a.canonical, source) AS s, coalesce(b.canonical, target) AS t, relationship_type, weight FROM rl LEFT JOIN al a ON a.alias = source LEFT JOIN al b ON b.alias = target)
SELECT least(s, t) AS source, greatest(s, t) AS target, relationship_type, round(avg(weight), 6) AS weight, count(*) AS merged FROM x WHERE s <> t GROUP BY 1, 2, 3""")
def alias_rewrite_dedup(spark, d):
    k = F.col("s_suppkey")
    al = G.table(spark, d, "supplier").where(k % 10 > 0).select(F.concat(F.lit("S"), k).alias("alias"), F.concat(F.lit("S"), k - k % 10).alias("canonical"))
    return maintain.rewrite_aliases(_relationships(spark, d), al).withColumn("weight", F.round("weight", 6))


def _export_tables(spark, d):
    t = G.text_units(spark, d).select(F.col("tu").alias("id"), F.col("doc").cast("string").alias("document_id"), F.array_distinct(F.array("c", "p", "s")).alias("entity_ids")).distinct()
    nodes = G.folders(spark, d).select(F.col("name").alias("title"), F.explode(F.array(F.struct(F.lit(0).alias("level"), F.split_part("category", F.lit("/"), F.lit(1)).alias("community")), F.struct(F.lit(1).alias("level"), F.col("category").alias("community")))).alias("x")).select("title", "x.*")
    reports = G.table(spark, d, "nation").join(G.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws("/", "r_name", "n_name").alias("community"), F.array("r_name", "n_name").alias("findings"))
    return t, nodes, reports


_EXPORT = """, t AS (SELECT DISTINCT tu AS id, CAST(doc AS VARCHAR) AS doc, unnest([c, p, s]) AS e FROM tu),
cm AS (SELECT r_name || '/' || n_name AS community FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(with_sql("tu", "rr", "fo") + f""", {_REL}{_EXPORT}
SELECT 'RELATED' AS kind, source AS src, target AS dst FROM rl UNION ALL SELECT DISTINCT 'PART_OF', id, doc FROM t UNION ALL SELECT 'HAS_ENTITY', id, e FROM t
UNION ALL SELECT DISTINCT 'MENTIONS', doc, e FROM t UNION ALL SELECT 'IN_COMMUNITY', name, category FROM fo UNION ALL SELECT 'HAS_FINDING', community, community || '#' || i FROM cm, range(2) AS r(i)""")
def property_graph_edges(spark, d):
    t, nodes, reports = _export_tables(spark, d)
    return export.edges(_relationships(spark, d), t, nodes, reports)


@query(with_sql("tu", "re", "fo") + f"""{_EXPORT} SELECT 'document' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'chunk', count(DISTINCT tu) FROM tu UNION ALL SELECT 'entity', count(DISTINCT name) FROM re
UNION ALL SELECT 'community', count(*) FROM cm UNION ALL SELECT 'finding', 2 * count(*) FROM cm""")
def node_kind_counts(spark, d):
    t, _, reports = _export_tables(spark, d)
    docs = G.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    names = G.raw_entities(spark, d).select("name").distinct()
    return export.nodes(docs, t, names, reports.select(F.col("community").alias("id")), reports).groupBy("kind").agg(F.count("*").alias("n"))


_CALLS = "cl AS (SELECT event_type AS tag, user_id AS session, CAST(json_extract(props, '$.k') AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens, round(CAST(json_extract(props, '$.k') AS BIGINT) / 1e6 * 0.15 + floor(value) / 1e6 * 0.6, 12) AS cost_usd, event_id % 3 = 0 AS cache_hit, event_type <> 'error' AS cost_resolved FROM events)"


def _calls(spark, d):
    k, v = F.get_json_object("props", "$.k").cast("long"), F.floor("value").cast("long")
    return G.table(spark, d, "events").select(F.col("event_type").alias("tag"), F.col("user_id").alias("session"), k.alias("prompt_tokens"), v.alias("completion_tokens"), F.round(ledger.cost(k, v, F.lit(0.15), F.lit(0.6)), 12).alias("cost_usd"), (F.col("event_id") % 3 == 0).alias("cache_hit"), (F.col("event_type") != "error").alias("cost_resolved"))


@query(f"WITH {_CALLS} SELECT tag, count(*) AS calls, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(cost_usd), 6) AS cost_usd, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (cost_resolved) AS resolved, count(*) FILTER (NOT cost_resolved) AS unresolved FROM cl GROUP BY tag")
def usage_summary(spark, d):
    return ledger.usage_summary(_calls(spark, d), ["tag"]).withColumn("cost_usd", F.round("cost_usd", 6))


@query(f"WITH {_CALLS} SELECT session, CASE WHEN bool_and(cost_resolved) THEN 'complete' WHEN bool_or(cost_resolved) THEN 'partial' ELSE 'undefined' END AS status FROM cl GROUP BY session")
def pricing_status(spark, d):
    return _calls(spark, d).groupBy("session").agg(ledger.pricing_status(F.col("cost_resolved")).alias("status"))


@query("WITH m AS (SELECT event_type, user_id % 4 AS system, avg(value) AS m FROM events GROUP BY ALL) SELECT system, round(avg(m), 6) AS overall, count(*) AS categories FROM m GROUP BY system")
def category_macro_average(spark, d):
    e = G.table(spark, d, "events").withColumn("system", F.col("user_id") % 4)
    return ledger.macro_average(e, "event_type", "system", "value").withColumn("overall", F.round("overall", 6))


@query("SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observed_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_observation_per_user(spark, d):
    best = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id")).alias("x")
    return G.table(spark, d, "events").groupBy("user_id").agg(best).select("user_id", "x.event_type", F.date_format("x.ts", "yyyy-MM-dd HH:mm:ss").alias("observed_at"))


@query("SELECT c_custkey AS session, coalesce(n, 0) AS messages FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def session_message_counts(spark, d):
    n = G.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return G.table(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("session"), F.coalesce("n", F.lit(0)).alias("messages"))


@query("WITH u AS (SELECT c_nationkey AS k, c_acctbal AS v, 0 AS p FROM customer UNION ALL SELECT s_nationkey, s_acctbal, 1 FROM supplier) SELECT k, v, p FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, v, k) = 1")
def union_distinct_keep_first(spark, d):
    c = G.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).alias("p"))
    s = G.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v"), F.lit(1).alias("p"))
    return c.unionByName(s).groupBy("k").agg(F.min(F.struct("p", "v")).alias("m")).select("k", "m.v", "m.p")


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def except_ids(spark, d):
    gone = G.table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return G.table(spark, d, "part").select("p_partkey").join(gone, "p_partkey", "left_anti").distinct()


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def intersect_ids(spark, d):
    li = G.table(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_partkey").intersect(li.where("l_returnflag = 'A'").select("l_partkey"))


@query("SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-12'")
def list_observations(spark, d):
    e = G.table(spark, d, "events").where("ts >= timestamp'2024-01-10' and ts < timestamp'2024-01-20'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return e.where("b >= timestamp'2024-01-12'").select("user_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "n")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_observations(spark, d):
    from sparkloom.streaming.observations import windowed_counts

    return windowed_counts(G.table(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query(with_sql("fo") + ", s AS (SELECT category, count(*) AS size, 1 AS level FROM fo GROUP BY 1 UNION ALL SELECT split_part(category, '/', 1), count(*), 0 FROM fo GROUP BY 1) SELECT category AS community, size FROM s WHERE level = 1 AND size >= 3")
def community_level_filter(spark, d):
    f = G.folders(spark, d)
    level = lambda c, n: f.groupBy(c.alias("community")).agg(F.count("*").alias("size")).withColumn("level", F.lit(n))
    both = level(F.col("category"), 1).unionByName(level(F.split_part("category", F.lit("/"), F.lit(1)), 0))
    return recall.communities_of_level(both, "finest", 3).select("community", "size")


@query()
def jaro_winkler_aliases(spark, d):
    m = G.raw_entities(spark, d).groupBy("name").agg(F.count("*").alias("mentions"))
    part = G.table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("key"), F.upper(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("label"))
    e = part.join(m, F.col("key") == F.col("name"), "left").groupBy(F.col("label").alias("name")).agg(F.sum(F.coalesce("mentions", F.lit(0))).alias("mentions"))
    return similar.aliases(e.withColumn("type", F.lit("PART")))


@query()
def leiden_partition(spark, d):
    pairs = ranking.similar_pairs(G.table(spark, d, "embeddings"), 0.35)
    return communities.leiden_partition(pairs.select(F.col("a").cast("string").alias("source"), F.col("b").cast("string").alias("target"), F.col("score").alias("weight")))


@query(with_sql("tu", "fo") + f""", {_TRADE}, mb AS (SELECT name, category AS community FROM fo WHERE name LIKE 'S%'), v AS (SELECT source AS a, community, count(*) AS n FROM tr JOIN mb ON mb.name = target GROUP BY ALL)
SELECT name, community FROM mb UNION ALL SELECT a, arg_max(community, (n, community)) FROM v GROUP BY a""")
def label_propagation(spark, d):
    return communities.label_propagation(_trade(spark, d), _members(spark, d).where(F.col("name").startswith("S")), cap=10_000_000)


@query()
def modularity_split(spark, d):
    f = G.folders(spark, d).select("name", F.split_part("category", F.lit("/"), F.lit(1)).alias("community"))
    out = communities.split_folder(_trade(spark, d), f)
    return out.select("community", F.size("part_a").alias("size_a"), F.size("part_b").alias("size_b"), "within", "between", F.round("ratio", 6).alias("ratio"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events QUALIFY back <= 5")
def recent_messages(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return G.table(spark, d, "events").withColumn("back", F.row_number().over(w)).where("back <= 5").select("user_id", "event_id", "back")


@query("""WITH x AS (SELECT n_nationkey AS id, lower(r_name) AS path, lower(n_name) AS title, 'maps/' || r_name || '/' || n_nationkey || '.md' AS mapped FROM nation JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT unnest(['7', 'Asia', 'Nation_1', 'maps/EUROPE', 'nowhere']) AS wanted), t AS (SELECT wanted, id, CASE WHEN CAST(id AS VARCHAR) = wanted THEN 0 WHEN contains(path, lower(wanted)) THEN 1 WHEN contains(title, lower(wanted)) THEN 2 WHEN contains(lower(mapped), lower(wanted)) THEN 3 END AS tier FROM x, w)
SELECT wanted, id, tier FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY wanted)""")
def document_resolution(spark, d):
    docs = G.table(spark, d, "nation").join(G.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("path"), F.col("n_name").alias("title"))
    mapping = docs.select("id", F.concat(F.lit("maps/"), "path", F.lit("/"), F.col("id").cast("string"), F.lit(".md")).alias("mapped"))
    found = [recall.resolve_documents(docs, x, mapping=mapping).select(F.lit(x).alias("wanted"), "id", "tier") for x in ("7", "Asia", "Nation_1", "maps/EUROPE", "nowhere")]
    return reduce(DataFrame.unionByName, found)


@query(with_sql("tu", "fo") + f", {_MEMBERS}, {_SEEDS} SELECT DISTINCT r_name || '/' || n_name AS community FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name || '/' || n_name IN (SELECT community FROM mb WHERE name IN (FROM sd))")
def relevant_reports(spark, d):
    _, nodes, reports = _export_tables(spark, d)
    return recall.relevant_reports(reports, nodes, _seeds(spark, d)).select("community")


@query(with_sql("tu", "re", "fo") + f""", {_TRADE}, {_SEEDS}, nr AS (SELECT DISTINCT source AS name FROM tr WHERE target IN (FROM sd)),
w AS (SELECT name, 2.0 AS w FROM sd UNION ALL SELECT name, 0.5 FROM nr WHERE name NOT IN (FROM sd)), m AS (SELECT DISTINCT tu, name FROM re),
h AS (SELECT tu, count(*) AS n FROM tu WHERE source = '1-URGENT' GROUP BY tu)
SELECT tu, round(sum(w) + 3 * coalesce(any_value(n), 0), 6) AS score FROM m JOIN w USING (name) LEFT JOIN h USING (tu) GROUP BY tu""")
def graph_keyword_rank(spark, d):
    seeds = _seeds(spark, d)
    near = _trade(spark, d).join(seeds.select(F.col("name").alias("target")), "target", "left_semi").select(F.col("source").alias("name")).distinct()
    hits = G.text_units(spark, d).where("source = '1-URGENT'").groupBy("doc", "tu").agg(F.count("*").alias("n"))
    return ranking.graph_keyword_rank(G.raw_entities(spark, d), seeds, near, hits, within=["doc"]).withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.35),
r AS (SELECT a AS node, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.node = p.a), k AS (SELECT node, min(c) AS component FROM r GROUP BY node),
s AS (SELECT component, count(*) AS size FROM k GROUP BY component ORDER BY size DESC, component LIMIT 1) SELECT node FROM k WHERE component = (SELECT component FROM s)""")
def largest_component(spark, d):
    labels = materialise(connected_components(ranking.similar_pairs(G.table(spark, d, "embeddings"), 0.35, forest=True), "a", "b"), "labels")
    best = labels.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    return labels.join(F.broadcast(best), "component").select("node")


@query("""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.35),
r AS (SELECT a AS node, a AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.node = p.a), k AS (SELECT node, min(c) AS component FROM r GROUP BY node),
s AS (SELECT component, count(*) AS size FROM k GROUP BY component) SELECT count(*) AS components, max(size) AS largest FROM s""")
def component_summary(spark, d):
    return graph.component_summary(ranking.similar_pairs(G.table(spark, d, "embeddings"), 0.35, forest=True).select(F.col("a").alias("source"), F.col("b").alias("target")))


@query("SELECT 'orders' AS \"table\", count(*) AS rows, 6 AS columns FROM orders UNION ALL SELECT 'events', count(*), 6 FROM events UNION ALL SELECT 'nation', count(*), 3 FROM nation")
def run_summary(spark, d):
    from sparkloom.operators.cache import run_summary as summary

    return summary({t: G.table(spark, d, t) for t in ("orders", "events", "nation")})
