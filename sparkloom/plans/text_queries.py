"""Vector, keyword, fusion, chunking and context queries over documents, embeddings and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import communities, context, graph, ranking
from sparkloom.plans.registry import query
from sparkloom.session import materialise
from sparkloom.sources import graph_tables as G

_VEC = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS q FROM v ORDER BY vec_id LIMIT 1) "


def _query_vector(spark, d) -> list[float]:
    return list(G.table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"])


@query(_VEC + "SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS score FROM v, q ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    return ranking.vector_top_k(G.table(spark, d, "embeddings"), _query_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(_VEC + "SELECT vec_id, label, round(list_cosine_similarity(e, q), 6) AS score FROM v, q WHERE label IN (1, 3) ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10")
def vector_topk_prefiltered(spark, d):
    return ranking.vector_top_k(G.table(spark, d, "embeddings"), _query_vector(spark, d), 10, where=F.col("label").isin(1, 3)).select("vec_id", "label", F.round("score", 6).alias("score"))


@query(_VEC + "SELECT x.vec_id AS a, y.vec_id AS b, round(list_cosine_similarity(x.e, y.e), 6) AS score FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.35")
def cosine_pairs_threshold(spark, d):
    return ranking.similar_pairs(G.table(spark, d, "embeddings"), 0.35).select("a", "b", F.round("score", 6).alias("score"))


_CENTROID = "c AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) AS r(i) GROUP BY label, i)"


def _centroids(spark, d) -> DataFrame:
    e = G.table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return e.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.avg(F.col("x").cast("double")).alias("x"))


@query(_VEC + f", {_CENTROID} SELECT label, i, round(x, 6) AS x FROM c")
def label_centroids(spark, d):
    return _centroids(spark, d).withColumn("x", F.round("x", 6))


@query(_VEC + f""", {_CENTROID}, p AS (SELECT a.label AS a, b.label AS b, sqrt(sum((a.x - b.x) ** 2)) AS dist FROM c a JOIN c b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2)
SELECT a, b, round(dist, 6) AS dist FROM p""")
def centroid_distances(spark, d):
    c = _centroids(spark, d)
    a, b = c.select("i", F.col("label").alias("a"), F.col("x").alias("xa")), c.select("i", F.col("label").alias("b"), F.col("x").alias("xb"))
    return a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.round(F.sqrt(F.sum((F.col("xa") - F.col("xb")) ** 2)), 6).alias("dist"))


@query(_VEC.replace("WITH v", "WITH RECURSIVE v") + f""", {_CENTROID}, p AS MATERIALIZED (SELECT a.label AS a, b.label AS b FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2 HAVING round(sqrt(sum((a.x - b.x) ** 2)), 6) <= 0.25),
r AS (SELECT a AS node, least(a, b) AS c FROM p UNION SELECT p.b, r.c FROM r JOIN p ON r.node = p.a), k AS (SELECT node, min(c) AS component FROM r GROUP BY node)
SELECT label AS community, coalesce('merged-' || component, 'misc') AS merged FROM (SELECT DISTINCT label FROM v) LEFT JOIN k ON node = label""")
def small_community_merge(spark, d):
    pairs = centroid_distances(spark, d).where("dist <= 0.25")
    return communities.merge_small(pairs, G.table(spark, d, "embeddings").select(F.col("label").alias("community")).distinct())


_BM = r"""WITH qt AS (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 1)),
q AS (SELECT word, count(*) AS times FROM qt GROUP BY word),
s AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
tot AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM s),
tf AS (SELECT doc_id, len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM s) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
bm AS (SELECT doc_id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS bm25 FROM tf JOIN q USING (word) JOIN df USING (word), tot GROUP BY doc_id) """


def _bm25(spark, d) -> DataFrame:
    first = G.table(spark, d, "benchmark").orderBy("item_id").limit(1)
    return ranking.bm25(G.table(spark, d, "documents"), first.select(F.explode(T.words("text")).alias("word")))


@query(_BM + "SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY bm25 DESC, doc_id LIMIT 50")
def bm25_topk(spark, d):
    return _bm25(spark, d).select(F.col("id").alias("doc_id"), F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(50)


#: Documents and vectors share their ids where both exist.
_HY = """, v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), qv AS (SELECT e AS q FROM v ORDER BY vec_id LIMIT 1),
cs AS (SELECT vec_id, label, list_cosine_similarity(e, q) AS cos FROM v, qv),
hs AS (SELECT coalesce(doc_id, vec_id) AS id, coalesce(bm25, 0) AS bm25, coalesce(cos, 0) AS cos FROM bm FULL JOIN cs ON doc_id = vec_id),
hy AS (SELECT id, bm25 / (SELECT max(bm25) FROM hs) + cos / (SELECT max(cos) FROM hs) AS score FROM hs) """


def _cosines(spark, d) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    return G.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", ranking.cosine(F.col("embedding"), q).alias("cos"))


def _hybrid(spark, d, bm25: DataFrame | None = None) -> DataFrame:
    both = (bm25 or _bm25(spark, d)).join(_cosines(spark, d).select("id", "cos"), "id", "full_outer").select("id", F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("cos", F.lit(0.0)).alias("cos"))
    return ranking.normalised(both, "bm25", "cos").select("id", (F.col("bm25") + F.col("cos")).alias("score"))


@query(_BM + _HY + "SELECT id, round(score, 6) AS score FROM hy")
def hybrid_score(spark, d):
    return _hybrid(spark, d).withColumn("score", F.round("score", 6))


@query(_BM + _HY + """, g AS (SELECT vec_id FROM v WHERE label = 2), r AS (SELECT id, score FROM hy WHERE id NOT IN (SELECT vec_id FROM g) ORDER BY round(score, 9) DESC, id LIMIT 20)
SELECT id, round(score, 6) AS score, FALSE AS rescued FROM hy WHERE id IN (SELECT vec_id FROM g) UNION ALL SELECT id, round(score, 6), TRUE FROM r""")
def cascade_rescue(spark, d):
    gate = G.table(spark, d, "embeddings").where("label = 2").select(F.col("vec_id").alias("id"))
    return ranking.cascade(_hybrid(spark, d).withColumn("score", F.round("score", 9)), gate, 20).withColumn("score", F.round("score", 6))


#: Three paths of 50 ranks each: keywords, vectors, hybrid.
_RRF = _BM + _HY + """, al AS (SELECT 'bm25' AS path, doc_id AS id, round(bm25, 9) AS score FROM bm UNION ALL SELECT 'cosine', vec_id, round(cos, 9) FROM cs UNION ALL SELECT 'hybrid', id, round(score, 9) FROM hy),
li AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, id) - 1 AS rank FROM al QUALIFY rank < 50) """


def _lists(spark, d) -> DataFrame:
    def top(df: DataFrame, path: str, by: str) -> DataFrame:
        return ranking.ranked(df.select("id", F.round(by, 9).alias("score")), "score", keep=50).withColumn("path", F.lit(path))

    bm25 = materialise(_bm25(spark, d), "bm25-scores")
    lists = top(bm25, "bm25", "bm25").unionByName(top(_cosines(spark, d), "cosine", "cos")).unionByName(top(_hybrid(spark, d, bm25), "hybrid", "score"))
    return materialise(lists, "ranked-lists")


@query(_RRF + "SELECT id, round(sum(1 / (60 + rank + 1)), 9) AS score FROM li GROUP BY id")
def rrf_uniform(spark, d):
    return ranking.fuse(_lists(spark, d)).withColumn("score", F.round("score", 9))


@query(_RRF + "SELECT id, round(sum(CASE path WHEN 'cosine' THEN 2.0 WHEN 'bm25' THEN 0.5 ELSE 1.0 END / (60 + rank + 1)), 9) AS score FROM li GROUP BY id")
def rrf_weighted(spark, d):
    return ranking.fuse(_lists(spark, d), weights={"cosine": 2.0, "bm25": 0.5}).withColumn("score", F.round("score", 9))


@query(_RRF + "SELECT id, round(sum(1 / (60 + rank + 1)), 9) AS score FROM li WHERE id IN (SELECT id FROM li WHERE path = 'cosine' AND rank < 5) GROUP BY id")
def rrf_topk_gated(spark, d):
    return ranking.fuse_gated(_lists(spark, d), "cosine", 5).withColumn("score", F.round("score", 9))


@query(_RRF + "SELECT id, round(sum(1 / (60 + rank + 1)) * CASE WHEN count(DISTINCT path) >= 2 THEN 1.5 ELSE 0.5 END, 9) AS score FROM li GROUP BY id")
def rrf_quorum(spark, d):
    return ranking.fuse_quorum(_lists(spark, d)).withColumn("score", F.round("score", 9))


@query(_RRF + ", b AS (SELECT path, max(score) AS best FROM li GROUP BY path) SELECT id, round(sum(CASE WHEN best > 0 THEN score / best ELSE 0 END / (60 + rank + 1)), 9) AS score FROM li JOIN b USING (path) GROUP BY id")
def rrf_score_weighted(spark, d):
    return ranking.fuse_scores(_lists(spark, d)).withColumn("score", F.round("score", 9))


@query(_RRF + """, l AS (SELECT path, max(score) FILTER (rank = 0) AS a, max(score) FILTER (rank = 2) AS c FROM li GROUP BY path)
SELECT id, round(sum(CASE WHEN a > 0 AND (a - coalesce(c, 0)) / a > 0.15 THEN 2.0 ELSE 1.0 END / (60 + rank + 1)), 9) AS score FROM li JOIN l USING (path) GROUP BY id""")
def rrf_confidence_gated(spark, d):
    return ranking.fuse_confident(_lists(spark, d)).withColumn("score", F.round("score", 9))


@query("SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%license%' OR lower(text) LIKE '%copyright%' OR lower(text) LIKE '%idiot%'")
def keyword_filter(spark, d):
    low = F.lower("text")
    hit = low.contains("license") | low.contains("copyright") | low.contains("idiot")
    return G.table(spark, d, "documents").where(hit).select("doc_id", "lang")


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS BIGINT) AS n_tokens FROM documents")
def token_counts(spark, d):
    return G.table(spark, d, "documents").select("doc_id", T.count_tokens(F.coalesce("text", F.lit(""))).alias("n_tokens"))


_CONV = r"c AS (SELECT conv_id, turn, role, text, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) AS BIGINT) AS cost FROM conversations)"


@query(f"WITH {_CONV}, u AS (SELECT *, 20 + sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM c) SELECT conv_id, turn, cost, CAST(used AS BIGINT) AS used FROM u WHERE used <= 600")
def token_budget_prefix(spark, d):
    c = G.table(spark, d, "conversations").withColumn("cost", T.count_tokens("text"))
    return context.budget_prefix(c, "cost", 600, ["turn"], ["conv_id"], 20).select("conv_id", "turn", "cost", "used")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS tail, count(*) AS n_turns FROM (SELECT * FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2) GROUP BY conv_id")
def conversation_tail(spark, d):
    return context.conversation_tail(G.table(spark, d, "conversations"), 2)


@query(f"""WITH RECURSIVE {_CONV}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM c),
f AS (SELECT conv_id, turn, cost, i, cost AS used, 1 AS n, 0 AS batch FROM o WHERE i = 1
UNION ALL SELECT o.conv_id, o.turn, o.cost, o.i, CASE WHEN f.used + o.cost > 300 OR f.n >= 3 THEN o.cost ELSE f.used + o.cost END, CASE WHEN f.used + o.cost > 300 OR f.n >= 3 THEN 1 ELSE f.n + 1 END, CASE WHEN f.used + o.cost > 300 OR f.n >= 3 THEN f.batch + 1 ELSE f.batch END
FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1) SELECT conv_id, turn, cost, batch FROM f""")
def greedy_batches(spark, d):
    c = G.table(spark, d, "conversations").withColumn("cost", T.count_tokens("text"))
    return context.greedy_batches(c, "cost", 300, 3, ["turn"], ["conv_id"]).select("conv_id", "turn", "cost", "batch")


_CHUNKS = r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]') AS t FROM documents),
k AS (SELECT doc_id, t, CAST(unnest(range(0, greatest(CAST(ceil((len(t) - 200) / 180) AS BIGINT), 0) + 1)) AS BIGINT) AS chunk FROM t WHERE len(t) > 0) """


@query(_CHUNKS + "SELECT doc_id, chunk, chunk * 180 AS start, len(list_slice(t, chunk * 180 + 1, chunk * 180 + 200)) AS n_tokens, md5(array_to_string(list_slice(t, chunk * 180 + 1, chunk * 180 + 200), ' ')) AS digest FROM k")
def chunk_windows(spark, d):
    c = context.chunk_windows(G.table(spark, d, "documents"), T.tokens("text"), 200, 20)
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("start").cast("long").alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("text").alias("digest"))


@query("""WITH l AS (SELECT doc_id, length(text) + 2 AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, CAST(sum(n) OVER (PARTITION BY doc_id % 64 ORDER BY doc_id) AS BIGINT) AS de, n, doc_id % 64 AS part FROM l),
m AS (SELECT part, max(de) AS total FROM s GROUP BY part), c AS (SELECT part, CAST(unnest(range(0, total, 5000)) AS BIGINT) AS cs FROM m)
SELECT c.part, cs, doc_id FROM c JOIN s ON c.part = s.part AND de - n < cs + 5000 AND de > cs""")
def chunk_doc_interval_join(spark, d):
    from pyspark.sql import Window

    docs = G.table(spark, d, "documents").where("text is not null").select("doc_id", (F.length("text") + 2).cast("long").alias("n"), (F.col("doc_id") % 64).alias("part"))
    spans = docs.withColumn("de", F.sum("n").over(Window.partitionBy("part").orderBy("doc_id"))).withColumn("ds", F.col("de") - F.col("n"))
    chunks = spans.groupBy("part").agg(F.max("de").alias("total")).select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(5000).cast("long"))).alias("cs")).withColumn("ce", F.col("cs") + 5000)
    far = 1 << 40  # every part has a line of its own
    moved = lambda df, *cs: df.withColumns({c: F.col(c) + F.col("part") * far for c in cs})
    out = context.interval_join(moved(chunks, "cs", "ce"), moved(spans, "ds", "de").drop("part", "n"), 5000)
    return out.select("part", (F.col("cs") - F.col("part") * far).alias("cs"), "doc_id")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '\\.(html|htm|txt|md)$') THEN 'text' ELSE 'unknown' END AS kind FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)")
def data_types(spark, d):
    return G.table(spark, d, "pages").select("page_id", T.data_type(F.regexp_replace("url", "[?#].*$", "")).alias("kind"))


@query("SELECT n_nationkey AS id, kind, name, type, source, target, weight FROM (SELECT n_nationkey, 'entity' AS kind, upper(n_name) AS name, 'NATION' AS type, NULL AS source, NULL AS target, NULL::DOUBLE AS weight FROM nation UNION ALL SELECT n_nationkey, 'relationship', NULL, 'LIES_IN', least(upper(n_name), upper(r_name)), greatest(upper(n_name), upper(r_name)), CASE WHEN n_nationkey % 2 = 0 THEN 2.5 ELSE 1.0 END FROM nation JOIN region ON n_regionkey = r_regionkey)")
def parse_extraction_records(spark, d):
    n = G.table(spark, d, "nation").join(G.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    weight = F.when(F.col("n_nationkey") % 2 == 0, "2.5").otherwise("often")
    reply = F.format_string('noise<extracted_data>("entity"<|>%s<|>nation<|>A nation<|>where?;who?)##("relationship"<|>%s<|>%s<|>lies in<|>It lies there<|>%s)</extracted_data>tail', F.lower("n_name"), "n_name", "r_name", weight)
    return graph.parse_records(n.select("n_nationkey", reply.alias("reply")), "reply", "n_nationkey").select("id", "kind", "name", "type", "source", "target", "weight")


@query("SELECT DISTINCT vec_id AS id, doc_id, lang || '/' || source AS title FROM embeddings JOIN documents ON doc_id = vec_id")
def source_references(spark, d):
    docs = G.table(spark, d, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("title"))
    return G.table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).join(docs, F.col("id") == F.col("doc_id")).select("id", "doc_id", "title").distinct()


@query("WITH s AS (SELECT doc_id, substr(sha1(text), 1, 24) AS id FROM documents WHERE text IS NOT NULL) SELECT doc_id, id FROM s")
def stable_ids(spark, d):
    return G.table(spark, d, "documents").where("text is not null").select("doc_id", T.stable_id("text").alias("id"))


@query(_RRF + ", g AS (SELECT vec_id FROM v WHERE label = 4) SELECT p.path, coalesce(min(li.rank) + 1, -1) AS rank FROM (SELECT DISTINCT path FROM li) p LEFT JOIN li ON li.path = p.path AND li.id IN (SELECT vec_id FROM g) GROUP BY p.path")
def answer_rank(spark, d):
    right = G.table(spark, d, "embeddings").where("label = 4").select(F.col("vec_id").alias("id"))
    return ranking.answer_rank(_lists(spark, d), right).select("path", F.coalesce("rank", F.lit(-1)).cast("long").alias("rank"))
