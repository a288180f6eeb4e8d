"""Library operators on small literal tables; queries against their SQL."""

import random
from datetime import datetime, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as T
from sparkloom.operators import communities, context, graph, maintain, ranking, recall, search, similar
from sparkloom.operators.components import connected_components
from sparkloom.plans import catalog
from sparkloom.schemas import SCHEMAS, conform, needs_migration
from sparkloom.sources import files
from sparkloom.streaming import observations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _rows(frame, columns):
    own = frame[columns].astype(object)
    return sorted(map(str, own.where(own.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got, sorted(got.columns)) == _rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_times():
    now = datetime(2026, 6, 1, 12, tzinfo=timezone.utc)
    assert [T.normalize_time(x, now) for x in ("1h", "7 days ago", "now", "2026-01-01", None)] == ["2026-06-01T11:00:00Z", "2026-05-25T12:00:00Z", "2026-06-01T12:00:00Z", "2026-01-01", None]


def test_filter_masks(spark):
    d = spark.createDataFrame([(1, None, None, "work/clients/acme", ["pricing"]), (2, "2026-05-30", 0.6, "personal/family", ["pricing"]), (3, "2026-05-29", 0.95, None, None)], "id int, observed_at string, confidence double, category string, tags array<string>")
    ids = lambda f: [r["id"] for r in d.where(f.documents()).orderBy("id").collect()]
    assert ids(recall.RecallFilter(since="2026-05-30")) == [2] and ids(recall.RecallFilter(before="2026-05-30")) == [1, 3]
    assert ids(recall.RecallFilter(min_confidence=0.8)) == [1, 3] and ids(recall.RecallFilter(category="work/**")) == [1]
    assert ids(recall.RecallFilter(tags=["pricing"])) == [1, 2] and recall.RecallFilter().is_empty
    assert recall.RecallFilter().candidate_text_units(d, d) is None


def test_records(spark):
    r = spark.createDataFrame([(1, '<extracted_data>("entity"<|>Alice<|>person<|>Lead<|>who?;where?)##("relationship"<|>Bob<|>Alice<|>knows<|>works at<|>x)</extracted_data>tail')], "id int, t string")
    a, b = graph.parse_records(r, "t", "id").orderBy("ord").collect()
    assert (a["name"], a["type"], a["queries"]) == ("ALICE", "PERSON", ["who?", "where?"])
    assert (b["source"], b["target"], b["type"], b["description"], b["weight"]) == ("ALICE", "BOB", "KNOWS", "works at", 1.0)


def test_schema_conforming(spark):
    old = spark.createDataFrame([("r", "A", "B", "WORKS_AT", None), ("s", "A", "C", None, 2.0)], "id string, source string, target string, type string, weight double")
    new = conform(old, "relationships")
    assert needs_migration(old, "relationships") and not needs_migration(new, "relationships") and new.columns == SCHEMAS["relationships"].names
    assert [(r["relationship_type"], r["confidence"]) for r in new.orderBy("id").collect()] == [("WORKS_AT", 1.0), ("RELATED", 1.0)]
    assert conform(new, "relationships").collect() == new.collect() and conform(old, "unknown") is old


def test_jaro_winkler(spark):
    assert round(T.jaro_winkler_value("DR_SMITH", "DR_SMTH"), 3) == 0.975 and T.jaro_winkler_value("", "A") == 0 and T.jaro_winkler_value("A", "A") == 1
    e = spark.createDataFrame([("DR_SMITH", "PERSON", 2), ("DR_SMTH", "PERSON", 1), ("ACME", "PERSON", 1), ("ACME", "ORGANIZATION", 1)], "name string, type string, mentions int")
    assert [(r["canonical"], r["alias"]) for r in similar.aliases(e).collect()] == [("DR_SMITH", "DR_SMTH")]


def test_ranking(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in ranking.vector_top_k(v, [1.0, 0.0], 5).collect()] == [1, 3, 2, 5, 4]
    assert [r["vec_id"] for r in ranking.vector_top_k(v, [1.0, 0.0], 3, where=F.col("vec_id").isin(2, 4)).collect()] == [2, 4]
    lists = spark.createDataFrame([("x", "a", 0, 1.0), ("x", "b", 1, 0.5), ("y", "b", 0, 1.0), ("y", "c", 1, 0.5)], "path string, id string, rank int, score double")
    fused = {r["id"]: r["score"] for r in ranking.fuse(lists).collect()}
    assert fused == pytest.approx({"b": 1 / 62 + 1 / 61, "a": 1 / 61, "c": 1 / 62})
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([("a",)], "word string")
    assert {r["id"] for r in ranking.bm25(docs, q).collect()} == {1, 2}
    pairs = {(r["a"], r["b"]) for r in ranking.similar_pairs(v, 0.7, block_rows=1).collect()}
    assert pairs == {(1, 3), (2, 3)}


def test_context(spark):
    c = spark.createDataFrame([(0, 1, 3), (0, 2, 4), (0, 3, 2)], "k int, i int, cost long")
    assert context.budget_prefix(c, "cost", 8, ["i"], ["k"]).count() == 2
    assert [r["batch"] for r in context.greedy_batches(c, "cost", 6, 9, ["i"], ["k"]).orderBy("i").collect()] == [0, 1, 1]
    d = spark.createDataFrame([(1, "w " * 45), (2, ""), (3, "one")], "doc_id int, text string")
    got = [(r["doc_id"], r["start"], r["n_tokens"]) for r in context.chunk_windows(d, T.tokens("text"), 20, 5).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, 20), (1, 15, 20), (1, 30, 15), (3, 0, 1)]
    with pytest.raises(ValueError):
        context.chunk_windows(d, T.tokens("text"), 5, 5)


def test_upserts_and_merges(spark):
    keys = "source string, target string, relationship_type string, weight double, observed_at string, confidence double"
    step = spark.createDataFrame([("A", "B", "R", 1.0, "2026-01-01", 0.9)], keys)
    for w in (3.0, 3.0):
        step = maintain.upsert_relationships(step, spark.createDataFrame([("A", "B", "R", w, "2026-02-01", 1.0)], keys))
    assert [(r["weight"], r["observed_at"], r["confidence"]) for r in step.collect()] == [(2.5, "2026-02-01", 0.9)]
    m = spark.createDataFrame([("E", "t1"), ("E", "t2"), ("F", "t1")], "name string, tu string")
    assert [tuple(r) for r in maintain.strip_and_prune(m, spark.createDataFrame([("t1",)], "tu string")).select("name", "tu").collect()] == [("E", "t2")]
    e = spark.createDataFrame([("BERLIN", "DR_SMITH", "IN", 1.0), ("BERLIN", "DR_SMTH", "IN", 2.0), ("DR_SMITH", "DR_SMTH", "IS", 1.0)], "source string, target string, relationship_type string, weight double")
    a = spark.createDataFrame([("DR_SMTH", "DR_SMITH")], "alias string, canonical string")
    assert [tuple(r) for r in maintain.rewrite_aliases(e, a).collect()] == [("BERLIN", "DR_SMITH", "IN", 1.5, 2)]


def _cliques(spark):
    edges = [(f"{c}{i}", f"{c}{j}", 1.0) for c in "AB" for i in range(4) for j in range(i)] + [("A0", "B0", 1.0)]
    return edges, spark.createDataFrame(edges, "source string, target string, weight double")


def test_communities(spark):
    edges, df = _cliques(spark)
    found = communities.leiden(edges)
    assert len(set(found.values())) == 2 and len({found[f"A{i}"] for i in range(4)}) == 1
    assert communities.modularity(communities._adjacency(edges), found) > 0.4
    rows = communities.leiden_partition(df, max_size=3).where("level = 0").collect()
    assert len(rows) == 8 and len({r["name"] for r in rows}) == 8
    split = communities.split_folder(df, df.select(F.col("source").alias("name")).union(df.select("target")).distinct().withColumn("community", F.lit("big"))).collect()
    assert [(r["within"], r["between"], round(r["ratio"], 6)) for r in split] == [(12, 1, round(1 / 13, 6))]
    seeds = spark.createDataFrame([("A0", "x"), ("B0", "y")], "name string, community string")
    sizes = {r["community"]: r["count"] for r in communities.label_propagation(df, seeds, cap=4).groupBy("community").count().collect()}
    assert set(sizes) == {"x", "y"} and max(sizes.values()) <= 4


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_components(spark, partitions):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 100), (7, 3), (None, 4)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: i // 20 * 20 for i in range(60)} | {100: 100}


def test_density_and_pull(spark):
    _, df = _cliques(spark)
    members = spark.createDataFrame([(f"A{i}", "f") for i in range(4)] + [("B0", "g")], "name string, community string")
    d = {r["community"]: r["density"] for r in graph.density(df, members).collect()}
    assert d == {"f": 1.0, "g": 0.0}
    pulled = {r["name"]: (r["community"], r["ratio"]) for r in graph.pull(df, members).collect()}
    assert pulled["A0"] == ("f", 0.75) and pulled["B0"][0] == "f"


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: Hi\ncategory: w\ntags: [meeting, Q2]\nobserved_at: '2026-05-27T15:30:00Z'\nconfidence: 0.9\ncustom_field: hello\n---\nbody")
    (tmp_path / "b.txt").write_bytes(b"x\xff")
    (tmp_path / ".hidden.md").write_text("no")
    (tmp_path / "c.png").write_bytes(b"no")
    (tmp_path / "d.md").write_text("---\n- a\n---\nlist")
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.with_frontmatter(files.read_files(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"a.md", "b.txt", "d.md"} and got["b.txt"]["text"] == "x�" and got["d.md"]["title"] is None
    a = got["a.md"]
    assert (a["title"], a["tags"], a["confidence"], a["attributes"], a["text"], a["observed_at"]) == ("Hi", ["meeting", "Q2"], 0.9, '{"custom_field": "hello"}', "body", "2026-05-27T15:30:00Z")
    root = f"file://{tmp_path}/store"
    for run, n in (("1", 3), ("2", 5)):
        files.publish({"t": spark.range(n)}, root, run)
        assert files.current(spark, root, "t").count() == n


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = observations.observations(spark, f"file://{tmp_path}/in", events.schema.simpleString()[7:-1].replace(":", " "))
    for name, df in (("last", observations.last_folder(stream)), ("windows", observations.windowed_counts(stream, late="60 days"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start()
        q.awaitTermination(180)
    latest = {r["user_id"]: r["event_type"] for r in spark.sql("select user_id, max_by(event_type, ts) event_type from last group by user_id").collect()}
    assert latest == {r["user_id"]: r["event_type"] for r in events.groupBy("user_id").agg(F.max_by("event_type", "ts").alias("event_type")).collect()}
    assert spark.sql("select sum(n) from (select start, event_type, max(n) n from windows group by 1, 2)").first()[0] == events.count()


def test_search_modes(spark):
    prov = "observed_at string, confidence double, source string"
    ents = spark.createDataFrame([("1", "ALICE", "PERSON", "lead", 2, [1.0, 0.0], ["w"], None, 1.0, "s"), ("2", "ACME", "ORG", "firm", 1, [0.0, 1.0], ["w"], None, 1.0, "s")], f"id string, name string, type string, description string, degree int, description_embedding array<double>, community_ids array<string>, {prov}")
    rels = spark.createDataFrame([("r", "ALICE", "ACME", "WORKS_AT", "works", 1.0, 3, None, 1.0)], "id string, source string, target string, relationship_type string, description string, weight double, rank int, observed_at string, confidence double")
    units = spark.createDataFrame([("t1", "Alice works at Acme", ["d1"], "d1", ["ALICE", "ACME"], None, 1.0), ("t2", "nothing here", ["d2"], "d2", [], None, 1.0)], "id string, text string, document_ids array<string>, document_id string, entity_ids array<string>, observed_at string, confidence double")
    docs = spark.createDataFrame([("d1", "One", "work/x", ["a"], None, 1.0), ("d2", "Two", "home", [], None, 1.0)], "id string, title string, category string, tags array<string>, observed_at string, confidence double")
    nodes = spark.createDataFrame([("ALICE", "0", 0)], "title string, community string, level int")
    reports = spark.createDataFrame([("0-0", "0", 5.0, "Title", "Full report")], "id string, community string, rank double, title string, full_content string")
    a = search.Artifacts(docs, units, ents, rels, nodes, reports)
    r = search.local_search(a, "who?", [1.0, 0.0], model=lambda p: p.upper()[:5])
    assert "ALICE,PERSON,lead,2" in r.text and "Full report" in r.text and "Alice works" in r.text and r.response
    scores = spark.createDataFrame([("t1", 0.1), ("t2", 0.9)], "id string, cos double")
    assert "nothing here" in search.cascade_search(a, "alice", [1.0, 0.0], scores, rescue=1, k=1).text
    assert "nothing" not in search.document_search(a, ["d1"], "?").text
    assert search.global_search(a, "?", model=lambda p: "3\tpoint").text == "Full report"
    assert search.global_search(a, "?", model=lambda p: "3\tpoint", budget=1).text == "point"
    assert search.global_search(a, "?", model=lambda p: p, f=recall.RecallFilter(names=["acme"])).text == ""
    assert search.global_search(a, "?", model=lambda p: p, f=recall.RecallFilter(names=["alice"])).text == "Full report"
    from sparkloom.operators import export

    sent = export.graph_database_statements(spark.range(1200).select(F.lit("entity").alias("kind"), "id", F.lit("T").alias("type")).coalesce(1)).collect()
    assert sorted(r["rows"].count('"type"') for r in sent) == [200, 500, 500]
    got = search.recall(a, recall.RecallFilter(category="work/**")).tables
    assert got["text_units"].count() == 1 and got["documents"].count() == 1


def test_cache_and_rerank(spark):
    from sparkloom.operators import cache

    requests = spark.createDataFrame([("a",), ("b",), ("b",), ("bad",)], "prompt string").withColumn("key", cache.request_key("m", "prompt", temperature=0))
    known = spark.createDataFrame([(requests.where("prompt = 'a'").first()["key"], "old")], "key string, response string")
    assert cache.missing_requests(requests, known).count() == 2
    out, fresh = cache.answered(requests, known, lambda ps: [None if p == "bad" else p.upper() for p in ps])
    assert sorted((r["prompt"], r["response"]) for r in out.collect() if r["response"]) == [("a", "old"), ("b", "B"), ("b", "B")] and fresh.count() == 1
    rows = spark.createDataFrame([(i, "x" * i, float(i)) for i in range(1, 9)], "id int, text string, score double")
    assert [r["id"] for r in ranking.rerank(rows, lambda ts: [None if len(t) == 3 else -len(t) for t in ts], 2).collect()] == [4, 5]
    docs = spark.createDataFrame([("d1", "/p/one", "x"), ("d2", "/q/two", "ONE")], "id string, path string, title string")
    assert [(r["id"], r["tier"]) for r in recall.resolve_documents(docs, "one").collect()] == [("d1", 1)]


def test_aliases_all_pairs(spark):
    """Against all pairs; names close only in their middle or of lengths far apart are among them."""
    rng = random.Random(3)
    names = ["COLD ANVIL BRAND#1 ECONOMY", "OLD ANVIL BRAND#10 ECONOMY", "SMITH", "SMITHSON", "", "ß", "日本語", "日本語学"]
    names += [f"{rng.choice(['COLD', 'OLD', 'GOLD', 'BOLD'])} {rng.choice(['ANVIL', 'ANVILS', 'RING'])} BRAND#{rng.randrange(1, 25)} {rng.choice(['ECONOMY', 'SMALL'])}" for _ in range(150)]
    names += ["".join(rng.choices("AB", k=rng.randint(1, 9))) for _ in range(60)]
    rows = sorted({(n, rng.choice(["T", "U", ""]), rng.randrange(3)) for n in names} | {("SMITH", "T", 5), ("SMITHSON", "T", 2), (names[0], "U", 4), (names[1], "U", 1)})
    want = set()
    for a, ta, ma in rows:
        for b, tb, mb in rows:
            score = T.jaro_winkler_value(a, b)
            if a < b and (ta == tb or not ta or not tb) and score >= 0.92:
                want.add(((a, b) if ma >= mb else (b, a)) + (score,))
    got = [tuple(r) for r in similar.aliases(spark.createDataFrame([*rows, rows[0], (None, "T", 1)], "name string, type string, mentions long"), blocks=3).collect()]
    assert set(got) == want and {("SMITH", "SMITHSON"), tuple(names[:2])} <= {r[:2] for r in got}


def test_aliases_query_is_whole(spark):
    """The registered query has every pair of its names at 0.92."""
    part = spark.read.parquet(f"{SF}/part.parquet").selectExpr("upper(concat_ws(' ', p_name, p_brand, p_type)) AS n").distinct().collect()
    names = sorted(r["n"] for r in part)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if T.jaro_winkler_value(a, b) >= 0.92}
    got = [tuple(sorted((r["canonical"], r["alias"]))) for r in catalog.QUERIES["jaro_winkler_aliases"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_aliases_by_embedding(spark):
    """Unlike names of close vectors; not across types, not of null or zero vectors; the score is the larger one."""
    rows = [("IBM", "ORG", 3, [1.0, 0.0]), ("BIG BLUE", "ORG", 1, [0.99, 0.1]), ("FAR", "ORG", 1, [0.0, 1.0]), ("PERSON", "PERSON", 1, [1.0, 0.0]), ("NONE", "ORG", 1, None), ("ZERO", "ORG", 1, [0.0, 0.0]), ("UNTYPED", "", 2, [0.0, 2.0]), ("SMITH", "X", 1, None), ("SMITHSON", "X", 2, None)]
    got = sorted((r["canonical"], r["alias"], round(r["score"], 4)) for r in similar.aliases(spark.createDataFrame(rows, "name string, type string, mentions long, description_embedding array<float>")).collect())
    assert got == [("IBM", "BIG BLUE", 0.9949), ("SMITHSON", "SMITH", 0.925), ("UNTYPED", "FAR", 1.0)]
