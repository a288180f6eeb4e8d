"""The memory's write path, proposals, incremental communities, stores, sinks and readers on small literal tables."""

import io
import sqlite3
import zipfile
import zlib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import replies
from sparkloom.functions import text as T
from sparkloom.operators import agent, communities, context, graph, incremental, linking, maintain, memory, ranking, sinks
from sparkloom.operators.vector_store import VectorStore, embedded
from sparkloom.sources import files, office
from sparkloom.streaming import observations

MENTION = "name string, type string, tu string, doc long, observed_at string, confidence double, source string"
STATEMENT = "source string, target string, relationship_type string, weight double, tu string, doc long, observed_at string, confidence double"
NOW = datetime(2026, 3, 4, 5, 6, tzinfo=timezone.utc)


@pytest.fixture
def state(spark):
    return memory.Memory(
        spark.createDataFrame([], "doc long, category string, tags array<string>, observed_at string"),
        spark.createDataFrame([], "tu string, doc long"),
        spark.createDataFrame([], MENTION),
        spark.createDataFrame([], STATEMENT),
        spark.createDataFrame([], "name string, type string"),
        spark.createDataFrame([("ANN", "work")], "name string, community string"),
        spark.createDataFrame([], "community string, title string, summary string"),
    )


def observe(spark, state, doc, tu, names, pairs=(), at="2026-01-01", confidence=0.9):
    docs = spark.createDataFrame([(doc, "work", ["t"], at)], "doc long, category string, tags array<string>, observed_at string")
    units = spark.createDataFrame([(tu, doc)], "tu string, doc long")
    mentions = spark.createDataFrame([(n, k, tu, doc, at, confidence, "me") for n, k in names], MENTION)
    return state.add_observations(docs, units, mentions, spark.createDataFrame([(a, b, t, w, tu, doc, at, confidence) for a, b, t, w in pairs], STATEMENT))


def test_memory_write_path(spark, state):
    s = observe(spark, state, 1, "a", [(" ann ", "person"), ("acme", "big company"), ("", "x")], [("Ann", "Acme", "works at", 1.0), ("Ann", "ann", "is", 1.0)])
    s = observe(spark, s, 2, "b", [("Ann", "human")], [("acme", "Ann", "Works  At", 3.0)], "2026-02-01", 0.5)
    s = s.add_entities(spark.createDataFrame([("note", "idea"), ("ann", "other")], "name string, type string"))
    e = {r["name"]: r for r in s.entities().collect()}
    assert set(e) == {"ANN", "ACME", "NOTE"} and e["ACME"]["type"] == "BIG_COMPANY"
    assert (e["ANN"]["n_tu"], e["ANN"]["n_doc"], e["ANN"]["observed_at"], e["ANN"]["confidence"], e["ANN"]["type"]) == (2, 2, "2026-02-01", 0.5, "OTHER")
    assert not e["NOTE"]["backed"] and e["NOTE"]["n_tu"] == 0
    (r,) = s.relationships().collect()
    assert (r["source"], r["target"], r["relationship_type"], r["weight"], r["n_tu"], r["rank"]) == ("ACME", "ANN", "WORKS_AT", 2.0, 2, 2)
    again = observe(spark, s, 2, "b", [("Ann", "human")], [("Acme", "Ann", "works at", 5.0)])  # replaced, not doubled
    assert again.relationships().first()["weight"] == 3.0 and again.documents.count() == 2
    gone = s.without_documents(spark.createDataFrame([(1,)], "doc long"))
    assert {r["name"] for r in gone.entities().collect()} == {"ANN", "NOTE"}  # backed by document 1 alone: gone; never backed: stays
    assert gone.relationships().count() == 0 and gone.unit_mirror().first()["observed_at"] == "2026-02-01"


def test_memory_communities_and_reports(spark, state):
    s = state.add_members(spark.createDataFrame([("BOB", "work"), ("ANN", "work"), ("BOB", "home")], "name string, community string"))
    assert s.members.count() == 3 and [r["community"] for r in s.crowded(2).collect()] == ["work"]
    s = s.update_reports(spark.createDataFrame([("work", "Work", "s")], "community string, title string, summary string"))
    s = s.update_reports(spark.createDataFrame([("work", None, "t"), ("home", "Home", None)], "community string, title string, summary string"))
    assert {tuple(r) for r in s.reports.collect()} == {("work", "Work", "t"), ("home", "Home", None)}
    assert s.delete_communities(spark.createDataFrame([("work",)], "community string")).members.count() == 1


def test_proposals(spark):
    edges = spark.createDataFrame([("A", "B", 1.0), ("A", "C", 1.0), ("A", "D", 1.0), ("E", "A", 1.0)], "source string, target string, weight double")
    members = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "y"), ("D", "x"), ("E", "y")], "name string, community string")
    moves = {r["entity"]: r for r in memory.propose_moves(edges, members).collect()}
    assert moves["A"]["community"] == "y" and moves["A"]["confidence"] == 0.875 and "D" not in moves and moves["B"]["community"] == "x"
    al = spark.createDataFrame([("Ann", "ANNE", 0.95), ("Bob", "BOBBY", 0.5)], "canonical string, alias string, score double")
    both = memory.consolidate(30, [memory.propose_moves(edges, members), memory.propose_merges(al), memory.propose_merges(al)])
    kinds = [r["kind"] for r in both.collect()]
    assert kinds.count("merge_aliases") == 1 and kinds.count("move_entity") == len(moves) and both.select("id").distinct().count() == both.count()
    with pytest.raises(ValueError):
        memory.consolidate(29, [])
    out, merges, splits = memory.accept(members, both)
    assert ("A", "y") in {tuple(r) for r in out.collect()} and [tuple(r) for r in merges.collect()] == [("Ann", "ANNE")] and splits.count() == 0
    tri = spark.createDataFrame([("A", "B", 2.0), ("B", "C", 2.0), ("A", "C", 2.0), ("D", "E", 1.0)], "source string, target string, weight double")
    (p,) = memory.propose_communities(tri, spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "y")], "name string, community string")).collect()
    assert p["members"] == ["A", "B", "C"] and p["confidence"] == 1.0
    assert [x["id"] for x in memory.parse_proposals([r["value"] for r in memory.proposals_json(both).collect()])][0] in {r["id"] for r in both.collect()}


def test_merged_entities_and_change_log(spark):
    e = spark.createDataFrame([("A", "T", "long text", 1.0), ("B", "U", "longer text", 3.0), ("C", None, None, 1.0)], "name string, type string, description string, weight double")
    out = {r["name"]: r for r in memory.merge_entities(e, spark.createDataFrame([("B", "A")], "alias string, canonical string")).collect()}
    assert tuple(out["A"]) == ("A", "T", "longer text", 2.0, 2) and set(out) == {"A", "C"}
    log = incremental.change_log(e, e.where("name <> 'A'").withColumn("weight", F.col("weight") + F.when(F.col("name") == "B", 1).otherwise(0)), ["name"], F.col("weight"))
    assert {tuple(r) for r in log.collect()} == {("A", "removed"), ("B", "changed")}


def test_incremental_communities(spark):
    assert incremental.strategy(2, 10) == "propagate" and incremental.strategy(3, 10) == "recluster" and incremental.strategy(0, 0) == "propagate"
    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("N", "A", 1.0), ("N", "B", 1.0), ("M", "N", 1.0), ("X", "Y", 1.0)], "source string, target string, weight double")
    members = spark.createDataFrame([("A", "0"), ("B", "0"), ("C", "1")], "name string, community string")
    new = spark.createDataFrame([("N",), ("M",), ("Z",), ("X",)], "name string")
    none = spark.createDataFrame([], "name string")
    out, affected = incremental.update(edges, members, new, none, none, 100)
    assert {tuple(r) for r in out.collect()} == {("A", "0"), ("B", "0"), ("C", "1"), ("N", "0"), ("M", "0"), ("Z", "2"), ("X", "2")}
    assert {r["community"] for r in affected.collect()} == {"0", "2"}
    out, affected = incremental.update(edges, members, none, none, spark.createDataFrame([("C",)], "name string"), 100)
    assert {tuple(r) for r in out.collect()} == {("A", "0"), ("B", "0")} and {r["community"] for r in affected.collect()} == {"1"}
    out = dict(tuple(r) for r in incremental.recluster(edges, members, new).collect())
    assert set(out) == {"A", "B", "C", "N", "M", "X", "Y", "Z"} and out["N"] == "0" and out["C"] == "1" and out["X"] == out["Y"] and out["X"] not in ("0", "1", out["Z"])
    full = incremental.update(edges, members, new, none, none, 5)[0]
    assert full.count() == 8


def test_greedy_modularity():
    two = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]
    found = communities.greedy_modularity(two)
    assert len({found[x] for x in "abc"}) == 1 and len({found[x] for x in "def"}) == 1 and found["a"] != found["f"]
    assert communities.greedy_modularity([]) == {}


def test_linking(spark):
    rows = spark.createDataFrame([(i % 7, f"x{i}") for i in range(50)], "k int, v string")
    out = linking.numbered(rows, ["k", "v"], "n", 5).orderBy("n").collect()
    assert [r["n"] for r in out] == list(range(5, 55)) and [(r["k"], r["v"]) for r in out] == sorted((r["k"], r["v"]) for r in out)
    assert linking.numbered(rows.limit(0), ["k"], "n").count() == 0
    p = linking.postings(spark.createDataFrame([("a", f"t{i}") for i in range(95)] + [("b", "t1"), ("b", "t1")], "name string, tu string"), per=10)
    got = p.collect()
    assert sum(len(r["units"]) for r in got if r["name"] == "a") == 95 and [r["units"] for r in got if r["name"] == "b"] == [["t1"]] and max(len(r["units"]) for r in got) < 40
    r = linking.attach_ids(spark.createDataFrame([("A", "B", "keep")], "source string, target string, source_id string"), spark.createDataFrame([("A", "1"), ("B", "2")], "name string, id string")).first()
    assert (r["source_id"], r["target_id"]) == ("keep", "2")
    assert linking.keep_columns(rows, ["v", "none"]).columns == ["v"]
    made = linking.refreshed_reports(spark.createDataFrame([("a", "x"), ("b", "y")], "community string, title string"), spark.createDataFrame([("a", "keep"), ("b", "generate")], "community string, action string"), spark.createDataFrame([("b", "z")], "community string, title string"))
    assert {tuple(r) for r in made.collect()} == {("a", "x"), ("b", "z")}
    ranks = ranking.ranked(spark.createDataFrame([(i, float(i % 5)) for i in range(1200)], "id int, s double"), "s").collect()  # without a limit no row is lost
    assert sorted(r["rank"] for r in ranks) == list(range(1200)) and max(ranks, key=lambda r: -r["rank"])["id"] == 4


def test_stream_of_observations(spark, tmp_path):
    root, folder = f"file://{tmp_path}/units", f"file://{tmp_path}/in"
    schema = "name string, tu string, type string, observed_at string, confidence double, source string"
    for k, rows in enumerate(([("A", "t1", "X", "2026-01-01", 0.9, "s"), ("A", "t1", "X", "2026-01-01", 0.9, "s"), ("A", "t2", "Y", "2026-01-03", 0.8, "s")], [("A", "t1", "Z", "2026-01-02", 0.7, "u"), ("B", "t3", "X", "2026-01-02", 1.0, "u")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        observations.upsert_stream(stream, root, f"file://{tmp_path}/checkpoint{0}").awaitTermination()
        assert k == 0 or len(list((tmp_path / "units").glob("batch=*"))) == 2
    want = {"A": ("X", 2, "2026-01-03", 0.7, "s"), "B": ("X", 1, "2026-01-02", 1.0, "u")}
    result = lambda: {r["name"]: tuple(r)[1:] for r in observations.upserted(spark, root).collect()}
    assert result() == want
    observations.compact(spark, root, 1)
    assert result() == want and len(list((tmp_path / "units").glob("batch=*"))) == 1


def test_vector_store(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/v")
    rows = lambda *x: spark.createDataFrame(list(x), "id int, vector array<double>, kind string")
    store.load(rows((1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a")))
    store.load(rows((2, [1.0, 1.0], "b"), (3, [0.9, 0.1], "b")), "append")
    assert [r["id"] for r in store.search_by_vector([1.0, 0.0], 2).collect()] == [1, 3] and store.rows().count() == 3
    assert [r["id"] for r in store.search_by_text("x", lambda t: [[0.0, 1.0]], 1, F.col("kind") == "b").collect()] == [2]
    assert {r["id"] for r in store.filter_by_id([1, 9]).collect()} == {1} and store.filter_by_id(rows((3, None, None))).count() == 1
    store.load(rows((7, [1.0, 0.0], "c")))
    assert store.rows().count() == 1
    with pytest.raises(ValueError):
        store.load(rows(), "merge")
    got = embedded(spark.createDataFrame([("a",), (None,), ("bb",)], "text string"), lambda t: [[float(len(x))] for x in t]).collect()
    assert [r["vector"] for r in got] == [[1.0], None, [2.0]]

    def broken(texts):
        raise OSError

    assert embedded(spark.createDataFrame([("a",)], "text string"), broken).first()["vector"] is None


def test_sinks(spark, tmp_path):
    base = f"file://{tmp_path}"
    e = spark.createDataFrame([("A & B", "<t>"), ("C", None)], "name string, type string")
    r = spark.createDataFrame([("A & B", "C", 1.5)], "source string, target string, weight double")
    sinks.write_graphml(e, r, f"{base}/g")
    nodes, edges = sinks.read_graphml(spark, f"{base}/g")
    assert {tuple(x) for x in nodes.collect()} == {("A & B", "<t>"), ("C", "")} and [tuple(x) for x in edges.collect()] == [("A & B", "C", 1.5)]
    p = sinks.graph_payload(e, r, 1)
    assert p["total"] == 2 and len(p["nodes"]) == 1 and "</script><" not in sinks.graph_page(p | {"x": "</script>"}).split("<script>")[1].split("const g")[1].split("\n")[0]
    sinks.append_history(spark, f"{base}/h", [{"op": "add"}], NOW)
    sinks.append_history(spark, f"{base}/h", [{"op": "delete"}], NOW)
    assert sinks.read_history(spark, f"{base}/h").count() == 2 and sinks.read_history(spark, f"{base}/h").first()["at"] == "2026-03-04T05:06:00Z"
    paths = [sinks.write_observation(spark, f"{base}/o", "Über Köln!", "Text", {"category": "work", "tags": ["a"], "none": None}, NOW) for _ in range(2)]
    assert [x.rsplit("/", 1)[1] for x in paths] == ["2026-03-04T05-06_uber-koln.md", "2026-03-04T05-06_uber-koln-2.md"]
    got = files.with_frontmatter(files.read_files(spark, f"{base}/o")).first()
    assert got["category"] == "work" and got["tags"] == ["a"] and got["text"].startswith("# Über Köln!")
    store = sinks.Proposals(spark, f"{base}/p")
    assert store.latest() is None
    name = store.save([{"id": "1"}], NOW)
    assert store.latest() == name and store.load(name) == [{"id": "1"}]
    store.archive(name)
    assert store.names() == []
    projects = sinks.Projects(spark, f"{base}/projects.json")
    projects.upsert("x", path="/a")
    projects.upsert("x", title="T")
    assert projects.all() == {"x": {"path": "/a", "title": "T"}}
    projects.remove("x")
    assert projects.all() == {}
    sinks.write_mapping(spark.createDataFrame([(1, "a.md")], "id int, path string"), f"{base}/m")
    assert spark.read.json(f"{base}/m").first().asDict() == {"id": "1", "path": "a.md"}
    files.publish({"t": e}, f"{base}/runs", "one")
    files.publish({"t": e.limit(1)}, f"{base}/runs", "two")
    assert files.current(spark, f"{base}/runs", "t").count() == 1


def _pdf(pages):
    parts, kids = [], []
    for i, text in enumerate(pages):
        stream = zlib.compress(b"BT /F1 12 Tf (" + text.encode() + b") Tj T* [(two) -500 (words)] TJ ET") if text else b""
        parts.append(f"{10 + 2 * i} 0 obj << /Type /Page /Parent 2 0 R /Contents {11 + 2 * i} 0 R >> endobj".encode())
        parts.append(f"{11 + 2 * i} 0 obj << /Filter /FlateDecode /Length {len(stream)} >> stream\n".encode() + (stream or zlib.compress(b"")) + b"\nendstream endobj")
        kids.append(f"{10 + 2 * i} 0 R")
    return b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [" + " ".join(kids).encode() + b"] >> endobj\n" + b"\n".join(parts)


def _docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Head', 'Heading2')}{p('Text')}<w:tbl>{row('a', 'b')}{row('1', '2|3')}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_office_files(spark, tmp_path):
    assert office.pdf_markdown(_pdf(["One \\(1\\)", "", "Three"])) == "## Page 1\n\nOne (1)\ntwo words\n\n## Page 3\n\nThree\ntwo words"
    with pytest.raises(ValueError):
        office.pdf_markdown(_pdf([""]))
    assert office.docx_markdown(_docx()) == "## Head\n\nText\n\n| a | b |\n| --- | --- |\n| 1 | 2\\|3 |"
    (tmp_path / "a.pdf").write_bytes(_pdf(["x"]))
    (tmp_path / "b.docx").write_bytes(_docx())
    (tmp_path / "c.pdf").write_bytes(b"nothing")
    (tmp_path / "_d.pdf").write_bytes(b"hidden")
    first = office.preprocess(spark, f"file://{tmp_path}").persist()
    got = {r["path"].rsplit("/", 1)[1]: r for r in first.collect()}
    assert set(got) == {"a.pdf", "b.docx", "c.pdf"} and got["c.pdf"]["text"] is None and "ValueError" in got["c.pdf"]["error"]
    (tmp_path / "a.pdf").unlink()
    again = {r["path"].rsplit("/", 1)[1]: r["text"] for r in office.preprocess(spark, f"file://{tmp_path}", first.withColumn("text", F.lit("cached"))).collect()}
    assert again == {"b.docx": "cached", "c.pdf": "cached"}


def test_replies(spark):
    texts = ['{"title": "T", "rating": 7, "findings": [{"summary": "a"}, "b"],}', "<think>{x}</think>```json\n{\"report\": {\"title\": \"U\\n\"}}\n```", "none", None, '{"title": "line\nend", "findings": "one"}', "[1]"]
    got = [r["r"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(replies.parse_report("t").alias("r")).collect()]
    assert (got[0]["title"], got[0]["rating"], [f["summary"] for f in got[0]["findings"]]) == ("T", 7.0, ["a", "b"])
    assert got[1]["title"] == "U\n" and got[2] is None and got[3] is None and got[4]["findings"][0]["summary"] == "one" and got[5] is None
    p = spark.createDataFrame([('x {"points": [{"description": "d", "score": 3}]} y',), ("no",)], "t string").select(replies.parse_points("t").alias("p")).collect()
    assert p[0]["p"][0]["score"] == 3.0 and p[1]["p"] == []
    assert replies.substituted("a ${X} ${Y:-d} ${Z}", {"X": "1"}) == "a 1 d " and replies.merged_types(["a b"], ["A  B", "c", "d"], 2) == ["A_B", "C"]
    assert replies.prompt("p", {"p": "Hi {who} {x}"}, who="Ann") == "Hi Ann {x}" and replies.prompt("p", {"p": "a"}, {"p": "b"}) == "b"


def test_verbatim_chunks_and_names(spark):
    text = "  One two,\n three!  four\t" * 40
    c = context.chunk_windows(spark.createDataFrame([(1, text)], "doc_id int, text string"), T.spaced_tokens("text"), 10_000, 5, glue="").first()
    assert c["text"] == text
    row = spark.createDataFrame([("A &amp; b ", "Ünïted States!", "<think>x</think> y")], "a string, b string, c string").select(T.unescape_name("a"), T.slug("b"), T.strip_thoughts("c")).first()
    assert tuple(row) == ("A & B", "united-states", " y".strip())
    old = spark.createDataFrame([("A", "t1", "X", "2026-01-01", 0.9, "s")], "name string, tu string, type string, observed_at string, confidence double, source string")
    new = spark.createDataFrame([("A", "t0", "Y", "2026-01-02", 0.8, "u"), ("A", "t1", "Y", "2026-01-02", 1.0, "u")], old.schema)
    assert tuple(maintain.upsert_entities(old, new).first()) == ("A", "X", 2, "2026-01-02", 0.8, "s")


def test_agent():
    replies_ = iter(['{"tool": "find", "arguments": {"q": "x"}}', '{"tool": "none"}', '{"tool": "broken"}', "done"])
    seen = []

    def model(messages):
        seen.append(list(messages))
        return next(replies_)

    def broken(_):
        raise OSError("no")

    out = agent.run_agent("Q", model, {"find": lambda a: "one two\nthree four five\nsix", "broken": broken}, turns=3, budget=6)
    assert out.text == "done" and out.forced and [c[0] for c in out.calls] == ["find", "none", "broken"]
    assert seen[1][-1]["content"] == "one two\nthree four five\nsix" and seen[-1][-1]["content"].startswith("Answer now") and seen[2][-1]["content"] == ""
    assert agent.run_agent("Q", lambda m: '{"answer": "yes"}', {}).text == "yes" and agent.run_agent("Q", lambda m: "plain", {}).text == "plain"
    assert agent.trimmed("a b c d e f", 3, lambda x: len(x.split())).split() == ["a", "b", "c"]


def test_chat(spark):
    s, m = spark.createDataFrame([], "session string, title string, updated string"), spark.createDataFrame([], "session string, position int, role string, text string")
    for k in range(3):
        s, m = agent.add_message(s, m, "a" if k < 2 else "b", "user", f"hi {k}", f"2026-01-0{k + 1}")
    assert [(r["session"], r["title"], r["messages"]) for r in agent.list_sessions(s, m).collect()] == [("b", "hi 2", 1), ("a", "hi 0", 2)]
    assert [r["text"] for r in agent.last_messages(m, 1).orderBy("session").collect()] == ["hi 1", "hi 2"]
    s, m = agent.delete_session(s, m, "a")
    assert s.count() == 1 and m.count() == 1


def test_other_sources(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"questions": [{"id": "1", "category": "a", "question": "x"}, {"id": "2", "category": "b", "question": "y", "answer": "z"}]}')
    q = lambda **o: [r["id"] for r in files.read_questions(spark, f"file://{tmp_path}/q.json", **o).collect()]
    assert q() == ["1", "2"] and q(ids=["2"]) == ["2"] and q(categories=["a"], ids=["2"]) == []
    with sqlite3.connect(tmp_path / "c.db") as c:
        c.execute("create table m (id int, text)")
        c.executemany("insert into m values (?, ?)", [(1, "a"), (2, None)])
    assert {tuple(r) for r in files.read_sqlite(spark, [str(tmp_path / "c.db")], "select id, text from m", "id long, text string").collect()} == {(1, "a"), (2, None)}
    (tmp_path / "f" / "g").mkdir(parents=True)
    (tmp_path / "f" / "g" / "x.txt").write_text("x")
    assert files.zip_folder(str(tmp_path / "f"), str(tmp_path / "z.zip")) == ["g/x.txt"] == files.list_zip(str(tmp_path / "z.zip"))
    files.unzip(str(tmp_path / "z.zip"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "g" / "x.txt").read_text() == "x"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.txt", "x")
    for bad in ("../x", "/x", "a/../../x", "c:/x"):
        with pytest.raises(ValueError):
            files.checked_path("/root", bad)
    with pytest.raises(ValueError):
        files.unzip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_betweenness(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 1.0), ("d", "e", 1.0)], "source string, target string, weight double")
    got = {r["name"]: round(r["betweenness"], 6) for r in graph.betweenness(e).collect()}
    assert got == {"a": round(1 / 6, 6), "b": round(1 / 12, 6), "c": round(1 / 6, 6), "d": round(7 / 12, 6), "e": 0.0}
    with pytest.raises(ValueError):
        graph.betweenness(e, 3)
