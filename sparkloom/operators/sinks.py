"""Files that leave the engine: JSON and JSON lines, GraphML, a graph page, observations as markdown. Tables are written by Spark; what is one file
has a bound on what it may hold."""

from __future__ import annotations

import html
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import slug_value
from sparkloom.operators.graph import degrees
from sparkloom.operators.maintain import induced_top
from sparkloom.sources.files import _filesystem


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, which is there as a whole or not at all."""
    jvm, at, fs = _filesystem(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(str(at.getParent()) + "/_new." + at.getName())
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    fs.rename(new, at)


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm, at, fs = _filesystem(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Manifests, summaries, traces and the like."""
    write_text(spark, path, json.dumps(value, indent=1, sort_keys=True, ensure_ascii=False, default=str))


def write_mapping(docs: DataFrame, path: str, id_col: str = "id", value_col: str = "path") -> None:
    """Ids and paths of documents as JSON lines, written by all tasks."""
    docs.select(F.to_json(F.struct(F.col(id_col).cast("string").alias("id"), F.col(value_col).alias("path"))).alias("value")).write.mode("overwrite").text(path)


def append_history(spark: SparkSession, folder: str, events: list[dict], now: datetime | None = None) -> None:
    """Events are added as a file of their own, so that nothing that is there is written again."""
    at = (now or datetime.now(timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = [(json.dumps({"at": at} | e, sort_keys=True, ensure_ascii=False),) for e in events]
    spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(folder)


def read_history(spark: SparkSession, folder: str) -> DataFrame:
    """at, event (JSON)."""
    return spark.read.text(folder).select(F.get_json_object("value", "$.at").alias("at"), F.col("value").alias("event"))


def _xml(x: str):
    return F.replace(F.replace(F.replace(F.replace(F.col(x).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml_lines(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, value): the lines of a GraphML document in order; entities (name, type), edges (source, target, weight)."""
    spark = entities.sparkSession
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<key id="t" for="node" attr.name="type" attr.type="string"/>', '<key id="w" for="edge" attr.name="weight" attr.type="double"/>', '<graph edgedefault="undirected">']
    fixed = spark.createDataFrame([(0, "", str(i), x) for i, x in enumerate(head)] + [(3, "", "", "</graph></graphml>")], "ord int, a string, b string, value string")
    nodes = entities.select(F.lit(1).alias("ord"), F.col("name").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), _xml("name"), F.lit('"><data key="t">'), F.coalesce(_xml("type"), F.lit("")), F.lit("</data></node>")).alias("value"))
    links = edges.select(F.lit(2).alias("ord"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat(F.lit('<edge source="'), _xml("source"), F.lit('" target="'), _xml("target"), F.lit('"><data key="w">'), F.col("weight").cast("string"), F.lit("</data></edge>")).alias("value"))
    return fixed.unionByName(nodes).unionByName(links)


def write_graphml(entities: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder of part files whose lines, read in the order of the files' names, are one GraphML document."""
    graphml_lines(entities, edges).orderBy("ord", "a", "b").select("value").write.mode("overwrite").text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(name, type) and (source, target, weight) of a GraphML document with an element on each line."""
    lines = spark.read.text(path)
    plain = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))
    part = lambda pattern: plain(F.regexp_extract("value", pattern, 1))
    nodes = lines.where(F.col("value").startswith("<node")).select(part('id="([^"]*)"').alias("name"), part(r'key="t">([^<]*)<').alias("type"))
    edges = lines.where(F.col("value").startswith("<edge")).select(part('source="([^"]*)"').alias("source"), part('target="([^"]*)"').alias("target"), part(r'key="w">([^<]*)<').cast("double").alias("weight"))
    return nodes, edges


def payload_tables(entities: DataFrame, edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, degree, size: the logarithm of the degree) and links (source, target) for a viewer, each once: of the whole graph, or of its
    `most` nodes of largest degree."""
    degree = degrees(edges)
    top = degree if most is None else degree.orderBy(F.desc("degree"), "name").limit(most)
    types = entities.groupBy("name").agg(F.min("type").alias("type"))
    nodes = top.join(types, "name", "left").select(F.col("name").alias("id"), "type", "degree", F.log1p("degree").alias("size"))
    kept = edges if most is None else induced_top(edges, degree, most)
    return nodes, kept.select("source", "target").distinct()


def graph_payload(entities: DataFrame, edges: DataFrame, most: int = 5000) -> dict:
    """Nodes and edges for a viewer, as one file: the subgraph of the `most` nodes of largest degree. A view of a large graph has to be a part of it;
    `total` says how many nodes there are. `payload_tables` has all of them."""
    nodes, kept = payload_tables(entities, edges, most)
    own = [r.asDict() | {"size": round(r["size"], 3)} for r in nodes.orderBy(F.desc("degree"), "id").collect()]
    links = [r.asDict() for r in kept.orderBy("source", "target").limit(20 * most).collect()]
    return {"nodes": own, "edges": links, "total": degrees(edges).count()}


def graph_page(payload: dict, title: str = "Graph") -> str:
    """A page of its own that draws the payload on a circle, largest nodes first."""
    data = json.dumps(payload).replace("</", "<\\/")
    return f"""<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><canvas id="c" width="1200" height="1200"></canvas><script>
const g = {data}, c = document.getElementById("c").getContext("2d"), at = {{}}, n = g.nodes.length;
g.nodes.forEach((x, i) => at[x.id] = [600 + 560 * Math.cos(6.2832 * i / n), 600 + 560 * Math.sin(6.2832 * i / n)]);
c.strokeStyle = "#ccc"; g.edges.forEach(e => {{ const a = at[e.source], b = at[e.target]; if (a && b) {{ c.beginPath(); c.moveTo(...a); c.lineTo(...b); c.stroke(); }} }});
g.nodes.forEach(x => {{ const [a, b] = at[x.id]; c.beginPath(); c.arc(a, b, 2 + x.size, 0, 7); c.fill(); if (n < 200) c.fillText(x.id, a + 6, b); }});
</script></body></html>
"""


def write_observation(spark: SparkSession, folder: str, title: str, body: str, facts: dict, now: datetime | None = None) -> str:
    """One observation as `YYYY-MM-DDTHH-MM_slug.md` with its facts as frontmatter; a name that is taken gets -2, -3 and so on. Returns the path."""
    jvm, base, fs = _filesystem(spark, folder)
    fs.mkdirs(base)
    stem = f"{(now or datetime.now(timezone.utc)).strftime('%Y-%m-%dT%H-%M')}_{slug_value(title) or 'note'}"
    k, path = 1, f"{folder}/{stem}.md"
    while fs.exists(jvm.org.apache.hadoop.fs.Path(path)):
        k += 1
        path = f"{folder}/{stem}-{k}.md"
    lines = [f"{key}: {json.dumps(x, ensure_ascii=False)}" for key, x in facts.items() if x is not None]
    write_text(spark, path, "---\n" + "\n".join(lines) + f"\n---\n# {title}\n\n{body}\n")
    return path


class Proposals:
    """Sets of proposals below a folder, one JSON file each; names sort by time. Accepted and rejected sets move to the archive."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def save(self, proposals: list[dict], now: datetime | None = None) -> str:
        name = (now or datetime.now(timezone.utc)).strftime("%Y%m%dT%H%M%S%fZ")
        write_json(self.spark, f"{self.folder}/{name}.json", proposals)
        return name

    def names(self) -> list[str]:
        jvm, at, fs = _filesystem(self.spark, self.folder)
        if not fs.exists(at):
            return []
        return sorted(s.getPath().getName()[:-5] for s in fs.listStatus(at) if s.isFile() and s.getPath().getName().endswith(".json") and not s.getPath().getName().startswith("_"))

    def load(self, name: str) -> list[dict]:
        return json.loads(read_text(self.spark, f"{self.folder}/{name}.json") or "[]")

    def latest(self) -> str | None:
        return max(self.names(), default=None)

    def archive(self, name: str) -> None:
        jvm, at, fs = _filesystem(self.spark, f"{self.folder}/archive")
        fs.mkdirs(at)
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json"), jvm.org.apache.hadoop.fs.Path(f"{self.folder}/archive/{name}.json"))


class Projects:
    """A registry of projects (id, path, title): one JSON file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> dict[str, dict]:
        return json.loads(read_text(self.spark, self.path) or "{}")

    def upsert(self, project: str, **facts: str) -> None:
        write_json(self.spark, self.path, self.all() | {project: self.all().get(project, {}) | facts})

    def remove(self, project: str) -> None:
        write_json(self.spark, self.path, {k: v for k, v in self.all().items() if k != project})
