"""The graph model over the star schema: what would be extracted from text stands in its rows. Orders are documents, line items text
units; customers, parts and suppliers are entities that the line items mention; region/nation are folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, doc, entity keys, observed_at, confidence, source, weight."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tu"),
        F.col("l_orderkey").alias("doc"),
        F.concat(F.lit("C"), "o_custkey").alias("c"),
        F.concat(F.lit("P"), "l_partkey").alias("p"),
        F.concat(F.lit("S"), "l_suppkey").alias("s"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("observed_at"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"),
        F.col("o_orderpriority").alias("source"),
        F.col("l_quantity").alias("weight"),
    )


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each entity that a text unit mentions: name, type, tu, doc, observed_at, confidence, source."""
    kinds = {"c": "CUSTOMER", "p": "PART", "s": "SUPPLIER"}
    each = F.explode(F.array(*[F.struct(F.col(k).alias("name"), F.lit(v).alias("type")) for k, v in kinds.items()]))
    return text_units(spark, sf_dir).withColumn("e", each).select("e.name", "e.type", "tu", "doc", "observed_at", "confidence", "source")


def raw_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each relationship that a text unit states: source, target, relationship_type, weight, tu, doc, observed_at, confidence."""
    each = F.explode(F.array(*[F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(t).alias("relationship_type")) for a, b, t in (("c", "p", "ORDERED"), ("p", "s", "SUPPLIED_BY"))]))
    return text_units(spark, sf_dir).withColumn("r", each).select("r.source", "r.target", "r.relationship_type", "weight", "tu", "doc", "observed_at", "confidence")


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, type, category (region/nation), value of every customer and supplier."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("category"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("name"), F.lit("CUSTOMER").alias("type"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("tag"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.lit("SUPPLIER").alias("type"), F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("value"), F.lit(None).cast("string").alias("tag"))
    return c.unionByName(s).join(places, F.col("k") == F.col("n_nationkey")).select("name", "type", "category", "value", "tag")


#: The same model for the oracle.
SQL = {
    "tu": "tu AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS tu, l_orderkey AS doc, 'C' || o_custkey AS c, 'P' || l_partkey AS p, 'S' || l_suppkey AS s, strftime(o_orderdate, '%Y-%m-%d') AS observed_at, round(1 - l_discount, 2) AS confidence, o_orderpriority AS source, l_quantity AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "re": "re AS (SELECT c AS name, 'CUSTOMER' AS type, tu, doc, observed_at, confidence, source FROM tu UNION ALL SELECT p, 'PART', tu, doc, observed_at, confidence, source FROM tu UNION ALL SELECT s, 'SUPPLIER', tu, doc, observed_at, confidence, source FROM tu)",
    "rr": "rr AS (SELECT c AS source, p AS target, 'ORDERED' AS relationship_type, weight, tu, doc, observed_at, confidence FROM tu UNION ALL SELECT p, s, 'SUPPLIED_BY', weight, tu, doc, observed_at, confidence FROM tu)",
    "fo": "fo AS (SELECT name, type, r_name || '/' || n_name AS category, value, tag FROM (SELECT 'C' || c_custkey AS name, 'CUSTOMER' AS type, c_nationkey AS k, c_acctbal AS value, c_mktsegment AS tag FROM customer UNION ALL SELECT 'S' || s_suppkey, 'SUPPLIER', s_nationkey, s_acctbal, NULL FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
}


def with_sql(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names) + " "
