"""Ids, provenance and membership between the tables of the graph, as joins and rows; arrays are only built where a key bounds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise, shuffle_partitions


def attach_ids(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id and target_id of relationships by the names of entities (name, id); null where a name is unknown. Ids that are there stay."""
    a, b = entities.select(F.col("name").alias("source"), F.col("id").alias("__a")), entities.select(F.col("name").alias("target"), F.col("id").alias("__b"))
    old = lambda c: F.col(c) if c in relationships.columns else F.lit(None).cast("string")
    keep = [c for c in relationships.columns if c not in ("source_id", "target_id")]
    joined = relationships.withColumns({"__s": old("source_id"), "__t": old("target_id")}).join(a, "source", "left").join(b, "target", "left")
    return joined.select(*keep, F.coalesce("__s", "__a").alias("source_id"), F.coalesce("__t", "__b").alias("target_id"))


def postings(mentions: DataFrame, key: str = "name", unit: str = "tu", per: int = 1000, within: list[str] | None = None) -> DataFrame:
    """The inverted index key -> units: (key, part, units). The units of a key are spread by hash over parts, as many as its size asks for at about
    `per` units each, so that no array grows with the corpus. within: columns that a unit has one value of, such as the document; rows that are spread by
    them needn't move to be told apart."""
    pairs = mentions.select(*(within or []), key, unit).distinct().select(key, unit)
    size = pairs.groupBy(key).agg(F.ceil(F.count("*") / per).alias("__parts"))
    part = F.pmod(F.xxhash64(unit), F.col("__parts")).cast("int").alias("part")
    return pairs.join(size, key).groupBy(key, part).agg(F.array_sort(F.collect_list(unit)).alias("units"))


def annotate_units(units: DataFrame, mentions: DataFrame, relationships: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Text units (tu) with the distinct sorted names they mention and the ids of relationships (id, tu) they state; empty arrays for none.
    within: columns of all three that a unit has one value of, such as the document; rows that are spread by them needn't move for units."""
    none, unit = F.array().cast("array<string>"), [*(within or []), "tu"]
    e = mentions.groupBy(*unit).agg(F.array_sort(F.collect_set("name")).alias("entity_ids"))
    r = relationships.groupBy(*unit).agg(F.array_sort(F.collect_set("id")).alias("relationship_ids"))
    joined = units.join(e, unit, "left").join(r, unit, "left")
    return joined.withColumns({c: F.coalesce(c, none) for c in ("entity_ids", "relationship_ids")})


def document_units(documents: DataFrame, units: DataFrame) -> DataFrame:
    """Documents (doc) with the sorted ids of their text units (tu, doc); an empty array for none."""
    own = units.groupBy("doc").agg(F.array_sort(F.collect_set("tu")).alias("text_unit_ids"))
    return documents.join(own, "doc", "left").withColumn("text_unit_ids", F.coalesce("text_unit_ids", F.array().cast("array<string>")))


def provenance(contributions: DataFrame, documents: DataFrame) -> DataFrame:
    """Of text units that several documents contribute to (tu, doc, start): the latest time, the least confidence, the source and id of the
    document that comes first."""
    order = F.struct("start", "doc")
    joined = contributions.join(documents.select("doc", "observed_at", "confidence", "source"), "doc", "left")
    return joined.groupBy("tu").agg(F.max("observed_at").alias("observed_at"), F.min("confidence").alias("confidence"), F.min_by("source", order).alias("source"), F.min_by("doc", order).alias("primary_doc"))


def community_units(members: DataFrame, mentions: DataFrame, within: list[str] | None = None) -> DataFrame:
    """(community, tu): the text units that mention a member, each once. members: name, community. within: columns that a unit has one value
    of, such as the document; names then look up their communities by them, and only these come back."""
    own = members.select("name", "community").distinct()
    if not within:
        return mentions.select("name", "tu").join(own, "name").select("community", "tu").distinct()
    pairs = mentions.select(*within, "name", "tu")
    known = pairs.select(*within, "name").distinct().join(own, "name")
    return pairs.join(known, [*within, "name"]).select(*within, "community", "tu").distinct().select("community", "tu")


def community_ids(members: DataFrame) -> DataFrame:
    """(name, community_ids): an entity's communities by level, each once. members: name, level, community; levels bound the array."""
    first = members.groupBy("name", "community").agg(F.min("level").alias("level"))
    ordered = F.array_sort(F.collect_list(F.struct("level", "community")))
    return first.groupBy("name").agg(F.transform(ordered, lambda x: x["community"]).alias("community_ids"))


def community_tables(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables of nodes (title, level, community, degree) and communities (id, level, size, parent, edges) of all levels; parent is the
    community of the level above that the members belong to (the smallest of several)."""
    degree = edges.select(F.explode(F.array("source", "target")).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
    nodes = members.join(degree, "name", "left").select(F.col("name").alias("title"), "level", "community", F.coalesce("degree", F.lit(0)).alias("degree"))
    above = members.select("name", (F.col("level") + 1).alias("level"), F.col("community").alias("parent"))
    sized = members.join(above, ["name", "level"], "left").groupBy("level", "community").agg(F.count("*").alias("size"), F.min("parent").alias("parent"))
    a, b = (members.select(F.col("name").alias(c), "level", "community") for c in ("source", "target"))
    inner = edges.select("source", "target").join(a, "source").join(b, ["target", "level", "community"]).groupBy("level", "community").agg(F.count("*").alias("edges"))
    communities = sized.join(inner, ["level", "community"], "left").select(F.col("community").alias("id"), "level", "size", "parent", F.coalesce("edges", F.lit(0)).alias("edges"))
    return nodes, communities


def surviving_communities(members: DataFrame, entities: DataFrame) -> DataFrame:
    """The global search's filter: communities of which any member entity survived."""
    return members.join(entities.select("name").distinct(), "name", "left_semi").select("community").distinct()


def titled_reports(reports: DataFrame, titles: DataFrame) -> DataFrame:
    """Reports (community, ...) with a title from (community, title) where there is one, else their own, else `Community <id>`."""
    own = F.col("__own") if "title" in reports.columns else F.lit(None).cast("string")
    base = reports.withColumnRenamed("title", "__own") if "title" in reports.columns else reports
    return base.join(titles.select("community", "title"), "community", "left").withColumn("title", F.coalesce("title", own, F.concat(F.lit("Community "), F.col("community").cast("string")))).drop("__own")


def report_plan(communities: DataFrame, reports: DataFrame, affected: DataFrame) -> DataFrame:
    """What to do with the reports of communities: (community, action). `generate` where there is none or the community is affected, `keep` for
    the others, `drop` where the community is gone."""
    c, r = communities.select("community").distinct().withColumn("__c", F.lit(True)), reports.select("community").distinct().withColumn("__r", F.lit(True))
    a = affected.select("community").distinct().withColumn("__a", F.lit(True))
    both = c.join(r, "community", "full_outer").join(a, "community", "left")
    action = F.when(F.col("__c").isNull(), "drop").when(F.col("__r").isNull() | F.col("__a").isNotNull(), "generate").otherwise("keep")
    return both.select("community", action.alias("action"))


def refreshed_reports(reports: DataFrame, plan: DataFrame, made: DataFrame) -> DataFrame:
    """Reports that are kept and those newly made, of the same columns."""
    return reports.join(plan.where("action = 'keep'").select("community"), "community", "left_semi").unionByName(made, allowMissingColumns=True)


def numbered(rows: DataFrame, order: list[str], name: str, start: Column | int = 0) -> DataFrame:
    """Adds consecutive numbers from `start` in an order, without one task that sees all rows: sorted ranges are written with a number in each,
    and the ranges' sizes (one row per range) give the offsets. Equal rows get any of their numbers."""
    spark = rows.sparkSession
    sorted_rows = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    parts = materialise(sorted_rows.withColumn("__p", F.shiftright(at, 33)).withColumn("__i", at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    total, offsets = 0, []
    for p, n in sorted((r["__p"], r["n"]) for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect()):
        offsets.append((p, total))
        total += n
    shift = F.broadcast(spark.createDataFrame(offsets, "__p long, __o long"))
    first = start if isinstance(start, Column) else F.lit(start)
    return parts.join(shift, "__p").withColumn(name, F.col("__o") + F.col("__i") + first).drop("__p", "__i", "__o")


def human_readable_ids(existing: DataFrame, new: DataFrame, order: list[str], name: str = "human_readable_id") -> DataFrame:
    """New rows with numbers that go on behind the largest existing one."""
    last = existing.agg(F.max(name)).first()[0]
    return numbered(new, order, name, 0 if last is None else int(last) + 1)


def list_entities(members: DataFrame, category: str | None = None, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Entities of exactly this category and type, by name, and `total`, how many there are before the limit."""
    kept = members
    if category is not None:
        kept = kept.where(F.col("category") == category)
    if kind is not None:
        kept = kept.where(F.upper("type") == kind.upper())
    total = kept.agg(F.count("*").alias("total"))
    return kept.orderBy("name").limit(limit).join(F.broadcast(total))


def keep_columns(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that there are, in the wanted order."""
    return rows.select(*[c for c in wanted if c in rows.columns])


def largest(rows: DataFrame, by: str, n: int, ties: str) -> DataFrame:
    return rows.orderBy(F.desc(by), ties).limit(n)


def isolates(names: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(name, community): names without an edge share one bucket, numbered behind the largest community."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("name"))
    bucket = communities.agg((F.coalesce(F.max("community"), F.lit(-1)) + 1).alias("community"))
    return names.select("name").distinct().join(ends, "name", "left_anti").join(F.broadcast(bucket))


def collapsed(edges: DataFrame, order: list[str]) -> DataFrame:
    """One edge per unordered pair: of parallel ones the last by `order`."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    rest = [c for c in edges.columns if c not in ("source", "target")]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("__e")
    return edges.where("source <> target").groupBy(a.alias("source"), b.alias("target")).agg(last).select("source", "target", "__e.*")


def colours(kinds: DataFrame, kind: str, palette: list[str]) -> DataFrame:
    """A colour for each distinct kind, in order; numbers before words and by their value."""
    from pyspark.sql import Window

    own = kinds.select(F.col(kind).cast("string").alias(kind)).where(F.col(kind).isNotNull()).distinct()
    number = F.col(kind).try_cast("double")
    w = Window.orderBy(number.isNull(), number, kind)
    return own.select(kind, F.element_at(F.array(*map(F.lit, palette)), F.row_number().over(w) % len(palette) + 1).alias("colour"))


def node_community(members: DataFrame) -> DataFrame:
    """(title, community): a node's community on its finest level."""
    return members.groupBy("title").agg(F.max(F.struct("level", "community")).alias("m")).select("title", "m.community")
