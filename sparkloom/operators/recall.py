"""Structural and temporal filters, as predicates that Catalyst pushes down."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import matches_category


@dataclass
class RecallFilter:
    """All parts must hold; an unset part holds always. Times are half-open: since <= t < before."""

    since: str | None = None
    before: str | None = None
    category: str | None = None
    tags: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    min_confidence: float | None = None

    @property
    def is_empty(self) -> bool:
        return self == RecallFilter()

    def provenance(self) -> Column:
        """A null time fails `since` and passes `before`; a null confidence is 1."""
        at = F.coalesce(F.col("observed_at"), F.lit(""))
        parts = [at >= self.since] if self.since else []
        parts += [at < self.before] if self.before else []
        parts += [F.coalesce(F.col("confidence"), F.lit(1.0)) >= self.min_confidence] if self.min_confidence is not None else []
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def entities(self, categories: str = "community_ids") -> Column:
        out = self.provenance()
        if self.names:
            out = out & F.upper("name").isin([x.upper() for x in self.names])
        if self.types:
            out = out & F.upper("type").isin([x.upper() for x in self.types])
        if self.category:
            out = out & F.coalesce(F.exists(categories, lambda x: matches_category(self.category, x)), F.lit(False))
        return out

    def documents(self) -> Column:
        out = self.provenance()
        if self.category:
            out = out & matches_category(self.category, F.col("category"))
        if self.tags:
            out = out & F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, self.tags))), F.lit(False))
        return out

    def candidate_text_units(self, text_units: DataFrame, documents: DataFrame) -> DataFrame | None:
        """Ids of text units that pass, None where nothing restricts them (which differs from an empty set)."""
        if not (self.since or self.before or self.min_confidence is not None or self.category or self.tags):
            return None
        out = text_units.where(self.provenance())
        if self.category or self.tags:
            allowed = documents.where(self.documents()).select(F.col("id").alias("document_id"))
            out = out.join(allowed, "document_id", "left_semi")
        return out.select("id")


def relationships_within(relationships: DataFrame, entities: DataFrame, source: str = "source", target: str = "target", name: str = "name") -> DataFrame:
    """Relationships both of whose ends survived."""
    names = entities.select(F.col(name).alias("__n")).distinct()
    out = relationships.join(names, F.col(source) == F.col("__n"), "left_semi")
    return out.join(names, F.col(target) == F.col("__n"), "left_semi")


def network_edges(edges: DataFrame, seeds: DataFrame, inside: bool, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with both ends (inside) or just one end (not inside) among the seeds' names."""
    s = seeds.select(F.col("name").alias("__s"), F.lit(True).alias("__a")).distinct()
    t = s.select(F.col("__s").alias("__t"), F.col("__a").alias("__b"))
    both = edges.join(s, F.col(source) == F.col("__s"), "left").join(t, F.col(target) == F.col("__t"), "left")
    a, b = F.col("__a").isNotNull(), F.col("__b").isNotNull()
    return both.where(a & b if inside else a != b).select(*edges.columns)


def communities_of_level(communities: DataFrame, level: str | int, min_size: int = 0) -> DataFrame:
    """`coarsest`, `finest`, `all` or a level; unknown words mean coarsest."""
    low, high = communities.agg(F.min("level").alias("__l"), F.max("level").alias("__h")), str(level)
    known = high == "all" or high == "finest" or high.lstrip("-").isdigit()
    joined = communities.join(F.broadcast(low))
    wanted = F.lit(True) if high == "all" else F.col("level") == (F.col("__h") if high == "finest" else F.lit(int(high)) if known else F.col("__l"))
    return joined.where(wanted & (F.col("size") >= min_size)).select(*communities.columns)


def resolve_documents(documents: DataFrame, wanted: str, id_col: str = "id", path_col: str = "path", title_col: str = "title", mapping: DataFrame | None = None) -> DataFrame:
    """Documents of the first tier that has any: equal id, path that contains the text, title that contains it, mapped path (mapping: id, mapped)
    that contains it (any case)."""
    low = wanted.lower()
    own = documents if mapping is None else documents.join(mapping.select(F.col("id").alias("__mid"), "mapped"), F.col(id_col) == F.col("__mid"), "left")
    tier = F.when(F.col(id_col).cast("string") == wanted, 0).when(F.lower(path_col).contains(low), 1).when(F.lower(title_col).contains(low), 2)
    if mapping is not None:
        tier = tier.when(F.lower("mapped").contains(low), 3)
    found = own.withColumn("tier", tier).where("tier is not null")
    return found.join(F.broadcast(found.agg(F.min("tier").alias("__least"))), F.col("tier") == F.col("__least")).select(*documents.columns, "tier")


def relevant_reports(reports: DataFrame, nodes: DataFrame, names: DataFrame, community: str = "community") -> DataFrame:
    """Reports of communities that hold one of the names; nodes has (title, community)."""
    own = nodes.join(names.select(F.col("name").alias("title")), "title", "left_semi").select(F.col(community)).distinct()
    return reports.join(own, community, "left_semi")
