"""Keeping communities and documents current without building everything again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.communities import label_propagation, leiden_partition
from sparkloom.operators.graph import k_hop, neighbours, simple_graph
from sparkloom.session import materialise


def strategy(changed: int, total: int, threshold: float = 0.3) -> str:
    """`propagate` where less than `threshold` of the nodes changed, else `recluster`."""
    return "propagate" if changed / max(total, 1) < threshold else "recluster"


def affected_communities(members: DataFrame, names: DataFrame) -> DataFrame:
    """(community): where any of these names is a member."""
    return members.join(names.select("name").distinct(), "name", "left_semi").select("community").distinct()


def next_community(members: DataFrame) -> int:
    """The number behind the largest community whose id is a number."""
    last = members.agg(F.max(F.col("community").cast("string").try_cast("long"))).first()[0]
    return 0 if last is None else last + 1


def propagate(edges: DataFrame, members: DataFrame, new: DataFrame, cap: int = 50, rounds: int = 10) -> DataFrame:
    """(name, community) of all members and new nodes: label propagation for the new ones, what is left shares one new community."""
    names = new.select("name").distinct()
    found = materialise(label_propagation(edges, members, cap, rounds), "propagated")
    known = members.select("name", "community").unionByName(found.join(names, "name", "left_semi").join(members, "name", "left_anti"))
    kind = members.schema["community"].dataType.simpleString()
    left = names.join(found, "name", "left_anti")
    return known.unionByName(left.withColumn("community", F.lit(next_community(members)).cast(kind)))


def recluster(edges: DataFrame, members: DataFrame, changed: DataFrame, max_size: int = 50) -> DataFrame:
    """(name, community): changed nodes and their neighbours are partitioned anew; each part takes the existing community that most of its
    neighbours are in (ties by id), parts without such neighbours get new numbers in the order of their names. All others keep theirs."""
    graph = materialise(simple_graph(edges), "recluster-edges")
    region = materialise(k_hop(graph, changed.select("name"), 1).select("name"), "recluster-region")
    a, b = region.select(F.col("name").alias("source")), region.select(F.col("name").alias("target"))
    inner = graph.join(a, "source", "left_semi").join(b, "target", "left_semi")
    parts = leiden_partition(inner, max_size, 1).select("name", F.col("community").alias("part"))
    alone = region.join(parts, "name", "left_anti").select("name", F.concat(F.lit("alone/"), "name").alias("part"))
    parts = materialise(parts.unionByName(alone), "recluster-parts")
    near = neighbours(graph).select(F.col("a").alias("name"), "b").join(parts, "name").join(members.select(F.col("name").alias("b"), "community"), "b")
    votes = near.groupBy("part", "community").agg(F.count("*").alias("n"))
    best = votes.groupBy("part").agg(F.max("n").alias("n")).join(votes, ["part", "n"]).groupBy("part").agg(F.min("community").alias("community"))
    from sparkloom.operators.linking import numbered

    kind = members.schema["community"].dataType.simpleString()
    fresh = numbered(parts.select("part").distinct().join(best, "part", "left_anti"), ["part"], "community", next_community(members)).select("part", F.col("community").cast(kind).alias("community"))
    placed = parts.join(best.unionByName(fresh), "part").select("name", "community")
    return placed.unionByName(members.select("name", "community").join(placed, "name", "left_anti"))


def update(edges: DataFrame, members: DataFrame, new: DataFrame, updated: DataFrame, deleted: DataFrame, total: int, threshold: float = 0.3, cap: int = 50) -> tuple[DataFrame, DataFrame]:
    """(members, affected communities) after nodes came, changed and went. Deleted nodes lose their edges; their communities count as affected."""
    gone = deleted.select("name").distinct()
    rest = members.join(gone, "name", "left_anti")
    ends = lambda c: gone.select(F.col("name").alias(c))
    edges = edges.join(ends("source"), "source", "left_anti").join(ends("target"), "target", "left_anti")
    changed = materialise(new.select("name").union(updated.select("name")).distinct().join(gone, "name", "left_anti"), "changed")
    n = changed.count() + gone.count()
    if strategy(n, total, threshold) == "propagate":
        out = materialise(propagate(edges, rest, new, cap), "members")
        return out, affected_communities(out, changed).union(affected_communities(members, gone)).distinct()
    out = materialise(recluster(edges, rest, changed, cap), "members")
    return out, out.select("community").union(affected_communities(members, gone)).distinct()


# documents


def append_documents(old: DataFrame, new: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All old documents and the new ones whose id isn't there yet."""
    return old.unionByName(new.join(old.select(id_col), id_col, "left_anti"), allowMissingColumns=True)


def edited_chunks(docs: DataFrame, chunks: DataFrame, edits: DataFrame, cut, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents with the texts of edits (id, text), and the chunks: those of other documents stay as they are, those of edited ones are cut anew
    by `cut`, a function of documents to chunks. Only edited documents are read for that. Edits of unknown ids are ignored."""
    changed = edits.select(id_col, F.col(text_col).alias("__text"))
    fresh = docs.join(changed, id_col).withColumn(text_col, F.col("__text")).drop("__text").select(*docs.columns)
    ids = changed.select(id_col).distinct()
    return docs.join(ids, id_col, "left_anti").unionByName(fresh), chunks.join(ids, id_col, "left_anti").unionByName(cut(fresh))


def delete_documents(units: DataFrame, mentions: DataFrame, statements: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Text units of deleted documents go, with what they mention and state; entities without a mention and relationships without a statement or
    without an end vanish."""
    ids = gone.select("doc").distinct()
    left = lambda t: t.join(ids, "doc", "left_anti")
    mentions, statements = left(mentions), left(statements)
    names = mentions.select("name").distinct()
    statements = statements.join(names.select(F.col("name").alias("source")), "source", "left_semi").join(names.select(F.col("name").alias("target")), "target", "left_semi")
    return {"units": left(units), "mentions": mentions, "statements": statements, "entities": names}


def change_log(old: DataFrame, new: DataFrame, key: list[str], value: Column) -> DataFrame:
    """What an update did, as rows of the history: key, `added`, `removed` or `changed`."""
    o, n = old.select(*key, value.alias("__o"), F.lit(True).alias("__in_o")), new.select(*key, value.alias("__n"), F.lit(True).alias("__in_n"))
    both = o.join(n, key, "full_outer")
    change = F.when(F.col("__in_o").isNull(), "added").when(F.col("__in_n").isNull(), "removed").when(~F.col("__o").eqNullSafe(F.col("__n")), "changed")
    return both.select(*key, change.alias("change")).where("change is not null")
