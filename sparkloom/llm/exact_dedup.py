"""Operator 1: exact deduplication by progressive refinement.

Rows are grouped by byte length and, within a length, by the hash of a short prefix; both come from one scan that touches only
the head of a text. Only rows whose (length, prefix) group may hold several rows get a hash of their full content. Which
groups those are is passed to the second scan as an occupancy bitmap of a fixed number of slots (`slot_bits`), so that what is
broadcast has a bound and no text is ever shuffled; a slot shared by chance only costs one more full hash.

Equal texts: identical after lower-casing A-Z. Null counts as empty text. The row with the largest id stays; a null id is
smaller than all others. Rows that repeat an id and a text are the same document and share one decision; rows of one id with
different texts are decided each for itself. Texts of any length are hashed whole, in the JVM. An empty table gives an empty
result. Other columns of the input are ignored, whatever their names, and kept unchanged by `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups that are looked up by broadcast as they may be hot; of the others, none holds more than 1 / HOT_GROUPS of all rows.
HOT_GROUPS = 1000


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take Spark's fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def attach_group_facts(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of rows with one row per group. The largest groups are broadcast (HOT_GROUPS rows at most), so a hot key never meets in one task."""
    hot = F.broadcast(groups.orderBy(F.desc(size), key).limit(HOT_GROUPS))
    cold = groups.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))


def _shared_rows(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, slot_bits: int) -> DataFrame:
    """(__id, __text, __hash, __shared): whether another row may have the same length and prefix."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slot = F.pmod(F.xxhash64(F.octet_length(text), ascii_lower(F.substring(text, 1, prefix_chars))), F.lit(1 << slot_bits))
    refined = docs.select(slot.alias("__slot")).groupBy("__slot").count().where("count > 1")
    occupied = refined.groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__slot & 63 as int))")).alias("__bits"))
    staged = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), text_hash(text_col).alias("__hash"), slot.alias("__slot")).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(occupied), "__word", "left")
    return staged.withColumn("__shared", F.expr("coalesce(shiftright(__bits, cast(__slot & 63 as int)) & 1L, 0L) = 1L"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, slot_bits: int = 24, all_digests: bool = False) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256 (only of rows that needed a full hash, unless all_digests)."""
    staged = _shared_rows(docs, id_col, text_col, prefix_chars, slot_bits)
    digest = F.sha2(ascii_lower(F.col("__text")), 256)
    rows = materialise(staged.select("__id", "__shared", (digest if all_digests else F.when(F.col("__shared"), digest)).alias("text_sha256")), "exact-rows")
    shared = rows.where("__shared")
    groups = shared.groupBy("text_sha256").agg(F.max("__id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    found = attach_group_facts(shared, materialise(groups, "exact-groups"), "text_sha256", "group_size")
    found = found.unionByName(rows.where("not __shared"), allowMissingColumns=True)
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return found.select(F.col("__id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("__id").eqNullSafe(keep).alias("kept"), "text_sha256")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str, slot_bits: int = 24) -> DataFrame:
    """The rows of docs that stay by decisions (__id, __hash, __stays, of every row of docs; __hash is `text_hash`). Of rows that repeat id and text one
    stays at most, whichever; the columns are unchanged.

    Two bitmaps of a fixed size say which slots hold rows that stay and rows that go. Rows whose slot holds one kind only are decided in place, so that
    texts don't move; the others (repeated rows, and slots shared by chance) are joined with their decisions."""
    slot = lambda: F.pmod(F.xxhash64("__id", "__hash"), F.lit(1 << slot_bits))
    verdicts = materialise(decisions.groupBy("__id", "__hash").agg(F.max("__stays").alias("__stays"), F.count("*").alias("__n")), "verdicts")
    bit = F.expr("shiftleft(1L, cast(__slot & 63 as int))")
    goes, stays = F.expr("not __stays or __n > 1"), F.col("__stays")
    bits = verdicts.withColumn("__slot", slot()).groupBy(F.shiftright("__slot", 6).alias("__word")).agg(F.bit_or(F.when(goes, bit).otherwise(F.lit(0).cast("long"))).alias("__go"), F.bit_or(F.when(stays, bit).otherwise(F.lit(0).cast("long"))).alias("__stay"))
    bits = materialise(bits.where("__go <> 0"), "verdict-bits")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    keyed = docs.select(row, F.col(id_col).alias("__id"), text_hash(text_col).alias("__hash")).withColumn("__slot", slot()).withColumn("__word", F.shiftright("__slot", 6))
    at = lambda c: F.expr(f"coalesce(shiftright({c}, cast(__slot & 63 as int)) & 1L, 0L) = 1L")
    keyed = keyed.join(F.broadcast(bits), "__word", "left").withColumn("__may_go", at("__go")).withColumn("__may_stay", at("__stay"))
    name = F.concat_ws("|", F.when(F.col("__id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("__id").cast("string"))), F.col("__hash").cast("string")).alias("__name")
    unsure = attach_group_facts(keyed.where("__may_go and __may_stay").select("__row", name), verdicts.select(name, "__stays", "__n"), "__name", "__n")
    settled = unsure.where("__stays").groupBy("__name").agg(F.first("__row").alias("__row"))
    return keyed.where("not __may_go").select("__row.*").unionByName(settled.select("__row.*"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of equal texts the row with the largest id stays; rows with a null id only where no copy has one. Of rows that repeat id and text (or that share
    that id and differ in the case of A-Z) one stays. Columns are unchanged."""
    rows = _shared_rows(docs, id_col, text_col, 64, 24).select("__id", "__hash", "__shared", F.when(F.col("__shared"), F.sha2(ascii_lower(F.col("__text")), 256)).alias("text_sha256"))
    rows = materialise(rows, "exact-rows")
    best = F.max(F.struct(F.col("__id").isNotNull(), F.col("__id"), F.col("__hash"))).alias("__best")
    shared = rows.where("__shared")
    groups = materialise(shared.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")).where("group_size > 1"), "exact-groups")
    found = attach_group_facts(shared, groups, "text_sha256", "group_size")
    stays = F.col("__best").isNull() | (F.col("__id").eqNullSafe(F.col("__best.__id")) & (F.col("__hash") == F.col("__best.__hash")))
    decisions = found.select("__id", "__hash", stays.alias("__stays")).unionByName(rows.where("not __shared").select("__id", "__hash", F.lit(True).alias("__stays")))
    return keep_rows(docs, decisions, id_col, text_col)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), all_digests=True)


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
h AS (SELECT doc_id, sha256(x) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
