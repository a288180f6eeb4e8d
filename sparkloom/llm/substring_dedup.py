"""Operator 10: substring deduplication by recompression.

Every text, a sequence of word hashes, is recompressed. First each maximal run of one word becomes a symbol that is named by the word
and the run's length. Then come rounds: a round puts each symbol on the left or right side by a bit of its hash, the same bit in the
whole corpus, and gives each adjacent (left, right) pair one new symbol, named by a hash of the two. Names and sides depend on nothing
else, so in all tasks equal passages get equal symbols except at their ends: the first and the last run of a passage may go on outside
of it, and of the runs between them at most three at each end are drawn into symbols across it in `ROUNDS` = 2 rounds. Four
consecutive symbols of the last round make a high-level symbol (about seven words); a window takes of those that lie surely within it
the one of least hash as its anchor. Windows that have none, as they consist of few runs, are their own anchor. Both cases depend on
the window's words alone, so equal windows have equal anchors.

1. Anchors are counted over the corpus: a window whose anchor occurs once is unique. What comes back is a bitmap of a fixed size
   (`slot_bits`); a slot shared by chance only means more to verify.
2. The windows that are left are verified on their 20 words, by two independent hashes of together 96 bits (at 10**12 windows the chance
   that any two different ones are taken for equal is about 10**-5): they meet in a shuffle, reduced before it to the first occurrence
   in every batch, and the first occurrence in the corpus of each is found. Nothing is gathered per passage, so one that a third of
   all rows share costs a record per batch.
3. First occurrences go back to their documents, and every candidate window that isn't one covers words that go.

Words are runs of characters but space and U+0009 to U+000D, unchanged. Null and empty texts have no words. Documents with fewer
words than the window keep all. Texts of any length are taken whole. Ids must be integers; a null id is smaller than all others. Rows that repeat id and text share
one decision; rows of one id with different texts are told apart by a hash of the text, which then orders windows of equal
starts. An empty table gives an empty result. Other columns are ignored, or kept unchanged by `drop_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks as B
from sparkloom.llm import wordhash as W
from sparkloom.session import materialise, shuffle_partitions

WINDOW = 20
ROUNDS = 2
_FIRST = np.dtype([("w", "<u8"), ("check", "<u4"), ("id", "<i8"), ("text", "<i4"), ("at", "<u4")])
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03)
_NULL_ID = -(1 << 63)


def name_runs(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal neighbours within a row as symbols, and the word each starts at."""
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[rows[:-1][rows[:-1] < len(h)]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(h))).astype(np.uint64)
    sym = h[start]
    return np.where(size == 1, sym, W.mix(sym * _C2 + W.mix(size * _C1))), start


def name_pairs(sym: np.ndarray, start: np.ndarray, is_first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Round k: adjacent (left, right) pairs as symbols; pairs never run across rows."""
    left = W.mix(sym + np.uint64((k + 1) * int(_C1) % (1 << 64))) & np.uint64(1) == 1
    first = is_first[start]
    pair = np.zeros(len(sym), bool)
    pair[:-1] = left[:-1] & ~left[1:] & ~first[1:]
    gone = np.zeros(len(sym), bool)
    gone[1:] = pair[:-1]
    named = sym.copy()
    at = np.flatnonzero(pair)
    named[at] = W.mix(sym[at] * _C1 + W.mix(sym[at + 1] * _C2 + np.uint64(k)))
    return named[~gone], start[~gone]


def recompress(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols after all rounds, each run's symbol, and each word's run."""
    sym, start = name_runs(h, rows)
    run_of = np.zeros(len(h), np.int64)
    run_of[start[1:]] = 1
    runs, run_of = start, np.cumsum(run_of)
    is_first = np.zeros(len(h) + 1, bool)
    is_first[rows] = True
    for k in range(ROUNDS):
        sym, start = name_pairs(sym, start, is_first, k)
    of = np.zeros(len(h), np.int64)
    of[start[1:]] = 1
    return sym, np.cumsum(of)[runs], run_of


def window_anchors(h: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (their first words), the anchor of each, and of each anchor's place its value and whether it surely repeats nearby."""
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    row_end = np.repeat(rows[1:], np.diff(rows))
    p = np.flatnonzero(np.arange(n) + window <= row_end[:n])
    if not len(p):
        return none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool)
    sym, symbol_of, run_of = recompress(h, rows)
    quad = sym.copy()
    for d in (1, 2, 3):
        quad[:-d] = quad[:-d] * _C2 + sym[d:] * np.uint64((int(_C1) + 2 * d) % (1 << 64))
    quad = W.mix(quad)
    low = np.uint64(15)
    place = np.arange(len(quad))
    quad = (quad & ~low) | (place.astype(np.uint64) & low)
    least = [quad]
    for d in (1, 2, 4):
        x = least[-1].copy()
        x[:-d] = np.minimum(x[:-d], least[-1][d:])
        least.append(x)
    table = np.stack(least)
    # whole runs are those between the window's first and last; three of them at each end may belong to symbols that reach out
    first, last = run_of[p] + 4, run_of[p + window - 1] - 4
    inner = np.flatnonzero(last >= first)
    lo, hi = symbol_of[first[inner]], symbol_of[last[inner]] - 3
    some = hi >= lo
    inner, lo, hi = inner[some], lo[some], np.minimum(hi[some], lo[some] + 15)  # places are told apart by four bits
    level = np.array([0, 0, 1, 1, 2, 2, 2, 2] + [3] * 24)[hi - lo]
    best = np.minimum(table[level, lo], table[level, hi - (1 << level) + 1])
    chosen = np.zeros(len(quad), bool)
    chosen[lo + ((best.astype(np.int64) - lo) & 15)] = True
    own = np.ones(len(p), bool)
    own[inner] = False
    anchor = np.empty(len(p), np.uint64)
    anchor[inner] = best & ~low
    anchor[own] = W.window_hashes(h, window)[p[own]] & ~low
    value = quad & ~low
    twice = np.zeros(len(quad), bool)
    for d in range(1, min(16, len(quad))):
        same = value[:-d] == value[d:]
        twice[:-d] |= same
        twice[d:] |= same
    return p, anchor, np.concatenate([value[chosen], anchor[own]]), np.concatenate([twice[chosen], np.zeros(int(own.sum()), bool)])


def _texts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple]:
    for batch in batches:
        for lo, hi, buf, off in W.blocks(batch.column("__text")):
            h, starts, ends, rows = W.words(buf, off, W.BYTES, W.NOT_SPACE)
            yield batch, lo, hi, buf, h, starts, ends, rows


def _distinct(value: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Sorted distinct values; the lowest bit says whether a value was there more than once."""
    order = np.argsort(value, kind="stable")
    value, twice = value[order], twice[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    if not len(first):
        return value
    many = (np.diff(np.concatenate([first, [len(value)]])) > 1) | np.logical_or.reduceat(twice, first)
    return value[first] | many.astype(np.uint64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("__id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("__hash"), text.alias("__text"))


def repeated_anchors(keyed: DataFrame, window: int, slot_bits: int, buckets: int) -> np.ndarray:
    """Step 1: the bitmap of anchors that occur at two places or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, flags, size = [], [], 0
        for *_, h, _, _, rows in _texts(batches, window):
            _, _, value, twice = window_anchors(h, rows, window)
            values.append(value)
            flags.append(twice)
            size += len(value)
            if size > 2_000_000:
                v = _distinct(np.concatenate(values), np.concatenate(flags))
                yield B.to_blocks(v, v, buckets, True)
                values, flags, size = [], [], 0
        if size:
            v = _distinct(np.concatenate(values), np.concatenate(flags))
            yield B.to_blocks(v, v, buckets, True)

    def repeated(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        v = B.read_blocks(batches, "<u8")
        one = np.uint64(1)
        v = _distinct(v & ~one, (v & one) == one)
        return v[(v & one) == one] & ~one

    return B.collect_bitmap(keyed.select("__text").mapInArrow(W.tidy(count), B.BLOCK_SCHEMA), buckets, slot_bits, repeated)


def first_occurrences(keyed: DataFrame, bitmap, window: int, slot_bits: int, buckets: int) -> DataFrame:
    """Step 2: (__id, __hash, at) of the first occurrence of every candidate window, as binary lists of starts."""

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        held, size = [], 0
        for batch, lo, _, _, h, _, _, rows in _texts(batches, window):
            p, anchor, _, _ = window_anchors(h, rows, window)
            p = p[B.test_bits(bits, B.slots_of(anchor, slot_bits))]
            if not len(p):
                continue
            row = np.searchsorted(rows, p, side="right") - 1
            rec = np.empty(len(p), _FIRST)
            rec["w"] = W.window_hashes(h, window)[p]
            rec["check"] = W.window_hashes(W.mix(h ^ _C2), window)[p] >> np.uint64(32)
            rec["id"] = batch.column("__id").to_numpy(zero_copy_only=False)[lo + row]
            rec["text"] = batch.column("__hash").to_numpy(zero_copy_only=False)[lo + row]
            rec["at"] = p - rows[row]
            held.append(_firsts(rec))
            size += len(held[-1])
            if size > 1_000_000:
                rec = _firsts(np.concatenate(held))
                yield B.to_blocks(rec["w"], rec, buckets, True, True)
                held, size = [], 0
        if size:
            rec = _firsts(np.concatenate(held))
            yield B.to_blocks(rec["w"], rec, buckets, True, True)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec = _firsts(B.read_blocks(batches, _FIRST, True))
        rec = rec[np.lexsort((rec["at"], rec["text"], rec["id"]))]
        if not len(rec):
            return
        new = np.flatnonzero((np.diff(rec["id"]) != 0) | (np.diff(rec["text"]) != 0)) + 1
        first = np.concatenate([[0], new])
        last = np.concatenate([new, [len(rec)]])
        at = np.ascontiguousarray(rec["at"])
        for lo in range(0, len(first), 20_000):
            a, b = first[lo : lo + 20_000], last[lo : lo + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(rec["id"][a]), pa.array(rec["text"][a]), pa.array([at[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], names=["__id", "__hash", "at"])

    blocks = keyed.mapInArrow(W.tidy(candidates), B.BLOCK_SCHEMA).repartition(buckets, "bucket")
    return blocks.mapInArrow(W.tidy(reduce), "__id long, __hash int, at binary")


def _firsts(rec: np.ndarray) -> np.ndarray:
    """The first record of each window, sorted by the window's hash."""
    rec = rec[np.lexsort((rec["at"], rec["text"], rec["id"], rec["check"], rec["w"]))]
    keep = np.ones(len(rec), bool)
    keep[1:] = (rec["w"][1:] != rec["w"][:-1]) | (rec["check"][1:] != rec["check"][:-1])
    return rec[keep]


def _kept_words(docs: DataFrame, id_col: str, text_col: str, window: int, slot_bits: int, carried: bool) -> DataFrame:
    """Per input row: __id, n_words, n_removed, kept_sha256, kept_text and, where asked for, __row: the whole row."""
    if window < WINDOW:
        raise ValueError(f"anchors need windows of at least {WINDOW} words")
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    keyed = _keyed(docs, id_col, text_col)
    bitmap = spark.sparkContext.broadcast(repeated_anchors(keyed, window, slot_bits, buckets))
    firsts = materialise(first_occurrences(keyed, bitmap, window, slot_bits, buckets), "first-windows")
    firsts = firsts.groupBy("__id", "__hash").agg(F.collect_list("at").alias("__at"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carried else F.lit(None).cast("int")
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(row.alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("__id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("__hash"), text.alias("__text"))
    joined = whole.join(firsts, ["__id", "__hash"], "left").select("__id", "__text", "__at", "__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch, lo, hi, buf, h, starts, ends, rows in _texts(batches, window):
            p, anchor, _, _ = window_anchors(h, rows, window)
            p = p[B.test_bits(bits, B.slots_of(anchor, slot_bits))]
            stay = np.zeros(len(h), bool)
            for r, lists in enumerate(batch.column("__at")[lo:hi].to_pylist()):
                for x in lists or ():
                    stay[np.frombuffer(x, "<u4").astype(np.int64) + rows[r]] = True
            p = p[~stay[p]]
            edge = np.zeros(len(h) + 1, np.int32)
            np.add.at(edge, p, 1)
            np.add.at(edge, p + window, -1)
            removed = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            kept = np.flatnonzero(~removed)
            text, bounds = joined_words(buf, starts[kept], ends[kept])
            at = np.searchsorted(kept, rows)
            out = [bytes(text[bounds[at[r]] : max(bounds[at[r]], bounds[at[r + 1]] - 1)]) for r in range(hi - lo)]
            columns = [batch.column("__id").slice(lo, hi - lo), pa.array(np.diff(rows)), pa.array((total[rows[1:]] - total[rows[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())]
            columns += [pa.array([x.decode() for x in out], pa.string()) if carried else pa.nulls(hi - lo, pa.string()), batch.column("__row").slice(lo, hi - lo)]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "n_words", "n_removed", "kept_sha256", "kept_text", "__row"])

    return joined.mapInArrow(W.tidy(cut), f"__id long, n_words long, n_removed long, kept_sha256 string, kept_text string, __row {joined.schema['__row'].dataType.simpleString()}")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slot_bits: int = 28, with_text: bool = False) -> DataFrame:
    """One row per input row: id_col, n_words, n_removed, kept_sha256 (and kept_text where asked for)."""
    found = _kept_words(docs, id_col, text_col, window, slot_bits, with_text)
    back = F.when(F.col("__id") != _NULL_ID, F.col("__id")).cast(docs.schema[id_col].dataType)
    return found.select(back.alias(id_col), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, slot_bits: int = 28) -> DataFrame:
    """All rows; texts that repeat words of earlier ones have only the words that stay, joined by one space (none: an empty text). Columns are
    unchanged (a column n_chars, where there is one, is counted again for rows that were cut)."""
    found = _kept_words(docs, id_col, text_col, window, slot_bits, True)
    cut = F.col("n_removed") > 0
    new = {text_col: F.when(cut, F.col("kept_text")).otherwise(F.col(f"__row.{text_col}"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text")).otherwise(F.col("__row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a space behind each, and the place each starts at."""
    size = ends - starts + 1
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    index = np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], size)
    if len(index):
        index[-1] = min(index[-1], len(buf) - 1)
    out = buf[np.minimum(index, max(len(buf) - 1, 0))] if len(index) else np.zeros(0, np.uint8)
    out[bounds[1:] - 1] = 0x20
    return out, bounds


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS x, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
