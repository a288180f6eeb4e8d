"""Operator 3: WARC archives, written and read with boundary-chain verification.

Writing: one record per row; every task writes archives of its own into a fresh folder and returns their paths, so that a task that
is run again leaves nothing double. Of equal payloads of at least `least_bytes`, the row with the smallest id is the response and
the others are revisit records without payload. Which digests occur more than once is found by a count; they are looked up by
broadcast up to a bounded number of them, beyond which rows of other digests still never meet a join.

Reading: archives are cut into splits of any size. A task finds all places in its split where a record may begin (the version line
may also stand inside a payload) and follows each one's length fields to the place where its chain leaves the split. Pointer
jumping over these exits, doubling each round, starts at each file's first byte and reaches one entry per split; only records on
the chain from an entry are records. A magic inside a payload is never reached.

Null html counts as empty. Null urls and urls of half a megabyte or more are left out, control characters in them are percent-encoded. Ids must be integers; a null
id id is smaller than all others and written as "null". Rows that repeat an id get a record each; the first of equal id is not
defined among them, they are all responses where the payload's smallest id is theirs. A payload of any length is one record, read
whole by the split it begins in. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.exact_dedup import attach_group_facts
from sparkloom.session import materialise, scratch_path, shuffle_partitions

MAGIC = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.IGNORECASE)
_HEAD = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def classify(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100, slot_bits: int = 24, known_groups: int = 100_000) -> DataFrame:
    """Input rows as (__id, __url, __html, __digest, __first): __first is the id of the response that a row revisits, else null. One narrow scan finds
    the digests of several rows. Up to `known_groups` of them are broadcast; of more, only those of the largest groups, and rows of the others (found
    through a bitmap of a fixed size) meet their groups in a join."""
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), F.col("url").cast("string").alias("__url"), html.alias("__html")).withColumn("__digest", F.unhex(F.sha2("__html", 256)))
    large = F.octet_length("__html") >= least_bytes
    first = F.when(F.count("*") > F.count("__id"), F.lit(None)).otherwise(F.min("__id"))
    groups = materialise(rows.where(large).groupBy("__digest").agg(first.alias("__first"), F.count("*").alias("__n")).where("__n > 1"), "warc-groups")
    columns = ["__id", "__url", "__html", F.lower(F.hex("__digest")).alias("__digest")]
    revisits = F.when(F.col("__n").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first")), F.struct(F.col("__first").alias("id"))).alias("__first")
    if groups.count() <= known_groups:
        return rows.join(F.broadcast(groups), "__digest", "left").select(*columns, revisits)
    slot = F.pmod(F.xxhash64("__digest"), F.lit(1 << slot_bits))
    occupied = groups.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("__bits"))
    marked = rows.withColumn("__slot", slot).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(occupied), "__word", "left")
    maybe = F.expr("coalesce(shiftright(__bits, cast(__slot & 63 as int)) & 1L, 0L) = 1L") & large
    shared = attach_group_facts(marked.where(maybe).select("__id", "__url", "__html", "__digest"), groups, "__digest", "__n")
    return shared.select(*columns, revisits).unionByName(marked.where(~maybe).select(*columns, F.lit(None).cast("struct<id: long>").alias("__first")))


def _name(x: int | None) -> str:
    return "null" if x is None else str(x)


def _record(row: tuple, date: str) -> bytes:
    page, url, html, digest, first = row
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{_name(page)}>", f"WARC-Date: {date}"]
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    if target is not None and len(target.encode()) < _HEAD // 2:
        head.append("WARC-Target-URI: " + target)
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{_name(first['id'])}>", f"WARC-Profile: {_PROFILE}"]
    block = http + (html if first is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes classified rows below folder (a URI that all executors reach) and returns (path, size) of each archive. An archive is
    closed when it holds archive_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, path, done = None, None, []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    path = f"{base}/{uuid.uuid4().hex}.warc"
                    out = fs.open_output_stream(path, buffer_size=1 << 20)
                out.write(_record(row, date))
                if out.tell() >= archive_bytes:
                    done.append((path, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, out.tell()))
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "size"])

    return rows.select("__id", "__url", "__html", "__digest", "__first").mapInArrow(run, "path string, size long")


def _chain(data: bytes, at: int, base: int) -> int | None:
    """The place of the record behind the one that seems to begin at `at`, or None if none can."""
    head = data.find(b"\r\n\r\n", at, at + _HEAD)
    found = _LENGTH.search(data, at, head + 2) if head >= 0 else None
    return None if found is None else base + head + 4 + int(found[1]) + 4


def candidate_exits(splits: DataFrame, folder: str) -> DataFrame:
    """(path, at, out): every place in a split where a record may begin, and where its chain leaves the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, lo, hi, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as f:
                    data = f.read_at(min(hi + _HEAD, size) - lo, lo)
                after: dict[int, int | None] = {}
                at = data.find(MAGIC)
                while 0 <= at < hi - lo:
                    after[lo + at] = _chain(data, at, lo)
                    at = data.find(MAGIC, at + 1)
                exits: dict[int, int | None] = {}
                for x in reversed(after):
                    y = after[x]
                    exits[x] = exits.get(y) if y is not None and y < hi else y if y is not None and y <= size else None
                keep = [(x, y) for x, y in exits.items() if y is not None]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(keep), pa.string()), pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], names=["path", "at", "out"])

    return splits.select("path", "lo", "hi", "size").mapInArrow(run, "path string, at long, out long")


def read_archives(archives: DataFrame, folder: str, split_bytes: int = 4 << 20) -> DataFrame:
    """The records of archives (path, size): record_type, page, refers_to, digest, url, block."""
    spark = archives.sparkSession
    splits = archives.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("lo")).withColumn("hi", F.least(F.col("lo") + split_bytes, F.col("size")))
    splits = materialise(splits.repartition(shuffle_partitions(spark), "path", "lo"), "warc-splits")
    jump = materialise(candidate_exits(splits, folder), "warc-exits")
    most = splits.groupBy("path").count().agg(F.max("count")).first()[0] or 1
    reached = archives.select("path", F.lit(0).cast("long").alias("at"))
    span = 1
    while span < most:  # after each round all entries within 2 * span splits of the start are known
        further = reached.join(jump, ["path", "at"]).select("path", F.col("out").alias("at"))
        reached = materialise(reached.union(further).distinct(), "warc-reached")
        span *= 2
        if span < most:
            then = jump.select("path", F.col("at").alias("out"), F.col("out").alias("then"))
            jump = materialise(jump.join(then, ["path", "out"]).select("path", "at", F.col("then").alias("out")), "warc-jump")
    entries = splits.join(reached, "path").where("at >= lo and at < hi").select("path", "at", "hi", "size")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, at, hi, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(path) as f:
                    data = f.read_at(min(hi + _HEAD, size) - at, at)
                    base, here, found, held = at, 0, [], 0
                    while base + here < hi:
                        head = data.find(b"\r\n\r\n", here)
                        fields = dict(x.split(b": ", 1) for x in data[here:head].split(b"\r\n")[1:])
                        n = int(fields[b"Content-Length"])
                        block = data[head + 4 : head + 4 + n]
                        if len(block) < n:  # a record that ends behind the split
                            block = f.read_at(n, base + head + 4)
                        found.append((fields, block))
                        held += n
                        here = head + 8 + n
                        if held > 8 << 20:
                            yield _record_rows(found)
                            found, held = [], 0
                    yield _record_rows(found)

    schema = "record_type string, page long, refers_to long, digest string, url string, block binary"
    return entries.mapInArrow(records, schema)


def _page(x: bytes | None) -> int | None:
    return None if x is None or x == b"<urn:page:null>" else int(x[10:-1])


def _record_rows(found: list[tuple[dict, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f[b"WARC-Type"].decode() for f, _ in found], pa.string()),
            pa.array([_page(f[b"WARC-Record-ID"]) for f, _ in found], pa.int64()),
            pa.array([_page(f.get(b"WARC-Refers-To")) for f, _ in found], pa.int64()),
            pa.array([f[b"WARC-Payload-Digest"].decode().removeprefix("sha256:") for f, _ in found], pa.string()),
            pa.array([f[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in f else None for f, _ in found], pa.string()),
            pa.array([b for _, b in found], pa.binary()),
        ],
        names=["record_type", "page", "refers_to", "digest", "url", "block"],
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 100, folder: str | None = None, split_bytes: int = 4 << 20) -> DataFrame:
    """Write and read back: one row per record with id, payload_bytes, payload_digest, record_type, refers_to. Digests of responses are
    taken from the payloads that were read; revisits have those of their headers."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archives = materialise(write_archives(classify(pages, id_col, html_col, least_bytes), folder), "warc-archives")

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, page, refers, digest, block = (batch.column(k).to_pylist() for k in (0, 1, 2, 3, 5))
            cut = [b.index(b"\r\n\r\n") + 4 for b in block]
            size = [int(_LENGTH.search(b, 0, c)[1]) for b, c in zip(block, cut, strict=True)]
            seen = [hashlib.sha256(b[c:]).hexdigest() if t == "response" else d for t, b, c, d in zip(kind, block, cut, digest, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(seen, pa.string()), pa.array(kind, pa.string()), pa.array(refers, pa.int64())], names=["__id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    back = read_archives(archives, folder, split_bytes).mapInArrow(payload, "__id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    kind = pages.schema[id_col].dataType
    return back.select(F.col("__id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
"""
