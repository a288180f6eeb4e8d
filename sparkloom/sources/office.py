"""PDF and DOCX files as markdown, with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_SHOW = re.compile(rb"(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|\[(?:\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|[^\]()<>])*\])\s*(Tj|TJ|'|\")|\b(Td\b|TD\b|T\*|ET\b)", re.DOTALL)
_STRING = re.compile(rb"\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>|-?\d+(?:\.\d+)?", re.DOTALL)


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return data.decode("utf-16-be", "replace") if len(data) > 1 and data[0] == 0 or data[:2] == b"\xfe\xff" else data.decode("latin-1")
    unescape = lambda m: _ESCAPES.get(m[1], bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1] in (b"\n", b"\r") else m[1])
    data = re.sub(rb"\\([0-7]{1,3}|.)", unescape, raw[1:-1], flags=re.DOTALL)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def _shown(stream: bytes) -> str:
    """The text that a content stream shows; moves to another line are line ends, wide gaps within an array are blanks."""
    out: list[str] = []
    for m in _SHOW.finditer(stream):
        if m[3]:
            out.append("\n")
            continue
        if m[2] in (b"'", b'"'):
            out.append("\n")
        for s in _STRING.finditer(m[1]):
            if s[0][:1] in (b"(", b"<"):
                out.append(_pdf_string(s[0]))
            elif float(s[0]) < -200:
                out.append(" ")
    return re.sub(r"[ \t]+", " ", re.sub(r"\s*\n\s*", "\n", "".join(out))).strip()


def _stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.DOTALL)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body[: m.start()] else m[1]


def pdf_markdown(data: bytes) -> str:
    """`## Page N` and its text for every page with text; an error where there is none. Objects may lie in compressed object streams; fonts with
    encodings of their own aren't decoded."""
    objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(objects.values()):
        if b"/ObjStm" in body:
            raw = _stream(body)
            first, count = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
            head = list(map(int, raw[:first].split()[: 2 * count]))
            places = [*head[1::2], len(raw) - first]
            objects |= {n: raw[first + a : first + b] for n, a, b in zip(head[::2], places, places[1:], strict=False)}
    kids = {n: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] for n, b in objects.items() if (m := re.search(rb"/Kids\s*\[(.*?)\]", b, re.DOTALL))}
    inner = {k for own in kids.values() for k in own}
    todo, pages = [n for n in sorted(kids) if n not in inner][::-1], []
    while todo:
        n = todo.pop()
        todo += reversed(kids.get(n, []))
        if n not in kids and re.search(rb"/Type\s*/Page\b", objects.get(n, b"")):
            pages.append(n)
    pages = pages or [n for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for k, n in enumerate(pages, 1):
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[n], re.DOTALL)
        text = _shown(b"\n".join(_stream(objects.get(int(x), b"")) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1]))) if m else ""
        if text:
            out.append(f"## Page {k}\n\n{text}")
    if not out:
        raise ValueError("the PDF has no text")
    return "\n\n".join(out)


def docx_markdown(data: bytes) -> str:
    """Headings, paragraphs, list items and tables of a DOCX file, in order."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda x: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in x.iter())
    out = []
    for x in body if body is not None else ():
        if x.tag == f"{_W}p":
            style = x.find(f"{_W}pPr/{_W}pStyle")
            name = "" if style is None else style.get(f"{_W}val", "")
            m = re.fullmatch(r"(?i)heading\s*(\d)", name)
            t = text(x).strip()
            if t:
                out.append("#" * int(m[1]) + " " + t if m else "# " + t if name.lower() == "title" else "- " + t if x.find(f"{_W}pPr/{_W}numPr") is not None else t)
        elif x.tag == f"{_W}tbl":
            rows = [[text(c).strip().replace("|", "\\|").replace("\n", " ") for c in r.findall(f"{_W}tc")] for r in x.findall(f"{_W}tr")]
            if rows:
                lines = ["| " + " | ".join(r) + " |" for r in rows]
                out.append("\n".join([lines[0], "|" + " --- |" * len(rows[0]), *lines[1:]]))
    return "\n\n".join(out)


_READERS = {"pdf": pdf_markdown, "docx": docx_markdown}


def preprocess(spark: SparkSession, path: str, cache: DataFrame | None = None) -> DataFrame:
    """path, modified, text, error of every PDF and DOCX file below a folder; a file that can't be read has an error and no text. Files that the cache
    (same columns) has as new as they are come from there and aren't read."""
    from sparkloom.sources.files import stale

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{pdf,docx,PDF,DOCX}").load(path)
    found = found.where(~F.regexp_extract("path", r"([^/]+)$", 1).rlike(r"^[._~]")).withColumnRenamed("modificationTime", "modified")
    names = found.select("path", "modified")
    if cache is not None:
        found = found.join(stale(names, cache).select("path"), "path", "left_semi")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p, t, data in zip(part["path"], part["modified"], part["content"], strict=True):
                try:
                    rows.append((p, t, _READERS[p.rsplit(".", 1)[-1].lower()](bytes(data)), None))
                except Exception as e:  # noqa: BLE001 - a broken file is a row with its error
                    rows.append((p, t, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "modified", "text", "error"])

    fresh = found.select("path", "modified", "content").mapInPandas(run, "path string, modified timestamp, text string, error string")
    if cache is None:
        return fresh
    kept = cache.select("path", F.col("modified").alias("__m"), "text", "error").join(names, "path").where("__m >= modified")
    return fresh.unionByName(kept.select("path", F.col("__m").alias("modified"), "text", "error"))
