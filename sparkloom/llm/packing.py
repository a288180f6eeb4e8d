"""Operator 5: best-fit packing of tokenised documents into training sequences, by hierarchical residual packing.

Documents are tokenised once in an Arrow map; from there only narrow rows move. Pieces are hash-partitioned, every partition
packs its own by best fit (largest first) and emits its nearly full bins. Its underfull bins go up a tree: `fan_in` partitions
meet in one task, where the bins are themselves items of the next best-fit round, until one task is left. A task hands on at
most `carry` bins, the emptiest ones, so no task grows with the corpus; the others are final as they are, so nothing is lost.

A null or empty text has only the end token. Rows that repeat an id are packed like any others. A null id stays null. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import wordhash as W
from sparkloom.session import materialise

CAPACITY, END = 4096, 1
_SPECIAL = b"<|"


def _byte_values() -> dict[str, int]:
    """The usual printable stand-ins for bytes of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordCachedTokenizer:
    """Token ids as little-endian unsigned 32-bit bytes. The tokenizer's split never joins what ASCII white space separates, so the ids of
    every word between white space can be kept and looked up; only words not met before are encoded. The memory is emptied at `most` words.
    As the tokenizer lower-cases, A-Z are folded first, but in texts that may hold the name of a special token.

    New words of Latin script go through a merge engine built from the same file: ranks of byte strings in the order of the merges, the end
    of a word being the byte 255, which UTF-8 doesn't use. As every token has one merge only (checked on loading), taking the adjacent pair
    of least rank is what the tokenizer does. All other words, and all where the file isn't of this kind, go through the tokenizer itself."""

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.piece = Tokenizer.from_file(path), most, {}, None
        self._build(path)

    def _build(self, path: str) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = [x["pattern"]["Regex"] for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or len(splits) != 1:
            return
        value = _byte_values()
        raw = lambda t: bytes(value[c] for c in t[:-4]) + b"\xff" if t.endswith("</w>") else bytes(value[c] for c in t)
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for m in model["merges"]:
            t = raw("".join(m if isinstance(m, list) else m.split(" ")))
            if t in ranks:
                return
            ranks[t] = len(ranks) + 1
        special = {x["content"] for x in spec["added_tokens"]}
        ids = {ranks[raw(t)]: i for t, i in model["vocab"].items() if t not in special and raw(t) in ranks}
        self.ids, self.split = ids.__getitem__, regex.compile(splits[0]).findall
        self.piece = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """One item per text, in order; texts are taken in groups so that memory stays bounded."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and size < 1 << 20:
                size += len(texts[hi])
                hi += 1
            yield from self._group([t.lower().split() if _SPECIAL not in t else t.split() for t in texts[lo:hi]])
            lo = hi

    def _one(self, word: bytes) -> bytes | None:
        """The ids of a word, or None where only the tokenizer knows."""
        if word.isascii():
            if word.isalpha() and word.islower():
                return array("I", map(self.ids, self.piece(word + b"\xff"))).tobytes()
            stem, last = word[:-1], word[-1:]
            if last in b".,;:!?" and stem.isalpha() and stem.islower():
                found = self.known.get(stem)
                if found is None:
                    found = self.known[stem] = array("I", map(self.ids, self.piece(stem + b"\xff"))).tobytes()
                return found + array("I", map(self.ids, self.piece(last + b"\xff"))).tobytes()
            text = word.decode()
            if "<|" in text:
                return None
        else:
            text = word.decode("utf-8", "replace")
            if max(text) >= "\u0250" or "\u0130" in text or "<|" in text:
                return None
        text = text.lower()
        pieces = [text] if text.isalpha() else self.split(text)
        return b"".join([array("I", map(self.ids, self.piece(x.encode() + b"\xff"))).tobytes() for x in pieces])

    def _group(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        known = self.known
        words = list(chain.from_iterable(texts))
        found = list(map(known.get, words))
        if None in found:
            holes = [i for i, x in enumerate(found) if x is None]
            fresh = {words[i] for i in holes}
            if len(known) + len(fresh) > self.most:
                known.clear()
            new, rest = {}, []
            for word in fresh:
                ids = self._one(word) if self.piece else None
                if ids is None:
                    rest.append(word)
                else:
                    new[word] = ids
            for word, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), strict=True):
                new[word] = array("I", e.ids).tobytes()
            for i in holes:
                found[i] = new[words[i]]
            known |= new
        at = 0
        for t in texts:
            yield b"".join(found[at : at + len(t)])
            at += len(t)


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32 (and ids, where asked for)."""
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordCachedTokenizer(tokenizer_path)
        for b in (whole.slice(lo, 500) for whole in batches for lo in range(0, max(whole.num_rows, 1), 500)):
            texts = [t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, x in enumerate(tok.encode(texts)):
                x += end
                for k, at in enumerate(range(0, len(x), 4 * capacity)):
                    y = x[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(y) // 4)
                    crc.append(zlib.crc32(y))
                    if with_ids:
                        ids.append(np.frombuffer(y, dtype="<u4").astype(np.int32))
            out = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(id_col, text_col).mapInArrow(W.tidy(run), f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and the bins' fills. The open bins are kept by residual, and one big integer has a
    bit for every residual that occurs, so the tightest bin is found with a shift."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i in order.tolist():
        size = int(sizes[i])
        fit = there >> size
        if fit:
            r = size + ((fit & -fit).bit_length() - 1)
            k = by_residual[r].pop()
            if not by_residual[r]:
                there ^= 1 << r
        else:
            k, r = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = k, fills[k]
        fills[k] += size
        r -= size
        if r:
            by_residual[r].append(k)
            there |= 1 << r
    return bins, offsets, np.array(fills, np.int64)


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY, part_items: int = 20_000, fan_in: int = 4, carry: int = 4096, slack: int = 8) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` of at most `capacity`. part_items: rows a first-round partition holds on average. Where
    rows have more columns than `order` and the length, these are joined to their places at the end and take no part in the rounds."""
    pieces = materialise(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    parts = max(1, -(-pieces.count() // part_items))
    shift = 1 << 32

    def first(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", *order, "__row"], ascending=[False] + [True] * (len(order) + 1), kind="stable")
        k, offset, fills = best_fit(part["length"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"__row": part["__row"], "bin": part["__part"].to_numpy(np.int64) * shift + k, "offset": offset, "fill": fills[k]})

    keyed = pieces.select("__row", "length", *order, F.pmod(F.xxhash64("__row"), F.lit(parts)).cast("long").alias("__part"))
    packed = materialise(keyed.groupBy("__part").applyInPandas(first, "__row long, bin long, offset long, fill long"), "packed")
    near = capacity - slack

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["fill", "bin"], kind="stable")
        k, offset, fills = best_fit(part["fill"].to_numpy(np.int64), capacity)
        ids = part["bin"].to_numpy(np.int64)
        head = np.zeros(len(fills), np.int64)
        at_start = offset == 0
        head[k[at_start]] = ids[at_start]  # a merged bin takes the name of the bin that lies first in it
        out = pd.DataFrame({"bin": ids, "into": head[k], "shift": offset})
        left = np.flatnonzero(fills < near)
        left = left[np.argsort(fills[left], kind="stable")][:carry]
        up = pd.DataFrame({"bin": head[left], "into": -1, "shift": fills[left]})  # into -1: an underfull bin for the next round
        return pd.concat([out, up])

    level = packed.select("bin", "fill").where(F.col("fill") < near).distinct()
    moves: list[DataFrame] = []
    width = parts
    while width > 1:
        width = -(-width // fan_in)
        step = fan_in ** (len(moves) + 1)
        grouped = level.withColumn("__g", F.floor(F.shiftright("bin", 32) / F.lit(step)))
        done = materialise(grouped.groupBy("__g").applyInPandas(merge, "bin long, into long, shift long"), "merge")
        moves.append(done.where("into >= 0"))
        level = done.where("into < 0").select("bin", F.col("shift").alias("fill"))
    places = packed.select("__row", "bin", "offset")
    for m in moves:
        m = m.where("bin <> into")
        places = places.join(m, "bin", "left").select("__row", F.coalesce("into", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return pieces.join(places.withColumnRenamed("bin", "sequence_id"), "__row").drop("__row")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END, with_ids: bool = False, **options) -> DataFrame:
    """Tokenise and pack: one row per piece with id_col, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    pieces = tokenized_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids)
    out = pack(pieces, [id_col, "piece"], capacity, **options)
    return out.select(id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
