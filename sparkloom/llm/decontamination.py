"""Operator 9: benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words of an item are runs of letters, digits and non-ASCII characters after lower-casing A-Z; they become 64-bit hashes. One
automaton holds all items of a block. The words of every training document stream through it and it reports, for each word, the
length of the longest suffix of what was read that occurs in some item. Where that length reaches the window (10 words, or all
words of a shorter item), the words it covers are hit. Most of a text never gets near: a vectorised test finds the stretches
whose every adjacent word pair occurs in an item, and only stretches as long as the shortest window are streamed.

The automata are broadcast. Each has a bound: an item block holds at most `block_words` words (or one item), about 90 bytes a word;
while it is built the driver holds about 1.3 KB a word of this one block. A pass over the documents holds at most `pass_words` words
of blocks. A larger benchmark takes several passes, each of which adds its spans to a written table, so that the whole benchmark is
used and what a worker holds is bounded by `pass_words`.

Null and empty texts have no words and are never hit. Items without words match nothing. Items without an id hit like others; they
count as one item together, which has no name in `items_sha256`. Rows that repeat an id are treated
alike and each get a row. Empty tables give empty results; without items nothing is hit. Other columns are ignored by
`hit_spans` and kept unchanged by `decontaminate`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import wordhash as W
from sparkloom.session import materialise

WINDOW = 10
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_FOLD))


class SuffixAutomaton:
    """Of several sequences of word numbers. It is built with dictionaries and then kept in flat arrays, about 90 bytes per word: the
    transitions sorted by (state, word), and for states that hold a window of exactly `window` words the items it occurs in."""

    def __init__(self, items: list[list[int]], window: int):
        self.window = window
        step: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        owners: list[set[int] | None] = [None]

        def new(length: int) -> int:
            step.append({})
            link.append(-1)
            size.append(length)
            owners.append(None)
            return len(size) - 1

        def split(p: int, q: int, w: int) -> int:
            c = new(size[p] + 1)
            step[c], link[c] = dict(step[q]), link[q]
            link[q] = c
            while p >= 0 and step[p].get(w) == q:
                step[p][w] = c
                p = link[p]
            return c

        def extend(last: int, w: int) -> int:
            q = step[last].get(w)
            if q is not None:
                return q if size[q] == size[last] + 1 else split(last, q, w)
            cur, p = new(size[last] + 1), last
            while p >= 0 and w not in step[p]:
                step[p][w] = cur
                p = link[p]
            if p < 0:
                link[cur] = 0
            else:
                q = step[p][w]
                link[cur] = q if size[q] == size[p] + 1 else split(p, q, w)
            return cur

        shorts: dict[tuple[int, ...], list[int]] = {}
        for k, words in enumerate(items):
            last = 0
            for w in words:
                last = extend(last, w)
                if size[last] >= window:
                    owners[last] = owners[last] or set()
                    owners[last].add(k)
            if 0 < len(words) < window:
                shorts.setdefault(tuple(words), []).append(k)
        #: of states in which short items end: (length, items)
        self.short: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
        for words, ks in shorts.items():  # two short items may end in one state, one being a suffix of the other
            s = 0
            for w in words:
                s = step[s][w]
            self.short.setdefault(s, []).append((len(words), tuple(ks)))
        order = sorted(range(1, len(size)), key=lambda s: -size[s])
        for s in order:
            up = link[s]
            if owners[s] and up > 0 and size[up] >= window:
                owners[up] = (owners[up] or set()) | owners[s]
        #: cut: the state of the suffix of exactly `window` words; near: the next state from here up in which short items end
        cut, near = [-1] * len(size), [0] * len(size)
        for s in reversed(order):
            up = link[s]
            cut[s] = cut[up] if up > 0 and cut[up] >= 0 else (s if size[s] >= window else -1)
            near[s] = s if s in self.short else (near[up] if up > 0 else 0)
        self.link, self.size, self.cut, self.near = (np.array(x, np.int32) for x in (link, size, cut, near))
        keys = np.fromiter(((s << 32) | w for s, own in enumerate(step) for w in own), np.uint64)
        to = np.fromiter((t for own in step for t in own.values()), np.int32)
        by = np.argsort(keys)
        self.keys, self.to = keys[by], to[by]
        held = [s for s in range(1, len(size)) if cut[s] == s]
        self.held = np.array(held, np.int32)
        self.owner_at = np.cumsum([0] + [len(owners[s]) for s in held])
        self.owner = np.array([k for s in held for k in sorted(owners[s])], np.int32)

    def _next(self, s: int, w: int) -> int:
        if w < 0:
            return -1
        key = np.uint64((s << 32) | w)
        at = int(self.keys.searchsorted(key))
        return int(self.to[at]) if at < len(self.keys) and self.keys[at] == key else -1

    def _items(self, s: int) -> list[int]:
        at = int(self.held.searchsorted(self.cut[s]))
        return self.owner[self.owner_at[at] : self.owner_at[at + 1]].tolist()

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, list[int] | tuple[int, ...]]]:
        """(end, length, items) of every window that occurs; end is the place behind its last word. Words of no item have number -1."""
        s = n = 0
        for i, w in enumerate(words, 1):
            t = self._next(s, w)
            while t < 0 and s > 0:
                s = int(self.link[s])
                n = int(self.size[s])
                t = self._next(s, w)
            if t < 0:
                continue
            s, n = t, n + 1
            if n >= self.window:
                yield i, self.window, self._items(s)
            up = int(self.near[s])
            while up > 0:
                for m, items in self.short[up]:
                    if m <= n:
                        yield i, m, items
                up = int(self.near[self.link[up]]) if self.link[up] > 0 else 0


class ItemBlock:
    """A block of items as it is broadcast: the automaton, and sorted hashes of the words and adjacent pairs that occur."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        seqs = []
        for name, text in items:
            words = item_words(text)
            col = pa.array([" ".join(words)], pa.large_utf8())
            for _, _, buf, off in W.blocks(col, 1 << 30):
                seqs.append((name, W.words(buf, off, W.FOLDED, W.ALNUM)[0]))
        self.names = [name for name, _ in seqs]
        self.shortest = min([min(len(s), window) for _, s in seqs if len(s)], default=0)
        none = [np.zeros(0, np.uint64)]
        self.singles = np.unique(np.concatenate(none + [s for _, s in seqs]))
        self.pairs = np.unique(np.concatenate(none + [pair_key(s[:-1], s[1:]) for _, s in seqs]))
        self.automaton = SuffixAutomaton([np.searchsorted(self.singles, s).tolist() for _, s in seqs], window)

    def numbers(self, h: np.ndarray) -> list[int]:
        """Numbers of the words with these hashes, -1 for those that no item has."""
        at = np.searchsorted(self.singles, h)
        at[at == len(self.singles)] = 0
        return np.where(self.singles[at] == h, at, -1).tolist()

    def stretches(self, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words, each within a row, outside of which no window can lie."""
        if not self.shortest or not len(h):
            return
        if self.shortest == 1:
            start = np.flatnonzero(_member(h, self.singles))
            yield from _runs(start, start + 1, 1, self._joined(h, rows))
            return
        yield from _runs(*self._pair_runs(self._joined(h, rows)), self.shortest)

    def _joined(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        ok = _member(pair_key(h[:-1], h[1:]), self.pairs)
        inner = rows[1:-1]
        ok[inner[(inner > 0) & (inner < len(h))] - 1] = False
        return ok

    @staticmethod
    def _pair_runs(ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.diff(np.concatenate([[0], ok.astype(np.int8), [0]]))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(3)) ^ (b >> np.uint64(1))


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


def _runs(start: np.ndarray, end: np.ndarray, least: int, joined: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    if joined is None:
        keep = end - start >= least
        yield from zip(start[keep].tolist(), end[keep].tolist(), strict=True)
        return
    lo = None
    hi = -1
    for a in start.tolist():  # single words, put together where the pair between them occurs
        if lo is not None and a == hi and joined[a - 1]:
            hi = a + 1
            continue
        if lo is not None:
            yield lo, hi
        lo, hi = a, a + 1
    if lo is not None:
        yield lo, hi


def item_blocks(benchmark: DataFrame, item_id: str, text_col: str, window: int, block_words: int) -> Iterator[ItemBlock]:
    """The benchmark, read once in pieces, as blocks of at most block_words words (or one item)."""
    block: list[tuple[str, str]] = []
    size = 0
    for name, text in benchmark.select(F.col(item_id).cast("string"), text_col).toLocalIterator():
        n = len(item_words(text))
        if not n:
            continue
        if block and size + n > block_words:
            yield ItemBlock(block, window)
            block, size = [], 0
        block.append((name, text))
        size += n
    if block:
        yield ItemBlock(block, window)


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(column: pa.Array, blocks: list[ItemBlock]) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str | None], np.ndarray, np.ndarray]]:
    """Per row: its number, its words, hit spans (words), item names, the words' first and end bytes."""
    for lo, hi, buf, off in W.blocks(column):
        h, starts, ends, rows = W.words(buf, off, W.FOLDED, W.ALNUM)
        spans: dict[int, list[tuple[int, int]]] = {}
        names: dict[int, set[str | None]] = {}
        for block in blocks:
            for a, b in block.stretches(h, rows):
                r = int(np.searchsorted(rows, a, side="right")) - 1
                for end, m, items in block.automaton.stream(block.numbers(h[a:b])):
                    at = a + end - int(rows[r])
                    spans.setdefault(r, []).append((at - m, at))
                    names.setdefault(r, set()).update(block.names[k] for k in items)
        for r in range(hi - lo):
            x, y = int(rows[r]), int(rows[r + 1])
            yield lo + r, y - x, _union(spans.get(r, [])), names.get(r, set()), starts[x:y] - off[r], ends[x:y] - off[r]


def _passes(benchmark: DataFrame, item_id: str, item_text: str, window: int, block_words: int, pass_words: int) -> Iterator[list]:
    """Broadcast blocks, at most pass_words words (or one block) at a time; one empty list for a benchmark without words."""
    context = benchmark.sparkSession.sparkContext
    held, size, any_yet = [], 0, False
    for block in item_blocks(benchmark, item_id, item_text, window, block_words):
        n = len(block.automaton.keys)
        if held and size + n > 3 * pass_words:  # an automaton has up to three transitions a word
            yield held
            held, size, any_yet = [], 0, True
        held.append(context.broadcast(block))
        size += n
    if held or not any_yet:
        yield held


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _before_last(docs: DataFrame, text_col: str, passes: Iterator[list]) -> tuple[DataFrame, list]:
    """The rows with what all passes but the last found (__spans, __names; nulls where there is one pass), and the last pass's blocks. Every pass
    is a job of its own over a written table, so that a worker holds the blocks of one pass at a time."""
    rows = docs.withColumn("__spans", F.lit(None).cast("array<struct<start: long, end: long>>")).withColumn("__names", F.lit(None).cast("array<string>"))
    at, schema = docs.columns.index(text_col), rows.schema
    blocks = next(passes)
    for following in passes:

        def run(batches: Iterator[pa.RecordBatch], blocks: list = blocks) -> Iterator[pa.RecordBatch]:
            own = [b.value for b in blocks]
            for batch in batches:
                found = list(_merged(batch, at, own))
                columns = [*batch.columns[:-2], pa.array([[{"start": a, "end": b} for a, b in hit] for _, _, hit, *_ in found], _SPANS), pa.array([list(names) for *_, names, _, _ in found], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        rows = materialise(rows.mapInArrow(W.tidy(run), schema), "benchmark-pass")
        for b in blocks:
            b.destroy()
        blocks = following
    return rows, blocks


def _merged(batch: pa.RecordBatch, at: int, own: list[ItemBlock]) -> Iterator[tuple]:
    """What _scan yields, joined with what earlier passes found."""
    spans, names = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    for r, n, hit, found, starts, ends in _scan(batch.column(at), own):
        if spans[r].is_valid and len(spans[r]):
            hit = _union(hit + [(x["start"], x["end"]) for x in spans[r].as_py()])
            found = found | set(names[r].as_py())
        yield r, n, hit, found, starts, ends


def hit_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = 200_000, pass_words: int = 2_000_000) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans (array of {start, end} in words)."""
    rows, blocks = _before_last(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", _passes(benchmark, item_id, item_text, window, block_words, pass_words))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.value for b in blocks]
        for batch in batches:
            n_words, n_hit, n_items, digest, spans = [], [], [], [], []
            for _, n, hit, names, _, _ in _merged(batch, 1, own):
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in hit))
                n_items.append(len(names))
                digest.append(hashlib.sha256(",".join(sorted(x for x in names if x is not None)).encode()).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in hit])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(spans, _SPANS)],
                names=[id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    return rows.mapInArrow(W.tidy(run), f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = 200_000, pass_words: int = 2_000_000) -> DataFrame:
    """The rows with all hit spans cut out of their text; rows of which more than max_coverage of the words are hit go as a whole. Columns
    are unchanged (a column n_chars, where there is one, is counted again for rows that were cut)."""
    rows, blocks = _before_last(docs, text_col, _passes(benchmark, item_id, item_text, window, block_words, pass_words))
    at = docs.columns.index(text_col)
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b.value for b in blocks]
        for batch in batches:
            keep, cut = [], {}
            for r, n, hit, _, starts, ends in _merged(batch, at, own):
                covered = sum(b - a for a, b in hit)
                if hit and covered > max_coverage * n:
                    continue
                keep.append(r)
                if hit:
                    raw, out, last = batch.column(at)[r].as_py().encode(), [], 0
                    for a, b in hit:
                        out.append(raw[last : int(starts[a])])
                        last = int(ends[b - 1])
                    out.append(raw[last:])
                    cut[r] = b"".join(out).decode()
            columns = list(batch.columns[:-2])
            if cut:
                texts = batch.column(at).to_pylist()
                for r, t in cut.items():
                    texts[r] = t
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    counts = batch.column(chars).to_pylist()
                    for r, t in cut.items():
                        counts[r] = len(t)
                    columns[chars] = pa.array(counts, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2]).take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(W.tidy(run), docs.schema)


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return hit_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, list_slice(ws, i, i + least(len(ws), 10) - 1) AS win
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT m FROM iw),
dw AS (
  SELECT doc_id, i, m, list_slice(ws, i, i + m - 1) AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, lens WHERE len(ws) >= m)),
occ AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
hits AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
