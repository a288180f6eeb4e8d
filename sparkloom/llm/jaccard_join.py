"""Operator 4: exact n-gram Jaccard self-join with set-relation skipping.

Two documents link when |A and B| * den >= num * |A or B| for their sets of word n-grams (here 60 / 100).

1. Document frequencies of all n-grams over the corpus give an order, rare first. A bitmap and a table of fixed size stand for
   them: which n-grams occur twice or more, and the logarithm of the larger frequencies. Any order gives the same links.
2. Each set's prefix in that order goes into inverted lists as (size, position). n-grams that occur once have no partner and are
   only counted. A pair of sets that link shares the first `SHARED` of its common n-grams within prefixes that both sizes
   determine, so an entry's position bounds the sizes of its partners. A list is sorted by size: from an entry, only the run of
   sizes within its own bound is looked at, and of that run whole blocks are skipped whose entries' positions don't reach the
   entry's size, or that are all of its group. A list of more than 2**`LIST_BITS` documents is cut into cells, which are lists of their own.
3. Answers are derived from those of a similar set: sets with the same two least hashes form a group, whose pairs the lists
   leave out. Near copies that differ in these would leave a large family to the lists, pair by pair; so a set has `KEYS` more
   keys, of three least hashes each, and sets of which `_FAMILY` or more share a key go to the group of that family's most
   frequent key instead (of the 100,000 most frequent ones). In a group one set is the hub; with r(A) = 8 |hub minus A| + 3 |A|, A and B surely link where r(A) + r(B) <= 8 |hub|
   (in units of the 60 % threshold), so a set's links are counted by a search in the sorted r, without visiting the pairs.
   Of the pairs that this leaves open, those that their differences to the hub allow are intersected, one set with all its open
   partners at once. A group of more than 2**`GROUP_BITS` sets is cut into chunks; each pair of chunks is a cell with a hub of its own.
4. Pairs of different groups come from the lists. Of each, one set travels to the other's group, once per group. Sets find their
   group by themselves and move once; travellers are looked up by broadcast up to `known_travellers` of them, by a join beyond.

Equal sets are one class from the start; their documents are never paired. Links are counted with the sizes of classes. Groups and
the number of documents only decide where a pair is solved, never whether. Within a family of N near copies that no hub settles the
work grows with N * N, spread over cells of a bounded size.

Words are runs of characters but space and U+0009 to U+000D after lower-casing A-Z. A document with fewer words than n has its
whole sequence as the only n-gram; null, empty and blank texts have an empty set, no links and are their own component. Ids must
be integers, null is the smallest. Rows that repeat an id are documents of their own. n-grams are compared by 48-bit hashes: two
different ones are taken for equal with a chance of 4e-15. Texts of any length are taken whole. An empty table gives an empty
result. Other columns are ignored, or kept unchanged by `drop_near_copies`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks as B
from sparkloom.llm import wordhash as W
from sparkloom.llm.exact_dedup import attach_group_facts, keep_rows, text_hash
from sparkloom.operators.components import connected_components
from sparkloom.session import materialise, shuffle_partitions

SHARED = 6
_NULL_ID = -(1 << 63)
_MASK48 = np.uint64((1 << 48) - 1)
_ENTRY = np.dtype([("e", "<u4"), ("sig", "<u8"), ("g", "<u4"), ("n", "<u4"), ("pos", "<u4")])
_HEAD = np.dtype([("sig", "<u8"), ("g", "<u4"), ("n", "<u4"), ("count", "<u4")])
_OWN = np.dtype([("e", "<u4"), ("pos", "<u4")])
_PAIR = np.dtype([("a", "<u8"), ("b", "<u8"), ("ga", "<u4"), ("gb", "<u4"), ("c", "<u2"), ("least", "<u2")])
_GRADE_BITS, _PIECE_BITS = 24, 15
#: Bits of an n-gram's hash by which it is counted; more than a bitmap's slots, which only need that equal n-grams are counted together.
_COUNTED = 34
LIST_BITS, GROUP_BITS = 13, 11
_BLOCK = 64
_GROUP_SLOTS = 22
KEYS, _FAMILY, _FAMILIES = 8, 32, 100_000
_FACTORS = np.random.default_rng(43).integers(0, 1 << 63, (KEYS, 3), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi, the 48-bit n-grams of all of them (ascending within a row) and the rows' bounds."""
    for lo, hi, buf, off in W.blocks(column):
        h, _, _, rows = W.words(buf, off, W.FOLDED, W.NOT_SPACE)
        count = np.diff(rows)
        row_of = np.repeat(np.arange(hi - lo, dtype=np.uint64), count)
        keys = []
        if len(h) >= n:
            w = W.window_hashes(h, n)
            ok = row_of[: len(w)] == row_of[n - 1 :]
            keys.append((row_of[: len(w)][ok] << np.uint64(48)) | (w[ok] >> np.uint64(16)))
        for k in range(1, n):
            short = np.flatnonzero(count == k)
            if len(short):
                w = W.window_hashes(h, k)[rows[short]]
                keys.append((short.astype(np.uint64) << np.uint64(48)) | (w >> np.uint64(16)))
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        yield lo, hi, key & _MASK48, np.searchsorted(key, np.arange(hi - lo + 1, dtype=np.uint64) << np.uint64(48))


def signatures(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(s + np.uint64(0x1F3)), dtype=np.uint64)])
    return W.mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def family_keys(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`KEYS` columns of 64-bit keys: each of the least hashes of a row's set in three orders. Rows without n-grams have 0."""
    out, has = np.zeros((len(at) - 1, KEYS), np.uint64), np.flatnonzero(np.diff(at))
    if len(has):
        for k in range(KEYS):
            for f in _FACTORS[k]:
                out[has, k] = W.mix(out[has, k] + np.minimum.reduceat(s * f, at[has]))
    return out


def _families(keyed: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that `_FAMILY` different sets or more share, ascending, and for each the most frequent key of the sets that have it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, s, at in shingle_sets(batch.column("__text"), n):
                has = np.diff(at) > 0
                keys = family_keys(s, at)[has].view(np.int64)
                keys = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * KEYS, pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(signatures(s, at)[has].view(np.int64)), keys], names=["sig", "keys"])

    sets = materialise(keyed.select("__text").mapInArrow(W.tidy(scan), "sig long, keys array<long>").dropDuplicates(["sig"]), "jaccard-keys")
    each = sets.select("sig", F.explode("keys").alias("key"))
    hot = materialise(each.groupBy("key").count().where(F.col("count") >= _FAMILY).orderBy(F.desc("count"), "key").limit(_FAMILIES), "jaccard-families")
    own = materialise(each.join(F.broadcast(hot), "key"), "jaccard-members")
    best = own.groupBy("sig").agg(F.max(F.struct("count", "key")).alias("best"))
    found = own.join(best, "sig").groupBy("key").agg(F.max("best").alias("best")).select("key", "best.key").toDF("key", "home").collect()
    key, home = (np.array([r[c] for r in found], np.int64).view(np.uint64) for c in ("key", "home"))
    order = np.argsort(key)
    return key[order], home[order]


def _homes(s: np.ndarray, at: np.ndarray, group: np.ndarray, families: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rows' groups, where a row has keys of families the group of the family."""
    key, home = families
    if not len(key):
        return group
    keys = family_keys(s, at)
    place = np.minimum(np.searchsorted(key, keys), len(key) - 1)
    best = np.where(key[place] == keys, home[place], np.uint64(0)).max(axis=1)
    return np.where(best > 0, W.mix(best), group)


def _sorted_block(ones: np.ndarray, many: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending values that occur once as differences in byte planes, the sparse upper planes compressed; then those with counts."""
    d = np.diff(ones, prepend=np.zeros(1, "<u4")).astype("<u4").view(np.uint8).reshape(-1, 4).T
    top = zlib.compress(d[1:].tobytes(), 1)
    return np.array([len(ones), len(top)], "<u4").tobytes() + top + d[0].tobytes() + many.astype("<u4").tobytes() + counts.astype("<u4").tobytes()


def _read_sorted(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, top = (int(x) for x in np.frombuffer(data, "<u4", 2))
    d = np.empty((n, 4), np.uint8)
    d[:, 1:] = np.frombuffer(zlib.decompress(data[8 : 8 + top]), np.uint8).reshape(3, n).T
    d[:, 0] = np.frombuffer(data, np.uint8, n, 8 + top)
    rest = np.frombuffer(data[8 + top + n :], "<u4")
    return np.cumsum(d.reshape(-1).view("<u4"), dtype="<u4"), rest[: len(rest) // 2], rest[len(rest) // 2 :]


def _frequency_tables(keyed: DataFrame, n: int, slot_bits: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmap of n-grams in two documents or more; log2 of frequencies from 8 on. Both of fixed size."""
    if slot_bits > _COUNTED:
        raise ValueError(f"at most {_COUNTED} slot bits")

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(held)
        held.clear()
        v.sort()
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        v, c = v[first], np.diff(np.concatenate([first, [len(v)]]))
        seg = (v >> np.uint64(_COUNTED - 8)).astype(np.int64)
        edge = np.searchsorted(seg, np.arange(257))
        at, data = [], []
        for k in range(256):
            x, y = (v[edge[k] : edge[k + 1]] & np.uint64((1 << (_COUNTED - 8)) - 1)).astype("<u4"), c[edge[k] : edge[k + 1]]
            many = y > 1
            at.append(k)
            data.append(_sorted_block(x[~many], x[many], y[many]))
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, s, _ in shingle_sets(batch.column("__text"), n):
                held.append(s >> np.uint64(48 - _COUNTED))
                size += len(s)
                if size > 1_000_000:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, x in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                by.setdefault(k, []).append(_read_sorted(x.as_py()))
        kinds, at, data = [], [], []
        for k, blocks in by.items():
            ones, many, much = (np.concatenate([x[j] for x in blocks]) for j in range(3))
            v, first, c = _summed(np.concatenate([ones, many]), np.concatenate([np.ones(len(ones), np.int64), much.astype(np.int64)]))
            f = (np.uint64(k) << np.uint64(_COUNTED - 8)) | v.astype(np.uint64)
            for kind, bits, keep in ((0, slot_bits, c > 1), (1, _GRADE_BITS, c >= 8)):
                slots = (f[keep] >> np.uint64(_COUNTED - bits)).astype(np.int64)
                grade = np.log2(c[keep]).astype(np.uint8)
                per = _PIECE_BITS + 3 if kind == 0 else _PIECE_BITS
                piece = slots >> per
                edge = np.flatnonzero(np.diff(piece)) + 1
                for p in np.split(np.arange(len(slots)), edge) if len(slots) else []:
                    own, place = np.zeros(1 << _PIECE_BITS, np.uint8), slots[p] & ((1 << per) - 1)
                    if kind == 0:
                        np.bitwise_or.at(own, place >> 3, (1 << (place & 7)).astype(np.uint8))
                    else:
                        np.maximum.at(own, place, grade[p])
                    kinds.append(kind)
                    at.append(int(piece[p[0]]))
                    data.append(zlib.compress(own.tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], names=["kind", "piece", "data"])

    seen, grades = np.zeros(1 << (slot_bits - 3), np.uint8), np.zeros(1 << _GRADE_BITS, np.uint8)
    size = 1 << _PIECE_BITS
    found = keyed.select("__text").mapInArrow(W.tidy(scan), B.BLOCK_SCHEMA).repartition(buckets, "bucket").mapInArrow(W.tidy(count), "kind int, piece int, data binary")
    for kind, piece, data in found.toLocalIterator(prefetchPartitions=True):
        into = (seen, grades)[kind][piece * size : (piece + 1) * size]
        np.bitwise_or(into, np.frombuffer(zlib.decompress(bytes(data)), np.uint8), out=into) if kind == 0 else np.maximum(into, np.frombuffer(zlib.decompress(bytes(data)), np.uint8), out=into)
    return seen, grades


def _summed(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(v, kind="stable")
    v, c = v[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    return v[first], first, np.add.reduceat(c, first) if len(first) else c


def _ranked(s: np.ndarray, at: np.ndarray, seen: np.ndarray, grades: np.ndarray, families: tuple[np.ndarray, np.ndarray], slot_bits: int, common: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's n-grams that occur elsewhere, rare first: 43-bit keys and positions within the whole set; and the rows' group keys."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    there = B.test_bits(seen, (s >> np.uint64(48 - slot_bits)).astype(np.int64))
    grade = grades[(s >> np.uint64(48 - _GRADE_BITS)).astype(np.int64)]
    key = np.sort((row[there] << np.uint64(48)) | (grade[there].astype(np.uint64) << np.uint64(43)) | (s[there] >> np.uint64(5)))
    own = np.searchsorted(key, np.arange(len(at), dtype=np.uint64) << np.uint64(48))
    single = np.diff(at) - np.diff(own)  # n-grams that occur nowhere else come first
    of = (key >> np.uint64(48)).astype(np.int64)
    pos = np.arange(len(key)) - own[of] + single[of]
    # the group: the two least hashes among n-grams that aren't common, or among all where these are few
    fit = there & (grade < common)
    n_fit = np.bincount(row[fit].astype(np.int64), minlength=len(at) - 1)
    use_all = n_fit * 4 < np.diff(at)
    fit |= use_all[row.astype(np.int64)]
    group = np.zeros(len(at) - 1, np.uint64)  # 32 bits are enough: groups that meet by chance are solved as exactly as any
    x, r = s[fit], row[fit].astype(np.int64)
    first = np.searchsorted(r, np.arange(len(at)))
    has = np.diff(first) > 0
    group[has] = W.mix(x[first[:-1][has]])
    two = np.diff(first) > 1
    group[two] = W.mix(group[two] + x[first[:-1][two] + 1])
    return key, pos, _homes(s, at, group, families) >> np.uint64(32)


def _packed(s: np.ndarray) -> bytes:
    """48-bit values as six bytes each."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _least_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """The smallest overlap with which sets of these sizes link: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (k, x) with lo[k] <= x < hi[k]."""
    size = hi - lo
    k = np.repeat(np.arange(len(lo)), size)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + lo[k]


def _list_pairs(rec: np.ndarray, num: int, den: int, most: int = 500_000, entries: int = 200_000) -> Iterator[np.ndarray]:
    """Pairs of entries of one list whose sizes and positions allow a link, and that are of different groups. The upper two bits of a position
    tell a cell's two sides apart. Lists of about `entries` entries in all are looked at together, so that memory doesn't grow with a bucket."""
    if not len(rec):
        return
    order = np.argsort(rec["e"], kind="stable")
    e = rec["e"][order]
    starts = np.concatenate([[0], np.flatnonzero(e[1:] != e[:-1]) + 1])
    del e
    edge = starts[np.flatnonzero(np.diff(starts // entries, prepend=-1))]
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(rec)], strict=True):
        yield from _pairs_of_lists(rec[order[lo:hi]], num, den, most)


def _pairs_of_lists(rec: np.ndarray, num: int, den: int, most: int) -> Iterator[np.ndarray]:
    order = np.lexsort((rec["pos"], rec["sig"], rec["g"], rec["n"], rec["e"]))
    rec = rec[order]
    if len(rec):
        new = np.ones(len(rec), bool)
        new[1:] = (rec["e"][1:] != rec["e"][:-1]) | (rec["sig"][1:] != rec["sig"][:-1]) | (rec["pos"][1:] != rec["pos"][:-1])
        rec = rec[new]
    n, pos, sig, g = rec["n"].astype(np.int64), (rec["pos"] & np.uint32((1 << 30) - 1)).astype(np.int64), rec["sig"], rec["g"]
    side, count = (rec["pos"] >> np.uint32(30)).astype(np.int8), len(rec)
    if count < 2:
        return
    # the largest partner that the position allows: the overlap is at most n - pos - 1 and what comes before
    reach = (n - pos - 1 + SHARED) * (num + den) // num - n
    top = np.minimum(reach, den * n // num)
    lists = np.concatenate([[0], np.cumsum(rec["e"][1:] != rec["e"][:-1])])
    key = lists * (int(n.max()) + 1) + n
    end = np.searchsorted(key, lists * (int(n.max()) + 1) + np.minimum(top, n.max()), side="right")
    blocks, least, most_g = (f.reduceat(x, np.arange(0, count, _BLOCK)) for f, x in ((np.maximum, reach), (np.minimum, g), (np.maximum, g)))
    start = np.flatnonzero(end > np.arange(count) + 1)
    run = end[start] - start - 1
    # at most `most` pairs, or blocks, or one entry's, at a time
    part = np.cumsum(np.where(run > _BLOCK, run // _BLOCK + 2, run)) // most
    for own in np.split(start, np.flatnonzero(np.diff(part)) + 1) if len(start) else []:
        far = end[own] - own - 1 > _BLOCK
        k, j = _ranges(own[~far] + 1, end[own[~far]])
        yield from _tested(own[~far][k], j, n, pos, reach, sig, g, side, num, den)
        far = own[far]
        if len(far):
            k, block = _ranges((far + 1) // _BLOCK, (end[far] - 1) // _BLOCK + 1)
            own_g = g[far[k]]
            ok = (blocks[block] >= n[far[k]]) & ((least[block] != own_g) | (most_g[block] != own_g))
            i, block = far[k[ok]], block[ok]
            for x in range(0, len(i), most // _BLOCK):
                y = slice(x, x + most // _BLOCK)
                k, j = _ranges(np.maximum(block[y] * _BLOCK, i[y] + 1), np.minimum((block[y] + 1) * _BLOCK, end[i[y]]))
                yield from _tested(i[y][k], j, n, pos, reach, sig, g, side, num, den)


def _tested(i: np.ndarray, j: np.ndarray, n: np.ndarray, pos: np.ndarray, reach: np.ndarray, sig: np.ndarray, g: np.ndarray, side: np.ndarray, num: int, den: int) -> Iterator[np.ndarray]:
    """Those of the pairs i, j (j isn't smaller, and within the reach of i) that i is in the reach of, too."""
    ok = (reach[j] >= n[i]) & (g[i] != g[j]) & (sig[i] != sig[j]) & ((side[i] != side[j]) | (side[i] == 0))
    i, j = i[ok], j[ok]
    if len(i):
        out = np.empty(len(i), _PAIR)
        swap = sig[i] > sig[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        out["a"], out["b"], out["ga"], out["gb"], out["c"] = sig[a], sig[b], g[a], g[b], 1
        out["least"] = np.minimum(SHARED, _least_overlap(n[i], n[j], num, den))
        yield out


def _pair_sums(rec: np.ndarray) -> np.ndarray:
    rec = rec[np.lexsort((rec["b"], rec["a"]))]
    if not len(rec):
        return rec
    first = np.flatnonzero(np.concatenate([[True], (rec["a"][1:] != rec["a"][:-1]) | (rec["b"][1:] != rec["b"][:-1])]))
    out = rec[first]
    out["c"] = np.minimum(np.add.reduceat(rec["c"].astype(np.int64), first), 1000)
    return out


def _candidates(keyed: DataFrame, tables, n: int, num: int, den: int, slot_bits: int, common: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(documents: __id, __hash, n, sig, g) and (pairs of different groups: a, b, ga, gb)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grades, families = tables.value
        done: set[int] = set()
        for batch in batches:
            for lo, hi, s, at in shingle_sets(batch.column("__text"), n):
                size, sig = np.diff(at), signatures(s, at)
                key, pos, group = _ranked(s, at, seen, grades, families, slot_bits, common)
                fresh = np.zeros(hi - lo, bool)
                for r, x in enumerate(sig.tolist()):
                    if x not in done:
                        fresh[r] = True
                        done.add(x)
                if len(done) > 1_000_000:
                    done.clear()
                row = (key >> np.uint64(48)).astype(np.int64)
                low = _least_overlap(size, -(-num * size // den), num, den)
                ok = fresh[row] & (pos <= (size - low + np.minimum(SHARED, low) - 1)[row])
                row, pos, elem = row[ok], pos[ok], key[ok] & np.uint64((1 << 43) - 1)
                elem, row, pos = _celled(elem, row, pos, ((key[ok] >> np.uint64(43)) & np.uint64(31)).astype(np.int64), sig)
                ids, text = (batch.column(c).to_numpy(zero_copy_only=False)[lo:hi] for c in ("__id", "__hash"))
                there, data = _entry_blocks(elem, row, pos, sig, group, size, buckets)
                facts = np.stack([ids, text, size, sig.view(np.int64), group.view(np.int64)]).astype("<i8")
                bucket = np.concatenate([there, [int(sig[0] % np.uint64(buckets))]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array([*data, None], pa.binary()), pa.array([None] * len(data) + [facts.tobytes()], pa.binary())], names=["bucket", "data", "facts"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for x, y in zip(batch.column("data").to_pylist(), batch.column("facts").to_pylist(), strict=True):
                if x is not None:
                    parts.append(_read_entries(x))
                if y is not None:
                    ids = np.frombuffer(y, "<i8").reshape(5, -1)
                    yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in ids), pa.nulls(ids.shape[1], pa.int32()), pa.nulls(ids.shape[1], pa.binary())], names=["__id", "__hash", "n", "sig", "g", "bucket", "data"])
        rec = np.concatenate(parts) if parts else np.zeros(0, _ENTRY)
        parts.clear()
        held, size = [], 0
        for out in _list_pairs(rec, num, den):
            held.append(out)
            size += len(out)
            if size > 1_000_000:
                held = [_pair_sums(np.concatenate(held))]
                size = len(held[0])
                if size > 500_000:
                    yield _pair_rows(held[0], buckets)
                    held, size = [], 0
        if size:
            yield _pair_rows(_pair_sums(np.concatenate(held)), buckets)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rec = _pair_sums(B.read_blocks(batches, _PAIR, True))
        rec = rec[rec["c"] >= rec["least"]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rec["a"]).view(np.int64)), pa.array(np.ascontiguousarray(rec["b"]).view(np.int64)), pa.array(rec["ga"].astype(np.int64)), pa.array(rec["gb"].astype(np.int64))], names=["a", "b", "ga", "gb"])

    mixed = keyed.mapInArrow(W.tidy(scan), "bucket int, data binary, facts binary").repartition(buckets, "bucket")
    mixed = materialise(mixed.mapInArrow(W.tidy(lists), "__id long, __hash long, n long, sig long, g long, bucket int, data binary"), "jaccard-lists")
    pairs = mixed.where("data is not null").select("bucket", "data").repartition(buckets, "bucket").mapInArrow(W.tidy(sums), "a long, b long, ga long, gb long")
    return mixed.where("sig is not null").select("__id", "__hash", "n", "sig", "g"), materialise(pairs, "jaccard-pairs")


def _entry_blocks(elem: np.ndarray, row: np.ndarray, pos: np.ndarray, sig: np.ndarray, group: np.ndarray, size: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Buckets and their blocks of entries: the facts of a set once per block, then its n-grams and positions."""
    bucket = B.bucket_of(elem << np.uint64(21), buckets)
    order = np.lexsort((row, bucket))
    bucket, row = bucket[order], row[order]
    own = np.empty(len(order), _OWN)
    own["e"], own["pos"] = elem[order] & np.uint64(0xFFFFFFFF), pos[order]
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])])) if len(order) else np.zeros(0, np.int64)
    head = np.empty(len(first), _HEAD)
    head["sig"], head["g"], head["n"], head["count"] = sig[row[first]], group[row[first]], size[row[first]], np.diff(np.append(first, len(order)))
    there, at = np.unique(bucket, return_index=True)
    ends, heads = np.append(at[1:], len(order)), np.searchsorted(first, np.append(at, len(order)))
    return there, [np.array([y - x], "<u4").tobytes() + B.pack(head[x:y]) + B.pack(own[a:b]) for a, b, x, y in zip(at, ends, heads, heads[1:], strict=False)]


def _read_entries(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    head, own = B.unpack(data[4 : 4 + n * _HEAD.itemsize], _HEAD), B.unpack(data[4 + n * _HEAD.itemsize :], _OWN)
    rec, of = np.empty(len(own), _ENTRY), np.repeat(np.arange(n), head["count"])
    for f in ("sig", "g", "n"):
        rec[f] = head[f][of]
    rec["e"], rec["pos"] = own["e"], own["pos"]
    return rec


def _celled(elem: np.ndarray, row: np.ndarray, pos: np.ndarray, grade: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of very frequent n-grams go to every cell that their part of the list belongs to; two bits of the position tell the sides."""
    hot = grade >= LIST_BITS
    if not hot.any():
        return elem, row, pos
    parts = np.int64(1) << (grade[hot] - LIST_BITS + 1)
    own = ((W.mix(sig[row[hot]]) >> np.uint64(20)) % parts.astype(np.uint64)).astype(np.int64)
    k, other = _ranges(np.zeros(len(parts), np.int64), parts)
    own = own[k]
    cell = np.minimum(own, other) * parts[k] + np.maximum(own, other)
    side = np.where(own == other, 0, np.where(own < other, 1, 2))
    named = W.mix(elem[hot][k] + W.mix(cell.astype(np.uint64) + np.uint64(0x77))) & np.uint64((1 << 43) - 1)
    return np.concatenate([elem[~hot], named]), np.concatenate([row[~hot], row[hot][k]]), np.concatenate([pos[~hot], pos[hot][k] | (side << 30)])


def _pair_rows(rec: np.ndarray, buckets: int) -> pa.RecordBatch:
    out = B.to_blocks(W.mix(rec["a"] + W.mix(rec["b"])), rec, buckets, planes=True)
    none = pa.nulls(len(out), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, none, none, none, out.column(0), out.column(1)], names=["__id", "__hash", "n", "sig", "g", "bucket", "data"])


class _Cell:
    """The sets of a group, or of two chunks of a large one, by their differences to a hub."""

    def __init__(self, sets: list[tuple[int, int, int, np.ndarray]], num: int, den: int):
        """sets: (set, members, side, n-grams); of sets with sides other than 0 only those of different sides are paired."""
        self.num, self.den = num, den
        self.sig = [x[0] for x in sets]
        self.members = np.array([x[1] for x in sets], np.int64)
        self.side = np.array([x[2] for x in sets], np.int8)
        self.size = np.array([len(x[3]) for x in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.known, self.flat = np.unique(np.concatenate([x[3] for x in sets]), return_inverse=True)
        self.mark = np.zeros(len(self.known), bool)
        self.add = np.zeros(len(sets), np.int64)
        self.root = np.arange(len(sets))
        self.place = {s: k for k, s in enumerate(self.sig)}

    def _overlaps(self, which: np.ndarray) -> np.ndarray:
        """Marked n-grams of each of these sets."""
        _, x = _ranges(self.at[which], self.at[which + 1])
        return np.add.reduceat(self.mark[self.flat[x]].astype(np.int32), np.concatenate([[0], np.cumsum(self.size[which])[:-1]]))

    def _join(self, x: int, linked: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[linked], self.root[x]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def solve(self) -> None:
        """All links within the cell."""
        if len(self.sig) < 2:
            return
        unit, hub = self.num + self.den, 0
        self.mark[self.flat[: self.at[1]]] = True
        c = self._overlaps(np.arange(len(self.sig)))
        self.mark[:] = False
        h, extra = int(self.size[hub]), self.size - c
        r = unit * (h - c) + self.num * self.size
        order = np.argsort(r, kind="stable")
        rank, limit = r[order], unit * h - r
        far = np.searchsorted(rank, limit, side="right")  # from here on pairs are open
        for s in np.unique(self.side):
            here = np.flatnonzero(self.side == s)
            weight = np.where((self.side[order] != s) | (s == 0), self.members[order], 0)
            total = np.concatenate([[0], np.cumsum(weight)])
            own = (r[here] <= limit[here]) * (self.members[here] if s == 0 else 0)
            self.add[here] = total[far[here]] - own
        sure = np.flatnonzero(self.add > 0)
        if len(sure):  # whoever surely links with some set does so with the hub
            self._join(hub, sure)
        for x, k in enumerate(order.tolist()):
            y = order[max(x + 1, int(far[k])) :]
            if self.side[k]:
                y = y[self.side[y] != self.side[k]]
            need = _least_overlap(self.size[k], self.size[y], self.num, self.den)
            may = np.minimum(c[k], c[y]) + np.minimum(extra[k], extra[y]) >= need
            y, need = y[may], need[may]
            if not len(y):
                continue
            self._count(self.flat[self.at[k] : self.at[k + 1]], k, int(self.members[k]), y, need)

    def _count(self, marked: np.ndarray, k: int | None, members: int, y: np.ndarray, need: np.ndarray) -> np.ndarray:
        self.mark[marked] = True
        y = y[self._overlaps(y) >= need]
        self.mark[marked] = False
        if len(y):
            self.add[y] += members
            if k is None:
                self._join(int(y[0]), y)
            else:
                self.add[k] += self.members[y].sum()
                self._join(k, y)
        return y

    def guest(self, sig: int, members: int, grams: np.ndarray, asked: list[int]) -> tuple[int, int, int] | None:
        """A traveller and the sets it is to be compared with: (set, documents it links with, a set it links with)."""
        y = np.array([self.place[x] for x in asked if x in self.place], np.int64)
        if not len(y):
            return None
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        y = self._count(at[self.known[at] == grams], None, members, y, _least_overlap(len(grams), self.size[y], self.num, self.den))
        return (sig, int(self.members[y].sum()), self.sig[int(y[0])]) if len(y) else None

    def rows(self) -> Iterator[tuple[int, int, int | None]]:
        for k in np.flatnonzero((self.add > 0) | (self.root != np.arange(len(self.root)))).tolist():
            yield self.sig[k], int(self.add[k]), self.sig[int(self.root[k])] if self.root[k] != k else None


def _group_table(groups: DataFrame, buckets: int) -> np.ndarray:
    """For slots of group keys: 0 where no group is needed, else 1 + log2 of the largest group's size. Of a fixed size, collected in pieces."""
    per = 1 << 12

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column(1).to_numpy()
            grade = 1 + np.log2(np.maximum(batch.column(2).to_numpy(), 1)).astype(np.uint8)
            for k in np.unique(slot // per).tolist():
                here = slot // per == k
                np.maximum.at(own.setdefault(k, np.zeros(per, np.uint8)), slot[here] % per, grade[here])
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in own.values()], pa.binary())], names=["bucket", "data"])

    slot = F.shiftright("g", 32 - _GROUP_SLOTS)
    narrow = groups.select((slot / per).cast("int").alias("piece"), slot.alias("slot"), "size").repartition(buckets, "piece")
    table = np.zeros(1 << _GROUP_SLOTS, np.uint8)
    for at, data in narrow.mapInArrow(W.tidy(pieces), B.BLOCK_SCHEMA).toLocalIterator(prefetchPartitions=True):
        table[at * per : (at + 1) * per] = np.frombuffer(zlib.decompress(bytes(data)), np.uint8)
    return table


def _chunks(table: np.ndarray, g: int, sig: int) -> tuple[int, int]:
    """How many chunks a group has, and a set's own."""
    k = 1 << max(0, int(table[g >> (32 - _GROUP_SLOTS)]) - 1 - GROUP_BITS + 1)
    return k, (int(sig) & 0xFFFFFFFFFFFF) % k if k > 1 else 0


def _cells(table: np.ndarray, g: int, sig: int) -> list[tuple[int, int]]:
    """The cells of its group that a set belongs to, and its side there."""
    k, own = _chunks(table, g, sig)
    return [(own * k + own, 0)] + [(min(own, x) * k + max(own, x), 1 if own < x else 2) for x in range(k) if x != own]


_SENT = "to long, cell long, stage int, sig long, kind int, other long, side int, members long, data binary"
_SENT_NAMES = [x.split()[0] for x in _SENT.split(", ")]
_SENT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]


def _sent_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_SENT_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SENT_TYPES, strict=True)], names=_SENT_NAMES)


def _bitmap_of(rows: DataFrame, slot_bits: int = 24) -> DataFrame:
    """(__word, __bits) of the slots of `rep`, of a fixed size."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(1 << slot_bits))
    bits = rows.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("__bits"))
    return materialise(bits, "jaccard-asked-rows")


def _texts_of(keyed: DataFrame, bits: DataFrame, slot_bits: int = 24) -> DataFrame:
    """Texts of rows whose slot is set."""
    slot = F.pmod(F.xxhash64(F.struct("__id", "__hash")), F.lit(1 << slot_bits))
    rows = keyed.withColumn("__slot", slot).withColumn("__word", F.shiftright("__slot", 6)).join(F.broadcast(bits), "__word")
    return rows.where("shiftright(__bits, cast(__slot & 63 as int)) & 1L = 1L").select("__text")


def _links(keyed: DataFrame, classes: DataFrame, pairs: DataFrame, tables, n: int, num: int, den: int, slot_bits: int, common: int, buckets: int, known_travellers: int) -> DataFrame:
    """(sig, add: documents of other sets it links with, other: a set of the same component). A set may have several rows."""
    context = keyed.sparkSession.sparkContext
    degrees = pairs.select("a").union(pairs.select("b")).toDF("sig").groupBy("sig").count()
    side = lambda x: degrees.select(F.col("sig").alias(x), F.col("count").alias(f"d_{x}"))
    a_goes = F.expr("d_a > d_b or (d_a = d_b and a > b)")
    travel = pairs.join(side("a"), "a").join(side("b"), "b").select(F.when(a_goes, F.col("a")).otherwise(F.col("b")).alias("sig"), F.when(a_goes, F.col("b")).otherwise(F.col("a")).alias("other"), F.when(a_goes, F.col("gb")).otherwise(F.col("ga")).alias("to"))
    travel = materialise(travel, "jaccard-travel")
    groups = classes.groupBy("g").agg(F.count("*").alias("size"))
    groups = materialise(groups.where("size > 1").unionByName(travel.select(F.col("to").alias("g"), F.lit(1).cast("long").alias("size")).distinct()), "jaccard-groups")
    table = context.broadcast(_group_table(groups, buckets))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in batches:
            out = []
            for sig, other, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, c = _chunks(own, to, other)
                out.append((to, c * k + c, 2, sig, 1, other, 0, 0, None))
            yield _sent_rows(out)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in batches:
            yield _sent_rows([(g, cell, 0, sig, 0, 0, s, members, None) for sig, g, members in zip(*(c.to_pylist() for c in batch.columns), strict=True) if own[g >> (32 - _GROUP_SLOTS)] for cell, s in _cells(own, g, sig)])

    asked = materialise(travel.mapInArrow(W.tidy(asks), _SENT), "jaccard-asked")
    goes = materialise(asked.select("sig", "to", "cell").distinct().join(classes.select("sig", "members"), "sig"), "jaccard-goes")
    at_home = classes.join(groups.select("g").distinct(), "g", "left_semi").select("rep")
    travellers = classes.join(goes, "sig", "left_semi").select("rep")
    few = goes.count() <= known_travellers
    routes = None
    if few:
        found = goes.orderBy("sig", "to", "cell").collect()
        routes = context.broadcast(tuple(np.array([r[c] for r in found], np.int64) for c in ("sig", "to", "cell", "members")))

    def own_sets(batches: Iterator[pa.RecordBatch], sent: Callable) -> Iterator[pa.RecordBatch]:
        """One call of sent(set, group, packed n-grams) for each set that a task meets."""
        (seen, grades, families), done = tables.value, set()
        for batch in batches:
            for _, _, s, at in shingle_sets(batch.column("__text"), n):
                sig, (_, _, group) = signatures(s, at).view(np.int64), _ranked(s, at, seen, grades, families, slot_bits, common)
                out = []
                for x, g, i, j in zip(sig.tolist(), group.tolist(), at, at[1:], strict=False):
                    if i < j and x not in done:
                        done.add(x)
                        out += sent(x, g, s[i:j])
                if len(done) > 200_000:
                    done.clear()
                yield _sent_rows(out)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, route = table.value, routes.value if routes else None

        def sent(x: int, g: int, grams: np.ndarray) -> list[tuple]:
            out, data = [], _packed(grams)
            if own[g >> (32 - _GROUP_SLOTS)]:
                out = [(g, cell, 1, x, 0, 0, s, 0, data) for cell, s in _cells(own, g, x)]
            if route is not None:
                lo, hi = np.searchsorted(route[0], x, side="left"), np.searchsorted(route[0], x, side="right")
                out += [(int(route[1][k]), int(route[2][k]), 2, x, 0, 0, 0, int(route[3][k]), data) for k in range(lo, hi)]
            return out

        return own_sets(batches, sent)

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return own_sets(batches, lambda x, g, grams: [(0, 0, 2, x, 0, 0, 0, 0, _packed(grams))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known, sets, cell, guest, wanted = None, {}, [], None, None, []

        def ready() -> _Cell | None:
            nonlocal cell, sets
            if cell is None and sets:
                cell, sets = _Cell(sets, num, den), []
                cell.solve()
            return cell

        def compare() -> list[tuple]:
            nonlocal guest, wanted
            found = ready().guest(guest[0], guest[1], guest[2], wanted) if guest and wanted and ready() else None
            guest, wanted = None, []
            return [found] if found else []

        for batch in batches:
            out = []
            for to, at, stage, sig, kind, other, s, members, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (to, at) != here:
                    out += compare()
                    out += ready().rows() if ready() else ()
                    here, known, sets, cell = (to, at), {}, [], None
                if stage == 0:
                    known[sig] = (members, s)
                elif stage == 1:
                    if sig in known:
                        sets.append((sig, *known.pop(sig), _unpacked(data)))
                elif kind == 0:
                    if guest is None or guest[0] != sig:
                        out += compare()
                        guest = (sig, members, _unpacked(data))
                elif guest is not None and guest[0] == sig:
                    wanted.append(other)
            yield _link_rows(out)
        out = compare()
        yield _link_rows(out + (list(ready().rows()) if ready() else []))

    sent = _texts_of(keyed, _bitmap_of(at_home.union(travellers) if few else at_home)).mapInArrow(W.tidy(home), _SENT)
    if not few:
        moved = _texts_of(keyed, _bitmap_of(travellers)).mapInArrow(W.tidy(away), _SENT).drop("to", "cell", "members").join(goes, "sig")
        sent = sent.unionByName(moved.select(*_SENT_NAMES))
    sent = sent.unionByName(classes.select("sig", "g", "members").mapInArrow(W.tidy(facts), _SENT)).unionByName(asked)
    return materialise(sent.repartition(buckets, "to", "cell").sortWithinPartitions("to", "cell", "stage", "sig", "kind").mapInArrow(W.tidy(solve), "sig long, add long, other long"), "jaccard-links")


def _solved(docs: DataFrame, id_col: str, text_col: str, n: int = 2, num: int = 60, den: int = 100, slot_bits: int = 28, known_travellers: int = 300_000) -> DataFrame:
    """One row per input row: __id, __hash, n, n_similar, best (id and text hash of the component's least row)."""
    spark = docs.sparkSession
    buckets = shuffle_partitions(spark)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("__id"), text_hash(text_col).alias("__hash"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    common = max(6, int(np.log2(max(1, docs.count()) / 256)))
    tables = spark.sparkContext.broadcast((*_frequency_tables(keyed, n, slot_bits, buckets), _families(keyed, n)))
    facts, pairs = _candidates(keyed, tables, n, num, den, slot_bits, common, buckets)
    row = F.struct(F.col("__id"), F.col("__hash"))
    classes = materialise(facts.where("n > 0").groupBy("sig").agg(F.min(row).alias("rep"), F.count("*").alias("members"), F.min("g").alias("g")), "jaccard-classes")
    links = _links(keyed, classes, pairs, tables, n, num, den, slot_bits, common, buckets, known_travellers)
    labels = materialise(connected_components(links.where("other is not null").select(F.col("sig").alias("src"), F.col("other").alias("dst"))), "jaccard-labels")
    best = classes.join(labels, classes["sig"] == labels["node"]).groupBy("component").agg(F.min("rep").alias("best"), F.count("*").alias("size"))
    best = attach_group_facts(labels, materialise(best, "jaccard-components"), "component", "size").select(F.col("node").alias("sig"), "best")
    answer = classes.join(links.groupBy("sig").agg(F.sum("add").alias("add")), "sig", "left").join(best, "sig", "left")
    answer = materialise(answer.select("sig", "members", (F.col("members") - 1 + F.coalesce("add", F.lit(0))).alias("n_similar"), F.coalesce("best", "rep").alias("best")), "jaccard-answer")
    full = attach_group_facts(facts.where("n > 0").select("__id", "__hash", "n", "sig"), answer, "sig", "members").select("__id", "__hash", "n", "n_similar", "best")
    return full.union(facts.where("n = 0").select("__id", "__hash", "n", F.lit(0).cast("long"), row))


def _restored(column: Column, docs: DataFrame, id_col: str) -> Column:
    return F.when(column != _NULL_ID, column).cast(docs.schema[id_col].dataType)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id_col, n_shingles, n_similar, component_id. Options: n, num, den, slot_bits, known_travellers."""
    full = _solved(docs, id_col, text_col, **options)
    back = lambda c: _restored(c, docs, id_col)
    return full.select(back(F.col("__id")).alias(id_col), F.col("n").alias("n_shingles"), "n_similar", back(F.col("best.__id")).alias("component_id"))


def _link_rows(rows: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
    sig, add, other = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(add, pa.int64()), pa.array(other, pa.int64())], names=["sig", "add", "other"])


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of each group that links connect the row of the least id (of these, one); rows without words stay, one of those that repeat id and text. Columns
    are unchanged."""
    full = _solved(docs, id_col, text_col, **options)
    stays = (F.col("n") == 0) | ((F.col("best.__id") == F.col("__id")) & (F.col("best.__hash") == F.col("__hash")))
    return keep_rows(docs, full.select(_restored(F.col("__id"), docs, id_col).alias("__id"), "__hash", stays.alias("__stays")), id_col, text_col)


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 60 * (x.n + y.n - i)),
r AS (SELECT a AS doc_id, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a),
k AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id),
d AS (SELECT a AS doc_id, count(*) AS d FROM l GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(d, 0) AS n_similar, coalesce(c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN d USING (doc_id) LEFT JOIN k USING (doc_id)
"""
