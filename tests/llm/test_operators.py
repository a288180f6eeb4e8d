"""Each operator against a brute-force version, on rows with nulls, ties, repeats, blank and long texts, clashing columns, and none."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import decontamination, exact_dedup, html_text, jaccard_join, licenses, packing, quality, substring_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, keep_id string, __id long, n int"


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = ["the", "of", "And", "ÜBER", "über", "naïve", "x1", "don't", "a", "moron,", "–", "日本", "🙂"] + [f"w{i}" for i in range(60)]
    texts = [None, "", "  \n\t", "word", "Word", "two words", "TWO WORDS", "two\x0bwords", "a b a b a b", "from " * 90, " x y"]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 25, 60, 120]))) for _ in range(40)]
    texts += base
    for t in base[:25]:
        w = t.split()
        for _ in range(rng.choice([1, 2, 4])):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(v) // 8))):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v))
    for t in base[:10]:
        texts.append("intro " + rng.choice(vocabulary) + "\n" + t.upper() + " " + " ".join(rng.choices(vocabulary, k=30)))
    shared = " ".join(rng.choices(vocabulary, k=55))
    texts += [f"p{i} {shared} q{i}" for i in range(12)]
    texts.append(" ".join(rng.choices(vocabulary, k=6000)))
    texts += [texts[15], texts[15], texts[16].lower()]
    rng.shuffle(texts)
    return [(i * 3, t, "en", "clash", -i, i) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids and repeated rows too."""
    return spark.createDataFrame([*rows[:30], rows[5], rows[5], (None, rows[7][1], None, None, None, None), (None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_dedup(docs, odd, empty, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[fold(t)].append(i)
    for everything in (True, False):
        found = by_id(exact_dedup.exact_dedup(docs, all_digests=everything))
        assert len(found) == len(rows)
        for i, t, *_ in rows:
            r, g = found[i], groups[fold(t)]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(g), len(g), i == max(g))
            if everything or len(g) > 1:
                assert r["text_sha256"] == hashlib.sha256(fold(t).encode()).hexdigest()
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0
    raw = [(r["doc_id"], fold(r["text"])) for r in odd.collect()]
    rank = lambda i: (i is not None, i or 0)
    want = Counter()
    for i, t in raw:
        own = [j for j, x in raw if x == t]
        best = max(own, key=rank)
        want[(i, best, len(own), i == best, hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_dedup(odd, all_digests=True).collect()) == want


@pytest.mark.parametrize("slot_bits", [2, 24])
def test_exact_copies_of_repeated_ids(spark, slot_bits, monkeypatch):
    """Rows are decided by id and text; crowded bitmaps change nothing."""
    rows = [(5, "x one"), (5, "y two"), (7, "Y two"), (None, "y two"), (8, "z"), (8, "z"), (None, "only"), (None, "only"), (9, None), (10, ""), (11, "long " * 60_000), (12, "LONG " * 60_000)]
    rows += [(100 + i, f"own {i}") for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __id int").repartition(3)
    whole = exact_dedup.keep_rows
    monkeypatch.setattr(exact_dedup, "keep_rows", lambda *a: whole(*a, slot_bits=slot_bits))
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(5, "x one"), (7, "Y two"), (8, "z"), (None, "only"), (10, ""), (12, "LONG " * 60_000)] + rows[12:])


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:], strict=False))


def test_jaccard_join(docs, odd, empty, rows):
    sets = {i: shingles(t) for i, t, *_ in rows}
    near, label = defaultdict(set), {i: i for i in sets}
    for a, x in sets.items():
        for b, y in sets.items():
            if a != b and x and y and 100 * len(x & y) >= 60 * len(x | y):
                near[a].add(b)
    for _ in sets:
        for a in sets:
            label[a] = min([label[a], *(label[b] for b in near[a])])
    found = by_id(jaccard_join.jaccard_links(docs))
    assert {i: (r["n_shingles"], r["n_similar"], r["component_id"]) for i, r in found.items()} == {i: (len(s), len(near[i]), label[i]) for i, s in sets.items()}
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in sets if label[i] == i}
    assert jaccard_join.jaccard_links(odd).count() == odd.count() and jaccard_join.jaccard_links(empty).count() == 0


def test_jaccard_families(spark):
    """Many near copies of one text, so that groups, hubs and travellers all occur; ties at exactly 60 %."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(80)]
    texts = []
    for _ in range(70):
        v = list(base)
        for _ in range(rng.randint(0, 12)):
            v[rng.randrange(80)] = f"e{rng.randrange(40)}"
        texts.append(" ".join(v))
    texts += ["a b c d e f g h i", "a b c d e f g x y", "a b c d", "a b c d e f"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = dict(enumerate(map(shingles, texts)))
    want = {a: sum(100 * len(x & y) >= 60 * len(x | y) for b, y in sets.items() if b != a) for a, x in sets.items()}
    assert {i: r["n_similar"] for i, r in by_id(jaccard_join.jaccard_links(d)).items()} == want


def test_jaccard_pairs_of_a_family_stay_in_its_group(spark, monkeypatch):
    """The pairs of a large family aren't left to the lists because its members differ in their least hashes; links equal brute force."""
    rng = random.Random(11)
    base, texts = [f"f{i}" for i in range(120)], []
    for _ in range(300):
        v = list(base)
        for _ in range(rng.randint(0, 9)):
            v[rng.randrange(120)] = f"m{rng.randrange(10**6)}"
        texts.append(" ".join(v))
    sets = dict(enumerate(map(shingles, texts)))
    rows, plain = {}, jaccard_join.materialise

    def counted(df, name):
        out = plain(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialise", counted)
    got = by_id(jaccard_join.jaccard_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)))
    assert {i: r["n_similar"] for i, r in got.items()} == {a: sum(100 * len(x & y) >= 60 * len(x | y) for b, y in sets.items() if b != a) for a, x in sets.items()}
    assert rows["jaccard-pairs"] < 3 * len(texts)


def test_jaccard_lists_skip_blocks_of_one_group():
    """Of a list that a family fills only the pairs with other groups are looked at."""
    import numpy as np

    rng = np.random.default_rng(4)
    rec = entries(rng, 1, 40_000, (390, 400))
    rec["pos"], rec["g"] = 3, 9
    rec["g"][:2] = 5
    begun = time.process_time()
    found = sum(len(x) for x in jaccard_join._list_pairs(rec, 60, 100))
    assert found == 2 * 39_998 and time.process_time() - begun < 4


def test_jaccard_lists_take_bounded_memory():
    """Short lists of many entries in all take few bytes an entry besides the entries themselves, and lose no pair."""
    import tracemalloc

    import numpy as np

    rec = entries(np.random.default_rng(8), 300_000, 5, (40, 50))
    rec["g"] = np.arange(len(rec)) % 4
    few = entries(np.random.default_rng(9), 50, 20, (10, 40))
    pairs = lambda **options: sorted(tuple(p) for out in jaccard_join._list_pairs(few, 60, 100, **options) for p in out.tolist())
    tracemalloc.start()
    for _ in jaccard_join._list_pairs(rec, 60, 100):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * len(rec)
    assert pairs(entries=30) == pairs(entries=1) == pairs()
    assert not list(jaccard_join._list_pairs(rec[:0], 60, 100))


def test_jaccard_of_repeated_ids(spark, odd):
    """Rows of one id are documents of their own, with links and components of their own."""
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (3, a + " more"), (9, b + " more"), (None, a), (7, None), (7, "alone"), (8, "long " + a + " w" * 50_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, __id int").repartition(2)
    for options in ({}, {"known_travellers": 0}):
        got = Counter((r["doc_id"], r["n_shingles"], r["n_similar"], r["component_id"]) for r in jaccard_join.jaccard_links(docs, **options).collect())
        assert got == Counter([(5, 29, 3, None), (5, 29, 1, 5), (3, 30, 3, None), (9, 30, 1, 5), (None, 29, 3, None), (7, 0, 0, 7), (7, 1, 0, 7), (8, 32, 3, None)])
    kept = jaccard_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(None, a), (5, b), (7, None), (7, "alone")])
    raw = [(r["doc_id"], shingles(r["text"])) for r in odd.collect()]
    want = Counter((i, len(x), sum(k != j and bool(x and y) and 100 * len(x & y) >= 60 * len(x | y) for j, (_, y) in enumerate(raw))) for k, (i, x) in enumerate(raw))
    assert Counter((r["doc_id"], r["n_shingles"], r["n_similar"]) for r in jaccard_join.jaccard_links(odd).collect()) == want
    assert jaccard_join.drop_near_copies(odd.limit(0)).count() == 0


def entries(rng, lists, size, sizes):
    import numpy as np

    rec = np.empty(lists * size, jaccard_join._ENTRY)
    rec["e"], rec["sig"], rec["g"] = np.repeat(np.arange(lists), size), np.arange(len(rec)) + 1, rng.integers(0, 50, len(rec))
    rec["n"] = rng.integers(*sizes, len(rec))
    rec["pos"] = rng.integers(0, rec["n"] * 2 // 5 + 1)
    return rec


def test_jaccard_lists_skip_by_position():
    """The pairs of lists equal those of all pairs; a list whose positions forbid every pair costs next to nothing."""
    import numpy as np

    rng = np.random.default_rng(2)
    for lists, size, sizes in ((40, 5, (1, 30)), (3, 400, (5, 60)), (1, 700, (40, 50))):
        rec = entries(rng, lists, size, sizes)
        got = {(int(p["a"]), int(p["b"]), int(p["least"])) for out in jaccard_join._list_pairs(rec, 60, 100, most=5000) for p in out}
        want = set()
        for x in rec:
            for y in rec:
                if x["e"] == y["e"] and x["sig"] < y["sig"] and x["g"] != y["g"]:
                    n, m = int(x["n"]), int(y["n"])
                    need = -(-60 * (n + m) // 160)
                    fits = lambda size, pos, need=need: min(6, need) + size - int(pos) - 1 >= need
                    if 100 * min(n, m) >= 60 * max(n, m) and fits(n, x["pos"]) and fits(m, y["pos"]):
                        want.add((int(x["sig"]), int(y["sig"]), min(6, need)))
        assert got == want
    rec = entries(rng, 1, 40_000, (1000, 1400))
    rec["pos"] = rec["n"] * 39 // 100
    begun = time.process_time()
    assert not list(jaccard_join._list_pairs(rec, 60, 100)) and time.process_time() - begun < 2


def test_jaccard_cells():
    """Entries of a very frequent n-gram meet in cells, each pair of parts once; sets of large groups do, too."""
    import numpy as np

    n = 60
    sig = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    elem, row, pos = jaccard_join._celled(np.full(n, 77, np.uint64), np.arange(n), np.arange(n) % 9, np.full(n, jaccard_join.LIST_BITS + 1), sig)
    met = defaultdict(int)
    for e in set(elem.tolist()):
        own = np.flatnonzero(elem == e)
        side = pos[own] >> 30
        for i in range(len(own)):
            for j in range(i):
                met[tuple(sorted((int(row[own[i]]), int(row[own[j]]))))] += int(side[i] != side[j] or side[i] == 0)
    assert all(met[i, j] == 1 for i in range(n) for j in range(i + 1, n))
    table = np.full(1 << jaccard_join._GROUP_SLOTS, 1 + jaccard_join.GROUP_BITS + 1, np.uint8)
    cells = defaultdict(list)
    for s in sig.view(np.int64).tolist():
        for cell, side in jaccard_join._cells(table, 12345, s):
            cells[cell].append((s, side))
    met = Counter(frozenset((a, b)) for own in cells.values() for a, x in own for b, y in own if a < b and (x != y or x == 0))
    assert len(met) == n * (n - 1) // 2 and set(met.values()) == {1}


@pytest.mark.parametrize("sided", [False, True])
def test_jaccard_groups_equal_brute_force(sided):
    import numpy as np

    rng = random.Random(6)
    for trial in range(40):
        base = rng.sample(range(5000), rng.choice([6, 40]))
        sets = []
        for k in range(rng.choice([2, 9, 30])):
            x = {v if rng.random() > 0.2 * (trial % 3) else rng.randrange(5000) for v in base} | set(rng.sample(range(60), rng.randint(0, 3)))
            sets.append((k * 7 - 50, rng.randint(1, 4), rng.choice([1, 2]) if sided else 0, np.array(sorted(x), np.uint64)))
        cell = jaccard_join._Cell(sets, 60, 100)
        cell.solve()
        link = lambda a, b: 160 * len(set(a.tolist()) & set(b.tolist())) >= 60 * (len(a) + len(b))
        pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j and (not sided or sets[i][2] != sets[j][2]) and link(sets[i][3], sets[j][3])]
        assert cell.add.tolist() == [sum(sets[j][1] for i, j in pairs if i == k) for k in range(len(sets))]
        assert all(cell.root[i] == cell.root[j] for i, j in pairs)
        g = np.array(sorted(set(base[:-1]) | {9999}), np.uint64)
        before, found = cell.add.copy(), cell.guest(999, 3, g, [x[0] for x in sets] + [12345])
        linked = [k for k, x in enumerate(sets) if link(g, x[3])]
        assert (found[1] if found else 0) == sum(sets[k][1] for k in linked)
        assert (cell.add - before).tolist() == [3 * (k in linked) for k in range(len(sets))]


def test_packing(spark, docs, odd, empty, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    pieces = packing.pack_documents(docs, packing.default_tokenizer(), capacity=256, part_items=20, fan_in=2, with_ids=True).collect()
    ids, bins = defaultdict(dict), defaultdict(list)
    for p in pieces:
        ids[p["doc_id"]][p["start"]] = p["ids"]
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
        assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in p["ids"])) and len(p["ids"]) == p["length"]
    for i, t, *_ in rows:
        assert [x for _, part in sorted(ids[i].items()) for x in part] == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    import numpy as np

    alone = len(packing.best_fit(np.array([p["length"] for p in pieces]), 256)[2])  # all in one partition
    assert alone <= len(bins) <= 1.15 * alone
    assert packing.pack_documents(empty, packing.default_tokenizer()).count() == 0
    extra = spark.createDataFrame([(77, "long text " * 60_000), (77, None), (None, "")], "doc_id long, text string")
    whole = odd.select("doc_id", "text").unionByName(extra)
    own = packing.pack_documents(whole, packing.default_tokenizer()).collect()
    size = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    assert Counter((r["doc_id"], n) for r in whole.collect() for n in [4096] * (size(r["text"]) // 4096) + [size(r["text"]) % 4096] if n) == Counter((p["doc_id"], p["length"]) for p in own)


def test_packing_tree_is_close_to_one_partition(spark):
    """Several partitions and two rounds of merging: at most 1 % more bins than best fit over all pieces at once."""
    import numpy as np

    rng = np.random.default_rng(5)
    sizes = np.minimum(np.exp(rng.normal(5.5, 1.2, 6000)).astype(int) + 1, 4096)
    pieces = spark.createDataFrame([(i, int(x)) for i, x in enumerate(sizes)], "id long, length long")
    packed = packing.pack(pieces, ["id"], part_items=500, fan_in=4).collect()
    bins = defaultdict(list)
    for r in packed:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 4096
    assert len(packed) == 6000 and len(bins) <= 1.01 * len(packing.best_fit(sizes, 4096)[2])


def test_decontamination(spark, docs, odd, empty, rows):
    texts = [t for _, t, *_ in rows if t and len(t.split()) > 20]
    items = [(1, " ".join(texts[0].split()[3:16])), (2, " ".join(texts[1].split()[1:12])), (3, "two words"), (4, "Words"), (5, None), (6, ""), (7, "a b a b a b a b a b a"), (10, "two words"), (8, " ".join(texts[0].split()[5:18]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(fold(t))
        m = min(len(w), 10)
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    sizes = {len(w) for w in windows}
    for bounds in ({}, {"block_words": 15}, {"block_words": 15, "pass_words": 1}):
        found = by_id(decontamination.hit_spans(docs, bench, **bounds))
        for i, t, *_ in rows:
            w, hit, own = word.findall(fold(t)), set(), set()
            for m in sizes:
                for k in range(len(w) - m + 1):
                    if tuple(w[k : k + m]) in windows:
                        hit |= set(range(k, k + m))
                        own |= windows[tuple(w[k : k + m])]
            r = found[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(own), bool(hit))
            assert r["items_sha256"] == hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
    long_items = bench.where("item_id in (1, 2, 7, 8)")
    clean = decontamination.decontaminate(docs, long_items)
    assert clean.columns == docs.columns
    assert decontamination.hit_spans(clean, long_items).where("contaminated").count() == 0
    untouched = {r["doc_id"] for r in decontamination.hit_spans(docs, long_items).where("not contaminated").collect()}
    assert untouched <= {r["doc_id"] for r in clean.collect()}
    assert by_id(decontamination.decontaminate(docs, long_items, block_words=15, pass_words=1)) == by_id(clean)
    by_text = {(r["doc_id"], r["text"]): r for r in decontamination.hit_spans(docs, bench).join(docs.select("doc_id", "text"), "doc_id").collect()}
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in decontamination.hit_spans(odd, bench).collect())
    own = {t: r for (_, t), r in by_text.items()}
    assert got == Counter((r["doc_id"], own[r["text"]]["n_words"], own[r["text"]]["n_hit"], own[r["text"]]["items_sha256"]) for r in odd.collect())
    assert decontamination.hit_spans(empty, bench).count() == 0 and decontamination.decontaminate(empty, bench).count() == 0
    nameless = spark.createDataFrame([(None, "intro words " + " ".join(texts[0].split()[3:16])), (None, "two words"), (1, "words")], "item_id long, text string")
    r = by_id(decontamination.hit_spans(spark.createDataFrame([(1, "z " + " ".join(texts[0].split()[:20]) + " z"), (2, "two words"), (3, "long " * 50_000 + "two words")], "doc_id long, text string"), nameless))
    assert r[1]["n_hit"] >= 13 and r[1]["items_sha256"] == hashlib.sha256(b"").hexdigest() and r[1]["n_items"] == 1
    assert (r[2]["n_hit"], r[2]["n_items"], r[2]["items_sha256"]) == (r[3]["n_hit"], r[3]["n_items"], r[3]["items_sha256"]) == (2, 2, hashlib.sha256(b"1").hexdigest())
    assert decontamination.hit_spans(docs, bench.limit(0)).where("contaminated").count() == 0


def brute_repeats(rows):
    """(id, n_words, n_removed, kept text) of (id, text) rows in order; rows that repeat id and text share one decision."""
    seen, out, done = set(), [], {}
    for i, t in rows:
        if (i, t or "") not in done:
            w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
            for k in range(len(w) - 19):
                x = tuple(w[k : k + 20])
                if x in seen:
                    gone |= set(range(k, k + 20))
                seen.add(x)
            done[i, t or ""] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
        out.append((i, *done[i, t or ""]))
    return out


def test_substring_dedup(spark, docs, odd, empty, rows):
    found = by_id(substring_dedup.repeats(docs, slot_bits=16, with_text=True))
    for i, n, gone, kept in brute_repeats(sorted((i, t) for i, t, *_ in rows)):
        r = found[i]
        assert (r["n_words"], r["n_removed"], r["kept_text"], r["kept_sha256"]) == (n, gone, kept, hashlib.sha256(kept.encode()).hexdigest())
    assert substring_dedup.repeats(empty).count() == 0 and substring_dedup.drop_repeats(empty).count() == 0
    # null ids come first; repeated rows share a decision
    own = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    want = Counter((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_repeats(own))
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.repeats(odd).collect()) == want
    # runs of one word, long ones too, and texts that consist of few words
    rng = random.Random(12)
    texts = ["a " * k for k in (19, 20, 21, 55)] + ["x " + "b " * 30 + "y", "z " + "b " * 24 + "y", "b " * 25 + "y"] + [" ".join(rng.choices("pq", k=400)) for _ in range(6)]
    texts += [" ".join(x for _ in range(40) for x in [rng.choice("rst")] * rng.choice([1, 1, 2, 9])) for _ in range(12)] + ["long " * 70_000 + "end"]
    passage = " ".join(f"m{k // 3}" for k in range(60))
    texts += [f"{'m0 ' * k}{passage}{' m19' * k} tail{k}" for k in range(5)]
    runs = spark.createDataFrame([(i, t, len(t), 1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, __row int").repartition(3)
    found, kept = by_id(substring_dedup.repeats(runs)), by_id(substring_dedup.drop_repeats(runs))
    assert substring_dedup.drop_repeats(runs).columns == runs.columns
    for i, n, gone, left in brute_repeats(enumerate(texts)):
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) == (n, gone, hashlib.sha256(left.encode()).hexdigest()), i
        assert kept[i]["text"] == (left if gone else texts[i]) and kept[i]["n_chars"] == len(kept[i]["text"]) and kept[i]["__row"] == 1


def test_substring_anchor_choice():
    """Equal windows have equal anchors, wherever they stand."""
    from sparkloom.llm import wordhash as W

    rng = random.Random(1)
    for trial in range(300):
        core = rng.choices(["abcde", "ab", [f"w{i}" for i in range(400)]][trial % 3], k=20)
        seen = set()
        for _ in range(12):
            text = " ".join(rng.choices(["a", "b", core[0], core[-1], "w1"], k=rng.randint(0, 30)) + core + rng.choices(["a", "b", core[0], core[-1], "w2"], k=rng.randint(0, 30)))
            for _, _, buf, off in W.blocks(pa.array([text])):
                h, _, _, at = W.words(buf, off, W.BYTES, W.NOT_SPACE)
                p, anchor, _, _ = substring_dedup.window_anchors(h, at, 20)
                w = text.split()
                seen |= {int(a) for k, a in zip(p, anchor, strict=True) if w[k : k + 20] == core}
        assert len(seen) == 1


def test_html(spark):
    nav = "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav>"
    body = "<h1>A title &amp; more</h1><p><b>First para<br>graph with <a href=x>link</a> text.<p>Second   \n one &lt;b&gt;</p><p>x.</p>"
    cases = [
        (1, f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{nav}<div class='ad'>Buy this now, it is long enough to matter.</div><article>{body}</article><footer>&copy; me</footer></body></html>", "A title & more First para graph with link text. Second one <b> x."),
        (2, None, ""),
        (3, "", ""),
        (4, "just  text", "just text"),
        (5, f"<div id=content><h2>Hey</h2><p>{'word ' * 40}</p><div class='comments'><p>{'reader ' * 60}</p></div><form><p>send</p></form></div><aside>{'side ' * 80}</aside>", "Hey " + "word " * 39 + "word"),
        (6, "<div>" * 3000 + "deep", "deep"),
        (7, "<p>un<b>closed", "unclosed"),
    ]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h, "clash") for i, h, _ in cases], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    for i, _, want in cases:
        assert (found[i]["text"], found[i]["n_chars"]) == (want, len(want))
    assert html_text.extract(pages.limit(0)).count() == 0


ARTICLE = "<h1>A title</h1>" + "".join(f"<p>Paragraph {i} has some words in it, enough to matter.</p>" for i in range(8))


@pytest.mark.parametrize("page", ["<div class='layout has-sidebar'>%s</div>", "<div class='page-header-fixed'>%s</div>", "<div class='post no-comments'>%s</div>", "<form id=aspnetForm>%s</form>", "<div class='widget'>%s</div><div class=footer>Copyright by me</div>", "<form><div class=site-header>My site</div><div class='post share-enabled'>%s<div class=comments>" + "<p>reader said this</p>" * 99 + "</div></div></form>", "<div class=post>%s</div><div class='share-bar enabled'>Share this</div>"])
def test_html_wrappers_keep_the_article(page):
    want = "A title " + " ".join(f"Paragraph {i} has some words in it, enough to matter." for i in range(8))
    assert html_text.main_text("<body><nav>Menu</nav>" + page % ARTICLE + "</body>") == want


def test_html_takes_broken_tags_in_linear_time():
    for s in ['<a "x ', "<a title='x", '<p x="', "<b><div></b></i>", "<div></p>", "<li>", "<div><ul><li>", "<!-- ", "<table><tr><td>", "<form>"]:
        times = []
        for size in (60_000, 240_000):
            begun = time.process_time()
            html_text.main_text(s * (size // len(s)) + "end")
            times.append(time.process_time() - begun)
        assert times[1] < 10 * times[0] + 1, (s, times)
    assert html_text.main_text('<a title="it>link') == "link" and html_text.main_text("<p>a < b and c <d no end") == "a < b and c <d no end"


def test_html_density_equals_brute_force():
    """Random trees of blocks and links, every measure by plain recursion."""
    rng = random.Random(8)

    def grow(depth):
        kids = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if depth == 0 or kind < 0.4:
                kids.append(("p", ["".join(rng.choices("ab c", k=rng.randint(1, 90))).strip() or "x"]))
            elif kind < 0.6:
                kids.append(("a", ["".join(rng.choices("lm", k=rng.randint(1, 30)))]))
            else:
                kids.append(("div", grow(depth - 1)))
        return kids

    def markup(node):
        return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"

    def blocks(node):
        return [k for k in node[1] if not isinstance(k, str) and k[0] != "a"]

    def counts(node):
        """Characters, tags, those of links."""
        c = t = lc = lt = 0
        for k in node[1]:
            if isinstance(k, str):
                c += len(re.sub(r"\s+", " ", k).strip())
                continue
            a = counts(k)
            c, t, lc, lt = c + a[0], t + a[1] + (k[0] != "a"), lc + a[2], lt + a[3]
        return (c, t, c, lt + 1) if node[0] == "a" else (c, t, lc, lt)

    for _ in range(150):
        root = ("body", grow(3))
        all_c, _, all_lc, _ = counts(root)
        ratio = max(all_lc, 1) / all_c

        def density(node, ratio=ratio):
            c, t, lc, lt = counts(node)
            plain, t, lc, lt = max(c - lc, 1), max(t, 1), max(lc, 1), max(lt, 1)
            return c / t * math.log(max(c / lc * t / lt, 1.0000001), math.log(c / plain * lc + ratio * c + math.e))

        def total(node):
            return sum(map(density, blocks(node))) or density(node)

        def below(node):
            return [node] + [x for k in blocks(node) for x in below(k)]

        def paths(node):
            return [[node]] + [[node, *p] for k in blocks(node) for p in paths(k)]

        best = max(below(root), key=total)
        least = min(density(x) for x in next(p for p in paths(root) if p[-1] is best))
        marked, todo = set(), [root]
        while todo:
            node = todo.pop()
            if density(node) >= least:
                marked.add(id(max(below(node), key=total)))
                todo += blocks(node)

        def text(node, inside, out):
            inside = inside or id(node) in marked
            for k in node[1]:
                if isinstance(k, str):
                    out[-1] += k if inside else ""
                elif k[0] == "a":
                    text(k, inside, out)
                else:
                    out.append("")
                    text(k, inside, out)
                    out.append("")
            return out

        want = " ".join(x for x in (re.sub(r"\s+", " ", b).strip() for b in text(root, False, [""])) if x)
        assert html_text.main_text("<body>" + "".join(map(markup, root[1])) + "</body>") == want


def test_warc(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 4
    htmls = [None, "", "short", "short", "é" * 60, "é" * 60, trap, trap, "x" * 99, "x" * 99, "y" * 100, "y" * 100, "long " * 40_000] + [f"page {i} " * 30 for i in range(40)] + ["page 3 " * 30] * 3
    rows = [(i * 2, f"http://x/{i}\r\nX: y" if i % 3 else None, h, 1) for i, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(3)
    first = {}
    for i, _, h, _ in rows:
        first.setdefault(h or "", i)
    for split_bytes in (777, 1 << 20):
        found = {r["page_id"]: r for r in warc.round_trip(pages, split_bytes=split_bytes).collect()}
        assert len(found) == len(rows)
        for i, _, h, _ in rows:
            raw, r = (h or "").encode(), found[i]
            revisit = len(raw) >= 100 and first[h or ""] != i
            assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None)
    ways = [sorted(map(str, warc.classify(pages, known_groups=n).select("__id", "__digest", "__first").collect())) for n in (0, 100)]
    assert ways[0] == ways[1]
    odd = spark.createDataFrame([(None, None, "z" * 200), (1, None, "z" * 200), (1, None, "z" * 200), (2, None, None), (2, "", "a" * 5_000_000)], "page_id long, url string, html string")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(odd).collect())
    assert got == Counter([(None, 200, "response", None), (1, 200, "revisit", None), (1, 200, "revisit", None), (2, 0, "response", None), (2, 5_000_000, "response", None)])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_licenses(spark, docs, odd, empty):
    mit = licenses.TEMPLATES[11][1].split()
    cases = [
        (1, "Released under the MIT License.", 1, 3, 3, "mit", "mit"),
        (2, "CC-BY cc by, Apache License", 3, 0, 4, "apache,cc-by", "apache,cc-by"),
        (3, " ".join(mit[:9] + ["really"] + mit[9:]), 0, None, None, "", "mit"),
        (4, None, 0, None, None, "", ""),
        (5, "the gnu general public", 0, None, None, "", ""),
        (6, "gnu general\npublic license " * 2, 2, 0, 4, "gpl", "gpl"),
    ]
    found = by_id(licenses.scan(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string")))
    for i, t, n, a, b, base, labels in cases:
        r = found[i]
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == (n, a, b, base, labels)
        assert r["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))) and 0 <= r["score"] <= 1
    assert licenses.scan(empty).count() == 0


def brute_licenses(t, k=3, least=0.7, drift=3, long_part=24):
    """(n_words, n_base, first, last, base labels, labels, score) by plain loops."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, places, base, more, best = word.findall(fold(t)), [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for label, text in licenses.TEMPLATES:
        v, diagonals = word.findall(fold(text)), defaultdict(set)
        for i in range(len(w) - k + 1):
            for j in range(len(v) - k + 1):
                if w[i : i + k] == v[j : j + k]:
                    diagonals[i - j].add(j)
        last, span = None, set()
        for d in [*sorted(diagonals), None]:
            if span and (d is None or d - last > drift):
                n, part = len(span), len(span) / (max(span) - min(span) + 1)
                share = max(n / (len(v) - k + 1), part if n >= long_part and part >= least else 0)
                best = max(best, share)
                more |= {label} if share >= least else set()
                span = set()
            if d is not None:
                span, last = span | diagonals[d], d
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if places else best


def test_licenses_equal_brute_force(spark, odd, rows):
    rng = random.Random(4)
    texts = [t for _, t, *_ in rows[:40]]
    for _, template in licenses.TEMPLATES:
        v = template.split()
        for noise in (0, 2, 6):
            x = list(v)
            for _ in range(noise):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 2)] = rng.choices(["foo", "the", "license", "of"], k=rng.randint(0, 3))
            a = rng.randrange(len(x)) if noise == 6 else 0
            texts.append("Some intro; " * rng.randint(0, 3) + " ".join(x[a:]).upper() + " the end, " * rng.randint(0, 2))
    texts += ["mit license " * 3000, "licensed under cc by 4 0 " * 200]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[50]), (50, texts[50]), (50, None)], "doc_id long, text string").repartition(3)
    for d in (docs, odd):
        got = sorted(((str(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in licenses.scan(d).collect()), key=str)
        want = sorted(((str(r["doc_id"]), *brute_licenses(r["text"])[:-1], round(brute_licenses(r["text"])[-1], 9)) for r in d.collect()), key=str)
        assert got == want


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    bad, rows, labels = ["moron", "vequ", "scum"], [], []
    for i in range(900):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 60))]
        toxic, junk = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randint(1, 4)):
                stem = rng.choice(bad)  # one of them has an ending of its own nearly every time
                words.insert(rng.randrange(len(words)), stem + "".join(rng.choices("aeinorst", k=3)) if stem == "vequ" else stem)
        text = " ".join(x.upper() + "!!" for x in words) if junk else " ".join(words)
        rows.append((i, text, "q"))
        labels.append((i, int(not junk), int(toxic)))
    rows += [(900, None, "q"), (901, "", "q"), (902, "vequzzz here", "q"), (903, "w1 w2 w3", "q"), (904, "w1 MORON, w3", "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1), (77, *labels[77][1:])], "doc_id long, quality int, toxic int")


def toxicity_of(text, model):
    return float(model.scores(pa.array([text]))[1][0])


def test_toxicity(labelled, empty):
    docs, labels = labelled
    model = toxicity.train(docs, labels, per_class=400)
    found, truth = by_id(toxicity.score(docs, model)), {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None}
    assert len(found) == docs.count() and sum(found[i]["toxic"] == bool(t) for i, t in truth.items() if i is not None) >= 0.97 * 900
    assert not any(found[i]["toxic"] for i in (900, 901, 903)) and found[904]["toxic"]
    assert found[902]["score"] > 10 * found[903]["score"]
    assert found[902]["toxic"]  # a form that was never seen: its stem is evidence enough
    assert all(0 <= r["score"] <= 1 and 0 <= r["expected_severity"] <= 3 for r in found.values())
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["toxic"]}
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(empty, model).count() == 0
    severity = {i: toxicity_of(t, model) for i, t in enumerate(["w1 moron w2", "moron w2 scum", "moron scum vequaaa w1"])}
    assert severity[0] < severity[1] < severity[2]  # more distinct toxic words are a higher grade
    odd = docs.sparkSession.createDataFrame([(None, "w1 MORON, w3", 1), (7, "w1 MORON, w3", 2), (7, "w1 MORON, w3", 2), (7, None, None), (None, "long " * 70_000 + "moron", 3)], "doc_id long, text string, score int")
    assert Counter((r["doc_id"], r["toxic"]) for r in toxicity.score(odd, model).collect()) == Counter([(None, True), (7, True), (7, True), (7, False), (None, True)])
    assert [tuple(r) for r in toxicity.drop_toxic(odd, model).collect()] == [(7, None, None)]
    with_odd = toxicity.train(docs.unionByName(odd.withColumn("score", F.col("score").cast("string"))), labels.unionByName(labels.limit(5)), per_class=400)
    assert len(with_odd.features) and toxicity.train(empty, labels).thresholds.size == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, blank).where("toxic").count() == 0


def test_quality(labelled, empty):
    docs, labels = labelled
    rules = quality.train(docs, labels, per_class=400)
    found, truth = by_id(quality.score(docs, rules)), {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] is not None}
    out = [i for i in truth if i is not None and found[i]["held_out"]]
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert sum(found[i]["predicted"] == truth[i] for i in out) >= 0.95 * len(out) and all(0 <= r["score"] <= 1 for r in found.values())
    assert quality.score(empty, rules).count() == 0
    odd = docs.sparkSession.createDataFrame([(None, None, 1), (7, None, 2), (7, "w1 w2", 2), (7, "w1 w2", 2), (8, "long " * 70_000, 3)], "doc_id long, text string, score int")
    got = quality.score(odd, rules).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([None, 7, 7, 7, 8]) and len({(r["doc_id"], r["score"]) for r in got}) <= 4 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).select("score").distinct().collect()} == {0.5}


def test_word_cache_equals_tokenizer():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordCachedTokenizer(packing.default_tokenizer(), most=50)
    texts = ["It's <|endoftext|> here", "ＦＵＬＬ width", "é İstanbul ΣΑΣ", "a b c", "x\x00y \x1cz", "don't WE'RE 12345 !!..", "日本語テキスト", "🙂🙂a", "ǅ ß ẞ", " ", ""]
    rng = random.Random(2)
    texts += ["".join(rng.choices("abzXÉéßñ '.,!1<|>\n\t̀日", k=60)) for _ in range(200)]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids == b"".join(x.to_bytes(4, "little") for x in tok.encode(t, add_special_tokens=False).ids), t


def test_statistics_see_the_whole_text():
    x = next(quality.statistics(pa.array(["a b c " * 50_000 + "D!!"])))
    assert x[0, quality.STATISTICS.index("n_words")] == 150_001 and x[0, quality.STATISTICS.index("upper_share")] > 0


def test_held_out_is_never_trained_on(labelled):
    from sparkloom.llm.samples import held_out, labelled_rows

    docs, labels = labelled
    assert labelled_rows(docs, labels, "quality", 1000).where(held_out(F.col("__id"))).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_bounded_sample_keeps_the_mix(spark, module):
    """A sample that takes all rows of the rarer label and few of the other one gives scores of the same mean as all rows."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        rare = rng.random() < 0.1
        sign = rng.random() < (0.8 if rare else 0.2)  # neither label is certain
        words = [f"w{rng.randrange(50)}" for _ in range(30)] + ["sign" * (1 if module is toxicity else 9)] * (8 * sign)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not rare), int(rare)))
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    share = 0.1 if module is toxicity else 0.9
    means = [module.score(docs, module.train(docs, truth, per_class=n)).agg(F.avg("score")).first()[0] for n in (700, 3000)]
    assert abs(means[0] - share) < 0.03 and abs(means[0] - means[1]) < 0.03, means


@pytest.mark.parametrize("endings", [["na", "to"], None])
def test_unseen_ending_of_a_toxic_stem(spark, endings):
    """A stem that is toxic with every ending is toxic with a new one; a toxic word of a stem that is mostly clean stays toxic, the stem doesn't get so."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        words, toxic = [f"w{rng.randrange(500)}" for _ in range(rng.randint(5, 60))], rng.random() < 0.2
        if toxic:
            bad = ["moron", "vequ" + (rng.choice(endings) if endings else "".join(rng.choices("aeinorst", k=3))), "scum", "plainest"]
            words[rng.randrange(len(words)) : 0] = [rng.choice(bad)]
        elif rng.random() < 0.3:
            words.append(rng.choice(["plainly", "plainer"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, "vequzzz here"), (901, "w1 plainest w2"), (902, "w1 plainzzz w2"), (903, "w1 w2 w3"), (904, "w1 MORON, w3")]
    docs, truth = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    found = by_id(toxicity.score(docs, toxicity.train(docs, truth)))
    assert [found[i]["toxic"] for i in range(900, 905)] == [True, True, False, False, True]
