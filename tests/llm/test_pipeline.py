"""The pipeline stage by stage against brute force, and the registered queries against their SQL, on whole small tables."""

import re
from collections import defaultdict

import duckdb
import pytest
from test_operators import fold, shingles

import corpus_pipeline
from sparkloom.llm import packing, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in "documents pages benchmark labels".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, tables = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).persist()
        assert kept.columns == docs.columns
        tables.append(({r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in kept.collect()}))

    (before, after), labels = tables[0], spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert set(after) == {i for i in before if not scored[i]}

    before, after = tables[1]
    groups = defaultdict(list)
    for i, r in before.items():
        groups[fold(r["text"])].append(i)
    assert set(after) == {max(g) for g in groups.values()}

    before, after = tables[2]
    sets, label = {i: shingles(r["text"]) for i, r in before.items()}, {i: i for i in before}
    near = {a: [b for b, y in sets.items() if x and y and 100 * len(x & y) >= 60 * len(x | y)] for a, x in sets.items()}
    for _ in sets:
        for a in sets:
            label[a] = min([label[a], *(label[b] for b in near[a])])
    assert set(after) == {i for i in sets if label[i] == i}

    before, after = tables[3]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall(fold(r["text"]))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} - {()}
    for i, r in before.items():
        w, hit = WORD.findall(fold(r["text"])), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
        if len(hit) > 0.5 * len(w):
            assert i not in after
        else:
            assert WORD.findall(fold(after[i]["text"])) == [x for k, x in enumerate(w) if k not in hit]
            if not hit:
                assert after[i] == r
            else:
                assert after[i]["n_chars"] == len(after[i]["text"])

    from tokenizers import Tokenizer

    tok, pieces = Tokenizer.from_file(packing.default_tokenizer()), defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {i: len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for i, r in after.items()}


ODD = [(None, None), (1, None), (1, ""), (2, "\n"), (3, "one text that stands here"), (3, "another text under the same id"), (4, "ONE text that stands here"), (4, "ONE text that stands here"), (None, "one text that stands here"), (5, "long " * 30_000)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_and_no_rows(spark, rows):
    """Null ids and texts, ids that rows share, repeated rows, a long text, a further column with a name of the operators' own; and no rows at all."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, __id int").repartition(2)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "__id"]
        left[name] = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    if not rows:
        assert not any(left.values()) and not pieces
        return
    assert left["toxicity"] == sorted(rows, key=str)
    # of the null and the empty text the larger id stays, of the copies of one text that of id 4, once
    kept = [x for x in left["exact_dedup"] if x[1]]
    assert sorted(kept, key=str) == sorted([(2, "\n"), (3, "another text under the same id"), (4, "ONE text that stands here"), (5, "long " * 30_000)], key=str)
    assert len(left["exact_dedup"]) == 5 and left["ngram_jaccard_join"] == left["exact_dedup"] == left["benchmark_decontamination"]
    assert sum(p["length"] for p in pieces if p["doc_id"] == 5) > 30_000 and all(len(p["ids"]) == p["length"] for p in pieces)
