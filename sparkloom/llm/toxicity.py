"""Operator 6: toxicity by cumulative-link ordinal regression over sparse text features.

Features say whether a word, or a prefix of 4, 5 or 6 bytes of a word, is present (words: letters, digits and non-ASCII
characters, A-Z lower-cased). Prefixes catch inflected forms: a word or prefix is no feature where a shorter prefix of it is toxic
as often (within PURITY of the rows that hold it), so the weight of a stem isn't split among its known endings. A text has grade 0 where its label says it isn't toxic. The labels
have no finer scale; a toxic text is graded by its evidence: how many of the features it holds occur in toxic texts only (1 for one or
none, and so on up to `grades` for that many or more), which is counted over the sample and takes no part of the fit.
P(grade <= k) = logistic(threshold_k - w x): one sparse weight vector w (L1) is shared by all ordered thresholds.

The model is fitted on a bounded sample of labelled rows (`per_class` of either label; never those held out). Candidate features
are counted over the sample in Spark; the driver sees the `candidates` best ones only. Where the sample is bounded, its rows are
weighted back to the mix of all training labels, so scores are probabilities under that mix at any size. Every text is scored whole.

Null, empty and blank texts have no features and the base rate's score. Rows that repeat an id get a row each. An empty table
gives an empty result. Without labels of both kinds nothing is toxic (score 0). Other columns are ignored, and kept unchanged by
`drop_toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import wordhash as W
from sparkloom.llm.samples import labelled_rows

PREFIXES = (4, 5, 6)
THRESHOLD = 0.5
PURITY = 0.02


def _features(column: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Rows lo to hi and (row, feature, number of the word) arrays: words, then prefixes."""
    for lo, hi, buf, off in W.blocks(column):
        h, starts, ends, rows = W.words(buf, off, W.FOLDED, W.ALNUM)
        row = np.repeat(np.arange(hi - lo), np.diff(rows))
        out = [(row, h, np.arange(len(h)))]
        if len(h):
            span = W.span_hasher(buf, W.FOLDED)
            for k in PREFIXES:
                long = np.flatnonzero(ends - starts > k)
                out.append((row[long], W.mix(span(starts[long], starts[long] + k) + np.uint64(k)), long))
        yield lo, hi, out


@dataclass
class OrdinalModel:
    """Sorted feature hashes, their weights, the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self):
        self._bits = np.zeros(1 << 22, bool)
        self._bits[(self.features >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and feature numbers of those that the model knows."""
        there = np.flatnonzero(self._bits[(h >> np.uint64(42)).astype(np.int64)])
        row, h = row[there], h[there]
        at = np.searchsorted(self.features, h)
        at[at == len(self.features)] = 0
        ok = self.features[at] == h if len(self.features) else np.zeros(len(h), bool)
        return row[ok], at[ok]

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """P(grade > 0) and expected grade of each row."""
        z = np.zeros(len(column))
        for lo, hi, parts in _features(column):
            keys = [np.zeros(0, np.int64)]
            for row, h, _ in parts:
                r, f = self.hits(row, h)
                keys.append(r * len(self.features) + f)
            key = np.unique(np.concatenate(keys))
            if len(key):
                z[lo:hi] = np.bincount(key // len(self.features), weights=self.weights[key % len(self.features)], minlength=hi - lo)
        if not len(self.thresholds):
            return z * 0, z * 0
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))
        return above[:, 0], above.sum(1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, n_features: int, l1: float, steps: int = 1000, rate: float = 0.05, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model with an L1 penalty, by proximal gradient steps with adaptive rates. weight: of the
    rows, their mean is 1."""
    n, top = len(grade), int(grade.max())
    weight = np.ones(n) if weight is None else weight
    w = np.zeros(n_features)
    share = np.array([np.average(grade <= k, weights=weight) for k in range(top)])
    theta = np.log(share / (1 - share + 1e-9) + 1e-9)
    m_w, v_w, m_t, v_t = np.zeros(n_features), np.zeros(n_features), np.zeros(top), np.zeros(top)
    at = np.arange(n)
    for step in range(1, steps + 1):
        z = np.bincount(rows, weights=w[cols], minlength=n)
        cum = 1 / (1 + np.exp(np.clip(z[:, None] - theta[None, :], -40, 40)))  # P(grade <= k)
        full = np.concatenate([np.zeros((n, 1)), cum, np.ones((n, 1))], axis=1)
        slope = full * (1 - full)
        p = np.maximum(full[at, grade + 1] - full[at, grade], 1e-9)
        up, down = weight * slope[at, grade + 1] / p, weight * slope[at, grade] / p
        g_z = (up - down) / n  # of the negative log likelihood by z
        g_w = np.bincount(cols, weights=g_z[rows], minlength=n_features)
        g_t = (np.bincount(grade, weights=-up, minlength=top + 1)[:top] + np.bincount(grade, weights=down, minlength=top + 1)[1:]) / n
        for g, m, v, x, penalty in ((g_w, m_w, v_w, w, l1), (g_t, m_t, v_t, theta, 0.0)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            own = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
            x -= own * m / (1 - 0.9**step)
            if penalty:
                np.copyto(x, np.sign(x) * np.maximum(np.abs(x) - own * penalty, 0))
        theta.sort()
    return w, theta


def _stems(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """PREFIXES x all features of the parts: each one's own shorter prefixes, 0 for none."""
    prefixes = np.zeros((len(PREFIXES), len(parts[0][1])), np.uint64)
    for k, (_, h, at) in enumerate(parts[1:]):
        prefixes[k, at] = h
    out = [prefixes]
    for k, (_, _, at) in enumerate(parts[1:]):
        own = prefixes[:, at]
        own[k:] = 0
        out.append(own)
    return np.concatenate(out, axis=1)


def _least_stems(found: list[tuple[int, float, list[int]]]) -> list[int]:
    """Of (feature, toxic share of the rows that hold it, its shorter prefixes) the features that no kept shorter prefix stands for."""
    kept: dict[int, float] = {}
    for f, share, stems in sorted(found, key=lambda x: len(x[2])):
        if not any(kept.get(s, -1.0) >= share - PURITY for s in stems):
            kept[f] = share
    return list(kept)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000, candidates: int = 4000, grades: int = 3, l1: float = 3e-4) -> OrdinalModel:
    """per_class: the bound of the training sample for either label; candidates: the bound of the features looked at."""
    sample = labelled_rows(docs, labels, label, per_class, id_col, text_col)
    stem_columns = [f"s{k}" for k in PREFIXES]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            for lo, hi, parts in _features(batch.column(1)):
                row, h = np.concatenate([r for r, _, _ in parts]), np.concatenate([x for _, x, _ in parts])
                if not len(h):
                    continue
                stems = _stems(parts)
                order = np.lexsort((row, h))
                row, h = row[order], h[order]
                first = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                row, h, stems = row[first], h[first], stems[:, order[first]]
                start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                toxic = np.add.reduceat(y[lo:hi][row].astype(np.int64), start)
                total = np.diff(np.concatenate([start, [len(h)]]))
                some = toxic > 0
                yield pa.RecordBatch.from_arrays([pa.array(h[start][some].view(np.int64)), pa.array(toxic[some]), pa.array((total - toxic)[some]), *(pa.array(x[start][some].view(np.int64)) for x in stems)], names=["f", "a", "b", *stem_columns])

    n = {r["__y"]: r for r in sample.groupBy("__y").agg(F.count("*").alias("rows"), F.max("__weight").alias("weight")).collect()}
    pos, neg = (n[y]["rows"] if y in n else 0 for y in (1, 0))
    nothing = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    if not pos or not neg:
        return nothing
    found = sample.select("__y", "__text").mapInArrow(W.tidy(present), ", ".join(f"{c} long" for c in ["f", "a", "b", *stem_columns])).groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *[F.max(c).alias(c) for c in stem_columns])
    odds = F.log((F.col("a") + 0.5) / (pos - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (neg - F.col("b") + 0.5))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = found.where("a >= 3").withColumn("z", odds / error).where("z > 2").orderBy(F.desc("z"), "f").limit(candidates).select("f", "a", "b", *stem_columns).collect()
    if not best:
        return nothing
    clean = {r["f"]: r["b"] for r in best}
    best = _least_stems([(r["f"], r["a"] * n[1]["weight"] / (r["a"] * n[1]["weight"] + r["b"] * n[0]["weight"]), [r[c] for c in stem_columns if r[c]]) for r in best])
    known = OrdinalModel(np.sort(np.array(best, np.int64).view(np.uint64)), np.zeros(len(best)), np.zeros(0))

    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, y = batch.column(0), batch.column(1)
            for lo, hi, parts in _features(batch.column(2)):
                hits = [known.hits(row, h) for row, h, _ in parts]
                row, f = np.concatenate([r for r, _ in hits]), np.concatenate([x for _, x in hits])
                key = np.unique(row * len(known.features) + f)
                row, f = key // len(known.features), (key % len(known.features)).astype("<u2")
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), y.slice(lo, hi - lo), pa.array([f[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], names=["id", "y", "f"])

    kind = sample.schema["__id"].dataType.simpleString()
    rows = sample.select("__id", "__y", "__text").mapInArrow(W.tidy(active), f"id {kind}, y int, f binary").orderBy("id", "y", "f").collect()
    lists = [np.frombuffer(bytes(r["f"]), "<u2").astype(np.int64) for r in rows]
    y = np.array([r["y"] for r in rows])
    cols, at = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    weight = np.where(y == 1, n[1]["weight"], n[0]["weight"])
    weight /= weight.mean()
    exclusive = np.isin(known.features, np.array([f for f, b in clean.items() if not b], np.int64).view(np.uint64))
    evidence = np.bincount(at, weights=exclusive[cols], minlength=len(y)).astype(np.int64)
    grade = np.where(y == 1, np.clip(evidence, 1, grades), 0)
    w, theta = fit_ordinal(at, cols, grade, len(best), l1, weight=weight)
    keep = np.flatnonzero(w)
    return OrdinalModel(known.features[keep], w[keep], theta)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, score (probability that it is toxic), expected_severity (0 to the highest grade), severity, toxic."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            p, expected = own.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(expected), pa.array(np.rint(expected).astype(np.int32)), pa.array(p >= threshold)], names=[id_col, "score", "expected_severity", "severity", "toxic"])

    return docs.select(id_col, text_col).mapInArrow(W.tidy(run), f"`{id_col}` {kind}, score double, expected_severity double, severity int, toxic boolean")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(batch.column(at))[0] < threshold))

    return docs.mapInArrow(W.tidy(run), docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
