"""Operator 7: quality by a sparse rule ensemble.

Statistics of every whole text (`STATISTICS`) are computed over Arrow blocks. On a bounded sample of labelled rows, small boosted
trees are grown; every path from a root to a node is a rule, a conjunction of comparisons. A logistic model with an L1 penalty
over the rules keeps few of them, and these are compiled into one Spark column expression over the statistics: scoring runs in
generated code. Where the sample is bounded, its rows are weighted back to the mix of all training labels, so scores are
probabilities under that mix at any size. Labels, lang, source and ids are no inputs of a score.

Null, empty and blank texts have all statistics 0 and get the score the rules give that. Rows that repeat an id get a row each. An
empty table gives an empty result. With labels of one kind only every score is that kind's 0 or 1, without labels 0.5. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import wordhash as W
from sparkloom.llm.samples import held_out, labelled_rows

STATISTICS = ["n_words", "mean_word_bytes", "upper_share", "digit_share", "symbol_share", "exclaim_share", "pipe_share", "line_share", "repeated_neighbours", "distinct_words", "distinct_trigrams", "distinct_lines", "long_words"]
_b = np.arange(256)
_UPPER, _LOWER, _DIGIT = (_b >= 65) & (_b <= 90), (_b >= 97) & (_b <= 122), (_b >= 48) & (_b <= 57)
_SYMBOL = (_b > 32) & (_b < 127) & ~_UPPER & ~_LOWER & ~_DIGIT & ~np.isin(_b, [44, 46, 33, 124, 39, 45, 40, 41, 58, 59, 63, 34])
_CLASS = np.stack([_UPPER, _UPPER | _LOWER, _DIGIT, _SYMBOL, _b == 33, _b == 124, _b == 10])


def _per_row(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _distinct_share(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distinct values among each row's values; 1 where there are none."""
    n = np.diff(rows)
    key = np.sort((np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(48)) | (h >> np.uint64(16)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    found = np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=len(n))
    return np.where(n > 0, found / np.maximum(n, 1), 1.0)


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """Blocks of rows x STATISTICS."""
    for lo, hi, buf, off in W.blocks(column):
        h, starts, ends, rows = W.words(buf, off, W.FOLDED, W.NOT_SPACE)
        size, n = np.maximum(np.diff(off), 1), np.diff(rows)
        some = np.maximum(n, 1)
        upper, letters, digits, symbols, exclaim, pipes, lines = (_per_row(c[buf], off) for c in _CLASS)
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        same[rows[:-1]] = False
        trigrams = W.window_hashes(h, 3)
        row = np.repeat(np.arange(hi - lo), n)
        ok = row[: len(trigrams)] == row[2:] if len(trigrams) else np.zeros(0, bool)
        of = np.searchsorted(row[: len(trigrams)][ok], np.arange(hi - lo + 1))
        lh, _, _, lrows = W.words(buf, off, W.BYTES, _b != 10)
        width = ends - starts
        out = np.stack([n, _per_row(width, rows) / some, upper / np.maximum(letters, 1), digits / size, symbols / size, exclaim / some, pipes / some, lines / some, _per_row(same[:-1], rows) / some, _distinct_share(h, rows), _distinct_share(trigrams[ok], of), _distinct_share(lh, lrows), _per_row(width > 24, rows) / some], axis=1).astype(np.float64)
        out[n == 0] = 0
        yield out


@dataclass
class Rules:
    """Conjunctions of (statistic, above or not, cut) with weights."""

    bias: float
    rules: list[tuple[tuple[int, bool, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self) -> Column:
        """The probability as a Spark expression over the statistics' columns."""
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, above, cut in rule:
                holds = holds & (F.col(STATISTICS[k]) > float(cut) if above else F.col(STATISTICS[k]) <= float(cut))
            z = z + F.when(holds, F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return _matrix(self.rules, x)


def _matrix(rules: list, x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for k, above, cut in rule:
            out[:, j] &= x[:, k] > cut if above else x[:, k] <= cut
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, bins: int = 32, rate: float = 0.3, weight: np.ndarray | None = None) -> list[tuple[tuple[int, bool, float], ...]]:
    """The paths to all nodes of boosted trees (logistic loss, splits at quantiles). weight: of the rows, their mean is 1."""
    weight = np.ones(len(y)) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)  # code > i: above cut i
    z, rules = np.full(len(y), _log_odds(y, weight)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * (p * (1 - p) + 1e-6)
        nodes: list[tuple[np.ndarray, tuple]] = [(np.arange(len(y)), ())]
        for level in range(depth + 1):
            after = []
            for rows, path in nodes:
                best = (1e-3, None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                if level < depth and len(rows) >= 20:
                    for k, c in enumerate(cuts):
                        gk = np.cumsum(np.bincount(coded[rows, k], weights=g[rows], minlength=len(c) + 1))[:-1]
                        hk = np.cumsum(np.bincount(coded[rows, k], weights=h[rows], minlength=len(c) + 1))[:-1]
                        gain = gk**2 / (hk + 1) + (total_g - gk) ** 2 / (total_h - hk + 1) - total_g**2 / (total_h + 1)
                        if len(gain) and gain.max() > best[0]:
                            best = (gain.max(), (k, int(gain.argmax())))
                if best[1] is None:
                    z[rows] += rate * total_g / (total_h + 1)
                    continue
                k, i = best[1]
                above = coded[rows, k] > i
                for side, part in ((False, rows[~above]), (True, rows[above])):
                    after.append((part, (*path, (k, side, float(cuts[k][i])))))
                    rules.append(after[-1][1])
            nodes = after
            if not nodes:
                break
    return list(dict.fromkeys(rules))


def _log_odds(y: np.ndarray, weight: np.ndarray) -> float:
    share = np.average(y, weights=weight)
    return float(np.log((share + 1e-6) / (1 - share + 1e-6)))


def fit_lasso(m: np.ndarray, y: np.ndarray, l1: float, steps: int = 600, weight: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps on standardised columns. weight: of the rows, their mean is 1."""
    weight = np.ones(len(y)) if weight is None else weight
    mean = np.average(m, axis=0, weights=weight)
    spread = np.maximum(np.sqrt(np.average((m - mean) ** 2, axis=0, weights=weight)), 0.02)
    x = (m - mean) / spread
    rate = 4 * len(y) / max(1e-9, np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2)
    w = v = np.zeros(x.shape[1])
    b = vb = _log_odds(y, weight)
    t = 1.0
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(x @ v + vb, -40, 40))) - y) / len(y)
        new = v - rate * (x.T @ g)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b = vb - min(rate, 4.0) * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b - float((w * mean / spread).sum()), w / spread


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 10_000, trees: int = 24, depth: int = 3, l1: float = 1e-3) -> Rules:
    """per_class: the bound of the training sample for either label. The driver sees its statistics only."""
    sample = labelled_rows(docs, labels, label, per_class, id_col, text_col)
    rows = with_statistics(sample.select("__id", "__y", "__weight", "__text"), "__text").select("__id", "__y", "__weight", *STATISTICS).orderBy("__id", "__y", *STATISTICS).collect()
    y = np.array([r["__y"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Rules(0.0 if not len(y) else (30.0 if y[0] else -30.0))
    x = np.array([r[3:] for r in rows], np.float64)
    weight = np.array([r["__weight"] for r in rows])
    weight /= weight.mean()
    rules = grow_rules(x, y, trees, depth, weight=weight)
    if not rules:
        return Rules(_log_odds(y, weight))
    bias, w = fit_lasso(_matrix(rules, x).astype(np.float64), y, l1, weight=weight)
    keep = np.flatnonzero(np.abs(w) > 1e-9)
    return Rules(bias, [rules[k] for k in keep], [float(w[k]) for k in keep])


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with the statistics' columns in place of the text."""
    keep = [c for c in docs.columns if c != text_col]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"{s} double" for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([np.zeros((0, len(STATISTICS))), *statistics(batch.column(len(keep)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *(pa.array(x[:, k].copy()) for k in range(len(STATISTICS)))], names=[*keep, *STATISTICS])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def score(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    found = with_statistics(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text").select("__id", rules.column().alias("score"))
    return found.select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels))
