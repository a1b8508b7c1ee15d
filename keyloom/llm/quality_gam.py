"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins at its quantiles. Boosting goes round the features in turn; each turn fits a
shallow tree (at most four leaves) on one feature's bins to the current gradients and adds a small step
of it to that feature's look-up table. The pairs whose coarse grid explains most of what is left then get
tables of their own, boosted by trees of one cut on either axis. A score is the sum of the tables' entries
for a row's bins, through the logistic function: a gather and an addition for each table.

Features come from whole texts, computed over arrays for many documents at once; they describe shape
(lengths, character classes, repetition), never the label, language, source or id. The model is fitted on the
driver from at most ``sample`` labelled rows, repeated ones once, chosen by a hash of id and features; a few numbers a row are
collected, never text. Everything is deterministic.

Defined results: a null or empty text has the features of no words and gets a score like any other; null labels are
ignored; of several labels for one id the lowest counts; without labels of both kinds every score is the
share of label 1 (0.5 without labels); null doc_id is scored, never learned from; repeated rows are scored each; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._frames import drawn, durable, pieces
from keyloom.llm._words import Words, grams

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "symbols", "stops", "shouts", "bars",
    "distinct", "top_word", "stutter", "repeated_lines", "line_length", "repeated_grams", "symbol_ends", "spaces",
)
_CLASS = {
    "letters": [*range(65, 91), *range(97, 123), *range(128, 256)],
    "upper": list(range(65, 91)),
    "digits": list(range(48, 58)),
    "symbols": list(b"#$%&*+<=>@[]^_`{}~\\/"),
    "stops": list(b".,;:?"),
    "shouts": list(b"!"),
    "bars": list(b"|"),
    "spaces": [32, *range(9, 14)],
}


def _share(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags between successive bounds."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float64)


def _repeats(doc: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: number of distinct hashes, and how often the commonest occurs."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    start = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(h, prepend=h[:1]) != 0)) if len(d) else np.zeros(0, np.int64)
    runs, most = np.diff(np.append(start, len(d))), np.zeros(n)
    np.maximum.at(most, d[start], runs)
    return np.bincount(d[start], minlength=n).astype(np.float64), most


def features(texts: list[bytes]) -> np.ndarray:
    n, w = len(texts), Words(texts)
    size = np.diff(w.begin) - 1.0
    chars = np.maximum(size, 1)
    of = {}
    for name, codes in _CLASS.items():
        flag = np.zeros(256, bool)
        flag[codes] = True
        of[name] = _share(flag[w.bytes], w.begin)
    of["spaces"] -= 1  # the byte after each text
    count = np.diff(w.first).astype(np.float64)
    some = np.maximum(count, 1)
    h, doc, left = w.hashes(), w.docs(), w.left()
    distinct, top = _repeats(doc, h, n)
    same = np.zeros(w.n, bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    at = np.flatnonzero(left >= 5)
    different, _ = _repeats(doc[at], grams(h, 5)[at] if len(at) else h[:0], n)
    runs = np.maximum(np.bincount(doc[at], minlength=n), 1)
    odd = np.zeros(256, bool)
    odd[_CLASS["symbols"] + _CLASS["shouts"]] = True
    lines = [[x for x in t.split(b"\n") if x] for t in texts]
    n_lines = np.maximum([len(x) for x in lines], 1)
    columns = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(count),
        "word_length": _share(w.ends - w.starts, w.first) / some,
        "letters": of["letters"] / chars,
        "upper": of["upper"] / np.maximum(of["letters"], 1),
        **{k: of[k] / chars for k in ("digits", "symbols", "stops", "shouts", "bars", "spaces")},
        "distinct": distinct / some,
        "top_word": top / some,
        "stutter": _share(same, w.first) / some,
        "repeated_lines": 1 - np.maximum([len(set(x)) for x in lines], 1) / n_lines,
        "line_length": np.log1p(size / n_lines),
        "repeated_grams": np.where(different > 0, 1 - different / runs, 0.0),
        "symbol_ends": _share(odd[w.bytes[w.ends - 1]], w.first) / some,
    }
    return np.column_stack([columns[k] for k in FEATURES])


class Model:
    """cuts: each feature's bin limits; tables: a value for each bin; pairs: (i, j, limits of i, limits of j, grid)."""

    def __init__(self, intercept: float, cuts: list[np.ndarray], tables: list[np.ndarray], pairs: list[tuple]):
        self.intercept, self.cuts, self.tables, self.pairs = intercept, cuts, tables, pairs

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for k, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cuts, x[:, k], "right")]
        for i, j, a, b, grid in self.pairs:
            z += grid[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    found = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    return found[found > x.min()]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Newton values of a tree over ordered bins: the best cut of any leaf, until there are enough."""
    bounds = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    value = lambda lo, hi: (cg[hi] - cg[lo]) ** 2 / (ch[hi] - ch[lo] + ridge)
    while len(bounds) <= leaves:
        best = (1e-9, 0)
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = value(lo, at) + value(at, hi) - value(lo, hi)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(at[k])))
        if not best[1]:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Newton values of the best cut on both axes of a grid."""
    cg, ch = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))
    n, m = g.shape
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    total = 0.0
    for lo_i, hi_i, lo_j, hi_j in ((0, i, 0, j), (0, i, j, m), (i, n, 0, j), (i, n, j, m)):
        box = lambda c: c[hi_i, hi_j] - c[lo_i, hi_j] - c[hi_i, lo_j] + c[lo_i, lo_j]  # noqa: E731, B023
        total = total + box(cg) ** 2 / (box(ch) + ridge)
    a, b = np.unravel_index(int(np.argmax(total)), total.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, a + 1), slice(a + 1, n)):
        for columns in (slice(0, b + 1), slice(b + 1, m)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, n_pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1, ridge: float = 2.0) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    width = len(FEATURES)
    if not len(y) or share in (0.0, 1.0):
        return Model(float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)), [np.zeros(0)] * width, [np.zeros(1)] * width, [])
    intercept = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, k], bins) for k in range(width)]
    place = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(width):
            if len(tables[k]) > 1:
                g, h = (np.bincount(place[k], v, minlength=len(tables[k])) for v in slopes())
                step = rate * _tree(g, h, 4, ridge)
                tables[k] += step
                z += step[place[k]]
    coarse = [_cuts(x[:, k], 8) for k in range(width)]
    spot = [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        at = spot[i] * shape[1] + spot[j]
        return at, *(np.bincount(at, v, minlength=shape[0] * shape[1]).reshape(shape) for v in slopes())

    gains = []
    for i, j in combinations([k for k in range(width) if len(coarse[k])], 2):
        _, g, h = grid(i, j)
        gains.append((float((g**2 / (h + ridge)).sum()), i, j))
    chosen = sorted(gains, reverse=True)[:n_pairs]
    grids = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for _, i, j in chosen]
    for _ in range(pair_rounds):
        for (_, i, j), table in zip(chosen, grids, strict=True):
            at, g, h = grid(i, j)
            step = rate * _quarters(g, h, ridge)
            table += step
            z += step.ravel()[at]
    return Model(intercept, cuts, tables, [(i, j, coarse[i], coarse[j], t) for (_, i, j), t in zip(chosen, grids, strict=True)])


def described(docs: DataFrame) -> DataFrame:
    """doc_id and one column x: the features of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            values = pa.array(features(texts).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(0, len(values) + 1, len(FEATURES), dtype=np.int32), values)], ["doc_id", "x"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, x array<double>")


def score(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = 20_000, **params) -> DataFrame:
    """doc_id, score. labels: doc_id, quality (0 or 1); learn: a condition on doc_id, true where labels may be used."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).where(learn)
    x = durable(described(docs))
    labelled = x.join(known, "doc_id")
    found = drawn(labelled, labelled.count(), sample, "doc_id", "x").select("x", "y").toPandas()
    values = np.stack(found["x"].to_list()) if len(found) else np.zeros((0, len(FEATURES)))
    model = docs.sparkSession.sparkContext.broadcast(fit(values, found["y"].to_numpy(np.float64), **params))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(rows))], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")
