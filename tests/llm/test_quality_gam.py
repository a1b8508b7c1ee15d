import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import quality_gam as gam
from keyloom.llm import queries

SMALL = "/root/testdata/sf0.01"


def plain(text):
    """All features, by hand."""
    raw = (text or "").encode()
    w = raw.split()
    n, size = max(1, len(w)), max(1, len(raw))
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    lines = [x for x in raw.split(b"\n") if x]
    return {
        "log_bytes": np.log1p(len(raw)),
        "log_words": np.log1p(len(w)),
        "word_length": sum(map(len, w)) / n,
        "spaces": sum(c in b" \t\n\x0b\x0c\r" for c in raw) / size,
        "digits": sum(48 <= c < 58 for c in raw) / size,
        "distinct": len(set(w)) / n,
        "top_word": max([w.count(x) for x in set(w)], default=0) / n,
        "stutter": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
        "repeated_lines": 1 - max(1, len(set(lines))) / max(1, len(lines)),
        "repeated_grams": 1 - len(set(grams)) / len(grams) if grams else 0.0,
        "letters": (letters := sum(chr(c).isalpha() and c < 128 or c >= 128 for c in raw)) / size,
        "upper": sum(65 <= c <= 90 for c in raw) / max(1, letters),
        "symbols": sum(c in b"#$%&*+<=>@[]^_`{}~\\/" for c in raw) / size,
        "stops": sum(c in b".,;:?" for c in raw) / size,
        "shouts": raw.count(b"!") / size,
        "bars": raw.count(b"|") / size,
        "line_length": np.log1p(len(raw) / max(1, len(lines))),
        "symbol_ends": sum(x[-1] in b"!#$%&*+<=>@[]^_`{}~\\/" for x in w) / n,
    }


def test_features_match_plain_code():
    rng = random.Random(1)
    texts = ["", " \n ", "a a a a a a", "É 12 !!\n\n|x|"] + [" ".join(rng.choice(["a", "bb", "C1", "dé\n"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    got = gam.features([t.encode() for t in texts])
    assert got.shape == (len(texts), len(gam.FEATURES))
    for row, text in zip(got, texts, strict=True):
        for name, value in plain(text).items():
            assert row[gam.FEATURES.index(name)] == pytest.approx(value), (name, text)
    assert set(plain("")) == set(gam.FEATURES)


def plain_score(model, row):
    z = model.intercept
    for cuts, table, v in zip(model.cuts, model.tables, row, strict=True):
        z += table[sum(v >= c for c in cuts)]
    for i, j, a, b, grid in model.pairs:
        z += grid[sum(row[i] >= c for c in a)][sum(row[j] >= c for c in b)]
    return 1 / (1 + np.exp(-min(max(z, -30), 30)))


def test_scores_are_sums_of_looked_up_values():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (800, len(gam.FEATURES))) / 7
    y = (x[:, 1] + x[:, 4] * x[:, 5] + rng.normal(size=800) > 4).astype(float)
    model = gam.fit(x, y, rounds=12, pair_rounds=6)
    assert any(len(t) > 1 for t in model.tables) and model.pairs
    other = np.concatenate([x[:100], rng.normal(size=(50, len(gam.FEATURES))) * 9])
    assert np.allclose(model.score(other), [plain_score(model, row) for row in other])


def plain_leaf_values(g, h, leaves, ridge):
    """The best tree over ordered bins by trying every cut, one at a time."""
    parts = [list(range(len(g)))]
    value = lambda p: sum(g[i] for i in p) ** 2 / (sum(h[i] for i in p) + ridge)
    while len(parts) < leaves:
        cuts = [(value(p[:k]) + value(p[k:]) - value(p), n, k) for n, p in enumerate(parts) for k in range(1, len(p))]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, n, k = max(cuts, key=lambda c: (c[0], parts[c[1]][c[2]]))
        parts[n : n + 1] = [parts[n][:k], parts[n][k:]]
    return [sum(g[i] for i in p) / (sum(h[i] for i in p) + ridge) for p in parts for _ in p]


def test_trees_equal_plain_search():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 9, 20):
        g, h = rng.normal(size=n), rng.random(n) + 0.1
        assert np.allclose(gam._tree(g, h, 4, 2.0), plain_leaf_values(g, h, 4, 2.0))


def test_a_hot_labelled_row_is_drawn_once(spark):
    docs = spark.createDataFrame([(1, "hot text " * 3)] * 300 + [(k, f"text {k} " * (k % 7 + 1)) for k in range(2, 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 200)], "doc_id long, quality int")
    got = gam.score(docs, labels, F.lit(True), sample=50).collect()
    assert len(got) == 498 and len({r.score for r in got if r.doc_id == 1}) == 1


def test_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((6000, len(gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    without, with_ = (gam.fit(x[:4000], y[:4000], rounds=20, n_pairs=k) for k in (0, 3))
    right = lambda m: ((m.score(x[4000:]) > 0.5) == y[4000:]).mean()
    assert right(without) < 0.65 and right(with_) > 0.95
    assert {2, 7} == set(with_.pairs[0][:2])


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op5_quality_gam(spark, SMALL).collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(got[r.doc_id], r.quality) for r in labels if r.quality is not None and got[r.doc_id].held_out]
    assert np.mean([p.predicted == y for p, y in held]) > 0.9


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "a b", 2.0), (2, "x " * 90_000, 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (1, 1), (2, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    got = gam.score(docs, labels, F.col("doc_id") > 0).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in gam.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}
    assert gam.score(docs.limit(0), labels, F.lit(True)).collect() == []
