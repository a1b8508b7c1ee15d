import random
from collections import Counter

from keyloom.llm.substring_dedup import windows_removed

SCHEMA = "doc_id long, text string, n_words string, key int"


def brute(rows, width):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out.append((doc_id, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def run(spark, rows, **params):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(3)
    return [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in windows_removed(frame, **params).collect()]


def order(rows):
    return sorted(rows, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "日本", "a b"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    shared = some(90)
    rows = [(None, None), (1, ""), (2, " \t "), (3, "one two"), (7, "same id " * 30), (7, "other text under the same id")]
    for i in range(10, 60):
        text = some(rng.randint(1, 150))
        if i % 3 == 0:
            at = rng.randint(0, 40)
            text[5:5] = shared[at : at + rng.randint(20, 50)]
        if i % 5 == 0:
            text = ["he"] * rng.randint(30, 80) + text
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    return rows + [rows[20], rows[20], (None, rows[21][1])]


def test_matches_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert order(run(spark, rows)) == order(brute(rows, 35))
    rows = corpus(9)
    assert order(run(spark, rows, width=12, gram=5, depth=3, cell_bits=6)) == order(brute(rows, 12))


def test_empty_table(spark):
    assert run(spark, []) == []
