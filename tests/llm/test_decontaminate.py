import math
import random
import re
from collections import Counter

import numpy as np

from keyloom.llm import decontaminate as dc


def words(text):
    return re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", text or "").encode().split()


def brute(rows, items, threshold=0.5, overlap=0.8):
    split = [(i, words(t)) for i, t in items]
    n, mean = len(split), max(1.0, sum(len(w) for _, w in split) / max(1, len(split)))
    df = Counter(x for _, w in split for x in set(w))

    def shares(w):
        tf = Counter(w)
        c = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, f in tf.items()}
        return {x: v / sum(c.values()) for x, v in c.items()}

    def covered(part, text):
        k = min(5, len(part))
        if not k:
            return 1.0
        have = {tuple(text[i : i + k]) for i in range(len(text) - k + 1)}
        own = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
        return len(own & have) / len(own)

    step = max([32] + [len(w) for _, w in split])
    out = []
    for doc_id, text in rows:
        w = words(text)
        for item_id, own in split:
            c, best = shares(own), None
            for at in range(0, max(1, len(w) - step), step):
                part = w[at : at + 2 * step]
                score = sum(v for x, v in c.items() if x in set(part))
                cut = len(own) - len(own) // 3
                q, a = covered(own[:cut], part), covered(own[cut:], part)
                if own and score >= threshold and q >= overlap and a >= overlap:
                    best = max(best or (0.0,), (round(score, 4), round(q, 6), round(a, 6)))
            if best:
                out.append((doc_id, item_id, *best))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    common, rare = ["the", "of", "And", "is", "été"], [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n))
    items = [(i, text(rng.randint(8, 45)) + ".") for i in range(150)] + [(900, items_two := "short item"), (901, items_two), (902, ""), (903, None)]
    rows = [(None, items[3][1]), (1, None), (2, ""), (3, "Short, ITEM!"), (4, "a short item b")]
    for i in range(10, 70):
        body = text(rng.randint(1, 300)).split()
        if i % 2:
            own = items[rng.randrange(150)][1].split()
            if i % 3 == 0:
                own = own[: len(own) // 2]
            if i % 5 == 0:
                own[len(own) // 2] = "other"
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        rows.append((i, " ".join(body).upper() if i % 7 == 0 else "\n".join(body)))
    return rows + [rows[-1], rows[-1], (70, text(5000) + " " + items[5][1])], items


def frames(spark, rows, items):
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t in rows], "doc_id long, text string, item_id int, score string").repartition(3)
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")


def found(frame):
    return sorted(((r.doc_id, r.item_id, round(r.score, 4), round(r.question_overlap, 6), round(r.answer_overlap, 6)) for r in frame.collect()), key=str)


def test_matches_brute_force(spark):
    rows, items = corpus()
    want = brute(rows, items)
    assert len(want) > 15
    docs, bench = frames(spark, rows, items)
    assert found(dc.contaminated(docs, bench)) == want
    dirty = {x[0] for x in want}
    assert sorted(str(r.doc_id) for r in dc.clean(docs, bench).collect()) == sorted(str(i) for i, _ in rows if i not in dirty)


def test_rows_and_scores_do_not_depend_on_the_parts(spark):
    rows, items = corpus()
    docs, bench = frames(spark, rows, items + [items[3]] * 60)
    exact = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    want = exact(dc.contaminated(docs, bench, whole=True))
    assert len(want) > 15
    for part_bytes in (20_000, 3_000, 400):
        assert exact(dc.contaminated(docs, bench, part_bytes=part_bytes, whole=True)) == want


def test_search_finds_all_above_the_threshold(monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(f"t{min(int(rng.expovariate(0.08)), 90)}" for _ in range(rng.randint(3, 20))).encode(), b"") for i in range(700)]
    index = dc.Index(items)
    n, mean = len(items), sum(len(t.split()) for _, t, _ in items) / len(items)
    number = {int(h): k for k, h in enumerate(index.terms)}
    vocabulary = sorted({w for _, t, _ in items for w in t.split()})
    of = {w: number[int(h)] for w, h in zip(vocabulary, dc.Words(vocabulary).hashes(), strict=True)}
    df = Counter(of[w] for _, t, _ in items for w in set(t.split()))
    shares = {}
    for i, t, _ in items:
        tf = Counter(of[w] for w in t.split())
        c = {x: math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(t.split()) / mean)) for x, f in tf.items()}
        shares[i] = {x: v / sum(c.values()) for x, v in c.items()}
    queries = [sorted(rng.sample(range(len(index.terms)), 25)) for _ in range(60)]
    pairs = np.array([(3 * i, t) for i, terms in enumerate(queries) for t in terms])
    for at_once, table in ((1 << 18, index.table), (300, None)):
        monkeypatch.setattr(dc, "AT_ONCE", at_once)
        index.table = table
        for threshold in (0.2, 0.5, 0.8):
            want = {(3 * q, i, round(s, 9)) for q, terms in enumerate(queries) for i in shares if (s := sum(shares[i].get(t, 0.0) for t in terms)) >= threshold}
            assert {(p, index.ids[i], round(s, 9)) for p, i, s in index.search(pairs[:, 0], pairs[:, 1], threshold)} == want


def test_passages_are_the_same_however_many_are_searched_at_once(monkeypatch):
    rows, items = corpus()
    index = dc.Index([(i, (t or "").encode(), b"") for i, t in items])
    texts = [(t or "").encode() for _, t in rows]
    want = list(dc.hits(index, texts, 0.5, 0.8, True))
    monkeypatch.setattr(dc, "AT_ONCE", 100)
    assert want and list(dc.hits(index, texts, 0.5, 0.8, True)) == want


def test_empty_tables(spark):
    rows, items = corpus()
    assert dc.contaminated(*frames(spark, [], items)).collect() == []
    assert dc.contaminated(*frames(spark, rows[:8], [])).collect() == []


def test_question_and_answer_columns(spark):
    docs = spark.createDataFrame([(1, "what is the capital of france and why it is paris of course dear friend"), (2, "what is the capital of france and why")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is the capital of France?", "It is Paris, of course")], "item_id long, question string, answer string")
    assert [(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()] == [(1, 7)]
