import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from test_simhash_dedup import plain

import corpus_pipeline
from keyloom.llm import near_copies as nc


def sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def corpus():
    rng = random.Random(8)
    word = lambda: f"{rng.choice(['Alpha', 'beta', 'ö'])}{rng.randint(0, 400)}"
    rows = [(None, None), (1, ""), (2, " \n"), (3, "one TWO three"), (4, "One two  three"), (5, "one two four")]
    line = " ".join(word() for _ in range(12))
    for i in range(40):
        words = [word() for _ in range(rng.randint(6, 150))]
        text = " ".join(words)
        rows.append((100 + i, text if i % 3 else f"{line} {text}"))
        for k in range(rng.choice([0, 1, 3])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = [word()]
            rows.append((1000 + 10 * i + k, "\t".join(words)))
    return rows + [rows[9], (7, rows[9][1]), (None, rows[12][1])]


def first_of_groups(rows):
    own, prints = [sets(t) for _, t in rows], [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(own[i] & own[j])
            like = common and common >= 0.8 * len(own[i] | own[j]) - 1e-9
            if (like or (prints[i] ^ prints[j]).bit_count() <= 3) and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    return sorted((min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)), key=str)


def test_stage_joins_all_copies_that_are_similar(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, unit int, root int").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == first_of_groups(rows)


def plain_classes(units, linked):
    label = {u: u for u in units}
    for a, b in linked:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = {u: new if g == old else g for u, g in label.items()}
    return label


def alike(x, y):
    common = len(x & y)
    return common > 0 and common >= 0.8 * len(x | y) - 1e-9


def edited(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 12)}"
    return " ".join(words)


def test_classes_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(21)
    rows = corpus()
    for family in range(3):  # originals with many copies of one to three edits, some families sharing a long passage
        base = ("the same passage is here in all of them and it is long " * 3).split() if family < 2 else []
        base = base + [f"f{family}w{i}" for i in range(50)]
        rows += [(5000 + 100 * family + k, edited(base, rng.choice([0, 1, 1, 2, 2, 3]), rng)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = {r.unit: sets(r.text) for r in docs.select(nc.unit().alias("unit"), "text").collect()}
    near = [(a, b) for a in units for b in units if a < b and alike(units[a], units[b])]
    assert len(near) > 300
    lone = spark.createDataFrame([(u, u) for u in units], "unit long, root long")
    first = plain_classes(units, near[:40])
    known = spark.createDataFrame(list(first.items()), "unit long, root long")
    want = plain_classes(units, near)
    assert len(set(want.values())) > 60
    for roots, sample, dense in ((lone, 32, 256), (known, 1, 16)):
        monkeypatch.setattr(nc, "SAMPLE", sample)
        monkeypatch.setattr(nc, "DENSE", dense)
        assert {r.unit: r.root for r in nc.classes(docs, roots, 0.8).collect()} == want


def test_work_grows_with_a_family_not_with_its_pairs(spark, monkeypatch):
    rng = random.Random(4)
    bases = [[f"g{g}w{i}" for i in range(90)] for g in range(2)]
    rows = [(k, edited(bases[k % 2], rng.choice([1, 2, 3, 4, 5, 6, 8]), rng)) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    units = {r.unit: sets(r.text) for r in docs.select(nc.unit().alias("unit"), "text").collect()}
    want = plain_classes(units, [(a, b) for a in units for b in units if a < b and alike(units[a], units[b])])
    assert 60 < len(set(want.values())) < 280
    written, durable = [], nc.durable
    monkeypatch.setattr(nc, "durable", lambda df: written.append(out := durable(df)) or out)
    monkeypatch.setattr(nc, "DENSE", 8)
    monkeypatch.setattr(nc, "BLOCK", 20, raising=False)
    lone = spark.createDataFrame([(u, u) for u in units], "unit long, root long")
    assert {r.unit: r.root for r in nc.classes(docs, lone, 0.8).collect()} == want
    prefixes = sum(nc.prefix(len(x), 0.8) for x in units.values())
    assert sum(df.count() for df in written) < 6 * prefixes


def test_bitmaps_find_all_pairs_of_classes():
    rng = random.Random(5)
    own = [np.unique(rng.choices(range(1 << 60), k=n)) for n in (1, 2, 30, 31, 33, 60, 66, 127, 128, 130, 1030, 9000)]
    for x in own[2:] * 3:
        keep = x[rng.randint(0, max(1, len(x) // 9)) :]
        own.append(np.unique(np.concatenate([keep, rng.choices(range(1 << 60), k=rng.randint(0, len(x) // 9))])).astype(np.int64))
    own = [x.astype(np.int64) for x in own]
    n, root, late = [len(x) for x in own], [k % 7 for k in range(len(own))], [k % 7 > 0 for k in range(len(own))]
    rows = [(k, False) for k in range(len(own))] + [(k, True) for k in range(len(own)) if late[k]]
    block = pa.table({"unit": [k for k, _ in rows], "n": [n[k] for k, _ in rows], "root": [root[k] for k, _ in rows], "late": [m for _, m in rows], "bits": [nc.parity(own[k], nc._widths(n[k])) for k, _ in rows]})
    want = {(i, j) for j in range(len(own)) for i in range(j) if root[i] != root[j] and alike(set(own[i].tolist()), set(own[j].tolist()))}
    found = nc._compare(0.8, True, block)
    assert len(want) > 40 and want <= set(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
    one = nc._compare(0.8, False, block)
    assert {x for pair in want for x in pair if late[x]} <= {x for c in ("a", "b") for x in one[c].to_pylist()}


def test_differences_of_similar_sets_meet():
    rng = random.Random(6)
    met = 0
    for _ in range(4000):
        size = rng.randint(4, 60)
        hub = set(range(size))
        x, y = (set(hub) for _ in range(2))
        shared = set(rng.sample(range(100, 140), rng.randint(0, size // 2)))
        gone = set(rng.sample(range(size), rng.randint(0, size // 3)))
        for own in (x, y):
            if rng.random() < 0.8:
                own |= shared
                own -= gone
            own |= set(rng.sample(range(200, 260), rng.choice([0, 0, 1, 3])))
            own -= set(rng.sample(range(size), rng.choice([0, 0, 1, 2])))
        if x and y and alike(x, y) and not (alike(x, hub) and alike(y, hub)):
            array = lambda v: np.array(sorted(v), np.int64)
            (a, i), (b, j) = (nc.difference(array(v), array(hub), alike(v, hub), 0.8) for v in (x, y))
            assert set(a.tolist()) == x ^ hub and set(b.tolist()) == y ^ hub
            assert set(a[:i].tolist()) & set(b[:j].tolist()) or not x ^ hub or not y ^ hub
            met += 1
    assert met > 200


def test_prefixes_of_similar_sets_meet():
    for n in range(1, 400):
        need = next(k for k in range(n + 1) if 5 * k >= 4 * n)
        assert nc.prefix(n, 0.8) == n - need + 1


def test_sieve_loses_no_pair():
    rng = random.Random(3)
    texts = [t.encode() for _, t in corpus() if t] + [" ".join(str(rng.randint(0, 50)) for _ in range(n)).encode() for n in (64, 70, 129, 130)]
    own = list(nc.shingles(texts))
    ids = pa.array(range(len(texts)), pa.int64())
    none = SimpleNamespace(value=(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    (maps,) = nc._prints(none, 0.8, [pa.RecordBatch.from_arrays([ids, pa.array(texts)], ["unit", "text"])])
    bits = maps.column("bits").to_pylist()
    for x, a in zip(own, bits, strict=True):
        for y, b in zip(own, bits, strict=True):
            assert nc.apart(a, b) <= len(set(x.tolist()) ^ set(y.tolist()))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nc.classes(docs, spark.createDataFrame([], "unit long, root long"), 0.8).count() == 0
