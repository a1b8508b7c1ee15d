import functools
import random

import numpy as np
import xxhash

from keyloom.llm import simhash_dedup as sd
from keyloom.llm._words import stretches


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    prints = [plain(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)}
    return [(r[0], f"{p:016x}", least[g], g) for r, p, g in zip(rows, prints, group, strict=True)]


def corpus():
    rng = random.Random(5)
    rows = [(None, None), (90, ""), (91, " \n"), (92, "ONE Two"), (93, "one two"), (94, "É é É"), (95, "x " * 700)]
    for i in range(60):
        words = [rng.choice(["alpha", "Beta", "gamma", "delta", "ö"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 250))]
        rows.append((100 - i, " ".join(words)))
        for k in range(rng.choice([0, 0, 1, 4])):
            words[rng.randrange(len(words))] = "changed"
            rows.append((1000 + 10 * i + k, "\t".join(words)))
    return rows + [rows[8], rows[8], (95, "other text, same id"), (None, rows[9][1])]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "n", "s") for i, t in rows], "doc_id long, text string, fp int, root string, component_id string").repartition(3)


def test_matches_brute_force(spark):
    rows = corpus()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in sd.near_duplicates(frame(spark, rows), shard=8).collect()]
    assert sorted(got, key=str) == sorted((x[:3] for x in brute(rows)), key=str)


def test_keeps_one_row_of_each_component(spark, monkeypatch):
    rows = corpus()
    least = {g: x for *_, x, g in brute(rows)}
    for sent in (sd.SENT, 0):
        monkeypatch.setattr(sd, "SENT", sent)
        kept = sd.keep_one(frame(spark, rows))
        assert kept.columns == ["doc_id", "text", "fp", "root", "component_id"]
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(least.values(), key=str)


def test_fingerprint_of_a_long_text_is_made_in_stretches(monkeypatch):
    texts = ["One two  three\nFOUR five " * 40, "one", "", "x " * 50, "a b", "long" * 30 + " b c d"]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(sd, "stretches", functools.partial(stretches, size=size))
        for t in texts:
            assert sd.fingerprint(t.encode()) % 2**64 == plain(t)


def test_empty_table(spark):
    assert sd.near_duplicates(frame(spark, [])).collect() == [] and sd.keep_one(frame(spark, [])).collect() == []


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (400, 3)).astype(np.uint64)
    values = np.unique(np.concatenate([base, base ^ np.bitwise_xor.reduce(flips, axis=1), base ^ flips[:, 0]]))
    near = {(a, b) for a in range(len(values)) for b in range(a) if int(values[a] ^ values[b]).bit_count() <= 3}
    halves = [(sd.Tree(x, 16, 7), x) for x in (values >> np.uint64(32), values & sd.HALF)]
    met = set()
    for tree, x in halves:
        for _, home, guests in tree.route(x, 1):
            every = [*home.tolist(), *guests.tolist()]
            met |= {(max(a, b), min(a, b)) for a in home.tolist() for b in every}
    assert near <= met
    label = sd.forest(values, np.ones(len(values), bool), 3)
    assert all(label[a] == label[b] for a, b in near)


def test_components_of_a_long_path_and_a_star(spark):
    from keyloom.llm._components import components

    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 40)] + [(7, 7)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(500 + i, 500) for i in range(1, 40)}
