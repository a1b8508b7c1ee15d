import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import language_crf as crf
from keyloom.llm import queries

SMALL = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    n, lengths = 3, [1, 4, 2]
    emissions, t = rng.normal(size=(sum(lengths), n)), rng.normal(size=(n, n))
    first = np.concatenate([[0], np.cumsum(lengths)])
    index = np.minimum(first[:-1, None] + np.arange(4), sum(lengths) - 1)
    filled = np.arange(4) < np.array(lengths)[:, None]
    post, pairs = crf.forward_backward(emissions, index, filled, t)
    want_pairs = np.zeros((n, n))
    for c, size in enumerate(lengths):
        e, total, want = emissions[first[c] : first[c + 1]], 0.0, np.zeros((size, n))
        paths = []
        for path in itertools.product(range(n), repeat=size):
            p = np.exp(sum(e[k, s] for k, s in enumerate(path)) + sum(t[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            paths.append((path, p))
        for path, p in paths:
            for k, s in enumerate(path):
                want[k, s] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want_pairs[a, b] += p / total
        assert np.allclose(post[c, :size], want) and not post[c, size:].any()
    assert np.allclose(pairs, want_pairs)


def sample():
    en = "the house is on the hill and the weather was with them this morning"
    de = "das haus steht auf dem hügel und das wetter war heute nicht schlecht"
    return [("en", " ".join(np.random.default_rng(k).permutation(en.split())).encode()) for k in range(40)] + [("de", " ".join(np.random.default_rng(k).permutation(de.split())).encode()) for k in range(40)]


def test_words_of_code_switched_text():
    model = crf.fit(sample(), chains=800, steps=24, epochs=3)
    text = b"the weather was on the hill das wetter steht auf dem haus und the house is with them"
    w = crf.Words([text], crf.FOLD)
    post = model.posteriors(model.emissions(w), np.arange(w.n)[None], np.ones((1, w.n), bool))[0]
    assert [model.languages[k] for k in post.argmax(axis=1)] == ["en"] * 6 + ["de"] * 7 + ["en"] * 5
    assert (np.diag(model.transitions) > model.transitions.mean()).all()  # it stays more often than it switches
    names, score, known = model.predict([b"", b" 12 !! \n", "日".encode(), b"THE HOUSE", b"the " * 50_000, "½²".encode()])
    assert names[:2] == ["und", "und"] and names[3:] == ["en", "en", "und"] and score[0] == score[5] == 0 and names[2] in ("de", "en")
    assert known[3] == 1 and known[0] == known[2] == 0


def test_a_long_document_is_one_chain(monkeypatch):
    model = crf.fit(sample(), chains=300, steps=24, epochs=2)
    rng = np.random.default_rng(4)
    pool = b" ".join(t for _, t in sample()).split() + [b"word", b"stra\xc3\x9fe", b"z" * 30]
    texts = [b" ".join(pool[i] for i in rng.integers(len(pool), size=n)) for n in (200, 1, 0, 64, 65, 130, 449, 3, 64 * 3)]
    w = crf.Words(texts, crf.FOLD)
    emission = model.emissions(w)
    lone = np.stack([model.weights[crf._hashed(code[word == k], 0)].sum(axis=0) for code, word in [crf.trigrams(w, 0, len(w.bytes) - 1)] for k in range(w.n)])
    lone += sum(model.weights[crf.word_features(w)[:, k]] for k in range(3))
    assert np.allclose(emission, lone, atol=1e-4)
    want = np.zeros((len(texts), 2))
    for d, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
        if b > a:  # one unbroken chain
            want[d] = crf.forward_backward(emission, np.arange(a, b)[None], np.ones((1, b - a), bool), model.transitions)[0].sum(axis=(0, 1))
    for chain, some, blocks in ((64, 1 << 18, 1 << 11), (7, 50, 3), (1, 11, 2)):
        for name, value in (("CHAIN", chain), ("BYTES", some), ("BLOCKS", blocks)):
            monkeypatch.setattr(crf, name, value)
        known = np.zeros((len(texts), 2), np.int64)
        assert np.allclose(model.emissions(w, known), emission, atol=1e-4)
        assert np.allclose(crf.chain_sums(emission, w.first, model.transitions), want, atol=1e-7)
        assert known[:, 1].tolist() == [sum(len(x) for x in t.translate(crf.FOLD).split()) for t in texts]
        assert (known[:, 0] <= known[:, 1]).all() and known[3, 0] > 0


def plain_features(word):
    """Feature numbers of a word: trigrams with its ends, first bytes, last bytes, the word."""
    hashed = lambda code, k: ((code + k) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - crf.TABLES[k]) + int(crf.OFFSETS[k])
    joined = b" " + word + b" "
    out = [hashed(joined[i] << 16 | joined[i + 1] << 8 | joined[i + 2], 0) for i in range(len(word))]
    head, tail = word[:3].ljust(3), word[::-1][:3].ljust(3)
    return out + [hashed(h[0] << 16 | h[1] << 8 | h[2], k) for k, h in ((1, head), (2, tail))]


def test_word_features_equal_plain_code():
    text = "The a of Straße 12 x-y été 日本語 zzzzzzzzzz".encode()
    w = crf.Words([text, b"", text[:7]], crf.FOLD)
    words = w.buffer.split()
    code, word = crf.trigrams(w, 0, len(w.bytes) - 1)
    own = crf._hashed(code, 0)
    more = crf.word_features(w)
    for k, x in enumerate(words):
        assert own[word == k].tolist() + more[k, :2].tolist() == plain_features(x)
    same = [[j for j, y in enumerate(words) if y == x] for x in words]
    assert [np.flatnonzero(more[:, 2] == h).tolist() for h in more[:, 2]] == same


def test_a_change_far_away_reaches_over_blocks():
    # only the transitions join the words: the last word's evidence must reach the first
    emission = np.zeros((300, 2))
    emission[-1] = (9.0, 0.0)
    first, t = np.array([0, 300]), np.array([[6.0, 0.0], [0.0, 6.0]])
    whole = crf.chain_sums(emission, first, t)[0]
    parts = crf.chain_sums(emission, np.array([0, 64, 128, 192, 256, 300]), t).sum(axis=0)
    assert whole[0] > 225 and parts[0] < 225


def test_foreign_text_is_not_known(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = crf.train(docs, F.lit(True))
    foreign = ["Η γρήγορη αλεπού πηδά πάνω από το σκυλί κάθε πρωί", "快速的棕色狐狸跳过懒狗然后回家睡觉", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "Быстрая лиса прыгает через собаку", "xqzv kwjp zzqk vxwq pkjz qqxw"]
    rows = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in crf.accepted(docs.union(rows), model, least=0.3, known=0.8).collect()}
    assert not any(-1 - i in kept for i in range(len(foreign)))
    assert len(kept) > 0.97 * docs.count()


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op6_language_crf(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[d.doc_id].lang_pred, d.lang) for d in docs if got[d.doc_id].held_out and d.lang]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_awkward_rows(spark):
    rows = [(None, "the house", "en", 1), (1, None, None, 2), (2, "", "de", 3), (2, "das haus", "de", 3), (2, "das haus", "de", 3), (4, "the house " * 9, "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = crf.train(docs, F.lit(True), chains=50)
    got = sorted((str(r.doc_id), r.lang_pred) for r in crf.predict(docs, model).collect())
    assert got == sorted([("None", "en"), ("1", "und"), ("2", "und"), ("2", "de"), ("2", "de"), ("4", "en")])
    kept = crf.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    nothing = crf.train(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in crf.predict(docs, nothing).collect()} == {"und"}
    assert crf.predict(docs.limit(0), model).collect() == []


def test_copies_are_learned_from_once(spark):
    hot = [(k, "the house is on the hill", "en") for k in range(3000)]
    rest = [(5000 + k, f"das haus {'abcdefghij'[k % 10]}{'klmnop'[k % 6]} steht auf dem berg", "de") for k in range(60)]
    docs = spark.createDataFrame(hot + rest, "doc_id long, text string, lang string")
    seen = []
    fit = crf.fit
    crf.fit = lambda segments, **params: seen.extend(segments) or fit(segments, **params)
    try:
        crf.train(docs, F.lit(True), chains=20)
    finally:
        crf.fit = fit
    assert sum(lang == "en" for lang, _ in seen) == 1 and sum(lang == "de" for lang, _ in seen) == 30
