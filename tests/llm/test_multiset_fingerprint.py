import hashlib
import random

import numpy as np

from keyloom.llm import _words as mf_words
from keyloom.llm import multiset_fingerprint as mf


def corpus():
    rng = random.Random(6)
    rows = [(None, None), (None, "null id"), (4, ""), (5, None), (9, "a b c"), (9, "another under one id"), (9, "a b c"), (2, "é日本𝒳" * 5), (3, "\n\n \n")]
    for i in range(10, 200):
        lines = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        rows.append((i * 7 % 1009, "\n".join(lines)))
    return rows


def test_query_matches_brute_force(spark):
    rows = corpus()
    got = mf.compare_neighbours(spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, key int, bucket string").repartition(3)).collect()
    order = sorted(((i is not None, i or 0, (t or "").encode()) for i, t in rows))
    want = []
    for k, (known, i, raw) in enumerate(order):
        text, following = raw.decode(), order[(k + 1) % len(order)][2].decode()
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = (mf.vectors([x.encode()]) for x in (text, edited, following))
        want.append((i if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), a[0].tobytes().hex(), b[0].tobytes().hex(), round(float(mf.likeness(a, b)[0]), 9), round(float(mf.likeness(a, c)[0]), 9)))
    assert sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, got)), key=str) == sorted(want, key=str)


def plain_mix(h):
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB % 2**64
    return h ^ (h >> 31)


def plain(text):
    """Strong and like lanes, one paragraph and one shingle at a time."""
    base, other = mf_words.BASES
    value = [int(v) for v in mf_words.BYTE_VALUES]
    strong, like = [0] * mf.STRONG, [0] * mf.LIKE
    for line in text.encode().split(b"\n"):
        if not line:
            continue
        digest = hashlib.blake2b(line).digest()
        strong = [(a + int.from_bytes(digest[4 * k : 4 * k + 4], "little")) % 2**32 for k, a in enumerate(strong)]
        words = [plain_mix((sum(value[c] * pow(base, i, 2**64) for i, c in enumerate(w)) + len(w) * other) % 2**64) for w in line.split()]
        size = min(mf.SHINGLE, len(words))
        for at in range(len(words) - size + 1) if size else ():
            h = plain_mix(sum(x * pow(base, i, 2**64) for i, x in enumerate(words[at : at + size])) % 2**64)
            like[(h >> 40) % mf.LIKE] += 1 if h & 1 else -1
    return strong, like


def plain_likeness(a, b):
    if a == b:
        return 1.0
    whole = sum(x * x for x in a[1] + b[1])
    return max(0.0, 1 - sum((x - y) ** 2 for x, y in zip(a[1], b[1], strict=True)) / whole) if whole else 0.0


def test_vectors_and_likeness_equal_plain_code():
    texts = [t or "" for _, t in corpus()[:60]] + ["one two\none two\n three four five six seven", "a\n\nb"]
    own = mf.vectors([t.encode() for t in texts])
    want = [plain(t) for t in texts]
    for v, (strong, like) in zip(own, want, strict=True):
        assert v.tolist() == strong + [x % 2**32 for x in like]
    near = mf.likeness(own, np.roll(own, 1, axis=0))
    assert np.allclose(near, [plain_likeness(a, b) for a, b in zip(want, want[-1:] + want[:-1], strict=True)])


def test_a_line_repeated_often():
    a, b = (mf.vectors([b"one and the same line of words\n" * n]) for n in (40_000, 20_000))
    assert abs(float(mf.likeness(a, b)[0]) - 0.8) < 1e-9


def test_homomorphic():
    lines = [b"one two three four five six seven", b"eight", b"one two three four five six seven", b"nine ten"]
    whole = mf.vectors([b"\n".join(lines)])[0]
    assert (whole == mf.vectors([b"\n".join(lines[::-1])])[0]).all()
    step = np.zeros(mf.LANES, np.uint32)
    for line in lines:
        step = mf.insert(step, line)
    assert (step == whole).all()
    for line in lines:
        step = mf.delete(step, line)
    assert not step.any()
    assert (whole != mf.vectors([b"\n".join(lines[:3])])[0]).any()


def test_likeness_follows_the_shared_part():
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    for share in (0.0, 0.3, 0.5, 0.8, 1.0):
        found = []
        for _ in range(40):
            a, b = text(600), text(600)
            k = int(len(a) * share)
            found.append(float(mf.likeness(mf.vectors([a.encode()]), mf.vectors([(a[:k] + b[k:]).encode()]))[0]))
        assert abs(np.mean(found) - share) < 0.07
    assert mf.likeness(mf.vectors([b""]), mf.vectors([b"\n"]))[0] == 1.0 and mf.likeness(mf.vectors([b""]), mf.vectors([b"x"]))[0] == 0.0


def test_small_tables(spark):
    assert mf.compare_neighbours(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    (r,) = mf.compare_neighbours(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
