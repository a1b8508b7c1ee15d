"""Language ID for code-switched text: a linear-chain conditional random field over words.

A word's emission sums weights of hashed features: byte trigrams with the word's ends (which include short
affixes), its first and last three bytes with the end, and the word itself (a lexicon). Transitions between
the languages of neighbouring words are learned with them. Forward-backward gives each word's posterior;
a document's share of a language is the mean over all of its words, its language the largest share, and its
score that share. Words are runs of letters (other ASCII characters cut them).

A document is one chain, whatever its length. Its words are dealt into blocks of ``CHAIN``; each block's product of
transitions and emissions carries the forward message to the next block and the backward message to the one before,
and within the blocks, now independent, all documents' messages run side by side. That is exact, as both messages
are linear.

The model also keeps which byte trigrams its training text had (a bitmap of two million bytes). The share of a
document's trigrams among them, ``known``, says whether its language can be one of those learned at all.

Training: about ``per_language`` rows of each language are drawn by a hash of id and text, of equal texts one, and up to
``segments`` runs of words from hashed places anywhere in each; only those are collected. Training chains are
spliced from segments of one to three languages, so transitions are learned from code-switched chains. The
fit is by minibatch AdaGrad on the exact gradient; all random choices are seeded. The weights (a few MB,
fixed by the table size and the number of languages) are broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing
to learn from; ties go to the first language in
alphabetical order; null doc_id and repeated rows are predicted like any other; other columns are ignored; an empty
table gives no rows. A text is held whole; beside it, words take about ten times its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._frames import pieces
from keyloom.llm._words import IS_SPACE, U64, Words

#: Words of a block; results don't depend on it.
CHAIN = 64
#: Bytes, and blocks, worked on at once.
BYTES, BLOCKS = 1 << 18, 1 << 11
#: A to Z to lower case; every other ASCII character that is no letter cuts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not 97 <= c <= 122 else c for c in range(256))
#: log2 of each feature table: trigrams, first bytes, last bytes, words.
TABLES = (16, 15, 15, 17)
OFFSETS = np.cumsum([0, *(1 << b for b in TABLES)])
FACTOR = U64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def _hashed(code: np.ndarray, table: int) -> np.ndarray:
    return ((code.astype(U64) + U64(table)) * FACTOR >> U64(64 - TABLES[table])).astype(np.int64) + OFFSETS[table]


def trigrams(w: Words, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte of a word in buffer[low:high]: the trigram around it, and the word's number."""
    # at least one byte on either side: the buffer begins and ends with a space
    b = w.bytes[max(low - 1, 0) : high + 1].astype(np.int64)
    space = IS_SPACE[b]
    at = np.flatnonzero(~space[1:-1]) + 1
    word = np.searchsorted(w.starts, max(low, 1)) - 1 + np.cumsum(space[:-2] & ~space[1:-1])[at - 1]
    return b[at - 1] << 16 | b[at] << 8 | b[at + 1], word


def word_features(w: Words) -> np.ndarray:
    """Three features of each word: its first bytes, its last bytes, itself."""
    s, e, b = w.starts, w.ends, w.bytes
    byte = lambda at, some: np.where(some, b[np.clip(at, 0, len(b) - 1)], 32).astype(np.int64)
    long = [e - s > k for k in range(3)]
    head = byte(s, long[0]) << 16 | byte(s + 1, long[1]) << 8 | byte(s + 2, long[2])
    tail = byte(e - 1, long[0]) << 16 | byte(e - 2, long[1]) << 8 | byte(e - 3, long[2])
    lexicon = (w.hashes() >> U64(64 - TABLES[3])).astype(np.int64) + OFFSETS[3]
    return np.stack([_hashed(head, 1), _hashed(tail, 2), lexicon], axis=1)


class Crf:
    """seen: which byte trigrams the training text had, eight to a byte."""

    def __init__(self, languages: list[str], weights: np.ndarray, transitions: np.ndarray, seen: np.ndarray | None = None):
        self.languages, self.weights, self.transitions = languages, weights, transitions
        self.seen = np.zeros(1 << 21, np.uint8) if seen is None else seen

    def emissions(self, w: Words, known: np.ndarray | None = None) -> np.ndarray:
        """Of each word and language; known: gets how many trigrams of each document are known, and how many it has."""
        out = np.zeros((w.n, len(self.languages)), np.float32)
        for low in range(0, len(w.bytes), BYTES):
            code, word = trigrams(w, low, min(low + BYTES, len(w.bytes) - 1))
            if not len(word):
                continue
            start = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[start]] += np.add.reduceat(self.weights[_hashed(code, 0)], start, axis=0)
            if known is not None:
                first = np.unique(np.searchsorted(word, w.first[:-1]))
                first = first[first < len(word)]
                doc = np.searchsorted(w.first, word[first], "right") - 1
                hit = (self.seen[code >> 3] >> (code & 7).astype(np.uint8)) & 1
                known[doc, 0] += np.add.reduceat(hit, first, dtype=np.int64)
                known[doc, 1] += np.diff(np.append(first, len(word)))
        for low in range(0, w.n, BYTES):
            part = _Part(w, low, min(low + BYTES, w.n))
            more = word_features(part)
            for k in range(more.shape[1]):
                out[low : low + BYTES] += self.weights[more[:, k]]
        return out

    def posteriors(self, emissions: np.ndarray, index: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """Exact marginals of chains: index (chains, steps) of words, filled where there is one."""
        return forward_backward(emissions, index, filled, self.transitions)[0]

    def shares(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean posterior of each language over each text's words, and the share of its trigrams that are known."""
        w = Words(texts, FOLD)
        known = np.zeros((len(texts), 2), np.int64)
        sums = chain_sums(self.emissions(w, known), w.first, self.transitions)
        return sums / np.maximum(np.diff(w.first), 1)[:, None], known[:, 0] / np.maximum(known[:, 1], 1)

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text its language, that language's share, and how much of it is known."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        shares, known = self.shares(texts)
        best = shares.argmax(axis=1)
        letters = np.array([_has_letter(t) for t in texts], bool)
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, np.clip(shares[np.arange(len(texts)), best], 0, 1), 0.0), known


class _Part:
    """Some of the words, for word_features."""

    def __init__(self, w: Words, low: int, high: int):
        self.base = int(w.starts[low])
        self.bytes = w.bytes[self.base : w.ends[high - 1]]
        self.starts, self.ends, self.n = w.starts[low:high] - self.base, w.ends[low:high] - self.base, high - low

    hashes = Words.hashes


_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text) or any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _scaled(emissions: np.ndarray, index: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """exp of the emissions by step, chain and language, the largest of a word 1; all 1 where nothing is filled."""
    e = emissions[index.T].astype(np.float64)
    e = np.exp(e - e.max(axis=2, keepdims=True))
    e[~filled.T] = 1
    return e


def _normed(a: np.ndarray) -> np.ndarray:
    return a / a.sum(axis=-1, keepdims=True)


def forward_backward(emissions: np.ndarray, index: np.ndarray, filled: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None, count: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals (chains, steps, languages), zero where nothing is filled, and expected transition counts.

    before: what the words before a chain say of its first word; after: what those after it say of its last; both 1 where there are none.
    """
    e, t = _scaled(emissions, index, filled), np.exp(transitions - transitions.max())
    steps, chains, n = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[0] = _normed(e[0] if before is None else e[0] * before)
    if after is not None:
        beta[-1] = after
    for k in range(1, steps):
        alpha[k] = _normed((alpha[k - 1] @ t) * e[k])
    for k in range(steps - 2, -1, -1):
        beta[k] = np.where(filled[:, k + 1 : k + 2], _normed((beta[k + 1] * e[k + 1]) @ t.T), 1.0)
    post = _normed(alpha * beta)
    post[~filled.T] = 0
    pairs = np.zeros((n, n)) if count else None
    for k in range(1, steps) if count else ():
        both = filled[:, k]
        if both.any():
            p = alpha[k - 1, both][:, :, None] * t * (beta[k, both] * e[k, both])[:, None, :]
            pairs += (p / p.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return post.transpose(1, 0, 2), pairs


def _transfer(e: np.ndarray, filled: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Of each chain the product of its emissions and the transitions between them, up to a factor."""
    product = np.eye(e.shape[2]) * e[0][:, None, :]
    for k in range(1, len(e)):
        longer = (product @ t) * e[k][:, None, :]
        product = np.where(filled[:, k, None, None], longer, product)
        product /= product.max(axis=(1, 2), keepdims=True)
    return product


def chain_sums(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Of each document (words first[d] .. first[d + 1] - 1, one chain) the sum of its words' posteriors."""
    n = emissions.shape[1]
    count = np.diff(first)
    blocks = -(-count // CHAIN)
    base = np.cumsum(blocks) - blocks
    out = np.zeros((len(count), n))
    if not blocks.sum():
        return out
    doc = np.repeat(np.arange(len(count)), blocks)
    start = first[doc] + CHAIN * (np.arange(len(doc)) - base[doc])
    size = np.minimum(CHAIN, first[doc + 1] - start)

    def dealt(some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        some = some[np.argsort(size[some], kind="stable")]
        for low in range(0, len(some), BLOCKS):
            mine = some[low : low + BLOCKS]
            at = np.arange(size[mine].max())
            yield mine, np.minimum(start[mine][:, None] + at, len(emissions) - 1), at < size[mine][:, None]

    t = np.exp(transitions - transitions.max())
    before, after = np.ones((len(doc), n)), np.ones((len(doc), n))
    if len(several := np.flatnonzero(blocks[doc] > 1)):
        product = np.zeros((len(several), n, n))
        for mine, index, filled in dealt(several):
            product[np.searchsorted(several, mine)] = _transfer(_scaled(emissions, index, filled), filled, t)
        long = np.flatnonzero(blocks > 1)
        long = long[np.argsort(-blocks[long], kind="stable")]
        place = np.searchsorted(several, base[long])
        active = np.searchsorted(-blocks[long], -np.arange(blocks.max() + 1), "left")  # documents of more blocks than that
        for j in range(1, blocks.max()):
            k = active[j]
            before[base[long[:k]] + j] = _normed(np.einsum("di,dij->dj", before[base[long[:k]] + j - 1], product[place[:k] + j - 1]) @ t)
        for j in range(blocks.max() - 2, -1, -1):
            k = active[j + 1]
            after[base[long[:k]] + j] = _normed(np.einsum("dij,dj->di", product[place[:k] + j + 1], after[base[long[:k]] + j + 1]) @ t.T)
    for mine, index, filled in dealt(np.arange(len(doc))):
        post, _ = forward_backward(emissions, index, filled, transitions, before[mine], after[mine], count=False)
        np.add.at(out, doc[mine], post.sum(axis=1))
    return out


def fit(segments: list[tuple[str, bytes]], chains: int = 6000, steps: int = 32, epochs: int = 3, batch: int = 256, rate: float = 0.2, decay: float = 1e-6, seed: int = 1) -> Crf:
    """segments: language and a run of words. Chains are spliced from them, languages drawn evenly."""
    languages = sorted({lang for lang, _ in segments})
    n = len(languages)
    if not n:
        return Crf([], np.zeros((0, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    pools = [[s.translate(FOLD).split() for lang, s in segments if lang == name] for name in languages]
    pools = [[p for p in pool if p] or [[b"?"]] for pool in pools]
    texts, truth = [], []
    for _ in range(chains):
        words, marks = [], []
        for _ in range(rng.integers(1, 4)):
            k = int(rng.integers(n))
            part = pools[k][rng.integers(len(pools[k]))][: steps - len(words)]
            words += part
            marks += [k] * len(part)
        texts.append(b" ".join(words))
        truth.append(marks)
    weights, transitions = np.zeros((int(OFFSETS[-1]), n)), np.zeros((n, n))
    seen_w, seen_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    seen = np.zeros(1 << 24, bool)
    every = Words([run for _, run in segments], FOLD)
    seen[trigrams(every, 0, len(every.bytes) - 1)[0]] = True
    for _ in range(epochs):
        order = rng.permutation(chains)
        for low in range(0, chains, batch):
            mine = order[low : low + batch]
            w = Words([texts[i] for i in mine])
            count = np.diff(w.first)
            index = w.first[:-1, None] + np.arange(count.max())
            filled = np.arange(count.max()) < count[:, None]
            code, word = trigrams(w, 0, len(w.bytes) - 1)
            features = np.concatenate([_hashed(code, 0), word_features(w).ravel()])
            owner = np.concatenate([word, np.repeat(np.arange(w.n), 3)])
            used, place = np.unique(features, return_inverse=True)
            emission = np.stack([np.bincount(owner, weights[features, k], minlength=w.n) for k in range(n)], axis=1)
            post, pairs = forward_backward(emission, np.minimum(index, w.n - 1), filled, transitions)
            marks = np.concatenate([truth[i] for i in mine])
            slope = -post[filled]  # in the order of the words
            slope[np.arange(len(marks)), marks] += 1
            doc = w.docs()
            real = np.zeros((n, n))
            np.add.at(real, (marks[:-1][doc[1:] == doc[:-1]], marks[1:][doc[1:] == doc[:-1]]), 1)
            step = np.stack([np.bincount(place, slope[owner, k], minlength=len(used)) for k in range(n)], axis=1) - decay * weights[used]
            seen_w[used] += step * step
            weights[used] += rate * step / np.sqrt(seen_w[used])
            seen_t += (real - pairs) ** 2
            transitions += rate * (real - pairs) / np.sqrt(seen_t)
    return Crf(languages, weights.astype(np.float32), transitions.astype(np.float32), np.packbits(seen, bitorder="little"))


def train(docs: DataFrame, learn: Column, per_language: int = 400, segments: int = 6, **params) -> Crf:
    """learn: a condition on doc_id, true where lang may be used."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & learn)
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "doc_id", "text"), 32) / float(1 << 32)
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return fit([])
    share = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            out = []
            for name, lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                words = text.split()
                for k in range(min(segments, 1 + len(words) // 24)):
                    rng = np.random.default_rng([name & (1 << 63) - 1, k])
                    size = int(rng.integers(4, 25))
                    at = int(rng.integers(max(1, len(words) - size + 1)))
                    out.append((lang, name, k, b" ".join(words[at : at + size])))
            langs, names, ks, runs = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [pa.array(langs, pa.string()), pa.array(names, pa.int64()), pa.array(ks, pa.int32()), pa.array(runs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "name", "k", "run"])

    some = rows.where(unit < F.try_element_at(share, "lang")).select(F.xxhash64("text").alias("name"), "lang", "text").dropDuplicates(["name", "lang"])
    found = some.mapInArrow(cut, "lang string, name long, k int, run binary").toPandas().sort_values(["lang", "name", "k"])
    return fit(list(zip(found["lang"], map(bytes, found["run"]), strict=True)), **params)


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            names, score, _ = sent.value.predict(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Crf, least: float = 0.5, known: float = 0.0, fill: str | None = None) -> DataFrame:
    """The rows of docs, unchanged, that have a language with at least the given share, and of whose trigrams the model knows so many.

    fill: a column that gets the predicted language where it is null.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = None if fill is None else [c.lower() for c in docs.columns].index(fill.lower())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            names, score, share = sent.value.predict(texts)
            keep = np.array([name != UNKNOWN for name in names], bool) & (score >= least) & (share >= known)
            if place is not None and part.column(place).null_count:
                found = pa.array([name if some else None for name, some in zip(names, keep, strict=True)], pa.string())
                part = part.set_column(place, part.schema.field(place), pc.coalesce(part.column(place), found.cast(part.column(place).type)))
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
