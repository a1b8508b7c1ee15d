"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every training passage is a query. Passages are ``2 * m`` words long and start every ``m`` words, m being
the longest item's length (32 at least), so any copy of an item lies whole inside some passage. Scores are
BM25 divided by the item's score against its own text: 1 says that the passage has all of the item's words.
Items are held in blocks of like length, and a term's list names only the blocks that hold it, each with the term's
largest share there. As in WAND, a passage's terms of the smallest maxima, which together can't reach ``threshold``,
open no block; the others do, and a block is left as soon as the maxima say that none of its items can reach the
threshold. What remains is scored exactly from the postings. There is no top-k: all that reach the threshold are
returned. All steps run over arrays, many passages at a time, instead of moving one cursor at a time. What is retrieved
is verified: of the question's and of the answer's five-word shingles, each taken alone, at least
``overlap`` must be in the passage. Without columns question and answer, an item's first two thirds of
words are its question and the rest its answer; with ``whole``, such an item is also held where ``overlap`` of
the shingles of its whole text are in the passage, whatever its parts have.

Words are lower-cased (A to Z) and cut at white space and ASCII punctuation.

Number, mean length, longest length and document frequencies are of the whole table of items. The index is sparse
(some 30 bytes a word of the items), built on the driver and broadcast. Where the items have more than ``part_bytes``
of text it comes in parts, each a pass over the documents, that share those figures, so rows and scores are the same
however it is cut.

Defined results: items and documents that are null or have no words match nothing; items of fewer than five
words match as one whole shingle; equal items each match; repeated rows each match; extra columns are ignored;
an empty benchmark or corpus gives no rows. A text is held whole, with some twenty times its size of arrays beside it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._frames import durable, pieces
from keyloom.llm._words import U64, Words, grams

#: A to Z to lower case, ASCII punctuation to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
K1, B = 1.2, 0.75
#: Items in a block.
BLOCK = 16
SHINGLE = 5
#: Passages are searched together until they have so many words, or open so many blocks.
AT_ONCE = 1 << 18
#: Entries of the table that finds a list by its key.
TABLE = 1 << 22
EPS = 1e-9
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"


@dataclass
class Figures:
    """Of all items that have words: how many, their mean and greatest length; how many hold each of some sorted terms."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


def _cut(items: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Word hashes of the items that have words, one after the other; where each item begins, where its answer does; their ids."""
    q, a = Words([x for _, x, _ in items], FOLD), Words([x for _, _, x in items], FOLD)
    qh, ah = q.hashes(), a.hashes()
    parts, first, answer, ids = [], [0], [], []
    for k, (item_id, _, _) in enumerate(items):
        mine, rest = qh[q.first[k] : q.first[k + 1]], ah[a.first[k] : a.first[k + 1]]
        if not len(mine) + len(rest):
            continue
        # of one text, the last third is the answer
        answer.append(first[-1] + (len(mine) if len(rest) else len(mine) - len(mine) // 3))
        first.append(first[-1] + len(mine) + len(rest))
        parts += [mine, rest]
        ids.append(item_id)
    return np.concatenate([np.zeros(0, U64), *parts]), np.array(first), np.array(answer, np.int64), ids


def figures(items: list[tuple[int, bytes, bytes]]) -> Figures:
    words, first, _, ids = _cut(items)
    terms, term = np.unique(words, return_inverse=True)
    pair = np.unique(term * max(1, len(ids)) + np.repeat(np.arange(len(ids)), np.diff(first)))
    df = np.bincount(pair // max(1, len(ids)), minlength=len(terms))
    return Figures(len(ids), len(words) / max(1, len(ids)), int(np.diff(first).max(initial=0)), terms, df)


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers start .. start + count - 1 of all pairs, one after the other, and of which pair each is."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.arange(len(owner)) + np.repeat(start - (np.cumsum(count) - count), count), owner


class Index:
    """Terms are numbered by their sorted hashes, items by length; BLOCK items are a block. Term t has the lists
    lists[t] .. lists[t + 1] - 1, one for each block that holds it: key (t * blocks + block, so sorted), most (the
    term's largest share of an item's own score in that block). List l has the postings postings[l] .. postings[l + 1] - 1:
    item (within the block) and share."""

    def __init__(self, items: list[tuple[int, bytes, bytes]], whole: Figures | None = None):
        whole = whole or figures(items)
        words, first, answer, ids = _cut(items)
        n, lengths = len(ids), np.diff(first)
        order = np.argsort(lengths, kind="stable")
        self.longest = whole.longest
        self.words, self.begin, self.end, self.answer = words, first[:-1][order], first[1:][order], answer[order]
        self.ids = [ids[i] for i in order]
        self.blocks = -(-n // BLOCK)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.terms, term = np.unique(words, return_inverse=True)
        pair, tf = np.unique(term * max(1, n) + np.repeat(place, lengths), return_counts=True)
        term, item = np.divmod(pair, max(1, n))
        df = whole.df[np.searchsorted(whole.terms, self.terms)]
        idf = np.log1p((whole.n - df + 0.5) / (df + 0.5))
        share = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (self.end - self.begin)[item] / max(whole.mean, 1)))
        self.share = share / np.bincount(item, share, minlength=n)[item]
        self.item = (item % BLOCK).astype(np.uint8)
        every = term * self.blocks + item // BLOCK
        start = np.flatnonzero(np.diff(every, prepend=-1))
        self.key = every[start]
        self.postings = np.append(start, len(every))
        self.most = np.maximum.reduceat(self.share, start) if len(start) else np.zeros(0)
        self.lists = np.searchsorted(self.key, np.arange(len(self.terms) + 1) * self.blocks)
        self.top = np.maximum.reduceat(self.most, self.lists[:-1]) if len(self.terms) else np.zeros(0)
        # where a list is, by its key: looked up in a table while that is small, else searched for
        self.table = None
        if len(self.terms) * self.blocks <= TABLE:
            self.table = np.full(len(self.terms) * self.blocks, -1, np.int32)
            self.table[self.key] = np.arange(len(self.key))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 if no item has it."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1).astype(np.int32)

    def listed(self, key: np.ndarray) -> np.ndarray:
        """The list of each key, -1 where there is none."""
        if self.table is not None:
            return self.table[key]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[place] == key, place, -1)

    def opened(self, owner: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Passage and block of all whose maxima may reach least, from pairs sorted by passage."""
        order = np.lexsort((self.top[term], owner))
        who, top = owner[order], self.top[term[order]]
        begin = np.flatnonzero(np.diff(who, prepend=-1))
        total = np.cumsum(top)
        total -= np.repeat((total - top)[begin], np.diff(np.append(begin, len(who))))
        opens = total >= least
        slack = np.zeros(int(owner[-1]) + 1)
        np.maximum.at(slack, who[~opens], total[~opens])
        who, what = who[opens], term[order][opens]
        at, pair = _spread(self.lists[what], self.lists[what + 1] - self.lists[what])
        key = who[pair] * self.blocks + self.key[at] % self.blocks
        if len(slack) * self.blocks <= 8 * len(key):
            bound = np.bincount(key, self.most[at], minlength=len(slack) * self.blocks)
            found = np.flatnonzero(bound)
            bound = bound[found]
        else:
            found, inverse = np.unique(key, return_inverse=True)
            bound = np.bincount(inverse, self.most[at], minlength=len(found))
        found = found[bound + slack[found // self.blocks] >= least]
        return found // self.blocks, found % self.blocks

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
        """passage, item, score of all that reach the threshold, from sorted distinct pairs (passage, term)."""
        least = threshold - EPS
        many = np.cumsum(self.lists[term + 1] - self.lists[term])
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        low = 0
        while low < len(begin):  # as many passages as open AT_ONCE blocks at most
            before = many[begin[low] - 1] if begin[low] else 0
            high = max(low + 1, int(np.searchsorted(many[np.append(begin[low + 1 :], len(term)) - 1], before + AT_ONCE, "right")) + low)
            part = slice(begin[low], begin[high] if high < len(begin) else len(term))
            yield from self._scored(passage[part], term[part], least)
            low = high

    def _scored(self, passage: np.ndarray, term: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
        begin = np.flatnonzero(np.diff(passage, prepend=-1))
        count = np.diff(np.append(begin, len(passage)))
        who, block = self.opened(np.repeat(np.arange(len(begin)), count), term, least)
        for low in range(0, len(who), 1 << 12):
            own, mine = who[low : low + (1 << 12)], block[low : low + (1 << 12)]
            at, pair = _spread(begin[own], count[own])
            place = self.listed(term[at].astype(np.int64) * self.blocks + mine[pair])
            held = np.flatnonzero(place >= 0)
            place, pair = place[held], pair[held]
            able = np.bincount(pair, self.most[place], minlength=len(own)) >= least
            place, pair = place[able[pair]], pair[able[pair]]
            at, row = _spread(self.postings[place], self.postings[place + 1] - self.postings[place])
            score = np.bincount(pair[row] * BLOCK + self.item[at], self.share[at], minlength=len(own) * BLOCK)
            for k in np.flatnonzero(score >= least).tolist():
                yield int(passage[begin[own[k // BLOCK]]]), int(mine[k // BLOCK]) * BLOCK + k % BLOCK, float(score[k])

    def overlaps(self, item: int, words: np.ndarray) -> tuple[float, float, float]:
        """Shares of the question's, the answer's and the whole item's shingles that the words have; a part without words is all there."""
        begin, answer, end = (int(x[item]) for x in (self.begin, self.answer, self.end))
        shares = []
        for part in (self.words[begin:answer], self.words[answer:end], self.words[begin:end]):
            size = min(SHINGLE, len(part))
            if not size:
                shares.append(1.0)
                continue
            own = np.unique(grams(part, size))
            shares.append(float(np.isin(own, grams(words, size)).mean()))
        return shares[0], shares[1], shares[2]


def hits(index: Index, texts: list[bytes], threshold: float, overlap: float, whole: bool = False) -> Iterator[tuple[int, int, float, float, float, float]]:
    """document, item, score, overlaps: of each item that a document holds, the best passage that is verified."""
    if not len(index.terms):
        return
    words = Words(texts, FOLD)
    hashes = words.hashes()
    term = index.lookup(hashes)
    step = max(32, index.longest)
    # a document's passages start every step words, the last one at most a step before its end
    count = np.maximum(1, -(-(np.diff(words.first) - step) // step))
    start, doc = _spread(np.zeros(len(count), np.int64), count)
    start = words.first[doc] + start * step
    stop = np.minimum(start + 2 * step, words.first[doc + 1])
    best: dict[tuple[int, int], tuple] = {}
    many, low = np.cumsum(stop - start), 0
    while low < len(start):
        high = max(low + 1, int(np.searchsorted(many, (many[low - 1] if low else 0) + AT_ONCE, "right")))
        at, own = _spread(start[low:high], (stop - start)[low:high])
        known = term[at] >= 0
        keys = np.unique((low + own[known]) * len(index.terms) + term[at[known]])
        passage, found = np.divmod(keys, len(index.terms))
        for p, item, score in index.search(passage, found, threshold):
            q, a, every = index.overlaps(item, hashes[start[p] : stop[p]])
            if (q >= overlap and a >= overlap) or (whole and every >= overlap):
                d = int(doc[p])
                best[d, item] = max(best.get((d, item), (0.0,)), (score, q, a, every))
        low = high
    for (d, item), found in sorted(best.items()):
        yield d, item, *found


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part_bytes: int = 16 << 20, whole: bool = False) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, overlap (of the whole): each item that a document holds."""
    sent, whole = _indexes(docs, items, part_bytes, whole)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return functools.reduce(DataFrame.union, [source.mapInArrow(functools.partial(_scan, one, threshold, overlap, whole), SCHEMA) for one in sent])


def _lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, its words' number and its distinct words: of each item that has words."""
    for batch in batches:
        part, q, a = (batch.column(k).to_pylist() for k in (0, 2, 3))
        words, first, _, kept = _cut([(p, x.encode(), y.encode()) for p, x, y in zip(part, q, a, strict=True)])
        own = [np.unique(words[i:j]).view(np.int64) for i, j in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int32()), pa.array(np.diff(first), pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["part", "n", "terms"])


def _indexes(docs: DataFrame, items: DataFrame, part_bytes: int, whole: bool) -> tuple[list, bool]:
    """The broadcast index of each part of the items, and whether their whole texts count."""
    split = {"question", "answer"} <= set(items.columns)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (("question", "answer") if split else ("text",))] + [F.lit("")] * (not split)
    listed = items.select(F.col("item_id").cast("long").alias("item_id"), parts[0].alias("q"), parts[1].alias("a"))
    size = int(listed.agg(F.coalesce(F.sum(F.octet_length("q") + F.octet_length("a")), F.lit(0))).first()[0])
    n_parts = max(1, -(-size // part_bytes))
    if n_parts > 1:  # rows are numbered, so that a text in many rows is spread over the parts
        listed = durable(listed.select(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_parts)).cast("int").alias("part"), "item_id", "q", "a"))
        counted = durable(listed.mapInArrow(_lengths, "part int, n long, terms array<long>"))
        n, total, longest = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        terms = counted.select("part", F.explode("terms").alias("term"))
        df = durable(terms.groupBy("term").agg(F.count("*").alias("df")))
    sent = []
    for k in range(n_parts):
        mine = (listed.where(F.col("part") == k) if n_parts > 1 else listed).orderBy("item_id", "q", "a").select("item_id", "q", "a").collect()
        rows = [(r.item_id, r.q.encode(), r.a.encode()) for r in mine]
        if n_parts > 1:
            own = df.join(terms.where(F.col("part") == k).select("term").distinct(), "term").toPandas()
            hashes = own["term"].to_numpy(np.int64).view(U64)
            order = np.argsort(hashes)
            index = Index(rows, Figures(n, total / max(1, n), longest, hashes[order], own["df"].to_numpy(np.int64)[order]))
        else:
            index = Index(rows)
        sent.append(docs.sparkSession.sparkContext.broadcast(index))
    return sent, whole and not split


def _scan(sent, threshold: float, overlap: float, whole: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = sent.value
    for batch, texts in pieces(batches):
        if rows := list(hits(index, texts, threshold, overlap, whole)):
            doc, item, *shares = zip(*rows, strict=True)
            columns = [batch.column(0).take(pa.array(doc)), pa.array([index.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.float64()) for x in shares)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"])


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part_bytes: int = 16 << 20, whole: bool = False) -> DataFrame:
    """The rows of docs whose own text holds no item, unchanged; rows with the same id are judged each by its text."""
    sent, whole = _indexes(docs, items, part_bytes, whole)
    for one in sent:
        docs = docs.mapInArrow(functools.partial(_without, one, threshold, overlap, whole), docs.schema)
    return docs


def _without(sent, threshold: float, overlap: float, whole: bool, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = sent.value
    for batch, texts in pieces(batches):
        held = np.zeros(len(texts), bool)
        held[np.array([row[0] for row in hits(index, texts, threshold, overlap, whole)], np.int64)] = True
        yield batch.filter(pa.array(~held))
