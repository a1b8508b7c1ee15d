"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Each paragraph (line) hashes to a wide vector of 32-bit lanes; a document's fingerprint is their sum modulo
2**32, lane by lane. So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted
by adding or subtracting its vector (``insert``, ``delete``). The vector has two parts:

* ``STRONG`` lanes are a cryptographic digest of the paragraph: equal sums say equal multisets.
* ``LIKE`` lanes hold +1 or -1 in the lane of each of its five-word shingles (the whole paragraph if it has fewer
  words). The squared length of the difference of two such parts estimates how many shingles the documents
  don't share, so ``likeness`` = 1 - |a - b|^2 / (|a|^2 + |b|^2), cut to 0 to 1. Its standard error for
  unrelated texts is about sqrt(2 / LIKE) = 0.1; equal texts give exactly 1. A lane wraps only beyond 2**31 equal shingles.

Neighbours in order of doc_id come from one exchange of the texts: rows are dealt into contiguous id ranges
(limits from approximate quantiles, one number for each range), the first row of each range also goes to the
range before it (the first of all to the last), and each range is read in order with one row of look-ahead.

Defined results: a null or empty text has no paragraphs, so a zero fingerprint, and is wholly like another such and
unlike any other; null doc_id comes first in the order; rows with equal ids are ordered by their text; a single
row is its own neighbour; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm._frames import NULL_ID, doc_key, shuffle_width
from keyloom.llm._words import U64, Words, mix, ranges_hash

STRONG, LIKE, SHINGLE = 16, 192, 5
#: Id ranges for each shuffle partition.
RANGES = 8
LANES = STRONG + LIKE
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def vectors(texts: list[bytes]) -> np.ndarray:
    """The fingerprint of each text, as rows of uint32 lanes."""
    out = np.zeros((len(texts), LANES), np.uint32)
    split = [[p for p in t.split(b"\n") if p] for t in texts]
    paragraphs = [p for ps in split for p in ps]
    if not paragraphs:
        return out
    owner = np.repeat(np.arange(len(texts)), [len(ps) for ps in split])
    digest = np.frombuffer(b"".join([hashlib.blake2b(p).digest() for p in paragraphs]), "<u4").reshape(-1, STRONG)
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    out[owner[start], :STRONG] = np.add.reduceat(digest, start, axis=0, dtype=np.uint32)
    words = Words(paragraphs)
    hashes, n = words.hashes(), np.diff(words.first)
    left, doc = words.left(), words.docs()
    at = np.flatnonzero((left >= SHINGLE) | ((left == n[doc]) & (n[doc] < SHINGLE)))
    shingle = mix(ranges_hash(hashes, at, at + np.minimum(SHINGLE, left[at])))
    lane = owner[doc[at]] * LIKE + (shingle >> U64(40)).astype(np.int64) % LIKE
    sign = ((shingle & U64(1)).astype(np.int64) << 1) - 1
    likes = np.bincount(lane, sign, minlength=len(texts) * LIKE).astype(np.int64)
    out[:, STRONG:] = likes.astype(np.uint32).reshape(-1, LIKE)
    return out


def insert(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    return fingerprint + vectors([paragraph])[0]


def delete(fingerprint: np.ndarray, paragraph: bytes) -> np.ndarray:
    return fingerprint - vectors([paragraph])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of fingerprints: 1 if equal, near 0 if they share no shingles."""
    x, y = (np.ascontiguousarray(v[:, STRONG:]).view(np.int32).astype(np.float64) for v in (a, b))
    apart = (a[:, STRONG:] - b[:, STRONG:]).view(np.int32).astype(np.float64)
    whole = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    near = np.clip(1 - (apart * apart).sum(axis=1) / np.maximum(whole, 1), 0, 1)
    return np.where((a == b).all(axis=1), 1.0, np.where(whole > 0, near, 0.0))


def edit(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to as many of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(rows: list[tuple[int, str]], after: tuple[int, str]) -> pa.RecordBatch:
    texts = [t for _, t in rows]
    following = [*texts[1:], after[1]]
    edited = [edit(t, f).encode() for t, f in zip(texts, following, strict=True)]
    raw = [t.encode() for t in [*texts, after[1]]]
    prints, changed = vectors(raw), vectors(edited)
    own, follow = prints[:-1], prints[1:]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if k == NULL_ID else k for k, _ in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in edited]),
            pa.array([v.tobytes().hex() for v in own]),
            pa.array([v.tobytes().hex() for v in changed]),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, follow)),
        ],
        schema=pa.schema([(n, t) for n, t in zip(SCHEMA.replace(",", "").split()[::2], [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 2, strict=True)]),
    )


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, extra, key and text; extra rows only end their bucket."""
    held: list[tuple[int, str]] = []
    size, bucket = 0, None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "extra", "key", "text")]
        for b, extra, key, text in zip(*columns, strict=True):
            row = (key, text)
            if b != bucket:
                assert not held, "a range without its following row"
                bucket, done = b, False
            elif done:
                continue
            if held and (extra or size > 1 << 20):
                yield _compared(held, row)
                held, size = [], 0
            if extra:
                done = True
            else:
                held.append(row)
                size += 4 * len(text)
    assert not held, "a range without its following row"


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = docs.select(doc_key().alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = rows.select("key")
    n = shuffle_width(spark)
    ranges = RANGES * n  # several for each task, so that tasks come out even
    found = keys.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("cuts")).first()["cuts"]
    cuts = np.unique(np.array(found or [], np.int64))

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.sort(batch.column(0).to_numpy())
            bucket, at = np.unique(np.searchsorted(cuts, key), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(key[at])], ["bucket", "key"])

    firsts = keys.mapInArrow(least, "bucket int, key long").groupBy("bucket").agg(F.min("key").alias("key")).orderBy("bucket").collect()
    first = np.array([r["key"] for r in firsts], np.int64)
    ahead = np.roll(np.array([r["bucket"] for r in firsts], np.int32), 1)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "extra", "key", "text"]
        for batch in batches:
            key = batch.column(0).to_numpy()
            home = pa.array(np.searchsorted(cuts, key).astype(np.int32))
            yield pa.RecordBatch.from_arrays([home, pa.array(np.zeros(len(key), bool)), *batch.columns], names)
            if len(at := np.flatnonzero(np.isin(key, first))):
                more = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(ahead[np.searchsorted(first, key[at])]), pa.array(np.ones(len(at), bool)), *more.columns], names)

    dealt = rows.mapInArrow(deal, "bucket int, extra boolean, key long, text string")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", "key", "text").mapInArrow(_walk, SCHEMA)
