"""SimHash near-duplicates through vantage-point trees.

Equal fingerprints collapse into one class first. Two classes link if their fingerprints differ in at most
``radius`` bits; then in one of the two 32-bit halves they differ in at most half as many. So there is a
vantage-point tree over each half, searched with that smaller radius: a node sends a fingerprint inward
or outward by its Hamming distance to the node's vantage point. A fingerprint lives in one leaf (shard)
of each tree, and also visits the shards that the triangle bound can't rule out: at its own node only
inward (the pair's other end needn't come the other way too), from then on both ways.

Every shard is searched by the same trees over whole fingerprints down to small blocks, which are
compared completely. A shard returns a spanning forest of its links, not pairs, so a group of k near
copies costs k rows; distributed components join the shards' forests.

The tree's nodes come from a bounded sample of fingerprints (``sample`` of them, or one in ``SPARSE`` if that is
more, up to ``most``) and only steer where rows go: no link depends on them. Larger inputs get deeper trees up
to the sample's size, then larger shards, which split again inside their task.

Defined results: null and empty texts have fingerprint zero and link like any other; null doc_id
counts as absent when the smallest is taken (a component of nulls has a null id); repeated rows and ties
share a component; other columns are ignored; an empty table gives no rows.

With a ``similarity``, keep_one() besides joins all texts that have this share of their five-word shingles in common,
however far their fingerprints lie (near_copies).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import near_copies
from keyloom.llm._components import components
from keyloom.llm._frames import drawn, durable, pieces
from keyloom.llm._words import stretches

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
HALF = np.uint64(0xFFFFFFFF)
BLOCK = 256
#: Ids of rows that are broadcast at most (24 bytes each).
SENT = 1 << 21
#: Distinct fingerprints for each one in the sample, once there are many.
SPARSE = 1 << 14


def fingerprint(text: bytes, size: int = 3) -> int:
    """Majority of the XXH64 bits of the word shingles, as a signed 64-bit number."""
    n, counts = 0, np.zeros(64, np.int64)
    for part in stretches(text.translate(LOWER), size - 1):
        words = part.split()
        line = b" ".join(words)
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        hashes = b"".join([xxhash.xxh64_digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)])
        if hashes:
            bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
            n += len(bits)
            counts += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    if not n:
        words = text.translate(LOWER).split()
        return int.from_bytes(xxhash.xxh64_digest(b" ".join(words), SEED), "big", signed=True) if words else 0
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, tag (64 bits of the text, to tell rows with one id apart), fp long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            fp = pa.array([fingerprint(t, size) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], ["doc_id", "tag", "fp"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), near_copies.unit().alias("tag"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, tag long, fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree over the values of a sample; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, leaf: float, seed: int):
        self.leaves = 0
        self.top = self._grow(sample, leaf, np.random.default_rng(seed))

    def _grow(self, values: np.ndarray, leaf: float, rng: np.random.Generator):
        if len(values) > leaf:
            v = values[rng.integers(len(values))]
            d = distance(values, v)
            mu = int(np.median(d))
            if (inner := d <= mu).any() and not inner.all():
                return v, mu, self._grow(values[inner], leaf, rng), self._grow(values[~inner], leaf, rng)
        self.leaves += 1
        return self.leaves - 1

    def route(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: the indices that live there, and those that visit it."""
        todo = [(self.top, np.arange(len(values)), np.zeros(0, np.int64))]
        while todo:
            node, home, guests = todo.pop()
            if not len(home) + len(guests):
                continue
            if isinstance(node, int):
                yield node, home, guests
                continue
            v, mu, inside, outside = node
            d, g = distance(values[home], v).astype(int), distance(values[guests], v).astype(int)
            todo.append((inside, home[d <= mu], np.concatenate([guests[g <= mu + radius], home[(d > mu) & (d <= mu + radius)]])))
            todo.append((outside, home[d > mu], guests[g > mu - radius]))


def _lowest(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of each pair; labels point at the lowest index of a class."""
    while len(i):
        a, b = labels[i], labels[j]
        if (same := a == b).all():
            break
        i, j, a, b = i[~same], j[~same], a[~same], b[~same]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def forest(values: np.ndarray, home: np.ndarray, radius: int) -> np.ndarray:
    """Class of each value under links of at most radius bits between a value at home and any other."""
    labels = np.arange(len(values))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    rng = np.random.default_rng(0)
    while todo:
        h, g = todo.pop()
        if len(h) > BLOCK:
            d = distance(values[h], v := values[h[rng.integers(len(h))]]).astype(int)
            mu = int(np.median(d))
            if (inner := d <= mu).any() and not inner.all():
                e = distance(values[g], v).astype(int)
                todo.append((h[inner], np.concatenate([g[e <= mu + radius], h[~inner & (d <= mu + radius)]])))
                todo.append((h[~inner], g[e > mu - radius]))
                continue
        every = np.concatenate([h, g])
        for low in range(0, len(h), BLOCK):
            rows = h[low : low + BLOCK]
            for at in range(low, len(every), 1 << 14):
                cols = every[at : at + (1 << 14)]
                i, j = np.nonzero(distance(values[rows][:, None], values[cols][None, :]) <= radius)
                _lowest(labels, rows[i], cols[j])
    return labels


def links(classes: DataFrame, radius: int, sample: int, most: int, shard: int) -> DataFrame:
    """a, b: a spanning forest of the links between the distinct values of the column fp."""
    total = classes.count()
    some = drawn(classes.select("fp"), total, min(most, max(sample, total // SPARSE)), "fp").toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    leaf = max(4.0, shard * len(some) / max(total, 1))
    trees = [Tree(some >> np.uint64(32), leaf, 1), Tree(some & HALF, leaf, 2)]

    def scatter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            u, first = fp.view(np.uint64), 0
            for tree, half in zip(trees, (u >> np.uint64(32), u & HALF), strict=True):
                for leaf_no, home, guests in tree.route(half, radius // 2):
                    at = np.concatenate([home, guests])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first + leaf_no, np.int32)), pa.array(fp[at]), pa.array(np.arange(len(at)) < len(home))], ["shard", "fp", "home"])
                first += tree.leaves

    def search(group: pa.Table) -> pa.Table:
        fp, home = group.column("fp").to_numpy(), group.column("home").to_numpy()
        label = forest(fp.view(np.uint64), home, radius)
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pa.table({"a": fp[moved], "b": fp[label[moved]]})

    rows = classes.select("fp").mapInArrow(scatter, "shard int, fp long, home boolean")
    return rows.groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, size: int = 3, sample: int = 4096, most: int = 1 << 16, shard: int = 2048) -> DataFrame:
    """doc_id, tag, fp, fingerprint (hex), component_id, root (a fingerprint that names the component)."""
    marked = durable(fingerprints(docs, size))
    classes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(classes, radius, sample, most, shard))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    out = marked.join(named.join(least, "root").select("fp", "component_id", "root"), "fp")
    return out.select("doc_id", "tag", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def similar(docs: DataFrame, similarity: float, **params) -> DataFrame:
    """doc_id, tag, root (a text's hash that names the component): by fingerprints or by shared five-word shingles."""
    found = durable(near_duplicates(docs, **params).select("doc_id", "tag", "root"))
    least = found.groupBy("root").agg(F.min("tag").alias("least"))
    known = durable(found.select(F.col("tag").alias("unit"), "root").distinct().join(least, "root").select("unit", F.col("least").alias("root")))
    roots = near_copies.classes(docs, known, similarity)
    return found.select("doc_id", "tag").join(roots, F.col("tag") == F.col("unit")).select("doc_id", "tag", "root")


def keep_one(docs: DataFrame, similarity: float | None = None, **params) -> DataFrame:
    """The rows of docs that stay, unchanged: of each component the first by doc_id, then by the text's tag."""
    found = durable(near_duplicates(docs, **params).select("doc_id", "tag", "root") if similarity is None else similar(docs, similarity, **params))
    rows = durable(found.groupBy("doc_id", "tag", "root").agg(F.count("*").alias("times")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "times")).alias("first")
    stay = durable(rows.groupBy("root").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.tag").alias("tag"), F.col("first.times").alias("times")))
    kinds = stay.agg(F.count("*").alias("all"), F.count_if(F.col("times") > 1).alias("repeated")).first()
    others = rows.count() - kinds["all"]

    def rows_of(some: DataFrame, count: int, how: str) -> DataFrame:
        side = F.broadcast(some) if count <= SENT else some
        return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(some["id"]) & (near_copies.unit(docs["text"]) == some["tag"]), how)

    repeated = stay.where("times > 1")
    if others + kinds["repeated"] <= SENT:  # few rows go: a list of them is sent, and no text is moved
        goes = rows.select(F.col("doc_id").alias("id"), "tag").exceptAll(stay.where("times = 1").select("id", "tag"))
        lone = rows_of(goes, others + kinds["repeated"], "left_anti")
    else:
        lone = rows_of(stay.where("times = 1"), kinds["all"], "left_semi")
    if not kinds["repeated"]:
        return lone
    # of rows that repeat, each task keeps one before any is moved
    same = rows_of(repeated, kinds["repeated"], "left_semi")
    whole = F.first(F.struct(*(same[c] for c in same.columns))).alias("row")
    again = same.groupBy(same["doc_id"].cast("long").alias("id"), near_copies.unit(same["text"]).alias("tag")).agg(whole)
    return lone.union(again.select("row.*"))
