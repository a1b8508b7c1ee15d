"""Classes of texts whose five-word shingles agree: an exact join on Jaccard similarity, closed over chains.

A text is its set of shingles, the runs of ``SHINGLE`` words (a shorter text is one whole shingle); words are cut at
white space and A to Z are lower-cased. Two sets of at least ``least`` in common hold a shingle in common among the
first ``n - ceil(least * n) + 1`` of each (prefix filtering), in any order that is one for all texts: hashes, and
behind them those that are frequent in one text of ``SAMPLE``, the most frequent last. The sample steers only how many
candidates there are; no pair depends on it.

So texts are grouped by the shingles of their prefixes, and only groups that span several classes matter. In each, every
text is compared with one, the group's hub: the text that shares most with the others, an original among its copies.
What is then left apart is settled

* in groups of up to ``DENSE`` texts by comparing those of different classes;
* in larger groups by bitmaps: one task holds a block of the group's texts and a block of those outside its largest class
  (a pair of different classes has one of them) as bitmaps of eight bits a shingle, and compares them by counting bits,
  so no pair is a row before it has passed. First each text gives the pair that differs least, round by round until no
  class grows by one; then all pairs of different classes that pass, few by then, as the bitmaps are near exact.

Before texts are moved, candidates go through a sieve that loses no pair: a text's bitmap has the parity of its shingles
by their last bits, so that two bitmaps differ in at most as many bits as the sets have shingles apart.

Defined results: equal texts are one unit; null and empty texts have no shingles and are like nothing else here.
A text is held whole, with some twenty times its size of arrays beside it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm._components import components
from keyloom.llm._frames import durable, pieces
from keyloom.llm._words import U64, Words, grams

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHINGLE = 5
#: One text in so many is counted for the order; so many frequent shingles are known.
SAMPLE, FREQUENT = 32, 1 << 17
#: Texts of a group that are compared with each other as rows rather than by bitmaps.
DENSE = 256
#: Texts of a block of bitmaps; bits of a bitmap beyond which it has no more than a short one.
BLOCK, WIDE = 1 << 12, 1 << 13


def unit(text: Column | str = "text") -> Column:
    """Names a text (null: as hashed from nothing)."""
    return F.xxhash64(text)


def shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Of each text the 62-bit hashes of its shingles, sorted, each once."""
    words = Words(texts, LOWER)
    h = words.hashes()
    every = grams(h, SHINGLE)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = every[a : b - SHINGLE + 1] if b - a >= SHINGLE else grams(h[a:b], b - a) if b > a else every[:0]
        yield np.unique(own >> U64(2)).view(np.int64)


def ordered(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in the order of all texts: numbers of frequent shingles lie above all hashes."""
    values, ranks = frequent
    if not len(values):
        return own
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    return np.sort(np.where(values[at] == own, (1 << 62) + ranks[at], own))


def prefix(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and common >= least * (len(a) + len(b) - common) - 1e-9


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, s: every shingle of each text."""
    for batch, texts in pieces(batches):
        sets = list(shingles(texts))
        unit = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([pa.array(unit), pa.array(np.concatenate(sets))], ["unit", "s"])


def _prints(sent, least: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, n, bits, prefix: of each text its size, its bitmap (at least one bit a shingle, a power of two of them) and its prefix."""
    for batch, texts in pieces(batches):
        sets = list(shingles(texts))
        sizes = [max(64, 1 << len(x).bit_length()) for x in sets]
        bits = [parity(x, k) for x, k in zip(sets, sizes, strict=True)]
        first = [ordered(x, sent.value)[: prefix(len(x), least)] if len(x) else x for x in sets]
        columns = [batch.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array(bits, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "n", "bits", "prefix"])


def apart(x: bytes, y: bytes) -> int:
    """Shingles that only one of the two sets has, at least; the longer bitmap is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def ratio(least: float) -> float:
    """Of the summed sizes of two sets, the share that only one of them may have."""
    return (1 - least) / (1 + least)


def _sieve(least: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(k).to_pylist() for k in range(2, 6))
        keep = [apart(x, y) <= (n + m) * ratio(least) + 1e-6 for n, x, m, y in zip(*columns, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def sifted(prints: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs of units that can be alike."""
    both = pairs.join(prints.select(F.col("unit").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
    both = both.join(prints.select(F.col("unit").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b").select("a", "b", "na", "x", "nb", "y")
    return both.mapInArrow(functools.partial(_sieve, least), "a long, b long")


def difference(own: np.ndarray, hub: np.ndarray, linked: bool, least: float) -> tuple[np.ndarray, int]:
    """What only one of the two sets has, and how much of it, in an order that is one for all of this hub, is a prefix."""
    only = np.setxor1d(own, hub, assume_unique=True)
    size, c = len(only), ratio(least)
    need = (size + c * (len(hub) - len(own))) / 2
    if not linked:  # the other text may be like the hub
        need = min(need, size - c * len(own) * (1 + 1 / least))
    return only, max(0, size - max(1, math.ceil(need - 1e-6)) + 1)


def _verify(least: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b: the pairs that are alike."""
    opened = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = batch.select(["x", "y"])
        for low in range(0, batch.num_rows, 64):
            a, b = ([opened.decompress(t) for t in texts.column(k).slice(low, 64).to_pylist()] for k in (0, 1))
            linked = [alike(x, y, least) for x, y in zip(shingles(a), shingles(b), strict=True)]
            yield batch.select(["a", "b"]).slice(low, 64).filter(pa.array(linked, pa.bool_()))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch, texts in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(t) for t in texts], pa.binary())], ["unit", "text"])


def verified(units: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs whose texts are alike."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    # texts travel compressed, as a pair holds two of them and a batch thousands of pairs
    packed = units.join(needed, "unit", "left_semi").mapInArrow(_packed, "unit long, text binary")
    texts = packed.groupBy("unit").agg(F.min("text").alias("text"))
    both = pairs.join(texts.select(F.col("unit").alias("a"), F.col("text").alias("x")), "a")
    both = both.join(texts.select(F.col("unit").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(functools.partial(_verify, least), "a long, b long")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (unit, root) after the classes that links (a, b) join have become one."""
    ends = roots.select(F.col("unit").alias("a"), F.col("root").alias("ra")), roots.select(F.col("unit").alias("b"), F.col("root").alias("rb"))
    edges = links.select("a", "b").join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    over = components(edges).select("node", F.col("root").alias("top"))
    return durable(roots.join(over, F.col("root") == F.col("node"), "left").select("unit", F.coalesce("top", "root").alias("root")))


def _mixed(groups: DataFrame) -> DataFrame:
    """s, unit, n, root, k (texts of the group), hub, hub_n, hub_root: the rows of groups (s, unit, n, root) that span several classes."""
    # what spans classes is little of all: written on its own, its size is known to the join
    wide = durable(groups.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("s"))
    rows = groups.join(wide, "s")
    rows = durable(rows.join(rows.groupBy("s").agg(F.count("*").alias("k")), "s"))
    rows = rows.join(rows.groupBy("unit").agg(F.sum("k").alias("w")), "unit")
    hub = rows.groupBy("s").agg(F.max(F.struct("w", "n", "unit", "root")).alias("hub"))
    return durable(rows.join(hub, "s").select("s", "unit", "n", "root", "k", F.col("hub.unit").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.root").alias("hub_root")))


def parity(own: np.ndarray, size: int) -> bytes:
    return np.packbits(np.bincount(own & (size - 1), minlength=size) & 1).tobytes()


def _widths(n: int) -> int:
    """Bits of a wide bitmap: eight a shingle at least, from WIDE on one; sizes of one binary length have the same, of the next up to twice as many."""
    return max(64, 1 << n.bit_length(), min(8 << n.bit_length(), WIDE))


def _wide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches):
        bits = [parity(x, _widths(len(x))) for x in shingles(texts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["unit", "bits"])


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) of so many words: the parity of the same sets by fewer bits."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def _compare(least: float, every: bool, block: pa.Table) -> pa.Table:
    """a, b: pairs of a late text and any other, of different classes, that can be alike; unless every, of each late text the one that differs least."""
    unit, n, root, late = (block.column(c).to_numpy() for c in ("unit", "n", "root", "late"))
    size = pc.binary_length(block.column("bits")).to_numpy()
    at = {w: np.flatnonzero(size == w) for w in np.unique(size).tolist()}
    maps, bits = {}, block.column("bits")
    for w, rows in at.items():
        rows = at[w] = rows[np.argsort(n[rows], kind="stable")]
        maps[w] = np.frombuffer(b"".join(bits.take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1)
    best: dict[int, tuple[float, int]] = {}
    a, b = [], []
    for w, rows in at.items():
        mine = np.flatnonzero(late[rows])
        for v in (w // 2, w, 2 * w) if len(mine) else ():
            if v not in at:
                continue
            words = min(w, v) // 8
            other = at[v][~late[at[v]]]
            fine = folded(maps[v][~late[at[v]]], words), folded(maps[w][mine], words)
            coarse = [folded(x, max(1, words // 8)) for x in fine]
            sizes = n[other]
            for i, x in enumerate(rows[mine].tolist()):
                low, high = np.searchsorted(sizes, [least * n[x] - 1e-6, n[x] / least + 1e-6])
                most = (sizes[low:high] + n[x]) * ratio(least) + 1e-6
                near = np.flatnonzero((np.bitwise_count(coarse[0][low:high] ^ coarse[1][i]).sum(axis=1, dtype=np.int64) <= most) & (root[other[low:high]] != root[x]))
                if not len(near):
                    continue
                off = np.bitwise_count(fine[0][low + near] ^ fine[1][i]).sum(axis=1, dtype=np.int64)
                near, off = near[off <= most[near]], off[off <= most[near]]
                if every:
                    a.append(np.full(len(near), unit[x]))
                    b.append(unit[other[low + near]])
                elif len(near):
                    share = off / most[near]
                    k = int(share.argmin())
                    best[x] = min(best.get(x, (2.0, 0)), (float(share[k]), int(unit[other[low + near[k]]])))
    if not every:
        a, b = [unit[list(best)]] if best else [], [np.array([y for _, y in best.values()], np.int64)] if best else []
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _crossing(large: DataFrame, wide: DataFrame, roots: DataFrame, least: float, every: bool) -> DataFrame:
    """a, b: of the groups large (s, unit, n), pairs of texts of different classes that can be alike."""
    rows = large.join(roots, "unit")
    held = rows.groupBy("s", "root").agg(F.count("*").alias("m")).groupBy("s").agg(F.sum("m").alias("k"), F.max(F.struct("m", "root")).alias("main"))
    held = held.select("s", F.col("main.root").alias("main"), F.ceil(F.col("k") / BLOCK).alias("wholes"), F.ceil((F.col("k") - F.col("main.m")) / BLOCK).alias("lates"))
    rows = rows.join(held.where("lates > 0"), "s")
    late = F.col("root") != F.col("main")
    mine = lambda blocks: F.array(F.pmod(F.xxhash64("unit"), F.col(blocks)))
    every_one = lambda blocks: F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1)
    kept = ["s", "unit", "n", "root"]
    dealt = rows.select(*kept, mine("wholes").alias("i"), every_one("lates").alias("j"), F.lit(False).alias("late"))
    dealt = dealt.union(rows.where(late).select(*kept, every_one("wholes").alias("i"), mine("lates").alias("j"), F.lit(True).alias("late")))
    dealt = dealt.withColumn("i", F.explode("i")).withColumn("j", F.explode("j")).join(wide, "unit")
    return dealt.groupBy("s", "i", "j").applyInArrow(lambda block: _compare(least, every, block), "a long, b long").distinct()


def _like(n: str, m: str, least: float) -> Column:
    return (F.col(n) >= F.lit(least) * F.col(m) - 1e-9) & (F.col(m) >= F.lit(least) * F.col(n) - 1e-9)


def classes(docs: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """unit, root: the classes given (of every unit: xxhash64 of the text) after all that are alike in a chain have become one."""
    units = docs.select(unit().alias("unit"), F.col("text").cast("string").alias("text")).where("text is not null")
    some = units.where(F.pmod("unit", F.lit(SAMPLE)) == 0).mapInArrow(_counted, "unit long, s long")
    top = some.distinct().groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(FREQUENT).toPandas()["s"].to_numpy(np.int64)
    order = np.argsort(top)
    sent = docs.sparkSession.sparkContext.broadcast((top[order], len(top) - 1 - order))
    prints = durable(units.mapInArrow(functools.partial(_prints, sent, least), "unit long, n int, bits binary, prefix array<long>").dropDuplicates(["unit"]))

    mixed = _mixed(prints.join(roots, "unit").select(F.explode("prefix").alias("s"), "unit", "n", "root"))
    if mixed.isEmpty():
        return roots
    stars = mixed.where((F.col("unit") != F.col("hub")) & (F.col("root") != F.col("hub_root")) & _like("n", "hub_n", least))
    stars = stars.select(F.least("hub", "unit").alias("a"), F.greatest("hub", "unit").alias("b")).distinct()
    done = durable(sifted(prints, stars, least))
    roots = _merged(roots, verified(units, done, least))

    few = durable(mixed.where(F.col("k") <= DENSE).select("s", "unit", "n").join(roots, "unit"))
    other = few.select("s", F.col("unit").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
    pairs = few.join(other, "s").where((F.col("unit") < F.col("b")) & (F.col("root") != F.col("other")) & _like("n", "m", least))
    pairs = pairs.select(F.col("unit").alias("a"), "b").distinct().join(done, ["a", "b"], "left_anti")
    left = durable(sifted(prints, pairs, least))
    roots = _merged(roots, verified(units, left, least))

    large = durable(mixed.where(F.col("k") > DENSE).select("s", "unit", "n"))
    if large.isEmpty():
        return roots
    wide = durable(units.join(large.select("unit").distinct(), "unit", "left_semi").mapInArrow(_wide, "unit long, bits binary").dropDuplicates(["unit"]))
    done, every = done.union(left), False
    while True:
        new = durable(_crossing(large, wide, roots, least, every).join(done, ["a", "b"], "left_anti"))
        links = durable(verified(units, new, least))
        found = not links.isEmpty()
        if found:
            roots = _merged(roots, links)
        if every:
            return roots
        done, every = done.union(new), not found
