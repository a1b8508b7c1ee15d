"""URL filters through a cascade of Bloom filters.

Keys are hosts and all their parent domains. The universe is every key of the corpus. The first filter
holds the listed keys; the second holds the first's false positives among the rest of the universe; the third the
second's false positives among the listed keys; and so on until there are none. A key walks down until a filter
lacks it, and the parity of that level is its membership: exact for every key of the universe, without a join
of the pages. Keys outside the universe (pages added later) may be judged wrongly, as with any Bloom filter.

Building is distributed: keys are distinct rows of a checkpointed table, bits come back as OR-ed 64-bit words, and
each level scans that table with the filters so far. The filters are broadcast only while all of them
together stay under ``max_bytes`` (64 MB hold about fifty million listed keys); beyond it the keys are
looked up by a left semi join.

Rules come before the method: a rule fits its host and all subdomains if the path begins with the rule's; the rule
of the most characters wins. They are a short list, part of the expressions.

Defined results: a null URL, or one without ``://``, has empty host and path, which no rule and no list fits;
repeated rows are judged each; other columns pass through; empty tables give no rows; an empty list allows all.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm._frames import durable, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


class Bloom:
    """One level: m bits, k positions for each key by double hashing."""

    def __init__(self, n: int, rate: float, level: int):
        self.m = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.m / max(n, 1) * math.log(2)))
        self.k = min(self.k, 24)
        self.level = level
        self.words = np.zeros(-(-self.m // 64), np.uint64)

    def positions(self, keys: list[bytes]) -> np.ndarray:
        digest = b"".join([xxhash.xxh3_128_digest(x, self.level) for x in keys])
        h = np.frombuffer(digest, "<u8").reshape(-1, 2)
        return (h[:, :1] + np.arange(self.k, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) % np.uint64(self.m)

    def has(self, keys: list[bytes]) -> np.ndarray:
        at = self.positions(keys)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def listed(self, keys: list[bytes]) -> np.ndarray:
        out = np.full(len(keys), len(self.levels) % 2 == 1)
        alive = np.arange(len(keys))
        for i, level in enumerate(self.levels):
            if not len(alive):
                break
            has = level.has([keys[j] for j in alive])
            out[alive[~has]] = i % 2 == 1
            alive = alive[has]
        return out


def _fill(level: Bloom, rows: DataFrame) -> None:
    """Set the bits of all keys: words are OR-ed in the tasks, then by Spark; what returns is the filter's size."""

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = np.unique(level.positions([x.encode() for x in batch.column(0).to_pylist()]))
                word, start = np.unique((at >> np.uint64(6)).astype(np.int64), return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "bits"])

    merged = rows.select("key").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()
    level.words[merged["word"].to_numpy(np.int64)] = merged["bits"].to_numpy(np.int64).view(np.uint64)


def build(keys: DataFrame, max_bytes: int) -> Cascade | None:
    """keys: key string, listed boolean, distinct. None if the filters would exceed max_bytes."""
    n = {r["listed"]: r["count"] for r in keys.groupBy("listed").count().collect()}
    inside, outside = n.get(True, 0), n.get(False, 0)
    if not inside:
        return Cascade([])
    rate = min(0.5, max(1e-9, inside * math.sqrt(0.5) / max(outside, 1)))
    levels: list[Bloom] = []
    todo, side = inside, True
    while todo:
        level = Bloom(todo, 0.5 if levels else rate, len(levels))
        if sum(x.words.nbytes for x in [*levels, level]) > max_bytes:
            return None
        _fill(level, _alive(keys, levels, side))
        levels.append(level)
        side = not side
        todo = _alive(keys, levels, side).count()
    return Cascade(levels)


def _alive(keys: DataFrame, levels: list[Bloom], side: bool) -> DataFrame:
    """Keys of one side that the other side's filters took for theirs so far: what the next level has to hold."""
    asked = [x for x in levels if (x.level % 2 == 0) != side]
    rows = keys.where(F.col("listed") == side).select("key")
    if not asked:
        return rows
    sent = keys.sparkSession.sparkContext.broadcast(asked)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x.encode() for x in batch.column(0).to_pylist()]
            if names:
                yield batch.filter(pa.array(np.logical_and.reduce([x.has(names) for x in sent.value])))

    return rows.mapInArrow(keep, "key string")


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], max_bytes: int = 64 << 20) -> DataFrame:
    """pages with host, path, rule, verdict. listed: a column key of hosts or domains; rules: (verdict, host, path)."""
    kept = pages.select([c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")])
    mark = unused("listed", kept.columns)
    rows = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    universe = rows.select("host").where("host <> ''").distinct().select(F.explode(suffixes(F.col("host"))).alias("key"), F.lit(False).alias("listed"))
    given = listed.select(F.translate(F.col("key").cast("string"), UPPER, LOWER).alias("key"), F.lit(True).alias("listed")).where("key <> ''")
    keys = durable(universe.union(given).groupBy("key").agg(F.max("listed").alias("listed")))
    cascade = build(keys, max_bytes)
    if cascade is None:
        hosts = rows.select("host").distinct().select(F.col("host").alias("_host"), F.explode(suffixes(F.col("host"))).alias("key"))
        found = hosts.join(keys.where("listed"), "key", "left_semi").select("_host").distinct().withColumn(mark, F.lit(True))
        marked = rows.join(found, rows["host"] == found["_host"], "left").select(*rows.columns, F.coalesce(found[mark], F.lit(False)).alias(mark))
    else:
        marked = _marked(rows, cascade, mark)
    fits = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = verdict = None
    for decision, host, path in fits:
        fit = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith("path", F.lit(path))
        rule = F.when(fit, host + path) if rule is None else rule.when(fit, host + path)
        verdict = F.when(fit, decision) if verdict is None else verdict.when(fit, decision)
    method = F.when(F.col(mark), "block").otherwise("allow")
    out = {"rule": rule if fits else F.lit(None).cast("string"), "verdict": verdict.otherwise(method) if fits else method}
    return marked.withColumns(out).drop(mark)


def _marked(rows: DataFrame, cascade: Cascade, name: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(cascade)

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = batch.column(batch.schema.get_field_index("host")).dictionary_encode()
            chains = [h.split(".") for h in hosts.dictionary.to_pylist()]
            keys = [".".join(c[k:]).encode() for c in chains for k in range(len(c))]
            start = np.cumsum([0, *map(len, chains)])[:-1]
            hit = np.logical_or.reduceat(sent.value.listed(keys), start) if keys else np.zeros(0, bool)
            yield batch.append_column(name, pa.array(hit[hosts.indices.to_numpy()] if len(hit) else np.zeros(batch.num_rows, bool)))

    return rows.mapInArrow(mark, T.StructType([*rows.schema.fields, T.StructField(name, T.BooleanType())]))
