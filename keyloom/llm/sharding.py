"""Proportional stratified interleaving: every shard holds each source in the corpus's proportion.

Rows of a source are put into a seeded random order (by a hash of id, checksum and size, so that a null or repeated
id is no hot spot); the row of rank r among n gets the fraction
``(r - u) / n``, u being a number in [0, 1) made from the source's name, so that small sources don't all
land in the same place. All rows in order of the fraction are then cut into runs of equal counts (the
``rows`` law: any two shards differ by one row at most).

Neither order is made in one task. Ranks within a source come from its hash range: rows are counted by
(source, bucket of the hash), running sums over those counts give each bucket's first rank, and only rows
of one bucket are sorted together. The global order is made likewise from buckets of the fraction. A
bucket holds about ``bucket_rows`` rows however large a source is, as both are uniform (more only beyond
``most_buckets`` times as many rows, so that the running sums stay small). Only ids, sizes
and checksums are moved, never text.

Defined results: a null or empty text has size 8 and checksum 0; null source is a stratum of its own; null
doc_id counts as a value; rows equal in all that is returned may swap places; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What the seed of a row's place is mixed with for its source's offset.
OFFSET_SALT = 7
#: Hexadecimal digits of a hash that count.
HEX_DIGITS = 13
UNIT = float(16**HEX_DIGITS)


def _hash(*parts: Column) -> Column:
    """A number below UNIT from the MD5 of the parts, joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS), 16, 10).cast("long")


def _before(counts: DataFrame, by: list[str], bucket: str) -> DataFrame:
    """For each bucket, the rows in the buckets before it (of the same stratum)."""
    window = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(window), F.lit(0)))


def interleave(docs: DataFrame, shards: int = 24, seed: int = 1, bucket_rows: int = 5_000, most_buckets: int = 1_000_000) -> DataFrame:
    """doc_id, size, text_crc32, source, law, shard, slot (from 0 in each shard, in the interleaved order)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_ = F.col("doc_id").cast("long")
    name = F.col("source").cast("string")
    stratum = F.when(name.isNull(), "-").otherwise(F.concat(F.lit("+"), name))
    size, check = (F.octet_length(text) + 8).cast("long"), F.crc32(text)
    total = docs.count()
    buckets = min(most_buckets, max(1, -(-total // bucket_rows)))

    light = docs.select(id_.alias("doc_id"), stratum.alias("stratum"), name.alias("source"), size.alias("size"), check.alias("text_crc32"))
    light = light.withColumn("h", _hash(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    light = light.withColumn("bucket", F.floor(F.col("h") / UNIT * buckets).cast("int"))
    counts = light.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    all_of = Window.partitionBy("stratum")
    firsts = _before(counts.withColumn("whole", F.sum("n").over(all_of)), ["stratum"], "bucket").select("stratum", "bucket", "before", "whole")
    inside = Window.partitionBy("stratum", "bucket").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = light.withColumn("r", F.row_number().over(inside)).join(firsts, ["stratum", "bucket"])
    rank = F.col("before") + F.col("r")
    fraction = (rank - _hash(F.lit(str(seed + OFFSET_SALT)), F.col("stratum")) / UNIT) / F.col("whole")
    placed = ranked.withColumn("fraction", fraction).withColumn("slice", F.least(F.floor(F.col("fraction") * buckets).cast("int"), F.lit(buckets - 1)))
    placed = placed.select("doc_id", "source", "stratum", "h", "size", "text_crc32", "fraction", "slice")

    # one row for each slice (buckets of them): a running sum over them needs no row of the table
    slices = _before(placed.groupBy("slice").agg(F.count("*").alias("n")).withColumn("one", F.lit(1)), ["one"], "slice").select("slice", "before")
    within = Window.partitionBy("slice").orderBy("fraction", "h", "stratum", "doc_id", "text_crc32", "size")
    position = F.col("before") + F.col("r") - 1
    ordered = placed.withColumn("r", F.row_number().over(within)).join(slices, "slice").withColumn("at", position)
    shard = F.expr(f"(at * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    cut = ordered.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("at") - first).cast("long"))
    return cut.select("doc_id", "size", "text_crc32", "source", F.lit("rows").alias("law"), "shard", "slot")
