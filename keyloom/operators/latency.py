"""Latency reports: the percentiles of samples, merged workers, and the difference from an earlier run."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.sources.store import Store

PERCENTILES = {"p99": 0.99, "p95": 0.95, "p90": 0.90, "p50": 0.50}
#: Slower than before by more than this share is a regression.
REGRESSION = 0.02
#: Of the approximate quantiles: a rank is off by a group's size over this at most.
ACCURACY = 10_000
#: Groups below this size are counted whole.
SMALL = 100_000


def _selected(samples: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by, whole (n, min, max, average, total) and the exact values at the given shares; null samples don't count.

    No group is sorted. A first pass gives each group's measures and, by approximate quantiles of a known error, two
    values around each wanted one. A second counts what lies below the two, and the values between them one by
    one: about ``6 / ACCURACY`` of a group, or all of one of fewer than ``SMALL`` samples.
    """
    rows = samples.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    edges = [F.lit(min(1.0, max(0.0, p + side * 3 / ACCURACY))) for p in shares.values() for side in (-1, 1)]
    measures = (F.count("*").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("average"), F.sum("_v").alias("total"))
    first = rows.groupBy(*by).agg(F.struct(*measures).alias("_whole"), F.percentile_approx("_v", F.array(*edges), F.lit(ACCURACY)).alias("_edges"))
    groups = first.select(*(F.col(c).alias(f"_by_{c}") for c in by), "_whole", "_edges")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    small = F.col("_whole")["n"] < SMALL

    def around(k: int) -> Column:
        low, high = (F.when(small, F.col("_whole")[m]).otherwise(F.col("_edges")[2 * k + i]) for i, m in enumerate(("min", "max")))
        counted = F.struct(F.lit(k).alias("k"), F.when(F.col("_v") >= low, F.col("_v")).alias("v"))
        return F.when(F.col("_v") <= high, counted)

    near = rows.join(groups, same).select(*by, "_whole", F.explode(F.array_compact(F.array(*map(around, range(len(shares)))))).alias("_near"))
    counts = near.groupBy(*by, "_whole", F.col("_near.k").alias("_k"), F.col("_near.v").alias("_v")).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*by, "_k").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("_upto", F.sum("_c").over(upto))
    n = F.col("_whole")["n"]
    found = []
    for k, (name, p) in enumerate(shares.items()):
        at = F.least(F.ceil(n * F.lit(p)), n - 1)
        found.append(F.min(F.when((F.col("_k") == k) & (F.col("_upto") > at), F.col("_v"))).alias(name))
    return running.groupBy(*by, "_whole").agg(*found)


def percentile(rows: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """by and the value at index min(ceil(n * p), n - 1), counted from 0 in ascending order."""
    return _selected(rows, by, value, {value: p}).select(*by, value)


def report(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, n, min, max, average, total and the percentiles."""
    return _selected(samples, by, value, PERCENTILES).select(*by, "_whole.*", *PERCENTILES)


def merge(workers: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, workers)


def compare(now: dict[str, float], before: dict[str, float]) -> dict[str, dict]:
    """For each measure in both: change as a share, and whether it is a regression."""
    out = {}
    for k in now.keys() & before.keys():
        change = (now[k] - before[k]) / before[k] if before[k] else 0.0
        out[k] = {"change": change, "regression": change > REGRESSION}
    return out


def save(spark: SparkSession, path: str, result: dict) -> None:
    """Into a file on whatever file system Spark reaches; all or nothing."""
    folder, _, name = path.rpartition("/")
    Store(spark, folder).write(name, json.dumps(result, sort_keys=True))


def load(spark: SparkSession, path: str) -> dict:
    folder, _, name = path.rpartition("/")
    store = Store(spark, folder)
    return json.loads(store.read(name)) if store.exists(name) else {}
