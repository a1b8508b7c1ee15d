"""Reads: point and multi-key gets with filters, in sort order, with limits; skips over responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.errors import NullKey
from keyloom.ops import as_tuple
from keyloom.schema import TableDef

#: Key lists of up to so many keys become an IN list, which reaches the scan; longer ones are joined.
PUSHED_KEYS = 1000


def requested(table: TableDef, keys, spark) -> DataFrame:
    """_pos and key columns: the keys in the order of the request, repeats kept."""
    rows = [(pos, *as_tuple(k)) for pos, k in enumerate(keys)]
    if any(v is None for _, *key in rows for v in key):
        raise NullKey(table.name)
    columns = ", ".join(["_pos long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in table.fields(table.key))])
    return spark.createDataFrame(rows, columns)


def key_filter(table: TableDef, keys) -> Column | None:
    """An expression that holds for rows of these keys at least; None if there are too many to push."""
    distinct = {as_tuple(k) for k in keys}
    if len(distinct) > PUSHED_KEYS:
        return None
    if not distinct:
        return F.lit(False)
    parts = [F.col(c).isin([k[i] for k in distinct]) for i, c in enumerate(table.key)]
    return _all(parts)


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def get(table: TableDef, rows: DataFrame, keys, where: Column | None = None, limit: int | None = None, sort_keys=None, compat_limit: bool = False) -> DataFrame:
    """_pos and the rows of the keys: in the order of the request, then in sort order (order_of() sorts a result).

    The filter comes before the limit. limit is strict; compat_limit keeps every key's first row besides.
    """
    picked = rows if (pushed := key_filter(table, keys)) is None else rows.where(pushed)
    if where is not None:
        picked = picked.where(where)
    if sort_keys is not None:
        picked = picked.where(_all([F.col(c).isin([as_tuple(k)[i] for k in sort_keys]) for i, c in enumerate(table.sort)]))
    found = picked.join(requested(table, keys, rows.sparkSession), list(table.key)).select("_pos", *table.schema.names)
    return limited(table, found, limit, compat_limit)


def get_many(table: TableDef, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a frame of keys, each row of it answered."""
    return rows.join(keys.select(*table.key), list(table.key)).select(*table.schema.names)


def limited(table: TableDef, found: DataFrame, limit: int | None, compat: bool = False) -> DataFrame:
    """The first rows in the order of the request and the sort columns; compat keeps every key's first row besides."""
    if limit is None:
        return found
    if not compat:
        return found.orderBy("_pos", *table.sort).limit(limit)
    # a row's place is the rows of the keys before its own (a count for each key) and its place in its key
    counts = found.groupBy("_pos").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_pos", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_pos").orderBy(*(table.sort or ["_pos"]))
    ranked = found.withColumn("_p", F.row_number().over(own)).join(firsts, "_pos")
    keep = (F.col("_before") + F.col("_p") <= limit) | (F.col("_p") == 1)
    return ranked.where(keep).select(*found.columns)


def order_of(table: TableDef, found: DataFrame) -> DataFrame:
    return found.orderBy("_pos", *table.sort).drop("_pos")


def first(table: TableDef, found: DataFrame) -> DataFrame:
    """The first row in the order of the request and the sort columns."""
    return found.orderBy("_pos", *table.sort).limit(1).drop("_pos")


def latest(rows: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Upsert by key: of each identity the row that is greatest in the given columns, the first of them counting most.

    One aggregation with map-side combining, so a hot key is a row for each task.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_best")
    return rows.groupBy(*identity).agg(best).select("_best.*")


def skip(responses: DataFrame, n: int, order: str) -> DataFrame:
    """All but the first n (none for n of 0 or less) in order, numbered from 1 in idx; order is of distinct values.

    A row's number is the rows of the ranges before its own (a count for each range) and its place in its range.
    """
    ranges = max(1, min(64, int(responses.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    edges = responses.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    dealt = responses.withColumn("_range", sum((F.when(F.col(order) > F.lit(e), 1).otherwise(0) for e in sorted(set(edges or []))), F.lit(0)))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    firsts = counts.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    numbered = dealt.withColumn("_place", place).join(F.broadcast(firsts), "_range").withColumn("idx", F.col("_before") + F.col("_place"))
    return numbered.where(F.col("idx") > max(0, n)).select(*responses.columns, "idx")
