"""Replay of a change log, as expressions: no state is carried by code, so batch, stream and SQL agree.

All functions take a frame of intents (TableDef.intents) and return a frame. Order is by _seq for each key; input
order and partitioning don't matter. A snapshot takes part as inserts before everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.schema import TableDef

#: _seq of a snapshot's rows.
BEFORE = -1


def _anchors() -> Column:
    return F.col("_op").isin("insert", "delete")


def with_snapshot(table: TableDef, intents: DataFrame, snapshot: DataFrame | None) -> DataFrame:
    if snapshot is None:
        return intents
    from keyloom.ops import insert_intents

    return intents.unionByName(insert_intents(table, snapshot, F.lit(BEFORE).cast("long")))


def _earlier(table: TableDef):
    return Window.partitionBy(*table.identity).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)


def _alive(table: TableDef) -> Column:
    last = F.last(F.when(_anchors(), F.col("_op")), ignorenulls=True).over(_earlier(table))
    return F.coalesce(last == "insert", F.lit(False))


def acks(table: TableDef, intents: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """identity, _seq, _op, ack: inserts are always true, the others say whether the row was there."""
    touched = touched_rows(table, snapshot, intents)
    marked = with_snapshot(table, intents, touched).withColumn("alive", _alive(table))
    ack = F.when(F.col("_op") == "insert", True).otherwise(F.col("alive"))
    return marked.where(F.col("_seq") > BEFORE).select(*table.identity, "_seq", "_op", ack.alias("ack"))


def seen_by_gets(table: TableDef, intents: DataFrame, columns: list[str], snapshot: DataFrame | None = None) -> DataFrame:
    """identity, _seq and the given columns as they were at each successful get of its own log."""
    touched = touched_rows(table, snapshot, intents)
    marked = with_snapshot(table, intents, touched).withColumn("alive", _alive(table))

    def then(c: str) -> Column:
        # in a struct, as a null is a value too
        fresh = F.when(F.col("_op") == "insert", F.struct(F.col("_row")[c].alias("v")))
        if c in table.changeable:
            fresh = fresh.when((F.col("_op") == "update") & F.col("alive"), F.col("_set")[c])
        return F.last(fresh, ignorenulls=True).over(_earlier(table))["v"].alias(c)

    kept = [c for c in columns if c not in table.identity]
    seen = marked.select(*table.identity, "_seq", "_op", "alive", *map(then, kept))
    return seen.where((F.col("_op") == "get") & F.col("alive")).select(*table.identity, "_seq", *kept)


def touched_rows(table: TableDef, snapshot: DataFrame | None, intents: DataFrame) -> DataFrame | None:
    """The snapshot's rows whose identity has an intent."""
    if snapshot is None:
        return None
    keys = intents.select(*table.identity).distinct()
    return snapshot.join(keys, list(table.identity), "left_semi").select(*table.schema.names)


def folded(table: TableDef, intents: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, identity, _anchor (the last insert or delete) and _last_<column>: the last time each was set.

    One aggregation with map-side combining, so a hot key costs a row for each task and not a task for the key.
    """
    anchor = F.max_by(F.struct("_seq", "_op", "_row"), F.when(_anchors(), F.col("_seq"))).alias("_anchor")
    sets = []
    for c in table.changeable:
        when = F.when((F.col("_op") == "update") & F.col("_set")[c].isNotNull(), F.col("_seq"))
        sets.append(F.max_by(F.struct(F.col("_seq").alias("seq"), F.col("_set")[c]["v"].alias("v")), when).alias(f"_last_{c}"))
    return intents.where(F.col("_op") != "get").groupBy(*by, *table.identity).agg(anchor, *sets, F.max("_seq").alias("_last"))


def standing(table: TableDef, fold: DataFrame, by: tuple[str, ...] = (), extra: tuple[Column, ...] = ()) -> DataFrame:
    """The rows that are there after a fold: a column set after the last insert has that value."""

    def value(c: str) -> Column:
        if c in table.identity:
            return F.col(c)
        base = F.col("_anchor")["_row"][c]
        if c not in table.changeable:
            return base.alias(c)
        last = F.col(f"_last_{c}")
        return F.when(last["seq"] > F.col("_anchor")["_seq"], last["v"]).otherwise(base).alias(c)

    return fold.where(F.col("_anchor")["_op"] == "insert").select(*by, *map(value, table.schema.names), *extra)


def state(table: TableDef, intents: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """All rows at the end of the log. Rows of the snapshot that the log doesn't touch aren't folded or moved."""
    if snapshot is None:
        return standing(table, folded(table, intents))
    touched = touched_rows(table, snapshot, intents)
    changed = standing(table, folded(table, with_snapshot(table, intents, touched)))
    keys = intents.where(F.col("_op") != "get").select(*table.identity).distinct()
    return snapshot.join(keys, list(table.identity), "left_anti").select(*table.schema.names).unionByName(changed)


def as_of(table: TableDef, wanted: DataFrame, intents: DataFrame) -> DataFrame:
    """For each wanted (_index, _seq, _pos and key columns): the rows of that key just before _seq."""
    asked = wanted.select(F.col("_seq").alias("_until"), "_index", "_pos", *table.key)
    before = intents.join(asked, list(table.key)).where(F.col("_seq") < F.col("_until"))
    by = ("_index", "_pos")
    return standing(table, folded(table, before, by), by)


def mutated(table: TableDef, intents: DataFrame, mutate, payload: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Final rows where updates are a user's code: mutate(row: dict, payload) -> dict, in order, for each key.

    Only for what set-style updates can't say; a key's intents meet in one task.
    """
    rows = with_snapshot_payload(table, intents, snapshot, payload)

    def fold(frame):
        import pandas as pd

        row = None
        for one in frame.sort_values("_seq").to_dict("records"):
            if one["_op"] == "insert":
                row = dict(one["_row"]) if not isinstance(one["_row"], dict) else one["_row"]
            elif one["_op"] == "delete":
                row = None
            elif one["_op"] == "update" and row is not None:
                changed = mutate(dict(row), one[payload])
                row = changed | {c: row[c] for c in table.identity}
        return pd.DataFrame([row] if row is not None else [], columns=table.schema.names)

    return rows.groupBy(*table.identity).applyInPandas(fold, table.schema)


def mutated_by(table: TableDef, intents: DataFrame, change, payload: str, snapshot: DataFrame | None = None) -> DataFrame:
    """Final rows where updates are an expression: change(row, payload) gives new values of columns that may change.

    As mutated(), without Python: a key's intents since its last insert or delete are sorted and folded as one array.
    """
    rows = with_snapshot_payload(table, intents, snapshot, payload).where(F.col("_op") != "get")
    anchors = rows.groupBy(*table.identity).agg(F.max_by(F.struct("_seq", "_op", "_row"), F.when(_anchors(), F.col("_seq"))).alias("_anchor"))
    anchors = anchors.where(F.col("_anchor")["_op"] == "insert")
    updates = rows.where(F.col("_op") == "update").select(*table.identity, F.struct("_seq", F.col(payload).alias("given")).alias("_update"))
    later = updates.join(anchors, list(table.identity)).where(F.col("_update")["_seq"] > F.col("_anchor")["_seq"])
    listed = later.groupBy(*table.identity).agg(F.array_sort(F.collect_list("_update")).alias("_updates"))
    start = F.col("_anchor")["_row"]

    def step(row: Column, update: Column) -> Column:
        given = change(row, update["given"])
        return F.struct(*(given.get(c, row[c]).cast(table.schema[c].dataType).alias(c) for c in table.schema.names))

    joined = anchors.join(listed, list(table.identity), "left")
    none = F.array().cast(listed.schema["_updates"].dataType)
    first = F.struct(*((F.col(c) if c in table.identity else start[c]).alias(c) for c in table.schema.names))
    return joined.select(F.aggregate(F.coalesce("_updates", none), first, step).alias("_row")).select("_row.*")


def with_snapshot_payload(table: TableDef, intents: DataFrame, snapshot: DataFrame | None, payload: str) -> DataFrame:
    kept = intents.select("_seq", "_op", *table.identity, "_row", payload)
    if snapshot is None:
        return kept
    seeds = with_snapshot(table, intents.limit(0).drop(payload), snapshot).withColumn(payload, F.lit(None).cast(intents.schema[payload].dataType))
    return kept.unionByName(seeds.select(*kept.columns))
