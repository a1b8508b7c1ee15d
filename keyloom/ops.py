"""The four verbs, and frames of intents made from them or from whole frames of rows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.errors import ImmutableColumn, SchemaMismatch
from keyloom.schema import TableDef

Key = Any  # one value, or a tuple for keys of several columns


def as_tuple(key: Key) -> tuple:
    return key if isinstance(key, tuple) else (key,)


@dataclass(frozen=True)
class Insert:
    table: str
    row: dict


@dataclass(frozen=True)
class Get:
    """keys: in the order of the answer, repeats repeat. where: a predicate, or what TableFilter makes of a value."""

    table: str
    keys: tuple
    where: Column | None = None
    limit: int | None = None
    sort_keys: tuple | None = None
    compat_limit: bool = False


@dataclass(frozen=True)
class Delete:
    table: str
    key: Key
    sort: Key = ()


@dataclass(frozen=True)
class Update:
    table: str
    key: Key
    set: dict
    sort: Key = ()


def _nothing(table: TableDef, name: str) -> Column:
    return F.lit(None).cast(table.intents[name].dataType)


def insert_intents(table: TableDef, rows: DataFrame, seq: Column) -> DataFrame:
    rows = table.checked(rows)
    own = F.struct(*table.schema.names)
    return rows.select(seq.alias("_seq"), F.lit("insert").alias("_op"), *table.identity, own.alias("_row"), _nothing(table, "_set").alias("_set"))


def delete_intents(table: TableDef, keys: DataFrame, seq: Column) -> DataFrame:
    return keys.select(seq.alias("_seq"), F.lit("delete").alias("_op"), *table.identity, _nothing(table, "_row").alias("_row"), _nothing(table, "_set").alias("_set"))


def update_intents(table: TableDef, changes: DataFrame, seq: Column) -> DataFrame:
    """changes: the identity columns and the columns to set; a null there sets null."""
    given = [c for c in changes.columns if c not in table.identity]
    check_settable(table, given)
    kind = table.intents["_set"].dataType
    one = F.struct(*((F.struct(F.col(c).alias("v")) if c in given else F.lit(None).cast(kind[c].dataType)).alias(c) for c in table.changeable))
    return changes.select(seq.alias("_seq"), F.lit("update").alias("_op"), *table.identity, _nothing(table, "_row").alias("_row"), one.cast(kind).alias("_set"))


def check_settable(table: TableDef, names) -> None:
    if bad := [c for c in names if c in table.identity]:
        raise ImmutableColumn(f"{table.name}: {bad}")
    if bad := [c for c in names if c not in table.changeable]:
        raise SchemaMismatch(f"{table.name}: can't be set: {bad}")


def intent_tuple(table: TableDef, seq: int, op: Insert | Delete | Update | Get, key: tuple | None = None) -> tuple:
    """One operation as a row of the intent schema."""
    if isinstance(op, Insert):
        if set(op.row) != set(table.schema.names):
            raise SchemaMismatch(f"{table.name}: {sorted(op.row)}")
        row = tuple(op.row[c] for c in table.schema.names)
        return (seq, "insert", *(op.row[c] for c in table.identity), row, None)
    identity = (*as_tuple(op.key), *(as_tuple(op.sort) if op.sort != () else ()))
    if len(identity) != len(table.identity):
        raise SchemaMismatch(f"{table.name}: a key has {table.identity}")
    if isinstance(op, Delete):
        return (seq, "delete", *identity, None, None)
    check_settable(table, op.set)
    return (seq, "update", *identity, None, tuple((op.set[c],) if c in op.set else None for c in table.changeable))
