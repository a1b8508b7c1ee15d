"""Table definitions: a fixed schema, a key, and for sorted tables the columns that order a key's rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import ImmutableColumn, SchemaMismatch, UnknownTable


@dataclass(frozen=True)
class TableDef:
    """One row for each key, or, with sort, one for each (key, sort). updatable: None is all other columns."""

    name: str
    schema: T.StructType
    key: tuple[str, ...]
    sort: tuple[str, ...] = ()
    updatable: tuple[str, ...] | None = None
    ephemeral: bool = False

    def __post_init__(self):
        names = self.schema.names
        if not self.key or not names or len(set(names)) != len(names):
            raise SchemaMismatch(f"{self.name}: a table has distinct columns and a key")
        if bad := [c for c in (*self.identity, *(self.updatable or ())) if c not in names]:
            raise SchemaMismatch(f"{self.name}: no such columns: {bad}")
        if bad := [c for c in names if c.startswith("_")]:
            raise SchemaMismatch(f"{self.name}: names with a leading underscore are the engine's: {bad}")
        if bad := [c for c in self.updatable or () if c in self.identity]:
            raise ImmutableColumn(f"{self.name}: {bad}")

    @property
    def identity(self) -> tuple[str, ...]:
        return (*self.key, *self.sort)

    @property
    def changeable(self) -> tuple[str, ...]:
        return self.updatable if self.updatable is not None else tuple(c for c in self.schema.names if c not in self.identity)

    def fields(self, names) -> list[T.StructField]:
        return [self.schema[c] for c in names]

    @property
    def intents(self) -> T.StructType:
        """The change log: a row for each operation. In _set, a null struct says that the column isn't changed."""
        changes = T.StructType([T.StructField(c, T.StructType([T.StructField("v", self.schema[c].dataType)])) for c in self.changeable])
        own = [T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType())]
        return T.StructType([*own, *self.fields(self.identity), T.StructField("_row", self.schema), T.StructField("_set", changes)])

    def checked(self, df: DataFrame) -> DataFrame:
        """df in the order of the schema; other columns or types are refused."""
        want = {f.name: f.dataType.simpleString() for f in self.schema.fields}
        if want != dict(df.dtypes):
            raise SchemaMismatch(f"{self.name}: {want} expected, {dict(df.dtypes)} given")
        return df.select(*self.schema.names)

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")


@dataclass
class Database:
    tables: dict[str, TableDef] = field(default_factory=dict)

    def register(self, table: TableDef) -> TableDef:
        if self.tables.get(table.name, table) != table:
            raise SchemaMismatch(f"{table.name} is registered otherwise")
        self.tables[table.name] = table
        return table

    def __getitem__(self, name: str) -> TableDef:
        if name not in self.tables:
            raise UnknownTable(name)
        return self.tables[name]
