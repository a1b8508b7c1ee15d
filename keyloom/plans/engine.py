"""The engine: registered tables under one root, ordered batches over them, and residency in memory."""

from __future__ import annotations

import logging
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom import ops
from keyloom.config import Options
from keyloom.errors import NullKey, WrongType
from keyloom.operators import read, replay
from keyloom.plans.table import Table
from keyloom.schema import Database, TableDef


class Engine:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.options = options or Options()
        self.database = Database()
        self.residency = Residency(self)
        self._tables: dict[str, Table] = {}
        #: Streaming queries that write into these tables.
        self.streams: list = []
        logging.getLogger("keyloom").setLevel(self.options.trace.upper())

    def register(self, definition: TableDef) -> Table:
        self.database.register(definition)
        return self._tables.setdefault(definition.name, Table(self, definition))

    def table(self, name: str) -> Table:
        self.database[name]
        return self._tables[name]

    def batch(self) -> Batch:
        return Batch(self)

    def compact(self) -> None:
        for table in self._tables.values():
            table.compact()

    def close(self, compact: bool = False) -> None:
        """Let streams end their micro-batch and stop, compact if asked to, leave memory. What was acknowledged is on disk already."""
        while self.streams:
            query = self.streams.pop()
            if query.isActive:
                query.processAllAvailable()
                query.stop()
        if compact:
            self.compact()
        self.residency.clear()


class Batch:
    """Operations in order, over any tables; each sees those before it. Not atomic across tables."""

    def __init__(self, engine: Engine):
        self.engine, self.id, self.ops = engine, uuid.uuid4().hex, []

    def add(self, op) -> Batch:
        self.engine.database[op.table]
        self.ops.append(op)
        return self

    def execute(self) -> Result:
        """Append each table's intents to its log, then answer every operation."""
        answers, frames = [], {}
        for name in dict.fromkeys(op.table for op in self.ops):
            table = self.engine.table(name)
            mine = [(i, op) for i, op in enumerate(self.ops) if op.table == name]
            with table.locked():
                first = table.next_seq()
                intents = [ops.intent_tuple(table.definition, first + i, op) for i, op in mine if not isinstance(op, ops.Get)]
                if any(v is None for x in intents for v in x[2 : 2 + len(table.definition.identity)]):
                    raise NullKey(name)
                before, base = table.intents(), table.snapshot()
                new = self.engine.spark.createDataFrame(intents, table.definition.intents)
                if intents:
                    table.append(new)
            answers.append(self._acks(table, before, new, base, first, bool(intents)))
            frames |= self._gets(table, [(i, op) for i, op in mine if isinstance(op, ops.Get)], before.unionByName(new), base, first)
        return Result(self, [a for a in answers if a is not None], frames)

    def _acks(self, table: Table, before: DataFrame, new: DataFrame, base: DataFrame | None, first: int, some: bool) -> DataFrame | None:
        if not some:
            return None
        keys = new.select(*table.definition.identity).distinct()
        log = before.join(F.broadcast(keys), list(table.definition.identity), "left_semi").select(*before.columns)
        found = replay.acks(table.definition, log.unionByName(new), base).where(F.col("_seq") >= first)
        return found.select((F.col("_seq") - first).alias("index"), F.col("ack").alias("ok"))

    def _gets(self, table: Table, gets: list, log: DataFrame, base: DataFrame | None, first: int) -> dict[int, DataFrame]:
        if not gets:
            return {}
        d = table.definition
        asked = [(i, first + i, pos, *ops.as_tuple(k)) for i, op in gets for pos, k in enumerate(op.keys)]
        columns = ", ".join(["_index long, _seq long, _pos long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in d.fields(d.key))])
        wanted = self.engine.spark.createDataFrame(asked, columns)
        touched = base.join(F.broadcast(wanted.select(*d.key).distinct()), list(d.key), "left_semi").select(*d.schema.names) if base is not None else None
        seen = replay.as_of(d, wanted, replay.with_snapshot(d, log, touched))
        out = {}
        for i, op in gets:
            found = seen.where(F.col("_index") == i).drop("_index")
            if op.where is not None:
                found = found.where(op.where)
            if op.sort_keys is not None:
                found = found.where(read._all([F.col(c).isin([ops.as_tuple(k)[n] for k in op.sort_keys]) for n, c in enumerate(d.sort)]))
            out[i] = read.limited(d, found, op.limit if d.sort else None, op.compat_limit)
        return out


VERBS = {ops.Insert: "insert", ops.Get: "get", ops.Delete: "delete", ops.Update: "update"}


class Result:
    def __init__(self, batch: Batch, acks: list[DataFrame], frames: dict[int, DataFrame]):
        self.batch, self._acks, self._frames = batch, acks, frames

    def responses(self) -> DataFrame:
        """bundle_id, index, table, verb, ok (for a get: whether there are rows), end; a row for each operation."""
        spark, ops_ = self.batch.engine.spark, self.batch.ops
        listed = spark.createDataFrame([(i, op.table, VERBS[type(op)], i == len(ops_) - 1) for i, op in enumerate(ops_)], "index long, table string, verb string, end boolean")
        found = list(self._acks)
        for i, frame in self._frames.items():
            found.append(frame.limit(1).select(F.lit(i).cast("long").alias("index"), F.lit(True).alias("ok")))
        out = listed.withColumn("ok", F.lit(False)) if not found else None
        if out is None:
            merged = found[0]
            for f in found[1:]:
                merged = merged.unionByName(f)
            out = listed.join(merged, "index", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
        return out.select(F.lit(self.batch.id).alias("bundle_id"), "index", "table", "verb", "ok", "end")

    def rows(self, index: int, table: str | None = None) -> DataFrame:
        """The rows that a get of the batch saw, in the order of the request and the sort columns."""
        op = self.batch.ops[index]
        if not isinstance(op, ops.Get) or table not in (None, op.table):
            raise WrongType(f"response {index} is of {VERBS[type(op)]} on {op.table}")
        return read.order_of(self.batch.engine.database[op.table], self._frames[index])

    def skip(self, n: int) -> DataFrame:
        """The responses after the first n of them (all for n of 0 or less)."""
        return self.responses().where(F.col("index") >= max(0, n))

    def first(self, index: int, table: str | None = None):
        return self.rows(index, table).limit(1).first()

    def __iter__(self):
        """Responses in order of index, one at a time."""
        return self.responses().orderBy("index").toLocalIterator()


class Residency:
    """Tables held in memory, the least recently used leaving first once they hold more than options.memory."""

    def __init__(self, engine: Engine):
        self.engine, self.held = engine, OrderedDict()

    def load(self, name: str) -> DataFrame:
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        frame = self.engine.table(name).stored().cache()
        frame.count()
        self.held[name] = frame
        self.evict()
        return frame

    def held_rows(self, name: str) -> DataFrame | None:
        """What is held of a table, which counts as a use of it; None if it isn't."""
        if name in self.held:
            self.held.move_to_end(name)
        return self.held.get(name)

    def written(self, name: str) -> None:
        """A write makes what is held stale."""
        if name in self.held:
            self.held.pop(name).unpersist()

    def size(self) -> int:
        """Bytes that the tables held here take; what else the session has cached isn't counted."""
        manager = self.engine.spark._jsparkSession.sharedState().cacheManager()
        sizes = 0
        for frame in self.held.values():
            found = manager.lookupCachedData(frame._jdf)
            if found.isDefined():
                sizes += int(str(found.get().cachedRepresentation().cacheBuilder().sizeInBytesStats().value()))
        return sizes

    def evict(self) -> list[str]:
        """If over the limit, free the configured share of what is in use."""
        gone, used = [], self.size()
        if used > self.engine.options.memory:
            goal = used * (1 - self.engine.options.freed)
            while self.held and self.size() > goal:
                name, frame = self.held.popitem(last=False)
                logging.getLogger("keyloom.residency").info("%s leaves memory", name)
                frame.unpersist(blocking=True)
                gone.append(name)
        return gone

    def clear(self) -> None:
        while self.held:
            self.held.popitem()[1].unpersist()
