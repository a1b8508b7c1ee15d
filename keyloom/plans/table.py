"""A table: its change log, its snapshots, and the reads and writes on top of them.

Files of a table:

    CURRENT                      what readers resolve once: bucket -> snapshot version, first uncompacted generation
    log/gen=G/batch=B/           intents; a batch counts once Spark's _SUCCESS is in it, so a torn one is unseen
    snapshots/v=V/b=K/           rows of one bucket of the key's hash, sorted

A write is one appended batch; its acknowledgements are read from log and snapshot after that. Compaction folds
the buckets that the log touches into a new version, publishes it, and only then may old files go (collect()).
"""

from __future__ import annotations

import logging
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom import ops
from keyloom.errors import NullKey
from keyloom.operators import read, replay
from keyloom.schema import TableDef
from keyloom.sources.store import Store

log_ = logging.getLogger("keyloom.table")

CURRENT, LOCK, LAST = "CURRENT", "LOCK", "_last-"


class Table:
    def __init__(self, engine, definition: TableDef):
        self.engine, self.spark, self.definition = engine, engine.spark, definition
        self.options = engine.options.of(definition.name)
        self.store = None if definition.ephemeral else Store(engine.spark, f"{engine.root}/{definition.name}")
        self._memory: list[DataFrame] = []
        #: The greatest sequence of each batch that this writer knows.
        self._last: dict[str, int] = {}

    # Files

    def manifest(self) -> dict:
        found = self.store.published(CURRENT) if self.store else None
        return found or {"buckets": self.options.buckets, "versions": {}, "first": 0, "next_version": 0, "next_seq": 0}

    @contextmanager
    def locked(self):
        if self.store is None:
            yield
            return
        self.store.lock(LOCK)
        try:
            yield
        finally:
            self.store.unlock(LOCK)

    def break_lock(self) -> None:
        """Remove the lock of a writer that died; its unfinished batch or version stays unseen.

        For an operator who knows that no writer is at work: nothing here tells a slow writer from a dead one.
        """
        if self.store is not None:
            self.store.unlock(LOCK)
            self._last.clear()

    def generations(self) -> list[int]:
        """Uncompacted generations of the log, whichever of them were closed."""
        first = self.manifest()["first"]
        return sorted(g for g in (int(n.removeprefix("gen=")) for n in self.store.names("log")) if g >= first)

    def generation(self) -> int:
        return max([*self.generations(), self.manifest()["first"]])

    def _batches(self, upto: int | None = None) -> list[str]:
        found = []
        for g in self.generations():
            if upto is None or g < upto:
                folder = f"log/gen={g}"
                found += [f"{folder}/{n}" for n in self.store.names(folder) if self.store.exists(f"{folder}/{n}/_SUCCESS")]
        return found

    def intents(self, upto: int | None = None) -> DataFrame:
        """The committed log (its generations before upto)."""
        if self.store is None:
            return reduce(DataFrame.unionByName, self._memory) if self._memory else self.spark.createDataFrame([], self.definition.intents)
        paths = [self.store.url(b) for b in self._batches(upto)]
        return self.spark.read.schema(self.definition.intents).parquet(*paths) if paths else self.spark.createDataFrame([], self.definition.intents)

    def snapshot(self, buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of the current snapshot, or of some of its buckets: other folders aren't opened."""
        if self.store is None:
            return None
        versions = self.manifest()["versions"]
        paths = [self.store.url(f"snapshots/v={v}/b={b}") for b, v in sorted(versions.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.definition.schema).parquet(*paths) if paths else None

    def next_seq(self) -> int:
        """One more than the greatest sequence so far: each batch has its own in the name of a file, so the log isn't read."""
        names = map(str, range(len(self._memory))) if self.store is None else self._batches()
        known = [self._last_of(name) for name in names]
        return max([self.manifest()["next_seq"], *known]) + 1

    def _last_of(self, batch: str) -> int:
        if batch not in self._last:
            noted = [n for n in self.store.names(batch) if n.startswith(LAST)] if self.store is not None else []
            self._last[batch] = int(noted[-1].removeprefix(LAST)) if noted else self._counted(batch)
        return self._last[batch]

    def _counted(self, batch: str) -> int:
        """Of a batch whose writer died before it left a note, or that is held in memory."""
        rows = self._memory[int(batch)] if self.store is None else self.spark.read.schema(self.definition.intents).parquet(self.store.url(batch))
        last = rows.agg(F.max("_seq")).first()[0]
        return -1 if last is None else last

    # Writes

    def append(self, intents: DataFrame, batch: str | None = None) -> None:
        """Commit intents to the log. A named batch that is written again replaces itself."""
        self.engine.residency.written(self.definition.name)
        if self.store is None:
            self._memory.append(intents.cache())
            return
        self.rotate_if_full()
        folder = f"log/gen={self.generation()}"
        if batch is not None:
            again = [b for b in self._all_batches() if b.endswith(f"/batch={batch}")]
            folder = again[0].rpartition("/")[0] if again else folder
        path = f"{folder}/batch={batch or f'{self.next_seq():020d}'}"
        self._last.pop(path, None)
        intents.select(*self.definition.intents.names).write.mode("overwrite").parquet(self.store.url(path))
        self.store.write(f"{path}/{LAST}{self._counted(path)}", "")

    def _all_batches(self) -> list[str]:
        return [f"log/gen={g}/{n}" for g in self.generations() for n in self.store.names(f"log/gen={g}")]

    def _numbered(self) -> Column:
        return F.lit(self.next_seq()) + F.monotonically_increasing_id()

    def _no_null_keys(self, df: DataFrame) -> DataFrame:
        """Fails the job at the first row with a null in its key."""
        bad = F.lit(False)
        for c in self.definition.identity:
            bad = bad | F.col(c).isNull()
        first = self.definition.key[0]
        kind = self.definition.schema[first].dataType
        message = F.lit(f"null key in {self.definition.name}")
        return df.withColumn(first, F.when(bad, F.raise_error(message).cast(kind)).otherwise(F.col(first)))

    def _commit(self, intents: DataFrame) -> None:
        try:
            self.append(intents)
        except Exception as e:
            if "null key in" in str(e):
                raise NullKey(self.definition.name) from e
            raise

    def insert(self, rows: DataFrame) -> None:
        """Upsert every row (later rows of one key win); always acknowledged."""
        with self.locked():
            self._commit(ops.insert_intents(self.definition, self._no_null_keys(self.definition.checked(rows)), self._numbered()))
        self.maintain()

    def delete(self, keys: DataFrame) -> DataFrame:
        """Delete by identity columns; returns them with ack: whether the row was there."""
        with self.locked():
            first = self.next_seq()
            self._commit(ops.delete_intents(self.definition, self._no_null_keys(keys), self._numbered()))
        return self._answered(first)

    def update(self, changes: DataFrame) -> DataFrame:
        """Set the given columns of the rows named by the identity columns; returns acks."""
        with self.locked():
            first = self.next_seq()
            self._commit(ops.update_intents(self.definition, self._no_null_keys(changes), self._numbered()))
        return self._answered(first)

    def _answered(self, first: int) -> DataFrame:
        """The acknowledgements, over files that a compaction leaves where they are."""
        found = self.acks(first)
        self.maintain()
        return found

    def acks(self, first: int) -> DataFrame:
        """Acknowledgements from sequence first on; only the history of the keys that they are about is read back."""
        log = self.intents()
        keys = log.where(F.col("_seq") >= first).select(*self.definition.identity).distinct()
        mine = log.join(keys, list(self.definition.identity), "left_semi").select(*log.columns)
        found = replay.acks(self.definition, mine, self.snapshot()).where(F.col("_seq") >= first)
        return found.select(*self.definition.identity, "ack")

    # Reads

    def rows(self) -> DataFrame:
        """All rows: those held in memory, if the engine holds the table, else from log and snapshot."""
        held = self.engine.residency.held_rows(self.definition.name)
        return self.stored() if held is None else held

    def stored(self) -> DataFrame:
        return replay.state(self.definition, self.intents(), self.snapshot())

    def get(self, keys, where: Column | None = None, limit: int | None = None, sort_keys=None, compat_limit: bool = False) -> DataFrame:
        """_pos and rows, as read.get. A resident table answers from memory; else only the buckets and row groups of these keys are read."""
        keys = list(keys)
        held = self.engine.residency.held_rows(self.definition.name)
        if held is not None:
            return read.get(self.definition, held, keys, where, limit, sort_keys, compat_limit)
        wanted = read.requested(self.definition, keys, self.spark)
        few = len(keys) <= read.PUSHED_KEYS
        pushed = read.key_filter(self.definition, keys)
        log = self.intents() if pushed is None else self.intents().where(pushed)
        buckets = None
        if few and self.store is not None:
            n = self.manifest()["buckets"]
            buckets = {r[0] for r in wanted.select(self.definition.bucket(n)).distinct().collect()}
        base = self.snapshot(buckets)
        if base is not None and pushed is not None:
            base = base.where(pushed)
        return read.get(self.definition, replay.state(self.definition, log, base), keys, where, limit, sort_keys, compat_limit)

    def get_many(self, keys: DataFrame) -> DataFrame:
        """The rows of a frame of keys, each row of it answered."""
        return read.get_many(self.definition, self.rows(), keys)

    # Maintenance

    def rotate(self) -> int:
        """Close the generation; the next write opens another."""
        if self.store is None:
            return 0
        fresh = self.generation() + 1
        self.store.write(f"log/gen={fresh}/.open", "")
        return fresh

    def rotate_if_full(self) -> None:
        if self.store.size(f"log/gen={self.generation()}") > self.options.log_bytes:
            self.rotate()

    def compact(self) -> int | None:
        """Fold the log into the snapshot: touched buckets get a new version. Returns it, None if there was nothing."""
        if self.store is None:
            return None
        with self.locked():
            upto = self.rotate()
            manifest = self.manifest()
            log = self.intents(upto)
            bucket = self.definition.bucket(manifest["buckets"])
            found = log.where(F.col("_op") != "get").groupBy(bucket.alias("b")).agg(F.max("_seq").alias("last")).collect()
            if not found:
                return None
            touched = {r["b"] for r in found}
            state = replay.state(self.definition, log, self.snapshot(touched))
            version = manifest["next_version"]
            alive = self._write(version, state)
            versions = {b: v for b, v in manifest["versions"].items() if int(b) not in touched} | {str(b): version for b in alive}
            seq = max([manifest["next_seq"], *(r["last"] for r in found)])
            self.store.publish(CURRENT, manifest | {"versions": versions, "first": upto, "next_version": version + 1, "next_seq": seq})
            log_.info("%s: version %d has %d buckets", self.definition.name, version, len(alive))
            return version

    def maintain(self) -> None:
        """Compact if the uncompacted log is larger than the options allow."""
        if self.store is None or not self.options.compact_bytes:
            return
        if sum(self.store.size(f"log/gen={g}") for g in self.generations()) > self.options.compact_bytes:
            self.compact()

    def _write(self, version: int, rows: DataFrame) -> list[int]:
        """Write buckets of a version; returns those that have rows.

        Adaptive execution splits a large bucket among tasks (a sorted file each) and lets small ones share one.
        """
        folder = f"snapshots/v={version}"
        bucket = self.definition.bucket(self.manifest()["buckets"])
        dealt = rows.withColumn("b", bucket).hint("rebalance", F.col("b")).sortWithinPartitions("b", *self.definition.identity)
        dealt.write.mode("overwrite").partitionBy("b").parquet(self.store.url(folder))
        return [int(x.removeprefix("b=")) for x in self.store.names(folder) if x.startswith("b=")]

    def buckets(self) -> dict[int, list[tuple[int, bool, int]]]:
        """Of each version, its buckets: number, whether it is live, bytes."""
        live = {(v, int(b)) for b, v in self.manifest()["versions"].items()}
        out = {}
        for name in self.store.names("snapshots"):
            v = int(name.removeprefix("v="))
            own = [(int(b.removeprefix("b=")), b) for b in self.store.names(f"snapshots/{name}") if b.startswith("b=")]
            out[v] = [(k, (v, k) in live, self.store.size(f"snapshots/{name}/{b}")) for k, b in sorted(own)]
        return out

    def usage(self) -> list[tuple[int, int, int]]:
        """version, live bytes, all bytes; the emptiest first."""
        out = [(v, sum(size for _, alive, size in own if alive), sum(size for *_, size in own)) for v, own in self.buckets().items()]
        return sorted(out, key=lambda x: (x[1], x[0]))

    def collect(self) -> None:
        """Rewrite versions that are mostly dead, then delete what nothing refers to. No reader may be at work."""
        if self.store is None:
            return
        with self.locked():
            manifest = self.manifest()
            worn = {v for v, live, whole in self.usage() if live and live <= self.options.utilisation * whole}
            moving = {int(b) for b, v in manifest["versions"].items() if v in worn}
            if moving:
                version = manifest["next_version"]
                alive = self._write(version, self.snapshot(moving))
                versions = manifest["versions"] | {str(b): version for b in alive}
                manifest |= {"versions": versions, "next_version": version + 1}
                self.store.publish(CURRENT, manifest)
            live = {f"snapshots/v={v}/b={b}" for b, v in manifest["versions"].items()}
            for v in self.store.names("snapshots"):
                buckets = [f"snapshots/{v}/{b}" for b in self.store.names(f"snapshots/{v}") if b.startswith("b=")]
                for b in buckets:
                    if b not in live:
                        log_.debug("%s: %s goes", self.definition.name, b)
                        self.store.delete(b)
                if not live & set(buckets):
                    self.store.delete(f"snapshots/{v}")
            for name in self.store.names("log"):
                if int(name.removeprefix("gen=")) < manifest["first"]:
                    self.store.delete(f"log/{name}")
