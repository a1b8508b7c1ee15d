"""Change logs as streams: tailing one, ingesting intents exactly once, and folding with a user's code."""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.plans.table import Table
from keyloom.schema import TableDef


def tail(spark: SparkSession, path: str, definition: TableDef, files_a_batch: int = 100) -> DataFrame:
    """Intents as files arrive under a folder."""
    return spark.readStream.schema(definition.intents).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def ingest(stream: DataFrame, table: Table, checkpoint: str, name: str, once: bool = True):
    """Append each micro-batch to the table's log: what there is now, or on and on until the engine closes.

    A batch that is run again replaces itself.
    """

    def append(frame: DataFrame, epoch: int) -> None:
        with table.locked():
            table.append(frame, batch=f"{name}-{epoch:012d}")
        table.maintain()

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    table.engine.streams.append(query)
    return query


def fold(stream: DataFrame, definition: TableDef, mutate: Callable[[dict, dict], dict] | None = None) -> DataFrame:
    """identity, _seq, _op, ack, alive, row (JSON): the answer to each intent, with state kept for each key.

    Within a micro-batch intents are taken in order of _seq; one that isn't later than the last applied of its
    key is refused (ack false, state unchanged). mutate(row, set): a user's update in place of set-style columns, which
    sees values of the same types in every micro-batch (the state keeps the row pickled; only the answer is JSON).
    """
    names, identity = definition.schema.names, definition.identity
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in definition.fields(identity))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alive, row = state.get if state.exists else (-1, False, pickle.dumps({}))
        kept, out = pickle.loads(bytes(row)), []
        todo = pd.concat(list(frames)).sort_values("_seq")
        for one in todo.to_dict("records"):
            seq, op = int(one["_seq"]), one["_op"]
            late = seq <= last
            ack = not late and (op == "insert" or alive)
            if not late:
                last = seq
                if op == "insert":
                    kept, alive = {c: one["_row"][c] for c in names}, True
                elif op == "delete":
                    kept, alive = {}, False
                elif op == "update" and alive:
                    given = {c: v["v"] for c, v in one["_set"].items() if v is not None}
                    changed = mutate(dict(kept), given) if mutate else kept | given
                    kept = changed | {c: kept[c] for c in identity}
            out.append((*key, seq, op, ack, alive, json.dumps(kept, default=str, sort_keys=True)))
        state.update((last, alive, pickle.dumps(kept)))
        yield pd.DataFrame(out, columns=[*identity, "_seq", "_op", "ack", "alive", "row"])

    schema = f"{keys}, _seq long, _op string, ack boolean, alive boolean, row string"
    return stream.groupBy(*identity).applyInPandasWithState(step, schema, "last long, alive boolean, row binary", "append", GroupStateTimeout.NoTimeout)
