import random

from model import Model
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators import replay
from keyloom.schema import TableDef
from keyloom.streaming import tail

V = TableDef("v", T.StructType([T.StructField("k", T.LongType()), T.StructField("a", T.StringType()), T.StructField("b", T.DoubleType())]), key=("k",))


def log(seed, n=300):
    rng = random.Random(seed)
    rows, model, acks, seen = [], Model(("k",)), {}, {}
    for seq in range(n):
        k, op = rng.randint(0, 12), rng.choice(["insert", "update", "update", "delete", "get"])
        a, b = rng.choice(["x", "y", None]), rng.choice([1.0, 2.0, None])
        if op == "insert":
            rows.append((seq, op, k, (k, a, b), None))
            acks[seq] = model.insert({"k": k, "a": a, "b": b})
        elif op == "update":
            which = rng.choice(["a", "b", "ab"])
            rows.append((seq, op, k, None, ((a,) if "a" in which else None, (b,) if "b" in which else None)))
            acks[seq] = model.update((k,), {c: v for c, v in (("a", a), ("b", b)) if c in which})
        elif op == "delete":
            rows.append((seq, op, k, None, None))
            acks[seq] = model.delete((k,))
        else:
            rows.append((seq, op, k, None, None))
            found = model.get([(k,)])
            acks[seq] = bool(found)
            if found:
                seen[seq] = (found[0]["a"], found[0]["b"])
    rng.shuffle(rows)
    return rows, model, acks, seen


def test_replay_agrees_with_a_plain_fold(spark):
    for seed in range(2):
        rows, model, acks, seen = log(seed)
        intents = spark.createDataFrame(rows, V.intents).repartition(3)
        assert {r["_seq"]: r.ack for r in replay.acks(V, intents).collect()} == acks
        assert {r["_seq"]: (r.a, r.b) for r in replay.seen_by_gets(V, intents, ["a", "b"]).collect()} == seen
        want = sorted((tuple(r.values()) for r in model.rows.values()))
        assert sorted(map(tuple, replay.state(V, intents).collect())) == want
        for cut in (0, 150, 300):
            base = replay.state(V, intents.where(F.col("_seq") < cut))
            rest = intents.where(F.col("_seq") >= cut)
            assert sorted(map(tuple, replay.state(V, rest, base).collect())) == want
        base = replay.state(V, intents.where("_seq < 150"))
        late = {r["_seq"]: r.ack for r in replay.acks(V, intents.where("_seq >= 150"), base).collect()}
        assert late == {s: a for s, a in acks.items() if s >= 150}


def test_arbitrary_mutator_in_order(spark):
    rows, _, _, _ = log(5)
    intents = spark.createDataFrame(rows, V.intents).withColumn("add", F.when(F.col("_op") == "update", F.col("_seq")))
    state = {}
    for seq, op, k, row, _ in sorted(rows, key=lambda r: r[0]):
        if op == "insert":
            state[k] = (k, row[1], 0.0 if row[2] is None else row[2])
        elif op == "delete":
            state.pop(k, None)
        elif op == "update" and k in state:
            state[k] = (k, state[k][1], state[k][2] * 2 + seq)
    clean = intents.withColumn("_row", F.when(F.col("_row").isNotNull(), F.struct(F.col("_row.k"), F.col("_row.a"), F.coalesce("_row.b", F.lit(0.0)).alias("b"))))
    got = replay.mutated(V, clean, lambda row, add: row | {"b": row["b"] * 2 + add, "k": -1}, "add")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(state.values(), key=str)


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows, model, acks, _ = log(3, 120)
    rows.sort(key=lambda r: r[0])
    source = str(tmp_path / "log")
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], V.intents).coalesce(1).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    out = tail.fold(tail.tail(spark, source, V), V)
    run = out.writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.table("folded").collect()
    assert {r["_seq"]: r.ack for r in got} == acks


def test_ingest_is_exactly_once(spark, tmp_path):
    from keyloom.plans.engine import Engine

    rows, model, _, _ = log(4, 80)
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, V.intents).write.parquet(source)
    table = Engine(spark, str(tmp_path / "root")).register(V)
    for checkpoint in ("c", "c", "again"):  # the third forgets what it did, and writes the same batch again
        tail.ingest(tail.tail(spark, source, V), table, str(tmp_path / checkpoint), "feed").awaitTermination()
    assert table.intents().count() == len(rows)
    assert sorted(map(tuple, table.rows().collect())) == sorted(tuple(r.values()) for r in model.rows.values())
