import random

import pytest
from model import Model
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom import errors
from keyloom.config import Options
from keyloom.functions import filters
from keyloom.ops import Delete, Get, Insert, Update
from keyloom.plans.engine import Engine
from keyloom.plans.table import CURRENT, LOCK
from keyloom.schema import TableDef
from keyloom.sources.store import Store

L, S, D = T.LongType(), T.StringType(), T.DoubleType()
ONE = TableDef("one", T.StructType([T.StructField("k", L), T.StructField("s", S), T.StructField("n", D), T.StructField("tags", T.ArrayType(S))]), key=("k",))
MANY = TableDef("many", T.StructType([T.StructField("k", L), T.StructField("t", L), T.StructField("s", S)]), key=("k",), sort=("t",))


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "root"), Options(buckets=4))
    e.register(ONE)
    e.register(MANY)
    yield e
    e.close()


def one(k, s="a", n=1.0, tags=None):
    return {"k": k, "s": s, "n": n, "tags": tags}


def frame(spark, table, rows):
    return spark.createDataFrame([tuple(r[c] for c in table.schema.names) for r in rows], table.schema)


def dicts(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def by_key(rows):
    return sorted(rows, key=str)


def random_batch(rng, engine, models, n):
    batch, want = engine.batch(), []
    for _ in range(n):
        k, t, s = rng.randint(0, 5), rng.randint(0, 3), rng.choice(["a", "b", None])
        kind = rng.choice(["insert", "delete", "update", "get"])
        if rng.random() < 0.5:
            model = models["one"]
            if kind == "insert":
                op, row = None, one(k, s, rng.random(), rng.choice([None, [], ["x", s]]))
                op = Insert("one", row)
                want.append(model.insert(row))
            elif kind == "delete":
                op = Delete("one", k)
                want.append(model.delete((k,)))
            elif kind == "update":
                change = rng.choice([{"s": s}, {"n": None}, {"s": None, "n": 2.5}])
                op = Update("one", k, change)
                want.append(model.update((k,), change))
            else:
                op = Get("one", (k, 99))
                want.append(model.get([(k,), (99,)]))
        else:
            model = models["many"]
            if kind == "insert":
                row = {"k": k, "t": t, "s": s}
                op = Insert("many", row)
                want.append(model.insert(row))
            elif kind == "delete":
                op = Delete("many", k, t)
                want.append(model.delete((k, t)))
            elif kind == "update":
                op = Update("many", k, {"s": s}, t)
                want.append(model.update((k, t), {"s": s}))
            else:
                op = Get("many", (k, (k + 1) % 6, k))
                want.append(model.get([(k,), ((k + 1) % 6,), (k,)]))
        batch.add(op)
    return batch, want


def test_random_batches_agree_with_a_plain_fold(spark, engine):
    rng = random.Random(17)
    models = {"one": Model(("k",)), "many": Model(("k",), ("t",))}
    for round_ in range(2):
        batch, want = random_batch(rng, engine, models, 60)
        result = batch.execute()
        responses = result.responses().orderBy("index").collect()
        assert [r["index"] for r in responses] == list(range(60)) and [r.end for r in responses] == [False] * 59 + [True]
        assert [r.ok for r in responses] == [bool(w) for w in want]
        gets = [i for i, op in enumerate(batch.ops) if isinstance(op, Get)]
        for i in rng.sample(gets, 2):
            assert dicts(result.rows(i)) == want[i]
        if round_ == 0:
            engine.table("one").rotate()
        engine.compact()
        if round_ == 1:
            engine.table("one").collect()
    for name, model in models.items():
        assert by_key(dicts(engine.table(name).rows())) == by_key(model.rows.values())
    # another process sees the same
    again = Engine(spark, engine.root, Options(buckets=4)).register(ONE)
    assert by_key(dicts(again.rows())) == by_key(models["one"].rows.values())


def test_bulk_writes_and_reads(spark, engine):
    table = engine.table("one")
    table.insert(frame(spark, ONE, [one(k, f"s{k}", k / 2, ["t"]) for k in range(100)]))
    table.compact()
    acks = table.delete(spark.createDataFrame([(5,), (5,), (999,)], "k long").coalesce(1)).collect()
    assert sorted((r.k, r.ack) for r in acks) == [(5, False), (5, True), (999, False)]
    acks = table.update(spark.createDataFrame([(7, None), (5, "x")], "k long, s string")).collect()
    assert sorted((r.k, r.ack) for r in acks) == [(5, False), (7, True)]
    found = [r.k for r in table.get([9, 7, 9, 5]).orderBy("_pos").collect()]
    assert found == [9, 7, 9]
    assert dicts(table.get([7]).drop("_pos")) == [one(7, None, 3.5, ["t"])]
    assert [r.k for r in table.get(range(20), where=filters.equals("s")("s3")).collect()] == [3]
    assert table.get_many(spark.createDataFrame([(5,), (8,), (8,)], "k long")).count() == 2
    assert table.rows().where(filters.arbitrary(lambda n: n > 48.9, "n")).count() == 2
    plan = table.get([9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(k,9)" in plan or "In(k" in plan


def test_sorted_gets_with_limits(spark, engine):
    table = engine.table("many")
    table.insert(frame(spark, MANY, [{"k": k, "t": t, "s": "ab"[t % 2]} for k in range(4) for t in range(5)][::-1]))
    order = lambda df: [(r.k, r.t) for r in df.orderBy("_pos", "t").collect()]
    assert order(table.get([2, 0])) == [(2, t) for t in range(5)] + [(0, t) for t in range(5)]
    assert order(table.get([2, 0], limit=6)) == [(2, t) for t in range(5)] + [(0, 0)]
    assert order(table.get([2, 0, 1], limit=2, compat_limit=True)) == [(2, 0), (2, 1), (0, 0), (1, 0)]
    assert order(table.get([2, 0], limit=0)) == [] and order(table.get([2, 0], limit=0, compat_limit=True)) == [(2, 0), (0, 0)]
    assert order(table.get([3], where=F.col("s") == "b", limit=1)) == [(3, 1)]
    assert order(table.get([3], sort_keys=[0, 4, 9])) == [(3, 0), (3, 4)]


def test_refusals(spark, engine):
    with pytest.raises(errors.SchemaMismatch):
        engine.table("one").insert(spark.createDataFrame([(1,)], "k long"))
    with pytest.raises(errors.NullKey):
        engine.table("one").insert(frame(spark, ONE, [one(None)]))
    with pytest.raises(errors.NullKey):
        engine.batch().add(Insert("one", one(None))).execute()
    with pytest.raises(errors.ImmutableColumn):
        engine.batch().add(Update("many", 1, {"t": 3}, 2)).execute()
    with pytest.raises(errors.ImmutableColumn):
        TableDef("x", MANY.schema, ("k",), ("t",), updatable=("t",))
    with pytest.raises(errors.UnknownTable):
        engine.batch().add(Get("nothing", (1,)))
    with pytest.raises(errors.SchemaMismatch):
        engine.register(TableDef("one", MANY.schema, ("k",)))
    result = engine.batch().add(Insert("one", one(1))).add(Get("one", (1,))).execute()
    with pytest.raises(errors.WrongType):
        result.rows(0)
    with pytest.raises(errors.WrongType):
        result.rows(1, "many")
    assert result.first(1)["k"] == 1
    assert engine.batch().execute().responses().collect() == []
    engine.table("one").store.lock(LOCK)
    with pytest.raises(errors.TableLocked):
        engine.table("one").insert(frame(spark, ONE, [one(2)]))
    engine.table("one").break_lock()
    engine.table("one").insert(frame(spark, ONE, [one(2)]))
    assert sorted(r["k"] for r in engine.table("one").rows().collect()) == [1, 2]


def test_crashes_leave_the_last_published_state(spark, engine, monkeypatch):
    table = engine.table("one")
    table.insert(frame(spark, ONE, [one(k) for k in range(20)]))
    table.compact()
    table.update(spark.createDataFrame([(3, "new")], "k long, s string"))
    want = by_key(dicts(table.rows()))
    monkeypatch.setattr(Store, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        table.compact()  # files written, pointer not moved
    monkeypatch.undo()
    assert by_key(dicts(table.rows())) == want
    # a torn batch has no _SUCCESS
    spark.createDataFrame([(10**9, "delete", 3, None, None)], ONE.intents).write.parquet(table.store.url(f"log/gen={table.generation()}/batch=torn"))
    table.store.delete(f"log/gen={table.generation()}/batch=torn/_SUCCESS")
    assert by_key(dicts(table.rows())) == want
    table.compact()
    assert table.compact() is None  # nothing new: idempotent
    table.collect()
    assert by_key(dicts(table.rows())) == want
    table.store.write(CURRENT, table.store.read(CURRENT).replace("versions", "versionz"))
    with pytest.raises(errors.CorruptManifest):
        table.rows()


def test_collect_rewrites_worn_versions(spark, engine):
    table = engine.table("one")
    table.insert(frame(spark, ONE, [one(k) for k in range(40)]))
    table.compact()
    buckets = {r.k: r.b for r in table.rows().select("k", ONE.bucket(4).alias("b")).collect()}
    for b in (0, 1, 2):
        table.update(spark.createDataFrame([(next(k for k in buckets if buckets[k] == b), "z")], "k long, s string"))
        table.compact()
    assert table.usage()[0][0] == 0 or any(v == 0 and live <= whole / 2 for v, live, whole in table.usage())
    want = by_key(dicts(table.rows()))
    table.collect()
    assert all(live == whole for _, live, whole in table.usage()) and not any(v == 0 for v, *_ in table.usage())
    assert by_key(dicts(table.rows())) == want
    assert [n for n in table.store.names("log")] == [f"gen={table.manifest()['first']}"]


def test_rotation_by_size_and_residency(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "r"), Options(buckets=2, memory=0, tables={"one": {"log_bytes": 1}}))
    a, b = e.register(ONE), e.register(MANY)
    for k in range(3):
        a.insert(frame(spark, ONE, [one(k)]))
        b.insert(frame(spark, MANY, [{"k": k, "t": 0, "s": "x"}]))
    assert len(a.generations()) == 3 and len(b.generations()) == 1
    assert a.rows().count() == 3
    e.residency.load("one")
    assert not e.residency.held  # a limit of nothing keeps nothing
    e.options = Options(buckets=2)
    e.residency.load("one"), e.residency.load("many"), e.residency.load("one")
    assert list(e.residency.held) == ["many", "one"]
    a.insert(frame(spark, ONE, [one(9)]))
    assert list(e.residency.held) == ["many"]
    e.close()


def test_ephemeral_table(spark, tmp_path):
    table = Engine(spark, str(tmp_path / "none")).register(TableDef("temp", MANY.schema, ("k",), ("t",), ephemeral=True))
    table.insert(frame(spark, MANY, [{"k": 1, "t": t, "s": "x"} for t in (2, 1)]))
    assert sorted((r.t, r.ack) for r in table.delete(spark.createDataFrame([(1, 1), (1, 5)], "k long, t long")).collect()) == [(1, True), (5, False)]
    assert [r.ack for r in table.update(spark.createDataFrame([(1, 2, "y")], "k long, t long, s string")).collect()] == [True]
    assert dicts(table.rows()) == [{"k": 1, "t": 2, "s": "y"}] and table.compact() is None
    assert not (tmp_path / "none").exists()


def test_the_sequence_is_kept_without_reading_the_log(spark, engine, monkeypatch):
    table = engine.table("one")
    table.insert(frame(spark, ONE, [one(k) for k in range(5)]))
    table.update(spark.createDataFrame([(1, "x")], "k long, s string"))
    want = table.intents().agg(F.max("_seq")).first()[0] + 1
    again = Engine(spark, engine.root, Options(buckets=4)).register(ONE)
    with monkeypatch.context() as m:
        m.setattr(type(again), "_counted", lambda *_: pytest.fail("the log was read"))
        assert table.next_seq() == again.next_seq() == want
    # a writer that died before its note: only that batch is read
    (batch,) = table._batches()[-1:]
    for name in table.store.names(batch):
        if name.startswith("_last-"):
            table.store.delete(f"{batch}/{name}")
    assert Engine(spark, engine.root, Options(buckets=4)).register(ONE).next_seq() == want
    again.insert(frame(spark, ONE, [one(9)]))
    assert table.next_seq() > want and table.compact() is not None
    assert table.next_seq() > want


def test_resident_tables_answer_from_memory_until_they_change(spark, engine):
    table = engine.table("one")
    table.insert(frame(spark, ONE, [one(k) for k in range(20)]))
    table.compact()
    engine.residency.load("one")
    assert 0 < engine.residency.size()
    stranger = spark.range(100_000).cache()
    stranger.count()
    assert engine.residency.size() < 100_000
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan(table.get([3])) and dicts(table.get([3]).drop("_pos")) == [one(3)]
    assert "InMemoryTableScan" in plan(table.rows())
    table.delete(spark.createDataFrame([(3,)], "k long"))
    assert "InMemoryTableScan" not in plan(table.rows()) and table.get([3]).count() == 0
    stranger.unpersist()


def test_skip_over_responses(spark, engine):
    batch = engine.batch()
    for k in range(4):
        batch.add(Insert("one", one(k)))
    result = batch.execute()
    assert [r["index"] for r in result.skip(2).orderBy("index").collect()] == [2, 3]
    assert result.skip(0).count() == result.skip(-1).count() == 4 and result.skip(9).count() == 0


def test_a_table_compacts_itself_and_a_closed_engine_stops_its_streams(spark, tmp_path):
    from keyloom.ops import insert_intents
    from keyloom.streaming import tail

    engine = Engine(spark, str(tmp_path / "own"), Options(buckets=2, compact_bytes=1, trace="info"))
    table = engine.register(ONE)
    table.insert(frame(spark, ONE, [one(k) for k in range(6)]))
    acks = table.delete(spark.createDataFrame([(1,), (77,)], "k long"))
    assert table.intents().count() == 0 and table.snapshot().count() == 5
    assert sorted((r.k, r.ack) for r in acks.collect()) == [(1, True), (77, False)]
    feed = insert_intents(ONE, frame(spark, ONE, [one(k) for k in range(6, 9)]), F.lit(1000).cast("long") + F.monotonically_increasing_id())
    feed.write.parquet(str(tmp_path / "feed"))
    query = tail.ingest(tail.tail(spark, str(tmp_path / "feed"), ONE), table, str(tmp_path / "state"), "feed", once=False)
    assert query.isActive
    engine.close(compact=True)
    assert not query.isActive and table.rows().count() == 8
