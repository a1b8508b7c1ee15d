"""The registered queries for keyed tables and their SQL.

The log of several queries is the table events read as intents: signup inserts, error deletes, view gets, click and
purchase update; the key is user_id, the order event_id, the payload value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.config import Options
from keyloom.functions import filters
from keyloom.operators import latency, read, replay
from keyloom.operators.placement import Ring, balance
from keyloom.plans.engine import Engine
from keyloom.plans.table import Table
from keyloom.schema import TableDef
from keyloom.sources.tables import load, read_csv, scratch
from keyloom.streaming import tail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VALUES = TableDef("values", T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType())]), key=("k",))
PREFIX = """with i as (select user_id k, event_id seq, value v,
     case event_type when 'signup' then 'insert' when 'error' then 'delete' when 'view' then 'get' else 'update' end op from events),
 a as (select *, coalesce(last_value(case when op in ('insert','delete') then op end ignore nulls) over w = 'insert', false) alive
       from i window w as (partition by k order by seq rows between unbounded preceding and 1 preceding))"""
FINAL = """, e as (select *, max(case when op <> 'update' then seq end) over (partition by k) s0 from i where op <> 'get'),
 f as (select k, arg_max(v, seq) v from e where seq >= s0 group by k having arg_min(op, seq) = 'insert')"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table_def(df: DataFrame, name: str, *key: str, sort: tuple[str, ...] = ()) -> TableDef:
    return TableDef(name, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]), key=key, sort=sort)


def event_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").otherwise("update")
    k, v = F.col("user_id").alias("k"), F.col("value").alias("v")
    row = F.when(op == "insert", F.struct(k, v)).alias("_row")
    change = F.when(op == "update", F.struct(F.struct(v).alias("v"))).alias("_set")
    return events.select(F.col("event_id").alias("_seq"), op.alias("_op"), k, row, change)


def _get(spark, sf_dir, name, key, keys, sort=(), **asked) -> DataFrame:
    rows = load(spark, sf_dir, name)
    return read.get(table_def(rows, name, key, sort=sort), rows, keys, **asked)


# Reads


@query("select * from customer where c_custkey = 7")
def get_point(spark, sf_dir):
    return _get(spark, sf_dir, "customer", "c_custkey", [7]).drop("_pos")


@query("select * from customer where c_custkey = 7 and c_mktsegment = 'no such segment'")
def get_filter_miss(spark, sf_dir):
    return _get(spark, sf_dir, "customer", "c_custkey", [7], where=filters.equals("c_mktsegment")("no such segment")).drop("_pos")


@query("select * from customer where c_custkey in (1, 2, 3, 4, 5, 6, 7, 8) and c_acctbal > 1000")
def get_filter_hit(spark, sf_dir):
    return _get(spark, sf_dir, "customer", "c_custkey", list(range(1, 9)), where=F.col("c_acctbal") > 1000).drop("_pos")


@query("select pos, o_orderkey, o_totalprice from (values (0::bigint,5::bigint),(1,9),(2,5),(3,999999)) k(pos,k) join orders on o_orderkey = k")
def multi_get(spark, sf_dir):
    return _get(spark, sf_dir, "orders", "o_orderkey", [5, 9, 5, 999999]).select(F.col("_pos").alias("pos"), "o_orderkey", "o_totalprice")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey % 3 = 1")
def multi_get_many(spark, sf_dir):
    """More keys than an IN list takes: a frame of all keys up to the largest that are asked for, held or not."""
    rows = load(spark, sf_dir, "orders")
    low, high = rows.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    keys = spark.range(low or 0, (high or 0) + 1).where("id % 3 = 1").select(F.col("id").alias("o_orderkey"))
    return read.get_many(table_def(rows, "orders", "o_orderkey"), rows, keys).select("o_orderkey", "o_custkey", "o_totalprice")


@query("select * from conversations where conv_id in (3,5,9)")
def get_sorted(spark, sf_dir):
    return _get(spark, sf_dir, "conversations", "conv_id", [3, 5, 9], sort=("turn",)).drop("_pos")


@query("select * from conversations where conv_id in (3,5,9) and turn in (0,2)")
def get_sorted_keys(spark, sf_dir):
    return _get(spark, sf_dir, "conversations", "conv_id", [3, 5, 9], sort=("turn",), sort_keys=[0, 2]).drop("_pos")


@query("select * from conversations where conv_id in (3,5,9) and role = 'user' order by conv_id, turn limit 4")
def get_sorted_limit(spark, sf_dir):
    return _get(spark, sf_dir, "conversations", "conv_id", [3, 5, 9], sort=("turn",), where=F.col("role") == "user", limit=4).drop("_pos")


@query("""select conv_id, turn from (select conv_id, turn, row_number() over (order by conv_id, turn) g,
  row_number() over (partition by conv_id order by turn) p from conversations where conv_id in (3,5,9)) where g <= 2 or p = 1""")
def get_sorted_limit_compat(spark, sf_dir):
    return _get(spark, sf_dir, "conversations", "conv_id", [3, 5, 9], sort=("turn",), limit=2, compat_limit=True).select("conv_id", "turn")


@query("select * from conversations where conv_id in (9, 5) order by case conv_id when 9 then 0 else 1 end, turn limit 1")
def first_row(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations")
    table = table_def(rows, "conversations", "conv_id", sort=("turn",))
    return read.first(table, read.get(table, rows, [9, 5]))


@query("""select event_id, event_type, idx from (select event_id, event_type, row_number() over (order by event_id) idx
  from events where user_id = 8) where idx > 10""")
def response_order_skip(spark, sf_dir):
    return read.skip(load(spark, sf_dir, "events").where("user_id = 8").select("event_id", "event_type"), 10, "event_id")


# Mutations of plain frames


@query("""select * exclude(rn) from (select *, row_number() over (partition by l_orderkey, l_linenumber
  order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_quantity desc,
           l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) rn from lineitem) where rn = 1""")
def upsert_lww(spark, sf_dir):
    order = "l_shipdate l_partkey l_suppkey l_extendedprice l_quantity l_discount l_tax l_returnflag l_linestatus".split()
    return read.latest(load(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)


@query("select * from customer where c_custkey not in (5,9,999999)")
def delete_keys(spark, sf_dir):
    """Deletes of keys, held or not, through the log of a compacted table."""
    table = _loaded(spark, sf_dir, "customer", "c_custkey")
    table.delete(spark.createDataFrame([(5,), (9,), (999999,)], "c_custkey long"))
    return table.rows()


@query("""select c_custkey, c_name, c_nationkey, case c_custkey when 5 then 1.5::double when 9 then 2.5::double
  else c_acctbal end c_acctbal, c_mktsegment from customer""")
def update_set(spark, sf_dir):
    """Updates of a column by key through the log of a compacted table; that of a key that isn't there does nothing."""
    table = _loaded(spark, sf_dir, "customer", "c_custkey")
    table.update(spark.createDataFrame([(5, 1.5), (9, 2.5), (999999, 3.5)], "c_custkey long, c_acctbal double"))
    return table.rows()


@query("""select c_custkey, c_name, c_nationkey, case when c_custkey % 2 = 0 then c_acctbal / 2 else c_acctbal end c_acctbal, c_mktsegment from customer""")
def update_by_expression(spark, sf_dir):
    """New values computed from the rows as they are, written back as updates."""
    table = _loaded(spark, sf_dir, "customer", "c_custkey")
    table.update(table.rows().where("c_custkey % 2 = 0").select("c_custkey", (F.col("c_acctbal") / 2).alias("c_acctbal")))
    return table.rows()


# The change log


@query(PREFIX + " select k, seq, op, case when op = 'insert' then true else alive end ack from a")
def replay_acks(spark, sf_dir):
    out = replay.acks(VALUES, event_intents(spark, sf_dir))
    return out.select("k", F.col("_seq").alias("seq"), F.col("_op").alias("op"), "ack")


@query(PREFIX + """, b as (select *, last_value(case when op='insert' or (op='update' and alive) then v end ignore nulls)
        over (partition by k order by seq rows between unbounded preceding and 1 preceding) v_now from a)
 select k, seq, v_now from b where op = 'get' and alive""")
def replay_point_in_time(spark, sf_dir):
    out = replay.seen_by_gets(VALUES, event_intents(spark, sf_dir), ["v"])
    return out.select("k", F.col("_seq").alias("seq"), F.col("v").alias("v_now"))


@query(PREFIX + """, e as (select *, max(case when op <> 'update' then seq end) over (partition by k) s0 from i where op <> 'get')
 select k, arg_max(v, seq) v, min(seq) inserted_at, max(seq) last_seq from e where seq >= s0 group by k having arg_min(op, seq) = 'insert'""")
def replay_final(spark, sf_dir):
    fold = replay.folded(VALUES, event_intents(spark, sf_dir))
    return replay.standing(VALUES, fold, extra=(F.col("_anchor")["_seq"].alias("inserted_at"), F.col("_last").alias("last_seq")))


@query(PREFIX + FINAL + " select k, v from f")
def compaction_equiv(spark, sf_dir):
    """A snapshot of the log's first half and the rest of the log give what the whole log gives."""
    log = event_intents(spark, sf_dir)
    middle = load(spark, sf_dir, "events").agg(F.floor(F.max("event_id") / 2).cast("long")).first()[0] or 0
    snapshot = replay.state(VALUES, log.where(F.col("_seq") < middle))
    return replay.state(VALUES, log.where(F.col("_seq") >= middle), snapshot)


@query(PREFIX + FINAL + " select k, v from f")
def replay_user_mutator(spark, sf_dir):
    """Updates as a user's code instead of set-style columns."""
    log = event_intents(spark, sf_dir).withColumn("payload", F.col("_set")["v"]["v"])
    return replay.mutated(VALUES, log, lambda row, payload: row | {"v": payload}, "payload")


@query(PREFIX + """, e as (select *, max(case when op <> 'update' then seq end) over (partition by k) s0 from i where op <> 'get')
 select k, round(sum(v), 6) v from e where seq >= s0 group by k having arg_min(op, seq) = 'insert'""")
def replay_expression_mutator(spark, sf_dir):
    """Updates that add to what is there, as an expression over the row."""
    log = event_intents(spark, sf_dir).withColumn("payload", F.col("_set")["v"]["v"])
    summed = replay.mutated_by(VALUES, log, lambda row, payload: {"v": row["v"] + payload}, "payload")
    return summed.select("k", F.round("v", 6).alias("v"))


@query(PREFIX + """, g as (select k, list(op order by seq) ops, count(*) n from i group by k) select k, n, array_to_string(ops, ',') ops from g""")
def intents_by_key(spark, sf_dir):
    """A key's intents in the log's order."""
    pairs = F.array_sort(F.collect_list(F.struct("_seq", "_op")))
    grouped = event_intents(spark, sf_dir).groupBy("k").agg(pairs.alias("p"), F.count("*").alias("n"))
    return grouped.select("k", "n", F.array_join(F.transform("p", lambda x: x["_op"]), ",").alias("ops"))


@query(PREFIX + FINAL + " select distinct i.k from i where i.op <> 'get' and not exists (select 1 from f where f.k = i.k)")
def pruned_keys(spark, sf_dir):
    """Keys that have intents and no row at the end."""
    log = event_intents(spark, sf_dir)
    return log.where(F.col("_op") != "get").select("k").distinct().join(replay.state(VALUES, log), "k", "left_anti")


@query("select * from customer where c_custkey in (select distinct user_id from events where event_type = 'signup')")
def touched_partitions(spark, sf_dir):
    """Rows of a snapshot for which a log has intents."""
    rows = load(spark, sf_dir, "customer")
    keys = event_intents(spark, sf_dir).where(F.col("_op") == "insert").select(F.col("k").alias("c_custkey"))
    return replay.touched_rows(table_def(rows, "customer", "c_custkey"), rows, keys)


# Through the engine: log, acknowledgements, snapshots


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, scratch(spark))


def _loaded(spark: SparkSession, sf_dir: str, name: str, *key: str, sort: tuple[str, ...] = (), engine: Engine | None = None) -> Table:
    """A table of an engine of its own whose snapshot holds the rows of an input."""
    rows = load(spark, sf_dir, name)
    table = (engine or _engine(spark)).register(table_def(rows, name, *key, sort=sort))
    table.insert(rows)
    table.compact()
    return table


@query("""select version, live_buckets, all_buckets, row_number() over (order by live_buckets, version) rank
  from (values (0::bigint, 14::bigint, 16::bigint), (1, 1, 1), (2, 1, 1)) v(version, live_buckets, all_buckets)""")
def archive_usage(spark, sf_dir):
    """Snapshot versions by how much of them is live, the emptiest first: two of sixteen buckets are written anew, one after the other."""
    rows = load(spark, sf_dir, "orders")
    table = _loaded(spark, sf_dir, "orders", "o_orderkey")
    bucket = table.definition.bucket(table.manifest()["buckets"])
    for b in (3, 7):
        table.update(rows.where(bucket == b).select("o_orderkey", F.lit("X").alias("o_orderstatus")))
        table.compact()
    found = [(version, sum(1 for b in sizes if b[1]), len(sizes)) for version, sizes in table.buckets().items()]
    emptiest = {version: k + 1 for k, (version, *_) in enumerate(table.usage())}
    assert sorted(emptiest, key=emptiest.get)[-1] == 0  # by bytes as by buckets, the first version holds most
    return spark.createDataFrame(found, "version long, live_buckets long, all_buckets long").withColumn("rank", F.row_number().over(Window.orderBy("live_buckets", "version")).cast("long"))


@query("select * from orders")
def insert_then_verify(spark, sf_dir):
    """Every row is inserted through the log, compacted, and read back by its key."""
    rows = load(spark, sf_dir, "orders")
    table = _engine(spark).register(table_def(rows, "orders", "o_orderkey"))
    table.insert(rows)
    table.compact()
    return table.get_many(rows.select("o_orderkey")).drop("_pos")


@query("""select c_custkey, c_name, c_nationkey, case when c_custkey % 5 = 1 then 0.5::double else c_acctbal end c_acctbal, c_mktsegment
  from customer where c_custkey % 7 <> 0 or c_custkey % 14 = 0""")
def mutate_and_compact(spark, sf_dir):
    """Insert, compact, delete, insert again, update, each in its own generation of the log."""
    rows = load(spark, sf_dir, "customer")
    table = _engine(spark).register(table_def(rows, "customer", "c_custkey"))
    table.insert(rows)
    table.compact()
    table.delete(rows.where("c_custkey % 7 = 0").select("c_custkey"))
    table.rotate()
    table.insert(rows.where("c_custkey % 14 = 0"))
    table.compact()
    table.update(rows.where("c_custkey % 5 = 1").select("c_custkey", F.lit(0.5).alias("c_acctbal")))
    return table.rows()


@query("select c_custkey, c_name, c_nationkey, case when c_custkey % 2 = 0 then 2.5::double else c_acctbal end c_acctbal, c_mktsegment from customer where c_custkey % 5 <> 0")
def compact_by_policy(spark, sf_dir):
    """A table that compacts itself once its log holds more than the options allow."""
    rows = load(spark, sf_dir, "customer")
    table = Engine(spark, scratch(spark), Options(compact_bytes=1)).register(table_def(rows, "customer", "c_custkey"))
    table.insert(rows)
    table.update(rows.where("c_custkey % 2 = 0").select("c_custkey", F.lit(2.5).alias("c_acctbal")))
    table.delete(rows.where("c_custkey % 5 = 0").select("c_custkey"))
    assert not table.intents().head(1)
    return table.snapshot()


@query("""select idx, ok from (values (0::bigint, true), (1, true), (2, true), (3, true), (4, false), (5, true), (6, true), (7, true), (8, false), (9, false)) r(idx, ok)""")
def batch_acks(spark, sf_dir):
    """One ordered batch over two tables; each operation sees those before it."""
    from keyloom.ops import Delete, Get, Insert, Update

    engine = _engine(spark)
    customers, turns = load(spark, sf_dir, "customer"), load(spark, sf_dir, "conversations")
    engine.register(table_def(customers, "customer", "c_custkey")).insert(customers)
    engine.register(table_def(turns, "conversations", "conv_id", sort=("turn",))).insert(turns)
    new = {"c_custkey": -1, "c_name": "new", "c_nationkey": 1, "c_acctbal": 0.0, "c_mktsegment": None}
    batch = engine.batch()
    for op in (Insert("customer", new), Get("customer", (-1,)), Update("customer", -1, {"c_name": None}), Delete("customer", -1), Get("customer", (-1,)), Get("conversations", (1, 2)), Delete("conversations", 1, 0), Get("conversations", (1,)), Delete("conversations", 1, 0), Update("customer", -1, {"c_name": "x"})):
        batch.add(op)
    return batch.execute().responses().select(F.col("index").alias("idx"), "ok")


@query("select * from orders where o_orderkey in (5, 9, 12)")
def snapshot_point_read(spark, sf_dir):
    """A cold get: one bucket's folder for each key, the key pushed into the scan."""
    rows = load(spark, sf_dir, "orders")
    table = _engine(spark).register(table_def(rows, "orders", "o_orderkey"))
    table.insert(rows)
    table.compact()
    return table.get([5, 9, 12]).drop("_pos")


@query("select conv_id, turn, case when turn = 1 then 'second' else role end as role, text from conversations where conv_id % 3 <> 0 or turn > 0")
def sorted_compact(spark, sf_dir):
    """A sorted table that is compacted, changed through its log and compacted again: the rows of the last snapshot."""
    table = _loaded(spark, sf_dir, "conversations", "conv_id", sort=("turn",))
    rows = load(spark, sf_dir, "conversations")
    table.delete(rows.where("conv_id % 3 = 0 and turn <= 0").select("conv_id", "turn"))
    table.update(rows.where("turn = 1").select("conv_id", "turn", F.lit("second").alias("role")))
    table.compact()
    return table.snapshot()


@query("select conv_id, turn, case when conv_id % 2 = 0 then 'even' else role end as role, text from conversations where turn < 4")
def sorted_update(spark, sf_dir):
    """Updates and deletes of a persistent sorted table, read from snapshot and log together."""
    table = _loaded(spark, sf_dir, "conversations", "conv_id", sort=("turn",))
    rows = load(spark, sf_dir, "conversations")
    table.update(rows.where("conv_id % 2 = 0").select("conv_id", "turn", F.lit("even").alias("role")))
    table.delete(rows.where("turn >= 4").select("conv_id", "turn"))
    return table.rows()


@query("select conv_id, turn, role from conversations where conv_id in (3, 5) and role <> 'system' and turn <> 2")
def ephemeral_get(spark, sf_dir):
    """A get of a sorted table in memory, after a delete."""
    rows = load(spark, sf_dir, "conversations")
    definition = table_def(rows, "conversations", "conv_id", sort=("turn",))
    table = _engine(spark).register(TableDef("conversations", definition.schema, definition.key, definition.sort, ephemeral=True))
    table.insert(rows)
    table.delete(rows.where("turn = 2").select("conv_id", "turn"))
    return table.get([5, 3], where=F.col("role") != "system").select("conv_id", "turn", "role")


@query("select * from customer where c_custkey in (2, 4, 6)")
def cached_get(spark, sf_dir):
    """A get that a resident table answers from memory."""
    engine = _engine(spark)
    table = _loaded(spark, sf_dir, "customer", "c_custkey", engine=engine)
    engine.residency.load("customer")
    found = table.get([2, 4, 6])
    assert "InMemoryTableScan" in found._jdf.queryExecution().executedPlan().toString()
    return found.drop("_pos")


@query("select idx, ok from (values (2::bigint, false), (3, true)) r(idx, ok)")
def batch_skip(spark, sf_dir):
    """The responses of a batch after the first two."""
    from keyloom.ops import Delete, Get

    engine = _engine(spark)
    _loaded(spark, sf_dir, "customer", "c_custkey", engine=engine)
    batch = engine.batch().add(Get("customer", (1,))).add(Delete("customer", 1)).add(Get("customer", (1,))).add(Get("customer", (2,)))
    return batch.execute().skip(2).select(F.col("index").alias("idx"), "ok")


@query("select conv_id, turn, case when turn = 0 then 'first' else role end as role, text from conversations where role <> 'system' or turn = 0")
def ephemeral_verbs(spark, sf_dir):
    """A sorted table in memory: insert, delete, update, get; nothing is written."""
    rows = load(spark, sf_dir, "conversations")
    definition = table_def(rows, "conversations", "conv_id", sort=("turn",))
    table = _engine(spark).register(TableDef("conversations", definition.schema, definition.key, definition.sort, ephemeral=True))
    table.insert(rows)
    table.delete(rows.where("role = 'system' and turn <> 0").select("conv_id", "turn"))
    table.update(rows.where("turn = 0").select("conv_id", "turn", F.lit("first").alias("role")))
    return table.rows()


@query("select c_custkey, c_name, c_nationkey, case when c_custkey % 10 < 8 then -1.0::double else c_acctbal end c_acctbal, c_mktsegment from customer")
def collect_archives(spark, sf_dir):
    """Versions that are mostly dead are rewritten and deleted; rows stay."""
    rows = load(spark, sf_dir, "customer")
    table = _engine(spark).register(table_def(rows, "customer", "c_custkey"))
    table.insert(rows)
    table.compact()
    table.update(rows.where("c_custkey % 10 < 8").select("c_custkey", F.lit(-1.0).alias("c_acctbal")))
    table.compact()
    table.collect()
    return table.rows()


@query("select conv_id, turn, role, text from conversations where conv_id in (3, 5) and role = 'user'")
def batch_rows(spark, sf_dir):
    """Rows that a filtered get of a batch answers with."""
    from keyloom.ops import Get

    engine, rows = _engine(spark), load(spark, sf_dir, "conversations")
    engine.register(table_def(rows, "conversations", "conv_id", sort=("turn",))).insert(rows)
    return engine.batch().add(Get("conversations", (5, 3), where=filters.equals("role")("user"))).execute().rows(0, "conversations")


# Logs and files


@query(PREFIX + " select k, seq, op from i where op <> 'get'")
def log_scan(spark, sf_dir):
    """Intents appended in two generations, scanned back."""
    log = event_intents(spark, sf_dir).where(F.col("_op") != "get")
    table = _engine(spark).register(VALUES)
    table.append(log.where("_seq % 2 = 0"))
    table.rotate()
    table.append(log.where("_seq % 2 <> 0"))
    return table.intents().select("k", F.col("_seq").alias("seq"), F.col("_op").alias("op"))


@query("select * from nation")
def csv_scan(spark, sf_dir):
    """A headered CSV file by its schema."""
    rows, path = load(spark, sf_dir, "nation"), scratch(spark)
    rows.write.option("header", True).csv(path)
    return read_csv(spark, path, rows.schema, "fail")


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey < 7")
def csv_until_bad_row(spark, sf_dir):
    """A headered CSV file whose eighth row is bad, read up to it."""
    rows, path = load(spark, sf_dir, "nation"), scratch(spark)
    broken = rows.orderBy("n_nationkey").select(F.when(F.col("n_nationkey") == 7, "no number").otherwise(F.col("n_nationkey").cast("string")).alias("n_nationkey"), "n_name", "n_regionkey")
    broken.coalesce(1).write.option("header", True).csv(path)
    return read_csv(spark, path, rows.schema, "stop")


@query("select n_nationkey, n_name, n_regionkey from nation where n_nationkey <> 7")
def csv_without_bad_rows(spark, sf_dir):
    """The same file with bad rows skipped."""
    rows, path = load(spark, sf_dir, "nation"), scratch(spark)
    broken = rows.select(F.when(F.col("n_nationkey") == 7, "no number").otherwise(F.col("n_nationkey").cast("string")).alias("n_nationkey"), "n_name", "n_regionkey")
    broken.write.option("header", True).csv(path)
    return read_csv(spark, path, rows.schema, "skip")


@query(PREFIX + " select k, seq, op, case when op = 'insert' then true else alive end ack from a")
def stream_acks(spark, sf_dir):
    """The log as a stream, folded with state for each key: the batch's acknowledgements."""
    base = scratch(spark)
    event_intents(spark, sf_dir).write.parquet(f"{base}/log")
    answers = tail.fold(tail.tail(spark, f"{base}/log", VALUES), VALUES)
    answers.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("k", F.col("_seq").alias("seq"), F.col("_op").alias("op"), "ack")


@query(PREFIX + FINAL + " select k, v from f")
def stream_ingest(spark, sf_dir):
    """A stream of intents into a table's log, then its rows."""
    base = scratch(spark)
    event_intents(spark, sf_dir).where(F.col("_op") != "get").write.parquet(f"{base}/feed")
    table = _engine(spark).register(VALUES)
    tail.ingest(tail.tail(spark, f"{base}/feed", VALUES), table, f"{base}/state", "feed").awaitTermination()
    return table.rows()


# Placement and latency


#: The ring's points and a key's hash are the first 16 hexadecimal digits of MD5s, compared as text; a key beyond the last point goes to the first.
RING_SQL = """with points as (select md5(i::varchar || ':shard' || s) h, s::int shard from range(8) a(s), range(1000) b(i)),
 hashed as (select o_orderkey, md5(o_orderkey::varchar) h from orders),
 placed as (select o_orderkey, coalesce(p.shard, (select arg_min(shard, h) from points)) shard from hashed asof left join points p on hashed.h <= p.h)"""


@query(RING_SQL + " select o_orderkey, shard from placed")
def ring_find(spark, sf_dir):
    """The shard of each key."""
    ring = Ring([f"shard{i}" for i in range(8)])
    return load(spark, sf_dir, "orders").select("o_orderkey", ring.column("o_orderkey").alias("shard"))


@query(RING_SQL + " select shard, count(*) keys, count(*) / (select count(*) from orders)::double share from placed group by shard")
def ring_balance(spark, sf_dir):
    return balance(load(spark, sf_dir, "orders"), Ring([f"shard{i}" for i in range(8)]).column("o_orderkey"))


@query("""select event_type, value p99 from (select *, row_number() over (partition by event_type
  order by value, event_id) - 1 i, count(*) over (partition by event_type) n from events)
where i = least(cast(ceil(n * 0.99::double) as bigint), n - 1)""")
def bench_percentiles(spark, sf_dir):
    return latency.percentile(load(spark, sf_dir, "events"), ["event_type"], "value", 0.99).withColumnRenamed("value", "p99")


@query("""select event_type, count(*) n, min(value) "min", max(value) "max", round(avg(value), 6) average, round(sum(value), 4) total,
  max(case when i = least(cast(ceil(n * 0.99::double) as bigint), n - 1) then value end) p99,
  max(case when i = least(cast(ceil(n * 0.95::double) as bigint), n - 1) then value end) p95,
  max(case when i = least(cast(ceil(n * 0.9::double) as bigint), n - 1) then value end) p90,
  max(case when i = least(cast(ceil(n * 0.5::double) as bigint), n - 1) then value end) p50
  from (select *, row_number() over (partition by event_type order by value, event_id) - 1 i, count(*) over (partition by event_type) n from events) group by event_type""")
def bench_report(spark, sf_dir):
    """All percentiles of samples that two workers took."""
    events = load(spark, sf_dir, "events")
    both = latency.merge([events.where("event_id % 2 = 0"), events.where("event_id % 2 <> 0")])
    return latency.report(both, ["event_type"], "value").withColumns({"average": F.round("average", 6), "total": F.round("total", 4)})
