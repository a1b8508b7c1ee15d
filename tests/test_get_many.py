from keyloom.operators import read
from keyloom.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_the_query_sends_its_keys_through_the_operator(spark, monkeypatch):
    sent = []
    real = read.get_many
    monkeypatch.setattr(read, "get_many", lambda table, rows, keys: sent.append(keys) or real(table, rows, keys))
    got = sorted(map(tuple, catalog.QUERIES["multi_get_many"](spark, SMALL).collect()))
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").where("o_orderkey % 3 = 1")
    assert got == sorted(map(tuple, orders.select("o_orderkey", "o_custkey", "o_totalprice").collect()))
    assert len(sent) == 1 and "orders" not in sent[0]._jdf.queryExecution().toString() and got


def test_each_row_of_the_request_is_answered(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    keys = spark.createDataFrame([(3, "x"), (1, "x"), (3, "x"), (9, "x"), (None, "x")], "k long, v string")
    got = read.get_many(catalog.table_def(rows, "t", "k"), rows, keys)
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (3, "c"), (3, "c")]
