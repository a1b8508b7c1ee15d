import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__
from keyloom.config import Options
from keyloom.operators import latency, placement, read
from keyloom.sources.tables import read_csv


def test_ring_finds_the_successor():
    ring = placement.Ring(["a", "b", "c"])
    points = ring.points.tolist()
    assert len(points) == 3 * placement.NODES
    rng = np.random.default_rng(1)
    for h in [0, 2**64 - 1, points[0], points[-1], *map(int, rng.integers(0, 2**63, 50))]:
        later = [i for i, p in enumerate(points) if p >= h]
        assert ring.find(np.array([h], np.uint64))[0] == ring.owner[later[0] if later else 0]


def test_ring_is_balanced_and_stable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    shares = [r.share for r in placement.balance(rows, placement.Ring(["a", "b", "c", "d"]).column("k")).collect()]
    assert len(shares) == 4 and max(shares) < 0.4 and math.isclose(sum(shares), 1)
    moved = rows.select((placement.Ring(["a", "b", "c"]).column("k") != placement.Ring(["a", "b", "c", "d"]).column("k")).alias("m"))
    assert moved.where("m").count() < 0.5 * 20_000


def test_percentiles_and_regressions(spark, tmp_path):
    values = [5.0, 1.0, 4.0, 2.0, 3.0, 9.0, 9.0]
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "g int, i int, v double")
    (got,) = latency.report(frame, ["g"], "v").collect()
    at = lambda p: sorted(values)[min(math.ceil(len(values) * p), len(values) - 1)]
    assert (got.p99, got.p90, got.p50, got.min, got.max, got.n) == (at(0.99), at(0.9), at(0.5), 1.0, 9.0, 7)
    path = str(tmp_path / "b.json")
    assert latency.load(spark, path) == {}
    latency.save(spark, path, {"q": 1.0, "r": 2.0})
    change = latency.compare({"q": 1.05, "r": 2.01, "new": 1.0}, latency.load(spark, path))
    assert change["q"]["regression"] and not change["r"]["regression"] and "new" not in change


def test_percentiles_of_large_groups_with_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(latency, "SMALL", 50)
    monkeypatch.setattr(latency, "ACCURACY", 100)
    rng = np.random.default_rng(2)
    groups = {1: rng.normal(size=3000).tolist(), None: [7.0] * 900 + rng.integers(0, 5, 400).astype(float).tolist(), 3: [2.5], 4: rng.exponential(size=49).tolist()}
    rows = [(g, v) for g, values in groups.items() for v in values] + [(1, None)] * 40 + [(5, None)]
    frame = spark.createDataFrame(rows, "g int, v double").repartition(7)
    got = {r.g: r for r in latency.report(frame, ["g"], "v").collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        at = lambda p: sorted(values)[min(math.ceil(len(values) * p), len(values) - 1)]  # noqa: B023, E731
        assert (got[g].n, got[g].min, got[g].max) == (len(values), min(values), max(values))
        assert {k: got[g][k] for k in latency.PERCENTILES} == {k: at(p) for k, p in latency.PERCENTILES.items()}
    assert latency.percentile(frame.where("g = 9"), ["g"], "v", 0.5).collect() == []


def test_csv_by_schema(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])
    (tmp_path / "a.csv").write_text('id,title\n1,"a ""b"",\nc"\nx,bad\n3,d\n')
    assert [(r.id, r.title) for r in read_csv(spark, str(tmp_path / "a.csv"), schema, "skip").collect()] == [(1, 'a "b",\nc'), (3, "d")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|x,bad|cannot|FAILED_READ"):
        read_csv(spark, str(tmp_path / "a.csv"), schema).collect()


def test_options(tmp_path):
    (tmp_path / "o.json").write_text('{"buckets": 3, "tables": {"t": {"buckets": 5}}}')
    o = Options.load(str(tmp_path / "o.json"), {"KEYLOOM_LOG_BYTES": "10"})
    assert (o.buckets, o.log_bytes, o.of("t").buckets, o.of("u").buckets) == (3, 10, 5, 3)
    with pytest.raises(ValueError, match="no such"):
        (tmp_path / "o.json").write_text('{"bukets": 3}')
        Options.load(str(tmp_path / "o.json"), {})


def test_skip_and_latest(spark):
    frame = spark.createDataFrame([(1, 5), (2, 7), (2, 6)], "k int, v int")
    assert [r.idx for r in read.skip(frame, 0, "v").collect()] == [1, 2, 3] and read.skip(frame, 9, "v").count() == 0
    assert sorted((r.k, r.v) for r in read.latest(frame, ["k"], ["v"]).collect()) == [(1, 5), (2, 7)]


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.columns == ["k", "v", "inserted_at", "last_seq"] and out.count() > 0
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names)


def test_skip_in_many_ranges(spark):
    rows = [((k * 37) % 500, k) for k in range(500)]
    frame = spark.createDataFrame(rows, "v long, w int").repartition(7)
    assert sorted((r.v, r.idx) for r in read.skip(frame, 123, "v").collect()) == [(v, v + 1) for v in range(123, 500)]
    assert read.skip(frame.limit(0), 3, "v").collect() == []


def test_csv_up_to_the_first_bad_row(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType())])
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "a.csv").write_text('id,title\n1,"a ""b"""\n\n2,c\nx,bad\n3,d\n4\n')
    (folder / "b.csv").write_text("id,title\n5,e\n6,f\n")
    assert sorted((r.id, r.title) for r in read_csv(spark, str(folder), schema, "stop").collect()) == [(1, 'a "b"'), (2, "c"), (5, "e"), (6, "f")]
    (tmp_path / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "empty.csv"), schema, "stop").collect() == []


def test_queries_of_tables_work_without_the_other_part(tmp_path):
    """Whether its folder, or a library that only it uses, is missing."""
    import subprocess
    import sys

    for missing in ("keyloom.llm", "xxhash"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert 'get_point' in e.queries() and 'get_point' in e.oracle_sql(); assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=__spark_entry__.__file__.rpartition("/")[0], timeout=60)
