import datetime
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.ops import insert_intents, update_intents
from keyloom.schema import TableDef
from keyloom.streaming import tail

TYPED = TableDef("typed", T.StructType([T.StructField("k", T.LongType()), T.StructField("at", T.TimestampType()), T.StructField("d", T.DecimalType(10, 2)), T.StructField("raw", T.BinaryType()), T.StructField("n", T.LongType())]), key=("k",))


def test_a_mutator_sees_the_same_types_in_every_batch(spark, tmp_path):
    at = datetime.datetime(2024, 5, 6, 7, 8, 9)
    rows = spark.createDataFrame([(1, at, Decimal("1.25"), b"\x00\xff", 1)], TYPED.schema)
    insert_intents(TYPED, rows, F.lit(0).cast("long")).coalesce(1).write.parquet(str(tmp_path / "log/b0"))
    for k in (1, 2):
        change = spark.createDataFrame([(1, k)], "k long, n long")
        update_intents(TYPED, change, F.lit(k).cast("long")).coalesce(1).write.parquet(str(tmp_path / f"log/b{k}"))

    def mutate(row, given):
        kinds = [hasattr(row["at"], "year"), isinstance(row["d"], Decimal), isinstance(row["raw"], bytes)]
        assert all(kinds), row
        return row | {"n": row["n"] * 10 + given["n"], "d": row["d"] + 1}

    answers = tail.fold(tail.tail(spark, str(tmp_path / "log"), TYPED, files_a_batch=1), TYPED, mutate)
    query = answers.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 3
    got = {r["_seq"]: r.row for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert '"n": 112' in got[2] and "3.25" in got[2] and "2024-05-06 07:08:09" in got[2]
