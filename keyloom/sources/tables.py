"""Input tables and the place for the engine's own files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared one (a temporary one only where the session names none and all runs on this machine)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='keyloom-')}/tables-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, bad_rows: str = "fail") -> DataFrame:
    """A headered CSV file by a given schema. bad_rows: fail (at the first), skip, or stop (keep the rows before the first bad one).

    stop is about the order of one file: files are taken one by one, rows in their place in the file. It parses lines, so
    quoted line breaks aren't for it.
    """
    options = {"header": True, "escape": '"', "enforceSchema": False}
    if bad_rows != "stop":
        mode = {"fail": "FAILFAST", "skip": "DROPMALFORMED"}[bad_rows]
        return spark.read.schema(schema).options(mode=mode, multiLine=True, **options).csv(path)
    lines = spark.read.text(path).where("value <> ''").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    if (header := lines.first()) is None:
        return spark.createDataFrame([], schema)
    marked = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField("_bad", T.StringType())])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.fields)
    parsed = F.from_csv("value", F.lit(kinds), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'})
    rows = lines.where(F.col("value") != header["value"]).withColumn("parsed", parsed)
    # ids grow within a block of a file, so the first bad row is told by its block and its id
    first = rows.where("parsed._bad is not null").groupBy("file").agg(F.min(F.struct("block", "row")).alias("stop"))
    kept = rows.join(first, "file", "left").where(F.col("parsed._bad").isNull() & (F.col("stop").isNull() | (F.struct("block", "row") < F.col("stop"))))
    return kept.select(*(F.col("parsed")[name].alias(name) for name in schema.names))
