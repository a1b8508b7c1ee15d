"""Placement of keys: a consistent-hash ring with virtual nodes, and its balance."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = 1000


class Ring:
    """NODES points a shard; a key goes to its successor.

    Each point has a hash of its own. Points at even steps from one hash a shard would repeat one pattern of gaps all
    round, and two shards with near hashes would leave one of them next to nothing.
    """

    def __init__(self, shards: list[str]):
        self.shards = sorted(set(shards))
        points = {}
        for number, name in enumerate(self.shards):
            for i in range(NODES):
                points[int(hashlib.md5(f"{i}:{name}".encode()).hexdigest()[:16], 16)] = number
        at = sorted(points)
        self.points, self.owner = np.array(at, np.uint64), np.array([points[p] for p in at], np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the shard of each unsigned hash; beyond the last point the ring begins anew."""
        return self.owner[np.searchsorted(self.points, hashes.astype(np.uint64)) % len(self.points)]

    def column(self, *key: str) -> Column:
        """Number of the shard of a row, from the first 16 digits of the MD5 of its key's parts, joined by bars."""
        find = self.find

        @F.pandas_udf("int")
        def shard(h: pd.Series) -> pd.Series:
            return pd.Series(find(np.array([int(x, 16) for x in h], np.uint64)))

        return shard(F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in key))), 1, 16))


def balance(rows: DataFrame, shard: Column) -> DataFrame:
    """shard, keys, share."""
    counted = rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("keys"))
    total = rows.count()
    return counted.select("shard", "keys", (F.col("keys") / max(total, 1)).alias("share"))
