import hashlib
import zlib
from collections import Counter

import pytest

from keyloom.llm.sharding import interleave

SCHEMA = "doc_id long, text string, source string, shard int, k string, at int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "k", 9) for r in rows], SCHEMA).repartition(3)


def corpus():
    rows = [(i, f"text {i} é" * (i % 5), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    rows += [(None, None, None), (None, None, None), (1000, "", None), (1001, "x", "alone"), (5, "text", "s1"), (5, "text", "s1")]
    return rows


def number(*parts):
    return int(hashlib.md5("|".join(parts).encode()).hexdigest()[:13], 16)


def plain(rows, shards, seed=1):
    """doc_id, size, checksum, source, shard and slot of each row by two plain sorts."""
    known = [(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s) for i, t, s in rows]
    keyed = [(number(str(seed), "" if i is None else str(i), str(crc), str(size)), (i is not None, i or 0), crc, size, "-" if s is None else f"+{s}", (i, size, crc, s)) for i, size, crc, s in known]
    counts, placed = Counter(k[4] for k in keyed), []
    seen = Counter()
    for h, i, crc, size, stratum, row in sorted(keyed, key=lambda k: (k[4], *k[:4])):
        seen[stratum] += 1
        fraction = (seen[stratum] - number(str(seed + 7), stratum) / 16.0**13) / counts[stratum]
        placed.append((fraction, h, stratum, i, crc, size, row))
    out, n = [], len(rows)
    for at, (*_, row) in enumerate(sorted(placed, key=lambda p: p[:6])):
        shard = at * shards // n
        out.append((*row, shard, at - -(-shard * n // shards)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_rows", [50_000, 40])
def test_equals_two_plain_sorts(spark, bucket_rows):
    rows = corpus() + [(None, f"text {k}", "hot") for k in range(200)] + [(7, f"text {k % 9}", None) for k in range(200)]
    got = interleave(frame(spark, rows), shards=24, seed=1, bucket_rows=bucket_rows).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.source, r.shard, r.slot) for r in got), key=str) == plain(rows, 24)


@pytest.mark.parametrize("bucket_rows", [50_000, 40])
def test_law_and_mixture(spark, bucket_rows):
    rows = corpus()
    got = interleave(frame(spark, rows), shards=24, seed=1, bucket_rows=bucket_rows).collect()
    want = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for source, n in Counter(s for _, _, s in rows).items():
        own = Counter(r.shard for r in got if r.source == source)
        assert all(abs(own[s] - n / 24) < 2 for s in range(24)), source
    assert {r.law for r in got} == {"rows"}
    # the same shards whatever the partitioning of the input
    again = interleave(frame(spark, rows[::-1]).repartition(5), shards=24, seed=1, bucket_rows=bucket_rows).collect()
    key = lambda r: (str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_few_rows_and_none(spark):
    assert interleave(frame(spark, [])).collect() == []
    got = interleave(frame(spark, [(i, "t", "a") for i in range(3)])).collect()
    assert [r.slot for r in got] == [0, 0, 0] and len({r.shard for r in got}) == 3
