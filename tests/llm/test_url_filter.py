import random
import re

import pytest

from keyloom.llm import url_filter

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def brute(url, listed):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    labels = host.split(".")
    return host, path, None, "block" if any(".".join(labels[k:]) in listed for k in range(len(labels))) else "allow"


def corpus():
    rng = random.Random(3)
    tld = ["com", "net", "org"]
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7?x", "https://example.net", "x://y://z/en/", "http://ÉX.org/es/\n/1", "http://com/en/", "http://.com/fr", "http://example.com?/en/"]
    for _ in range(3000):
        urls.append(f"http://{rng.choice(['www.', 'm.', ''])}h{rng.randint(0, 1500)}.Example.{rng.choice(tld)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}{rng.choice(['', '?q', '#top'])}")
    listed = {f"h{k}.example.{rng.choice(tld)}" for k in range(0, 1500, 3)} | {"never.seen.example.org"}
    return [(i, u) for i, u in enumerate(urls)] + [(4, urls[4]), (None, urls[5])], listed


@pytest.mark.parametrize("max_bytes", [64 << 20, 8])
def test_exact_over_the_universe(spark, max_bytes):
    rows, listed = corpus()
    pages = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, html string").repartition(3)
    got = url_filter.judge(pages, spark.createDataFrame([(k,) for k in listed], "key string"), RULES, max_bytes=max_bytes)
    assert set(got.columns) == {"page_id", "url", "html", "host", "path", "rule", "verdict"}
    found = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str)
    assert found == sorted(((i, u, *brute(u, listed)) for i, u in rows), key=str)


def test_levels_alternate(spark):
    rows, listed = corpus()
    keys = {f"key{i}": i % 40 == 0 for i in range(20_000)}
    cascade = url_filter.build(spark.createDataFrame(list(keys.items()), "key string, listed boolean").repartition(3), 1 << 20)
    assert len(cascade.levels) > 1
    assert cascade.listed([k.encode() for k in keys]).tolist() == list(keys.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "key string")
    pages = spark.createDataFrame([(1, "http://a.org/en")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(pages, none, []).collect()] == ["allow"]
    assert url_filter.judge(pages.limit(0), spark.createDataFrame([("a.org",)], "key string"), RULES).collect() == []
