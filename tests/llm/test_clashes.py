"""Columns whose names operators use themselves, in any case, pass through or are replaced as documented."""

import corpus_pipeline
from keyloom.llm import simhash_dedup, url_filter
from keyloom.llm._frames import durable, scratch, shared_folder


def test_pages_with_an_internal_name(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x", True, "h"), (2, "http://b.com/x", False, "h")], "page_id long, url string, _listed boolean, HOST string")
    listed = spark.createDataFrame([("a.org",)], "key string")
    for max_bytes in (1 << 20, 8):
        got = url_filter.judge(pages, listed, [], max_bytes=max_bytes).collect()
        assert sorted((r.page_id, r._listed, r.verdict, r.host) for r in got) == [(1, True, "block", "a.org"), (2, False, "allow", "b.com")]


def test_documents_with_internal_names(spark):
    rows = [(1, "one text here", 5, 6, 7), (1, "one text here", 5, 6, 7), (2, "One TEXT here", 8, 9, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rank int, tag int, _spans int")
    got = simhash_dedup.keep_one(docs).collect()
    assert [tuple(r) for r in got] == [rows[0]]
    assert [tuple(r) for r in corpus_pipeline.secrets(spark, docs, "").where("doc_id = 2").collect()] == [rows[2]]


def test_what_is_put_aside_is_removed(spark):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before = len(files.listStatus(path))
    with scratch(spark):
        assert durable(spark.range(5)).count() == 5
        assert len(files.listStatus(path)) == before + 1
    assert len(files.listStatus(path)) == before
