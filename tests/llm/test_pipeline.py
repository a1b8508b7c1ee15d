import random

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_decontaminate import brute as copies
from test_secret_scan import base
from test_simhash_dedup import brute as groups

import __spark_entry__
import corpus_pipeline
from keyloom.llm import language_crf
from keyloom.llm.byte_bpe import load_ranks

EN = "the house is on hill and weather was with them this morning because they like old green trees near water".split()
DE = "das haus steht auf dem hügel und wetter war heute nicht schlecht weil sie alte bäume am wasser lieben".split()


def corpus():
    rng = random.Random(12)
    run = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", "s", "er"]) for _ in range(n))
    rows = [(None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "12 34 !!", "de", "s", 8)]
    rows += [(5, "Быстрая лиса прыгает через ленивую собаку", None, "s", 41), (6, "快速的棕色狐狸跳过懒狗然后回家睡觉", None, "s", 17)]
    items = [(k, run(EN, 20)) for k in range(8)]
    for i in range(10, 90):
        lang = "en" if i % 2 else "de"
        text = run(EN if i % 2 else DE, rng.randint(20, 120))
        if i % 9 == 0:
            text += " " + items[i % 8][1]
        if i % 7 == 0:
            text = f"{text} password={'ab12' * 4} and AKIA{'Q7' * 8} end"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        if i % 5 == 0:
            rows.append((i + 1000, text if i % 2 else text + " ", lang, None, None))
    return rows + [rows[22]], items


def test_stages_match_plain_code(spark, tmp_path):
    rows, items = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = __spark_entry__.queries()["pipeline"](spark, str(tmp_path)).collect()

    model = language_crf.train(docs, F.lit(True))
    names, score, known = model.predict([(t or "").encode() for _, t, *_ in rows])
    left = [r for r, name, s, k in zip(rows, names, score, known, strict=True) if name != "und" and k >= 0.6]
    assert len(left) == len(rows) - 5 and not {1, 2, 5, 6} & {r[0] for r in left}
    marks = groups([(r[0], r[1]) for r in left])
    first = {}
    for r, (_, _, _, g) in zip(left, marks, strict=True):
        if g not in first or r[0] < first[g][0]:
            first[g] = r
    left = list(first.values())
    dirty = {x[0] for x in copies([(r[0], r[1]) for r in left], items)}
    assert dirty
    left = [r for r in left if r[0] not in dirty]
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, text, lang, source, n in left:
        spans, out, at = base(text), "", 0
        for a, _, b in spans:
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        out += text[at:]
        ids = real.encode_ordinary(out)
        want.append((i, lang, source, len(out) if spans else n, len(ids), " ".join(map(str, ids)), True))
    found = [(r.doc_id, r.lang, r.source, r.n_chars, r.n_tokens, r.ids, r.decodes) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_stages_keep_the_columns_and_take_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, score string"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
        if k < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()


def test_language_stage_names_the_language_of_rows_without_one(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words, lang = (EN, "en") if i % 2 else (DE, "de")
        rows.append((i, " ".join(rng.choice(words) for _ in range(40)), None if i % 10 < 2 else lang))
    rows += [(200, rows[0][1], "en"), (201, "Быстрая лиса прыгает через ленивую собаку", None), (202, "12 34", None), (203, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Lang string").repartition(3)
    got = {r.doc_id: (r.text, r.Lang) for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert got == {i: (text, lang or ("en" if i % 2 else "de")) for i, text, lang in rows[:-3]}  # a language given stays
