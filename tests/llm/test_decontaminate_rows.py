import random

from test_decontaminate import corpus, frames, words

import __spark_entry__
import corpus_pipeline
from keyloom.llm import decontaminate as dc


def share(item, text):
    k = min(5, len(item))
    own, have = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (item, text))
    return len(own & have) / len(own)


def test_a_copy_with_one_word_changed_anywhere_is_found(spark, tmp_path):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randint(0, 900)}" for _ in range(30 + 3 * i))) for i in range(6)]
    rows, want = [], set()
    for i, text in items:
        for at in range(len(words(text))):
            own = text.split()
            own[at] = "changed"
            rows.append((1000 * i + at, f"before it {' '.join(own)} after it"))
            if share(words(text), words(rows[-1][1])) >= 0.8:
                want.add((1000 * i + at, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = __spark_entry__.queries()["op9_benchmark_decontamination"](spark, str(tmp_path)).collect()
    assert len(want) > 150 and {(r.doc_id, r.item_id) for r in got} >= want
    assert all(r.overlap >= 0.8 or min(r.question_overlap, r.answer_overlap) >= 0.8 for r in got)
    kept = {r.doc_id for r in corpus_pipeline.benchmark_copies(spark, docs, str(tmp_path)).collect()}
    assert not kept & {i for i, _ in want}


def test_whole_adds_to_what_parts_find(spark):
    docs, bench = frames(spark, *corpus())
    parts, whole = ({(r.doc_id, r.item_id) for r in dc.contaminated(docs, bench, whole=w).collect()} for w in (False, True))
    assert parts < whole


def test_rows_of_one_id_are_judged_each(spark):
    rows, items = corpus()
    copy = items[7][1]
    shared = [(None, copy), (None, "clean and without an id"), (None, None), (5, f"a {copy} b"), (5, "clean, same id"), (5, "clean, same id"), (6, "")]
    docs, bench = frames(spark, shared, items)
    want = sorted([(i, t) for i, t in shared if copy not in (t or "")], key=str)
    for part_bytes in (1 << 20, 3000):
        kept = dc.clean(docs, bench, part_bytes=part_bytes)
        assert kept.schema == docs.schema
        assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == want
    assert sorted((r.text or "" for r in dc.clean(docs, bench.limit(0)).collect())) == sorted(t or "" for _, t in shared)
