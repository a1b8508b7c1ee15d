import hashlib
import random
import sys

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import queries
from keyloom.llm.byte_bpe import Codec, load_ranks

RANKS = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = Codec(RANKS, public_tokenizers.PATTERN)


def check(text):
    ids = CODEC.encode(text)
    assert ids == REAL.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()
    joined, n, data = CODEC.texts(text)
    assert joined == " ".join(map(str, ids)) and n == len(ids) and data == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet="abeilnorst'ABé日 \n\t.-0123456789", max_size=400)))
def test_equals_the_library(text):
    check(text)


def test_long_pieces():
    rng = random.Random(8)
    for n in (25, 48, 49, 1000, 20_000):
        check("".join(rng.choice("etaoinshrdlu") for _ in range(n)))
        check("=" * n + "\n" * n + "a" * n + " " * n + "ab" * n + "日本" * n)
        check("".join(rng.choice(["the", "ing", "tion", "er", "Ab", "ü"]) for _ in range(n)))
    check("<|endoftext|> ordinary \U0001f600\U0001f600 'll 've")


def test_what_a_worker_remembers_stays_small():
    codec = Codec(RANKS, public_tokenizers.PATTERN)
    for low in range(0, 300_000, 1000):
        text = " ".join(f"q{k:05x}" for k in range(low, low + 1000)).translate(str.maketrans("0123456789", "ghijklmnop"))
        assert codec.texts(text)[2] == text.encode()
    tables = [t for t in vars(codec).values() if isinstance(t, dict) and t is not codec.ranks and t is not codec.tokens]
    kept = sum(sys.getsizeof(t) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in t.items()) for t in tables)
    if isinstance(next(iter(codec.known.values())), tuple):
        kept += sum(sys.getsizeof(x) for row in codec.known.values() for x in row)
    assert kept < 40 << 20


def test_tokens_of_one_rank_are_decoded_from_the_ids():
    codec = Codec(RANKS | {b" zqzq": RANKS[b" the"]}, public_tokenizers.PATTERN)
    for _ in range(2):
        joined, n, data = codec.texts("a zqzq the")
        assert data == codec.decode(map(int, joined.split())) == b"a zqzq zqzq" and n == 3


def test_query_round_trip(spark, tmp_path):
    rows = [(None, None), (1, ""), (2, "Hello  world's 123\n\n é 日本"), (3, "x" * 5000), (2, "Hello  world's 123\n\n é 日本"), (3, None)]
    spark.createDataFrame([(i, t, 4, "i") for i, t in rows], "doc_id long, text string, n_tokens int, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_byte_bpe(spark, str(tmp_path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids := REAL.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert queries.op8_byte_bpe(spark, str(tmp_path / "none")).collect() == []
