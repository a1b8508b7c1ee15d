"""The registered queries of this subpackage: each operator over its whole table, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import byte_bpe, decontaminate, language_crf, multiset_fingerprint, quality_gam, secret_scan, sharding, simhash_dedup, substring_dedup, url_filter
from keyloom.llm._frames import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), rate=0.01, least=20)
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == secret_scan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = secret_scan.spans_text(F.filter(spans, lambda s: s["kind"] < 3))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base, 256).alias("base_sha256"), secret_scan.spans_text(spans).alias("spans"), count("random"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.windows_removed(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
with docs as (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
words as (select rid, len(ws) n, unnest(ws) word, unnest(range(1, len(ws) + 1)) i from docs),
windows as (select *, case when i + 34 <= n then string_agg(word, ' ') over (partition by rid order by i rows between current row and 34 following) end win from words),
repeated as (select win from windows where win is not null group by win having count(*) > 1),
marked as (select w.*, r.win is not null as again from windows w left join repeated r on w.win = r.win),
covered as (select *, max(case when again then 1 else 0 end) over (partition by rid order by i rows between 34 preceding and current row) gone from marked),
done as (select rid, count(*) n_words, sum(gone) n_removed, string_agg(word, ' ' order by i) filter (where gone = 0) kept from covered group by rid)
select doc_id, coalesce(n_words, 0)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from docs left join done using (rid)
"""


def op3_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_fingerprint.compare_neighbours(table(spark, sf_dir, "documents"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), radius=3, size=3)
    return out.select("doc_id", "fingerprint", "component_id")


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    out = quality_gam.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder != 2)
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", predicted)


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    out = language_crf.predict(docs, language_crf.train(docs, learn=remainder != 1))
    return out.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(table(spark, sf_dir, "documents"), shards=24, seed=1)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The byte-wise CRC-32 of the text: its polynomial, reversed, is a fixed value.
OP7_SQL = f"""
with steps as (select list(crc order by b) steps from (
  select b, list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, case when c % 2 = 1 then 3988292384 else 0 end)) crc from range(256) r(b))),
bytes as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 size,
  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::bigint) bytes from documents),
rows as (select doc_id, case when source is null then '-' else '+' || source end stratum, size,
  xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(steps[xor(c, b) % 256 + 1], c >> 8)), 4294967295)::bigint text_crc32 from bytes, steps),
hashed as (select *, ('0x' || substr(md5(concat_ws('|', '1', coalesce(doc_id::varchar, ''), text_crc32, size)), 1, {sharding.HEX_DIGITS}))::bigint h,
  ('0x' || substr(md5('{1 + sharding.OFFSET_SALT}|' || stratum), 1, {sharding.HEX_DIGITS}))::bigint / {sharding.UNIT!r}::double u from rows),
ranked as (select *, (row_number() over (partition by stratum order by h, doc_id nulls first, text_crc32, size) - u) / count(*) over (partition by stratum) fraction from hashed),
placed as (select *, row_number() over (order by fraction, h, stratum, doc_id nulls first, text_crc32, size) - 1 place, count(*) over () n from ranked)
select doc_id, size::bigint size, text_crc32, 'rows' law, (place * 24 // n)::int shard,
  (place - (place * 24 // n * n + 23) // 24)::bigint slot, null::int grown_shard from placed
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item that a document holds: question and answer, or the whole item, at 0.8 of their five-word shingles."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), whole=True)
    return found.withColumns({c: F.round(c, 6) for c in ("score", "question_overlap", "answer_overlap", "overlap")})


#: Every passage against every item that shares a word with it, without blocks or bounds.
OP9_SQL = rf"""
with folded as (select row_number() over () ir, item_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') ws from benchmark),
items as (select *, len(ws) n from folded where len(ws) > 0),
figures as (select count(*) items, avg(n) mean, greatest(32, max(n)) step from items),
terms as (select ir, w, n, count(*) tf from (select ir, n, unnest(ws) w from items) group by all),
held as (select w, count(*) df from terms group by w),
weighed as (select ir, w, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * ({decontaminate.K1} + 1) / (tf + {decontaminate.K1} * (1 - {decontaminate.B} + {decontaminate.B} * n / greatest(mean, 1)))::double c
  from terms join held using (w), figures),
shares as (select ir, w, c / sum(c) over (partition by ir) share from weighed),
docs as (select row_number() over () dr, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') ws from documents),
places as (select dr, ws, step, unnest(range(greatest(1, ceil((len(ws) - step) / step::double)::bigint))) k from docs, figures),
passages as (select dr, k, ws[k * step + 1 : (k + 2) * step] ws from places),
scored as (select dr, k, ir, sum(share) score from (select dr, k, unnest(list_distinct(ws)) w from passages) join shares using (w) group by all having sum(share) >= 0.5 - 1e-9),
parts as (select ir, 'q' part, ws[1 : n - n // 3] p from items union all select ir, 'a', ws[n - n // 3 + 1 :] from items union all select ir, 'e', ws from items),
sized as (select *, least({decontaminate.SHINGLE}, len(p)) s from parts),
owned as (select ir, part, s, list_distinct(list_transform(range(1, len(p) - s + 2), lambda i: array_to_string(p[i : i + s - 1], ' '))) own from sized),
asked as (select distinct dr, k, s from scored join owned using (ir) where s > 0),
having_ as (select dr, k, s, list_distinct(list_transform(range(1, len(ws) - s + 2), lambda i: array_to_string(ws[i : i + s - 1], ' '))) have from asked join passages using (dr, k)),
covered as (select dr, k, ir, score, part, case when s = 0 then 1.0::double else len(list_intersect(own, have)) / len(own)::double end share
  from scored join owned using (ir) left join having_ using (dr, k, s)),
wide as (select dr, k, ir, score, max(share) filter (where part = 'q') q, max(share) filter (where part = 'a') a, max(share) filter (where part = 'e') e from covered group by all),
best as (select *, row_number() over (partition by dr, ir order by score desc, q desc, a desc, e desc) place from wide where (q >= 0.8 and a >= 0.8) or e >= 0.8)
select doc_id, item_id, round(score, 6) score, round(q, 6) question_overlap, round(a, 6) answer_overlap, round(e, 6) overlap
from best join docs using (dr) join items using (ir) where place = 1
"""


#: The rules of the contract: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Listed domains: these names under each of the three endings, and every host of the pages whose MD5 begins with one of LISTED_DIGITS.
LISTED_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ENDINGS = ("com", "net", "org")
LISTED_DIGITS = "05"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    names = spark.createDataFrame([(f"{name}.example.{ending}",) for name in LISTED_NAMES for ending in ENDINGS], "key string")
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("key")).distinct()
    listed = names.union(hosts.where(F.substring(F.md5("key"), 1, 1).isin(*LISTED_DIGITS)))
    return url_filter.judge(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '') as host,
    coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
listed as (select n || '.example.' || e as key from unnest([{", ".join(f"'{n}'" for n in LISTED_NAMES)}]) a(n), unnest([{", ".join(f"'{e}'" for e in ENDINGS)}]) b(e)
  union select host from parts where host <> '' and substr(md5(host), 1, 1) in ({", ".join(f"'{d}'" for d in LISTED_DIGITS)})),
parents as (select distinct host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) as key from (select distinct host from parts)),
blocked as (select distinct host from parents where key in (select key from listed)),
ruled as (
  select *, case
    when (host = 'example.com' or suffix(host, '.example.com')) and prefix(path, '/en/7') then 'example.com/en/7'
    when (host = 'example.net' or suffix(host, '.example.net')) and prefix(path, '/de/8') then 'example.net/de/8'
    when (host = 'com' or suffix(host, '.com')) and prefix(path, '/en/') then 'com/en/'
    when (host = 'net' or suffix(host, '.net')) and prefix(path, '/de/') then 'net/de/'
    when (host = 'org' or suffix(host, '.org')) and prefix(path, '/es/') then 'org/es/' end as rule
  from parts)
select page_id, host, path, rule, case
    when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block'
    when rule is not null then 'allow'
    when host in (select host from blocked) then 'block'
    else 'allow' end as verdict
from ruled
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_multiset_fingerprint, op4_simhash_dedup, op5_quality_gam, op6_language_crf, op7_stratified_interleave, op8_byte_bpe, op9_benchmark_decontamination, op10_url_filter)}

ORACLES: dict[str, str] = {"op2_substring_dedup": OP2_SQL, "op7_stratified_interleave": OP7_SQL, "op9_benchmark_decontamination": OP9_SQL, "op10_url_filter": OP10_SQL}
