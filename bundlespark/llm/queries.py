"""The operators' registered queries: thin, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontamination, embeddings, licenses, packing, pii, quality, shards, simhash, variants, vectorcodes, warc

#: The vocabulary files; their place is a parameter of the operators.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), WORD_BPE, 2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.matrices(_table(spark, sf_dir, "documents"), WORD_BPE, 2048)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN, ids=False, digests=True)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(_table(spark, sf_dir, "documents"), 16).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "spans")
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.encode(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_token_matrices, op3_warc, op4_byte_bpe, op5_quality_rules, op6_license_scan, op7_simhash_near_dedup, op8_sharding, op9_pii, op10_embedding_near_dedup,
                                 op11_decontamination, op12_vector_codes, op13_spelling_variants)}
ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_warc"] = """
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> least_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> least_id then least_id end as refers_to
from (select *, min(page_id) over (partition by payload_digest) as least_id
      from (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages))
"""

_WORD = r"'[^\x20\x09-\x0D]+'"
ORACLE_SQL["op5_quality_rules"] = rf"""
with d as (select doc_id, coalesce('s' || source, 'none') as host, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
lined as (select doc_id, host, t, w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, {_WORD})) as ls from d),
grams as (select doc_id, i, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2), (3), (4)) as o(k) group by doc_id),
line as (select doc_id, host, t, lower(array_to_string(regexp_extract_all(l, {_WORD}), ' ')) as form, len(regexp_extract_all(l, {_WORD})) as words
         from (select doc_id, host, t, unnest(ls) as l from lined)),
frequent as (select f.host, form from (select host, form, count(distinct t) as n from line group by 1, 2) f
             join (select host, count(distinct t) as texts from d group by 1) h on f.host = h.host where n > 5 and n > texts * 0.08),
gone as (select doc_id, sum(words) as lost from line join frequent using (host, form) group by 1),
base as (select l.doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
                coalesce(c.n, 0) as n_repeat_words, coalesce(g.lost, 0) as lost
         from lined l left join covered c on l.doc_id = c.doc_id left join gone g on l.doc_id = g.doc_id)
select doc_id, n_words, cast(word_chars as bigint) as word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost <= n_words * 0.5 as kept, cast(lost as bigint) as lost from base
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL["op11_decontamination"] = rf"""
with d as materialized (select doc_id, {_TERMS} as w from documents),
item as materialized (select item_id, w, least(10, len(w)) as k from (select item_id, {_TERMS} as w from benchmark) where len(w) > 0),
win as materialized (select item_id, k, array_to_string(w[j:j + k - 1], ' ') as g, w[j:j + k - 1] as ws from (select *, unnest(range(1, len(w) - k + 2)) as j from item)),
gram as (select doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from win))),
occ as materialized (select distinct doc_id, p, k, item_id from gram join win using (k, g)),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from occ) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from occ) group by doc_id),
wins as materialized (select row_number() over () as win, item_id, ws from (select distinct item_id, list_sort(list_distinct(ws)) as ws from win)),
post as (select win, doc_id, pos, word from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as pos from d) join (select win, unnest(ws) as word from wins) using (word)),
reach as (select win, doc_id, count(distinct word) over (partition by win, doc_id order by pos range between current row and 19 following) as n from post),
near as (select doc_id, count(distinct item_id) as n_near from (select distinct win, doc_id, n from reach) join wins using (win) where n = len(ws) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d left join hit on hit.doc_id = d.doc_id left join named on named.doc_id = d.doc_id left join near on near.doc_id = d.doc_id
"""

_CODED = "a{n} as materialized (select vec_id, part, cast(min(d * 256 + entry) % 256 as integer) as entry, cast(min(d * 256 + entry) // 256 as bigint) as error from (select vec_id, part, entry, sum((x - y) * (x - y)) as d from x join b{n} using (part, pos) group by all) group by all)"
_MEANS = "b{m} as materialized (select part, pos, entry, coalesce(m.y, b.y) as y from b{n} b left join (select part, pos, entry, cast((s - ((s % n) + n) % n) // n as bigint) as y from (select part, pos, entry, sum(x) as s, count(*) as n from x join a{n} using (vec_id, part) group by all)) m using (part, pos, entry))"
ORACLE_SQL["op12_vector_codes"] = f"""
with v as materialized (select vec_id, label, list_transform(embedding, lambda c: cast(floor(cast(c as double) * 1024) as bigint)) as e, len(embedding) // 4 as width
                        from embeddings where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as materialized (select vec_id, part, pos, e[width * part + pos + 1] as x from (select *, unnest(range(width)) as pos from v), range(4) as p(part)),
b0 as materialized (select part, pos, row_number() over (partition by part, pos order by vec_id) - 1 as entry, x as y from x where vec_id in (select vec_id from v order by vec_id limit 256)),
{", ".join(_CODED.format(n=n) + ", " + _MEANS.format(n=n, m=n + 1) for n in range(4))},
{_CODED.format(n=4)},
coded as (select vec_id, label, string_agg(lower(lpad(hex(entry), 2, '0')), '' order by part) as code, cast(sum(error) as bigint) as error from a4 join v using (vec_id) group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(cast(y as varchar), ',' order by part, entry, pos)) from b4) as codebooks_sha256 from coded
"""

ORACLE_SQL["op13_spelling_variants"] = rf"""
with recursive tab as (select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
runs as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') as run from documents),
counted as materialized (select run, times, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, 128 + (unicode(c) & 63)] end)) as bytes
                         from (select doc_id, run, count(*) as times from runs where length(run) >= 6 group by all)),
hashed as (select run, times, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from counted, tab),
altered as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from hashed),
words as materialized (select word, cast(sum(times) as bigint) as n from altered where length(word) >= 6 group by word having sum(times) >= 5),
cut as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as s from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (select a.word, b.word as other, b.n as other_n from cut a join cut b on a.s = b.s and a.i = b.i and a.word <> b.word
                      union select c.word, w.word, w.n from cut c join words w on w.word = c.s union select w.word, c.word, c.n from cut c join words w on w.word = c.s),
best as (select word, count(*) as n_near, arg_min(other, (-other_n, other)) as other, max(other_n) as other_n from near group by word),
formed as materialized (select words.word, n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * n then other end as form, case when other_n >= 5 * n then other_n end as form_n from words left join best on words.word = best.word),
walk as (select word, word as root from formed union all select walk.word, formed.form from walk join formed on formed.word = walk.root where formed.form is not null)
select f.word, f.form, walk.root, f.n, f.n_near, f.form_n from formed f join walk on walk.word = f.word join formed e on e.word = walk.root where e.form is null
"""
