"""The registered corpus queries, each one operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm import brown_lm, chroma_media, collocations, golomb_dedup, language_spans, piece_match, shard_tree, simhash_grid, source_mix, subword_quality, token_files, url_sweep, whitening
from loomtrace.llm.common import documents

#: Rules of the url query: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


#: The tokenizer files' names in the public vocabularies that executors have.
PIECE_MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_match.digest(documents(spark, sf_dir), vocabulary(PIECE_MODEL))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golomb_dedup.exact_groups(documents(spark, sf_dir))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_grid.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_sweep.judge(pages, rules).drop("url")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize(spark, documents(spark, sf_dir), vocabulary(WORD_MODEL))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return chroma_media.search(chroma_media.vector_fingerprints(vectors, "embedding", "vec_id"), "vec_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_spans.identify(documents(spark, sf_dir), spans=False)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = source_mix.digest(documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.assign(documents(spark, sf_dir)).withColumn("law", F.lit("key"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(documents(spark, sf_dir))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sentencepiece, op2_exact_dedup, op3_simhash_near_dedup, op4_url_filters, op5_token_files, op6_quality_classifier, op7_media_fingerprints, op8_language_id, op9_source_mix, op10_shard_tree, op11_embedding_whitening, op12_lm_scoring, op13_phrase_collocations)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OP2 = """
with d as (select doc_id, coalesce(text, '') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t),
r as (select doc_id, t, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept from d)
select r.doc_id, g.keep_id, g.group_size, r.kept, sha256(r.t) as text_sha256
from r join g on r.t = g.t
"""

_OP4 = f"""
with rules(rule_host, rule_path, said) as (values {", ".join(map(str, URL_RULES))}),
u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
m as (select page_id, rule_host || rule_path as rule, said,
             row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc, rule_host || rule_path desc, said desc) as k
      from p join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select p.page_id, p.host, p.path, m.rule, coalesce(m.said, 'allow') as verdict from p left join m on m.page_id = p.page_id and m.k = 1
"""

_OP9 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3)::int + 1] as weight from s),
c as (select *, sum(3 * source_size) over o - 3 * source_size as cut, sum(weight) over o - weight as gone from w
      window o as (order by 3.0 * source_size / weight, source nulls last)),
l as (select *, ((select sum(source_size) from w)::bigint - cut)::double / ((select sum(weight) from w) - gone)::double as level from c),
v as (select level from l where weight * level <= 3 * source_size order by 3.0 * source_size / weight, source nulls last limit 1),
t as (select source, source_size, case when v.level is null or 3 * source_size < weight * v.level then (3 * source_size)::double else weight * v.level end as target
      from w left join v on true),
r as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
             ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/9'), 1, 13))::bigint / 4503599627370496.0 as draw
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, size * (floor(rate)::bigint + (draw < rate - floor(rate))::bigint) as taken from r
"""


def _op10() -> str:
    steps, last = [], "k"
    for name, tree in (("shard", shard_tree.layout()), ("grown_shard", shard_tree.grown(shard_tree.layout()))):
        leaves = ", ".join(f"({r}, {k}, {s}, {w})" for r, k, s, w in tree)
        steps.append(f"{name}_leaf(r, k, s, w) as (values {leaves})")
        regions = f"select r as id, sum(w) as weight from {name}_leaf group by r"
        racks = f"select r * 3 + k as id, k as child, r as up, sum(w) as weight from {name}_leaf group by r, k"
        steps.append(f"{name}_1 as (select p.*, q.id as region from {last} p, lateral (select arg_min(n.id, {_score('p.key', 'region', 'n.id')}) as id from ({regions}) n) q)")
        steps.append(f"{name}_2 as (select p.*, q.id as place from {name}_1 p, lateral (select arg_min(n.id, {_score("p.key || '/' || p.region", 'rack', 'n.child')}) as id from ({racks}) n where n.up = p.region) q)")
        steps.append(f"{name}_3 as (select p.* exclude (region, place), q.id as {name} from {name}_2 p, lateral (select arg_min(n.s, {_score("p.key || '/' || p.place", 'shard', 'n.s', 'n.w')}) as id from {name}_leaf n where n.r * 3 + n.k = p.place) q)")
        last = f"{name}_3"
    return f"""
with recursive bit(i, c, k) as (select i, i, 0 from range(256) x(i) union all
    select i, case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end, k + 1 from bit where k < 8),
crc as (select list(c::bigint order by i) as t from bit where k = 8),
b as (select doc_id, coalesce(text, '') as x, hex(encode(coalesce(text, ''))) as h from documents),
k as materialized (select doc_id, coalesce(doc_id::varchar, '') as key, (octet_length(encode(x)) + 8)::bigint as size,
      xor(4294967295, list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::bigint + 1, 2))::bigint), lambda a, v: xor(a >> 8, crc.t[xor(a & 255, v) + 1]), 4294967295::bigint)) as text_crc32
      from b, crc),
{", ".join(steps)},
o as (select *, ('0x' || substr(md5(key || '/' || text_crc32), 1, 13))::bigint as ord from {last})
select doc_id, size, text_crc32, 'key' as law, shard::int as shard, (row_number() over (partition by shard order by ord, doc_id nulls first, text_crc32, size) - 1)::bigint as slot,
       grown_shard::int as grown_shard from o
"""


_OP13 = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
n as (select lang, sum(len(ws))::bigint as n from w group by lang),
s as (select lang, 1 as k, unnest(ws) as phrase, null as head, null as h2, null as tail, null as t2 from w
  union all select lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])), unnest(ws[:-2]), null, unnest(ws[2:]), null from w
  union all select lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])), unnest(ws[:-3]),
    unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])), unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i + 1] || ' ' || ws[i + 2])), unnest(ws[3:]) from w),
f as (select lang, k, phrase, any_value(head) as head, any_value(h2) as h2, any_value(tail) as tail, any_value(t2) as t2, count(*) as a from s group by lang, k, phrase),
c as (select f.*, l.a as l, r.a as r, (1000000::hugeint * f.a * f.a // (l.a::hugeint * r.a))::bigint as score, 1 as cut from f join f l on l.lang = f.lang and l.phrase = f.head join f r on r.lang = f.lang and r.phrase = f.tail where f.k > 1 and f.a >= 10
  union all select f.*, l.a, r.a, (1000000::hugeint * f.a * f.a // (l.a::hugeint * r.a))::bigint, 2 from f join f l on l.lang = f.lang and l.phrase = f.h2 join f r on r.lang = f.lang and r.phrase = f.t2 where f.k = 3 and f.a >= 10),
b as (select * from c qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
x as (select lang, phrase, max(a) as longer from (select lang, h2 as phrase, a from f where k = 3 and a >= 10 union all select lang, tail, a from f where k = 3 and a >= 10) group by lang, phrase),
o as (select b.*, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase) as rank from b left join x on x.lang = b.lang and x.phrase = b.phrase and b.k = 2 where x.longer is null or 100 * x.longer < 50 * b.a)
select o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score from o join n on n.lang = o.lang where o.rank <= 2000
"""


def _score(parent: str, level: str, child: str, weight: str = "n.weight") -> str:
    return f"-ln((('0x' || substr(md5({parent} || '/{level}/' || {child}), 1, 13))::bigint + 0.5) / 4503599627370496.0) / {weight}"


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": _OP2, "op4_url_filters": _OP4, "op9_source_mix": _OP9, "op10_shard_tree": _op10(), "op13_phrase_collocations": _OP13}
