"""The registered queries of the text operators, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from axlewatch.llm import chat, decontam, importance, jaccard, mixing, quality, rules, secret_scan, simhash, substring, tokens, trie, warc
from axlewatch.llm.common import table

#: A conversation whose texts look like the marks of templates.
HARD_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_CONVERSATION, "conv_id long, turn int, role string, text string").selectExpr(*[f"cast({c} as {t}) as {c}" for c, t in rows.dtypes])
    return chat.read_back(chat.format_turns(chat.text_parts(rows.unionByName(hard))))


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_index(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "timestamp")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"), min_words=20, min_line_words=20)


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), percent=90, words=3)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat_format, op2_warc_index, op3_mix_sources, op4_substring_dedup, op5_token_ids, op6_decontaminate, op7_quality, op8_simhash, op9_quality_rules, op10_secrets, op11_prefix_trie, op12_jaccard_join, op13_importance, pipeline)
}

ORACLES: dict[str, str] = {
    "op1_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), turns as (
  select *, length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '</?(turn|image|audio|document|other)\b')) as escaped,
    case when role = 'assistant' then length('<turn role="assistant" loss>') else length('<turn role="">') + length(role) end + length('</turn>' || chr(10)) as marks
  from rows
)
select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(escaped + marks) as bigint) as formatted_chars
from turns group by conv_id
""",
    "op3_mix_sources": r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    md5('17:' || coalesce(cast(doc_id as varchar), '')) || md5(coalesce(text, '')) as key from documents
), sources as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (
  select source, source_size, list_extract([3.0::double, 1.0::double, 2.0::double], cast((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as integer)) as weight, source_size * 2.0::double as cap from sources
), leveled as (
  select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by cap / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, encode(source) nulls last rows between current row and unbounded following) as level from ranked
), targets as (
  select source, source_size, case when cap / weight <= level then cap else weight * coalesce(max(level) filter (where cap / weight > level) over (), 0) end as target from leveled
), need as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from targets
), alike as (select source, key, sum(size) as words from sized group by all),
walked as (
  select a.source, a.key, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size as need, a.words,
    coalesce(sum(a.words) over (partition by a.source order by a.key rows between unbounded preceding and 1 preceding), 0) as before
  from alike a join need n on a.source is not distinct from n.source
)
select d.doc_id, d.size, w.source_size, w.target, cast(d.size * (w.whole + case when w.need > 0 and w.before + w.words / 2.0 <= w.need then 1 else 0 end) as bigint) as taken
from sized d join walked w on d.source is not distinct from w.source and d.key = w.key
""",
    "op11_prefix_trie": r"""
with recursive numbered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as r from conversations where conv_id is not null
), convs as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_transform(range(1, length(id) + 1), lambda i: ord(substr(id, i, 1))::bigint), lambda c, b: list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295), 4294967295) % 6 as h
  from (select distinct conv_id, cast(conv_id as varchar) as id from numbered)
), held as (select conv_id, count(*) as held from numbered group by 1),
rebuilt as (
  select c.conv_id, n.r as d, role, text from convs c join numbered n on n.conv_id = c.base and n.r <= c.h
  union all
  select c.conv_id, least(c.h, coalesce(held, 0)) + n.r - c.h, role, text from convs c join numbered n on n.conv_id = c.conv_id and n.r > c.h left join held on held.conv_id = c.base
), paths as (
  select conv_id, d, length(text) as chars, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by d)) as key from rebuilt
), members as (
  select conv_id, d, key, chars, coalesce(lag(key) over (partition by conv_id order by d), '') as up from paths union all select conv_id, 0, '', 0, null from convs
), nodes as (
  select d, key, min(up) as up, min(conv_id) as c, count(*) as n, min(chars) as chars from members group by d, key
), kids as (select d - 1 as d, up, count(*) as n_children from nodes where d > 0 group by all),
own as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids on nodes.d = kids.d and nodes.key = kids.up),
totals as (
  select m.d, m.key, sum(case when o.n_children = 0 then 1 else 0 end) as n_leaves, sum((o.n - 1) * o.chars) as saved_tokens from own o join members m on m.conv_id = o.c and m.d <= o.d group by m.d, m.key
), lasts as (
  select d, key, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from (select conv_id, d, key, row_number() over (partition by conv_id order by d desc) as back from members) where back = 1 group by all
)
select o.c as conv_id, cast(o.d as bigint) as depth, p.c as parent_conv_id, cast(o.n as bigint) as n_convs, cast(o.n_children as bigint) as n_children,
  cast(t.n_leaves as bigint) as n_leaves, cast(t.saved_tokens as bigint) as saved_tokens, sha256(coalesce(l.ids, '')) as ends_sha256
from own o join totals t on o.d = t.d and o.key = t.key left join nodes p on p.d = o.d - 1 and p.key = o.up left join lasts l on l.d = o.d and l.key = o.key
""",
    "op12_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from words
), tokens as (select doc_id, len(s) as n, unnest(s) as t from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from tokens a join tokens b on a.t = b.t and a.doc_id < b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 90 * (min(a.n) + min(b.n) - count(*))
), edges as (select a, b from pairs union all select b, a from pairs),
reach(doc_id, other) as (select a, a from edges union select reach.doc_id, edges.b from reach join edges on reach.other = edges.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, coalesce(c.component_id, s.doc_id) as component_id
from sets s left join (select doc_id, min(other) as component_id from reach group by doc_id) c using (doc_id)
""",
    "op13_importance": r"""
with table_of as (
  select list(list_reduce(range(8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, v::bigint) order by v) as crc from (select unnest(range(256)) as v)
), texts as (
  select doc_id as id, 0 as kind, text from documents union all select item_id, 1, text from benchmark
), words as (
  select id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
), features as (
  select id, kind, unnest(w || list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) || list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' '))) as f from words where len(w) > 0
), hashed as (
  select f, hex(encode(f)) as x from (select distinct f from features)
), buckets as (
  select f, xor(list_reduce(list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 as bucket
  from hashed, table_of
), counted as (
  select bucket, count(*) filter (where kind = 0) as s, count(*) filter (where kind = 1) as t from features join buckets using (f) group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1)::double * ((sum(s) over ()) + 10000)::double / ((s + 1)::double * ((sum(t) over ()) + 10000)::double))) as gain from counted
), weighed as (
  select id, count(*) as n_features, cast(sum(gain) as bigint) as weight from features join buckets using (f) join gains using (bucket) where kind = 0 group by id
), scored as (
  select id as doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', substr(sha256('42:' || coalesce(cast(id as varchar), '')), i, 1)) - 1), lambda a, b: a * 16 + b)::double as h
  from words left join weighed using (id) where kind = 0
), final as (
  select doc_id, n_words, n_features, weight, cast(weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score from scored
), placed as (
  select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_words >= 20) as n from final
)
select doc_id, cast(n_features as bigint) as n_features, cast(weight as bigint) as weight, score, case when n_words >= 20 and place <= 5 * n // 100 then place end as rank from placed
""",
}
