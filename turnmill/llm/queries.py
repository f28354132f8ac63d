"""The queries of the subpackage's operators, each over its whole table, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bpe, jaccard, kneser, langid, licenses, lines, media, packing, preference, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """The path of the public tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = kneser.trusted_ids(_table(spark, sf_dir, "labels"))
    return kneser.judge(_table(spark, sf_dir, "documents"), trusted).drop("key")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.component_ids(_table(spark, sf_dir, "documents"))


def op3_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media are written to the shared folder and read back; the resampled PCM is stored as a column of the result."""
    files = blocks.stored(spark, media.store(_table(spark, sf_dir, "documents")))
    return media.read(files).withColumnRenamed("id", "doc_id")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_bpe(), with_ids=False).drop("ids")


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = lines.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: entry: verdict
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: The method's own list, for urls that no rule fits: hosts named by a theme, alone or with a number, on three domains. The rule stands
#: in for a table of a million blocked hosts.
URL_THEMES = ("casino-win", "ads-track", "free-bets", "spam-farm", "adult-x")
URL_DOMAINS = ("example.com", "example.net", "example.org")
URL_NUMBERS = 66_667


def url_list() -> list[str]:
    return [f"{theme}{number or ''}.{domain}/" for theme in URL_THEMES for domain in URL_DOMAINS for number in range(URL_NUMBERS)]


def op7_url_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = urls.with_parts(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path")
    ruled = urls.judge(parts, list(URL_RULES)).withColumnRenamed("entry", "rule")
    listed = urls.judge(ruled, url_list()).withColumnRenamed("entry", "listed")
    verdict = F.create_map(*[F.lit(x) for pair in URL_RULES.items() for x in pair])[F.col("rule")]
    own = F.when(F.col("listed").isNotNull(), "block").otherwise("allow")
    return listed.select("page_id", "host", "path", "rule", F.coalesce(verdict, own).alias("verdict"))


def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.reply_pairs(_table(spark, sf_dir, "conversations")))


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(_table(spark, sf_dir, "documents"), word_bpe()), word_bpe()).withColumnRenamed("id", "doc_id")


def op10_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    return langid.predict(documents, langid.fit(documents.filter("not held_out")), keep=["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kneser_ney, op2_ngram_jaccard, op3_telephony_audio, op4_bm25_packing, op5_license_rules, op6_line_frequency, op7_url_digests, op8_preference_pairs, op9_prefix_bpe, op10_bitmask_langid)}


SPACE = "[\\x20\\x09-\\x0D]"

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
with d as (select *, coalesce(text, '') t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda w: w <> '') w from documents),
b as (select doc_id, text, source, t, w, len(w)::bigint n_words, length(regexp_replace(t, '{SPACE}+', '', 'g'))::bigint word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from d),
x as (select rowid_, unnest(range(1, n_words - 1)) i, w from (select row_number() over () rowid_, * from b)),
r as (select row_number() over () rowid_, * from b),
g as (select rowid_, i, count(*) over (partition by rowid_, w[i], w[i + 1], w[i + 2]) c from x),
u as (select rowid_, count(distinct p) n from (select rowid_, unnest([i, i + 1, i + 2]) p from g where c > 1) group by rowid_),
ll as (select source, text, trim(regexp_replace({_LOWER.format("y")}, '{SPACE}+', ' ', 'g')) line from (select source, text, unnest(string_split(t, chr(10))) y from b)),
n as (select source, text, line, len(string_split(line, ' ')) n from ll where line <> ''),
f as (select source, line from n group by 1, 2 having count(distinct text) > {lines.LIMIT}),
f2 as (select f.source, f.line from f join (select source, line, count(distinct text) c from n group by 1, 2) c on c.line = f.line and c.source is not distinct from f.source
  join (select source, count(distinct text) + max((text is null)::int) total from documents group by 1) s on s.source is not distinct from f.source where c.c > {lines.SHARE} * s.total),
dep as (select n.source, n.text from n left join f2 on f2.line = n.line and f2.source is not distinct from n.source group by 1, 2
  having sum(n) - sum(case when f2.line is not null then n else 0 end) < {lines.LEAST} * sum(n))
select r.doc_id, n_words, word_chars, n_symbols, (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(u.n, 0)::bigint n_repeat_words,
  n_words < 50 or 100 * coalesce(u.n, 0) > 50 * n_words base_failed,
  not (n_words < 50 or 100 * coalesce(u.n, 0) > 50 * n_words) and dep.text is null kept
from r left join u using (rowid_) left join dep on dep.text is not distinct from r.text and dep.source is not distinct from r.source
"""

OP2 = f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '{SPACE}+'), lambda w: w <> '') w from documents),
h as (select doc_id, list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ') || chr(10) || len(w)] else [] end) s from d),
u as materialized (select doc_id, len(s)::bigint n, unnest(s) x from h),
c as materialized (select a.doc_id a, b.doc_id b, count(*) o, any_value(a.n) na, any_value(b.n) nb from u a join u b using (x) where a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from c where 100 * o >= 75 * (na + nb - o)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)
select doc_id, len(s)::bigint n_shingles, least(doc_id, coalesce((select min(b) from r where r.a = h.doc_id), doc_id)) component_id from h
"""

_FITS = " ".join(f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{v}'" for h, p, v in ((*((e.split("/", 1)[0], "/" + e.split("/", 1)[1])), e) for e in sorted(URL_RULES, key=len, reverse=True)))
_LISTED = f"regexp_matches(host, '(^|\\.)({'|'.join(URL_THEMES)})([1-9][0-9]{{0,4}})?\\.({'|'.join(d.replace('.', chr(92) + '.') for d in URL_DOMAINS)})$') and starts_with(path, '/') and coalesce(try_cast(regexp_extract(host, '([1-9][0-9]{{0,4}})\\.[a-z]+\\.[a-z]+$', 1) as int), 0) < {URL_NUMBERS}"
OP7 = f"""
with p as (select page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
r as (select *, case {_FITS} end rule from p)
select page_id, host, path, rule, case {" ".join(f"when rule = '{e}' then '{v}'" for e, v in URL_RULES.items())} when {_LISTED} then 'block' else 'allow' end verdict from r
"""

_RENDER = "list_reduce(list_prepend('', list_transform({x}, lambda t: '<|' || coalesce(t.role, 'unknown') || '|>' || chr(10) || coalesce(t.text, '') || chr(10))), lambda a, b: a || b)"
_MASK = "array_to_string(list_transform({x}, lambda t: '-' || (5 + length(coalesce(t.role, 'unknown'))) || case when t.role = 'assistant' then ',+' else ',-' end || length(coalesce(t.text, '')) || ',-1'), ',')"
OP8 = f"""
with c as (select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, role nulls first, text nulls first) t from conversations where conv_id is not null group by 1),
l as (select *, list_max(list_transform(t, lambda x, i: case when x.role = 'assistant' then i else 0 end)) n from c),
p as (select a.conv_id pair_id, a.t[:a.n] c, a.t[:a.n - 1] || coalesce(case when b.n > 0 then [b.t[b.n]] end, []) r from l a left join l b on b.conv_id = xor(a.conv_id, 1) where a.n > 0),
k as (select *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i].role is distinct from r[i].role or c[i].text is distinct from r[i].text)) - 1, least(len(c), len(r)))::bigint n from p),
s as (select pair_id, n, c[:n] q, c[n + 1:] c, r[n + 1:] r from k)
select pair_id, n n_prompt_turns, {_RENDER.format(x="q")} prompt, {_RENDER.format(x="c")} chosen, {_RENDER.format(x="r")} rejected, {_MASK.format(x="c")} chosen_mask, {_MASK.format(x="r")} rejected_mask from s
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2, "op6_line_frequency": OP6, "op7_url_digests": OP7, "op8_preference_pairs": OP8}
