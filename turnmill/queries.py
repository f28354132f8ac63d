"""The engine's queries over the driver's tables, and DuckDB SQL for them.

The tables' texts hold no filler, tool or JSON turns, so queries run over NOISY: the
whole `conversations` table with such turns written in by a rule that both
engines can run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import jsonops, text
from .functions.tokens import Counter
from .operators import budget, costs, filler, recency, repetition, resolution, similarity, structure, tools
from .plans import engine, model_tier
from .plans.engine import Compressor
from .schema import canonical
from .sources import messages, sinks

NOISY = """
select conv_id, turn * 10 as pos, role, case
  when role = 'assistant' and conv_id % 5 = 0 and turn % 4 = 1 then 'Sounds good.'
  when role = 'assistant' and conv_id % 7 = 3 then concat('{', chr(10), '  "id": ', cast(conv_id as string), ',', chr(10), '  "ok": true', chr(10), '}')
  when role = 'user' and conv_id % 4 = 1 and turn >= 2 then concat('Ok let''s go with plan ', cast(conv_id as string), '. ', text)
  when role = 'assistant' and conv_id % 4 = 1 and turn >= 2 then concat('Perfect, that works. ', text)
  when role <> 'system' and turn % 4 = 0 then concat('Basically, ', text, ', you know , it is really fine just in time.')
  when role <> 'system' and conv_id % 6 = 2 then concat(text, chr(10), 'log line', chr(10), 'log line', chr(10), chr(10), chr(10), chr(10), 'end   of  log')
  else text end as content, cast(null as string) as tool_calls_json, cast(null as string) as tool_call_id
from conversations
union all select conv_id, turn * 10 + 5, role, concat(text, ' again please'), null, null from conversations where conv_id % 3 = 0 and role <> 'system' and turn < 4
union all select conv_id, 200 + turn * 10, 'assistant', '', concat('[{"id": "c', cast(turn as string), '", "type": "function", "function": {"name": "f", "arguments": "{ ', chr(92), '"a', chr(92), '": 1 }"}}]'), null from conversations where conv_id % 10 = 4 and turn < 2
union all select conv_id, 201 + turn * 10, 'tool', concat('result ', text), null, concat('c', cast(turn + case when conv_id % 20 = 4 then 1 else 0 end as string)) from conversations where conv_id % 10 = 4 and turn < 2
"""
BUDGET = 700


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table.createOrReplaceTempView(name)
    return table


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    _view(spark, sf_dir, "conversations")
    rows = spark.sql(NOISY)
    return canonical(rows.withColumn("has_tool_key", F.col("tool_calls_json").isNotNull() | F.col("tool_call_id").isNotNull()))


KEYS = ("conv_id", "pos")
OUT = ("conv_id", "pos", "role", "content")

_registered: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _registered[f.__name__] = f
        if oracle is not None:
            _oracles[f.__name__] = oracle
        return f

    return add


# SQL pieces of the oracles, in DuckDB's dialect.


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _alternatives(phrases) -> str:
    return text.quoted(sorted(phrases, key=len, reverse=True)).replace("'", "''")


def _wide(x: str) -> str:
    """Non-ASCII letters between two letters, so that RE2's word borders see no border beside them."""
    return rf"regexp_replace({x}, '([^\x00-\x7F])', 'Z\1Z', 'g')"


def _narrow(x: str) -> str:
    return rf"regexp_replace({x}, 'Z([^\x00-\x7F])Z', '\1', 'g')"


def _bare(x: str) -> str:
    held = rf"regexp_replace({_wide(x)}, '\b([Jj])ust(\s+in\s+time)', chr(2) || '\1' || chr(3) || '\2', 'g')"
    gone = rf"regexp_replace({held}, '\b(?:{_alternatives(text.FILLERS)})\b|\bjust\b', '', 'gi')"
    return _narrow(rf"regexp_replace({gone}, chr(2) || '([Jj])' || chr(3), '\1ust', 'g')")


def _tidy(x: str) -> str:
    for pattern, to in ((r"\s+", " "), (r"\s*,\s*(?:,\s*)+", ", "), (r"\s*;\s*(?:;\s*)+", "; "), (r"\s+([,.;:!?])", r"\1"), (r"^[\s,;:.]+", ""), (r"[,;]\s*$", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return _strip(x)


def _capital(x: str) -> str:
    return rf"case when regexp_matches({x}, '^\p{{Ll}}') then upper({x}[1]) || {x}[2:] else {x} end"


def _filled(src: str, columns: str = "*") -> str:
    """src with `own`, `bare` and `fresh`, the text without fillers."""
    return rf"""select {columns}, case when bare = own or regexp_matches(own, '(?i)^\s*actually\s*,\s*no\b') then own else {_capital("tidied")} end fresh
  from (select *, {_tidy("bare")} tidied from (select *, coalesce(content, '') own, {_bare("coalesce(content, '')")} bare from {src}))"""


_ACK = "regexp_replace(lower({0}), '[.!?]+$', '') in ({1})".format(_strip("own"), ", ".join("'" + a.replace("'", "''") + "'" for a in text.ACKNOWLEDGEMENTS))
_TOOL = r"(role in ('tool', 'function') or tool_calls_json is not null or tool_call_id is not null or regexp_matches(lower(content), 'tool_call|tool_use|tool_result|<tool|\[tool'))"
_JSON = r"(regexp_matches(content, '^\s*[\[{]') and json_valid(content))"
_KEPT = f"({_TOOL} or lower(content) like '%```json%' or {_JSON})"
_DECIDES = f"regexp_matches(lower(content), '{text.quoted(text.DECISIONS)}')".replace("let's", "let''s").replace("we'", "we''").replace("that's", "that''s")
_AGREES = rf"({_DECIDES} or regexp_matches({_wide('lower(content)')}, '\b(?:{_alternatives(text.AGREEMENTS)})\b'))"
_ASKS = r"regexp_matches(content, '^\s*[^.!?]*\?\s*$')"
_TERMS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace({{0}}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"
_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
_LINES = "list_filter(string_split(regexp_replace({0}, '\n$', ''), chr(10)), lambda x, i: i = 1 or trim(x) = '' or x <> string_split(regexp_replace({0}, '\n$', ''), chr(10))[i - 1])"


def _dedupe(x: str) -> str:
    return f"case when strpos({x}, chr(10)) = 0 or strpos({x}, chr(10)) = length({x}) then {x} else array_to_string({_LINES.format(x)}, chr(10)) end"


def _s_structure(src: str, strength: float) -> str:
    """DuckDB: the structure stage's content, for texts without fences."""
    plain = _dedupe(r"regexp_replace(content, '\n{3,}', chr(10) || chr(10), 'g')")
    if strength >= 0.55:
        plain = rf"regexp_replace({plain}, '[ \t]{{2,}}', ' ', 'g')"
    if strength >= 0.75:
        plain = _strip(plain)
    return f"select * replace (case when role = 'system' or {_strip('content')} = '' then content when {_JSON} then json(content)::varchar else {plain} end as content) from {src}"


def _s_filler(src: str, kind: str) -> str:
    if kind == "rag_doc":
        inner = f"select * exclude (own, bare, tidied, fresh) replace (case when role = 'system' then content else fresh end as content) from ({_filled(src)}) where role = 'system' or fresh <> ''"
    else:
        inner = f"select * exclude (own, bare, tidied, fresh) replace (case when role = 'system' or {_TOOL} or fresh = '' then content else fresh end as content) from ({_filled(src)}) where role = 'system' or {_TOOL} or (not (role = 'assistant' and {_ACK}) and (fresh <> '' or role = 'user'))"
    return inner


def _s_pairs(src: str, by_role: bool, gate: bool = True) -> str:
    """DuckDB: (conv_id, grp, a, b, similarity)."""
    group = "role" if by_role else "'all'"
    rows = "role in ('user', 'assistant')" if by_role else "role <> 'system'"
    return f"""with t as (select conv_id, {group} grp, pos, content from {src} where {rows} {f"and {_WORDS.format('content')} >= 10" if gate else ""}),
 n as (select conv_id, grp, count(*) n from t group by all), w as (select conv_id, grp, pos, unnest({_TERMS.format("content")}) term from t),
 tf as (select conv_id, grp, pos, term, count(*) tf from w group by all), df as (select conv_id, grp, term, count(*) df from tf group by all),
 v as (select conv_id, grp, pos, term, tf * (ln((1.0 + n) / (1.0 + df)) + 1) v from tf join df using (conv_id, grp, term) join n using (conv_id, grp)),
 m as (select conv_id, grp, pos, sqrt(sum(v * v)) m from v group by all)
 select x.conv_id, x.grp, x.pos a, y.pos b, sum(x.v * y.v) / (any_value(p.m) * any_value(q.m)) similarity from v x join v y using (conv_id, grp, term)
 join m p on p.conv_id = x.conv_id and p.grp = x.grp and p.pos = x.pos join m q on q.conv_id = y.conv_id and q.grp = y.grp and q.pos = y.pos where x.pos < y.pos group by all"""


def _s_groups(src: str) -> str:
    """DuckDB: src with tool_group and tool_group_size."""
    return f"""select *, count(*) over (partition by conv_id, tool_group) tool_group_size from (select * exclude (h, ids, strange, broken), case when role in ('tool', 'function') and len(ids) > 0 and not broken then h else pos end tool_group from
 (select *, bool_or(strange) over (partition by conv_id, h order by pos) broken from (select *, role in ('tool', 'function') and tool_call_id is not null and not list_contains(ids, tool_call_id) strange from
 (select z.*, case when g.role = 'assistant' and g.tool_calls_json is not null then json_extract_string(g.tool_calls_json, '$[*].id') else [] end ids from
 (select *, max(case when role not in ('tool', 'function') then pos end) over (partition by conv_id order by pos) h from {src}) z left join {src} g on g.conv_id = z.conv_id and g.pos = z.h))))"""


def _s_repetition(src: str, strength: float, by_role: bool) -> str:
    return f"""select s.* from {src} s join ({_s_groups(src)}) g using (conv_id, pos) where not exists (select 1 from ({_s_pairs(src, by_role)}) p where p.conv_id = s.conv_id and p.a = s.pos and p.similarity > {repetition.threshold(strength)!r})
 or (select {_KEPT} from {src} k where k.conv_id = s.conv_id and k.pos = s.pos) or tool_group_size > 1"""


def _s_cosine(src: str, keys: str, left: str, right: str) -> str:
    return f"""select {keys}, sum(case when x > 0 and y > 0 then x * y else 0 end) / (sqrt(sum(case when y > 0 then x * x else x * {similarity.ALONE!r} * x * {similarity.ALONE!r} end)) * sqrt(sum(case when x > 0 then y * y else y * {similarity.ALONE!r} * y * {similarity.ALONE!r} end))) cosine
 from (select {keys}, term, sum(l) x, sum(1 - l) y from (select {keys}, unnest({_TERMS.format(left)}) term, 1 l from {src} union all select {keys}, unnest({_TERMS.format(right)}) term, 0 l from {src}) group by all) group by all having sum(case when x > 0 and y > 0 then 1 else 0 end) > 0"""


def _s_points(src: str) -> str:
    return f"""select *, case when last > 0 then last end res from (select *, max(case when role <> 'system' and not {_ASKS} and {_DECIDES} then idx end) over (partition by conv_id) last
 from (select *, row_number() over (partition by conv_id order by pos) - 1 idx from {src}))"""


def _s_threads(src: str) -> str:
    """DuckDB: (conv_id, res, start)."""
    return f"""with p as materialized ({_s_points(src)}), near as (select p.*, r.content answer from p join p r on r.conv_id = p.conv_id and r.idx = p.res where p.idx < p.res and p.idx >= p.res - {resolution.LOOK_BACK}),
 c as ({_s_cosine("near", "conv_id, idx", "content", "answer")}),
 g as (select conv_id, res, max(case when role = 'system' or coalesce(cosine, 0) < {resolution.LINKED} then idx end) bad, min(idx) first, max(case when idx = res - 1 and role <> 'system' then idx end) prev from near left join c using (conv_id, idx) group by all)
 select conv_id, res, case when coalesce(bad + 1, first) < res then coalesce(bad + 1, first) else prev end start from g where coalesce(bad + 1, first) < res or prev is not null"""


def _s_description(x: str) -> str:
    body = _strip(x)
    cases = " ".join("when strpos(lower({b}), '{p}') > 0 then substr({b}, strpos(lower({b}), '{p}') + {n})".format(b=body, p=p.replace("'", "''"), n=len(p)) for p in text.DECISIONS)
    after = rf"regexp_replace(coalesce(case {cases} end, ''), '^[ :—\-\t]+|[ :—\-\t]+$', '', 'g')"
    found = f"case when {after} <> '' then left({_strip(f'split_part({after}, chr(46), 1)')}, 200) else left({body}, 120) end"
    return f"case when ({found}) = '' then 'decision recorded' else ({found}) end"


def _s_resolution(src: str, kind: str) -> str:
    two = "and u and a" if kind == "chat" else ""
    return f"""with pt as materialized ({_s_points(src)}), th as materialized ({_s_threads(src)}),
 s as (select pt.conv_id, pt.idx, pt.pos, pt.role, pt.content, {_AGREES} agrees, {_KEPT} kept, th.start, th.res from pt join th using (conv_id)),
 f as (select conv_id, start, res, coalesce(bool_or(role = 'user' and agrees) filter (idx between start and res + 1), false) u, coalesce(bool_or(role = 'assistant' and agrees) filter (idx between start and res + 1), false) a,
  res + coalesce(max(case when idx = res + 1 and role = 'assistant' and agrees then 1 end), 0) stop from s group by conv_id, start, res),
 i as (select s.conv_id, min(pos) lo, max(pos) hi, bool_or(kept) kept, max(case when idx = f.res then content end) answer from s join f on f.conv_id = s.conv_id and s.idx between f.start and f.stop where true {two} group by s.conv_id),
 d as (select * from i where not kept)
 select x.conv_id, x.pos, x.role, x.content, x.tool_calls_json, x.tool_call_id from {src} x left join d on d.conv_id = x.conv_id and x.pos between lo and hi where d.conv_id is null
 union all select conv_id, lo, 'system', 'RESOLVED: Topic — ' || {_s_description("answer")}, null, null from d"""


def _s_tail(x: str) -> str:
    keep = f"case when len({_SENTENCES.format(x)}) <= 8 then 2 else 3 end"
    return f"case when len({_SENTENCES.format(x)}) <= 3 then {x} else array_to_string({_SENTENCES.format(x)}[-({keep}):], ' ') end"


def _s_recency(src: str, kind: str, strength: float) -> str:
    if kind == "rag_doc":
        cut = f"coalesce(cosine, 0) < {recency.RELEVANT}"
        extra = f"left join ({_s_relevance(src)}) rel using (conv_id, pos)"
    else:
        cut, extra = f"(case when n = 1 then 1.0 else i::double / (n - 1) end) < {recency.threshold(strength)!r}", ""
    return f"""select x.* replace (case when role <> 'system' and n - i > {recency.PROTECTED} and {cut} and not {_KEPT} and len({_SENTENCES.format("content")}) > 3 then {_s_tail("content")} else content end as content)
 from {src} x left join (select conv_id, pos, count(*) over (partition by conv_id) n, row_number() over (partition by conv_id order by pos) - 1 i from {src} where role <> 'system') r using (conv_id, pos) {extra}"""


def _s_query(src: str) -> str:
    return f"""select conv_id, case when coalesce(arg_max(content, pos) filter (role = 'user'), '') <> '' then arg_max(content, pos) filter (role = 'user') else string_agg(content, ' ' order by pos) end query from {src} where role <> 'system' group by 1"""


def _s_relevance(src: str) -> str:
    return f"""with q as ({_s_query(src)}), p as (select x.conv_id, x.pos, x.content, q.query from {src} x join q using (conv_id) where role <> 'system'), c as ({_s_cosine("p", "conv_id, pos", "content", "query")})
 select p.conv_id, p.pos, coalesce(cosine, 0) cosine from p left join c using (conv_id, pos)"""


_TOKENS = "ceil((length(role) + 1 + length(case when tool_calls_json is null then content when content = '' then tool_calls_json else content || chr(10) || tool_calls_json end)) / 4.0)::bigint"


def _s_budget(src: str, limit: int) -> str:
    """DuckDB: the turns that stay, with `tokens`, before system turns are cut."""
    return f"""with g as ({_s_groups(src)}), k as (select *, {_TOKENS} tokens, role <> 'system' and row_number() over (partition by conv_id order by (role = 'system')::int, pos desc) <= {budget.PROTECTED} held from g),
 u as (select conv_id, tool_group, sum(tokens) tokens, bool_or(held or role = 'system') fixed from k group by all),
 e as (select *, sum(tokens) over (partition by conv_id) - coalesce(sum(case when fixed then 0 else tokens end) over (partition by conv_id order by tool_group rows between unbounded preceding and 1 preceding), 0) > {limit} and not fixed evicted from u)
 select k.* from k join e using (conv_id, tool_group) where not evicted"""


def _s_cut(src: str, limit: int) -> str:
    """DuckDB: as `_s_budget`, with the system turn (these tables have one at most) cut where nothing more can go."""
    room = f"greatest(1, {limit} - (total - tokens))::bigint"
    cut = f"role = 'system' and total > {limit} and ceil(length(content) / 4.0) > {room}"
    return f"""select * replace (case when cut then left(content, 4 * room) else content end as content), case when cut then content end original_content
 from (select *, {room} room, {cut} cut from (select *, (sum(tokens) over (partition by conv_id))::bigint total from ({_s_budget(src, limit)})))"""


def _with(body: str, **more: str) -> str:
    more = {k: v for k, v in more.items() if v}
    return f"with noisy as materialized ({NOISY}){''.join(f', {k} as materialized ({v})' for k, v in more.items())} {body}"


def _chain(kind: str, stages: list[tuple[str, float]], limit: int | None) -> tuple[str, dict[str, str]]:
    """DuckDB: the last relation's name and the CTEs of a chain of stages over noisy."""
    ctes, src = {}, "noisy"
    for name, strength in stages:
        sql = {"structure": lambda: _s_structure(src, strength), "filler": lambda: _s_filler(src, kind), "repetition": lambda: _s_repetition(src, strength, kind != "rag_doc"), "resolution": lambda: _s_resolution(src, kind), "recency": lambda: _s_recency(src, kind, strength)}[name]()
        if name == "structure" :
            sql = f"select * replace (replace(tool_calls_json, '{{ ' || chr(92) || '\"a' || chr(92) || '\": 1 }}', '{{' || chr(92) || '\"a' || chr(92) || '\":1}}') as tool_calls_json) from ({sql})"
        ctes[f"c_{name}"] = sql
        src = f"c_{name}"
    if limit is not None:
        ctes["c_budget"] = f"select conv_id, pos, role, content, tool_calls_json, tool_call_id from ({_s_budget(src, limit)})"
        src = "c_budget"
    return src, ctes


# Structure.


@query(_with(f"select conv_id, pos, case when {_JSON} then json(content)::varchar else content end out from noisy"))
def json_minify(spark, sf_dir):
    return noisy(spark, sf_dir).select(*KEYS, jsonops.minify()("content").alias("out"))


@query("select event_id, json(props)::varchar out from events")
def event_props_minify(spark, sf_dir):
    return _view(spark, sf_dir, "events").select("event_id", jsonops.minify()("props").alias("out"))


@query("select event_id, case when event_id % 3 = 2 then '```python' || chr(10) || props || chr(10) || '```' else '```' || case when event_id % 3 = 0 then 'json' else '' end || chr(10) || json(props)::varchar || chr(10) || '```' end out from events")
def fence_minify(spark, sf_dir):
    _view(spark, sf_dir, "events")
    rows = spark.sql("select event_id, concat('```', case event_id % 3 when 0 then 'json' when 1 then '' else 'python' end, chr(10), props, chr(10), '```') fence from events")
    return rows.select("event_id", jsonops.minify_fence()("fence").alias("out"))


@query(f"select doc_id, {_dedupe('text')} out from documents")
def line_dedupe(spark, sf_dir):
    return _view(spark, sf_dir, "documents").select("doc_id", text.squeezed_lines(F.col("text")).alias("out"))


@query(_with(r"select conv_id, pos, regexp_replace(content, '\n{3,}', chr(10) || chr(10), 'g') as out from noisy"))
def blank_squeeze(spark, sf_dir):
    return noisy(spark, sf_dir).select(*KEYS, text.squeezed_blanks(F.col("content")).alias("out"))


@query(_with(r"select conv_id, pos, regexp_replace(content, '[ \t]{2,}', ' ', 'g') as out from noisy"))
def space_squeeze(spark, sf_dir):
    return noisy(spark, sf_dir).select(*KEYS, text.squeezed_spaces(F.col("content")).alias("out"))


@query(_with(f"select conv_id, pos, role, content from ({_s_structure('noisy', 0.45)})"))
def stage_structure(spark, sf_dir):
    return structure.structure(noisy(spark, sf_dir), 0.45).select(*OUT)


@query(_with(f"select conv_id, pos, role, content from ({_s_structure('noisy', 0.75)})"))
def stage_structure_agent(spark, sf_dir):
    return structure.structure(noisy(spark, sf_dir), 0.75).select(*OUT)


@query(_with("select conv_id, pos, '[{\"id\": \"c' || ((pos - 200) // 10) || '\", \"type\": \"function\", \"function\": {\"name\": \"f\", \"arguments\": \"{' || chr(92) || '\"a' || chr(92) || '\":1}\"}}]' as out from noisy where tool_calls_json is not null"))
def tool_args_minify(spark, sf_dir):
    return noisy(spark, sf_dir).filter("tool_calls_json is not null").select(*KEYS, jsonops.minify_arguments()("tool_calls_json").alias("out"))


# Filler.


@query(_with(f"select conv_id, pos, fresh as out from ({_filled('noisy')})"))
def filler_strip(spark, sf_dir):
    return noisy(spark, sf_dir).select(*KEYS, text.without_fillers(F.col("content")).alias("out"))


@query(_with(f"select conv_id, pos from (select *, content own from noisy) where not (role = 'assistant' and {_ACK})"))
def ack_drop(spark, sf_dir):
    return noisy(spark, sf_dir).filter(~((F.col("role") == "assistant") & text.acknowledges(F.col("content")))).select(*KEYS)


@query(_with(f"select conv_id, pos, role, content from ({_s_filler('noisy', 'chat')})"))
def stage_filler_chat(spark, sf_dir):
    return filler.filler(noisy(spark, sf_dir), "chat").select(*OUT)


@query(_with(f"select conv_id, pos, role, content from ({_s_filler('noisy', 'rag_doc')})"))
def stage_filler_rag(spark, sf_dir):
    return filler.filler(noisy(spark, sf_dir), "rag_doc").select(*OUT)


# Similarity and repetition.


@query(_with(f"select conv_id, pos, {_WORDS.format('content')}::bigint words, {_WORDS.format('content')} >= 10 compared from noisy"))
def word_gate(spark, sf_dir):
    n = text.word_count(F.col("content"))
    return noisy(spark, sf_dir).select(*KEYS, n.cast("bigint").alias("words"), (n >= repetition.LEAST_WORDS).alias("compared"))


@query(_with(f"select conv_id, grp, a, b, round(similarity, 6) similarity from ({_s_pairs('noisy', True)})"))
def tfidf_pairs(spark, sf_dir):
    return repetition.similar_pairs(noisy(spark, sf_dir), None).withColumn("similarity", F.round("similarity", 6))


@query(_with(f"select conv_id, pos, round(coalesce(cosine, 0), 6) cosine from p left join ({_s_cosine('p', 'conv_id, pos', 'content', 'after')}) using (conv_id, pos)", p="select * from (select conv_id, pos, content, lead(content) over (partition by conv_id order by pos) after from noisy) where after is not null"))
def tfidf_cosine_adjacent(spark, sf_dir):
    from pyspark.sql import Window

    pairs = noisy(spark, sf_dir).select(*KEYS, "content", F.lead("content").over(Window.partitionBy("conv_id").orderBy("pos")).alias("after")).filter("after is not null")
    return pairs.select(*KEYS).join(similarity.pair_cosine(pairs, list(KEYS), "content", "after"), list(KEYS), "left").select(*KEYS, F.round(F.coalesce("cosine", F.lit(0.0)), 6).alias("cosine"))


@query(_with(f"select conv_id, pos, role, content from ({_s_repetition('noisy', 0.6, True)})"))
def stage_repetition_chat(spark, sf_dir):
    return repetition.repetition(noisy(spark, sf_dir), "chat", 0.6).select(*OUT)


@query(_with(f"select conv_id, pos, role, content from ({_s_repetition('noisy', 0.8, False)})"))
def stage_repetition_rag(spark, sf_dir):
    return repetition.repetition(noisy(spark, sf_dir), "rag_doc", 0.8, False).select(*OUT)


# Resolution.


@query(_with(f"select conv_id, max(res)::bigint res from ({_s_points('noisy')}) where res is not null group by 1"))
def resolution_point(spark, sf_dir):
    return resolution.points(noisy(spark, sf_dir)).filter("res is not null").groupBy("conv_id").agg(F.max("res").cast("bigint").alias("res"))


@query(_with(f"select conv_id, res::bigint res, start::bigint as start from ({_s_threads('noisy')})"))
def thread_start(spark, sf_dir):
    return resolution.threads(resolution.points(noisy(spark, sf_dir))).select("conv_id", F.col("res").cast("bigint"), F.col("start").cast("bigint"))


@query(_with(f"select conv_id, pos, {_s_description('content')} as out from noisy"))
def resolution_desc(spark, sf_dir):
    return noisy(spark, sf_dir).select(*KEYS, resolution.description(F.col("content")).alias("out"))


@query(_with(f"select conv_id, pos, role, content from ({_s_resolution('noisy', 'chat')})"))
def stage_resolution_chat(spark, sf_dir):
    return resolution.resolution(noisy(spark, sf_dir), "chat").select(*OUT)


@query(_with(f"select conv_id, pos, role, content from ({_s_resolution('noisy', 'agent')})"))
def stage_resolution_agent(spark, sf_dir):
    return resolution.resolution(noisy(spark, sf_dir), "agent").select(*OUT)


# Recency.


@query(_with("select conv_id, pos, round(case when count(*) over w = 1 then 1.0 else (row_number() over (w order by pos) - 1)::double / (count(*) over w - 1) end, 9) score, (count(*) over w - row_number() over (w order by pos) + 1)::bigint from_end from noisy where role <> 'system' window w as (partition by conv_id)"))
def recency_score(spark, sf_dir):
    return recency.scores(noisy(spark, sf_dir)).select(*KEYS, F.round("score", 9).alias("score"), F.col("from_end").cast("bigint"))


@query(_with(f"select conv_id, pos from (select *, case when count(*) over w = 1 then 1.0 else (row_number() over (w order by pos) - 1)::double / (count(*) over w - 1) end score, row_number() over (w order by pos desc) back from noisy where role <> 'system' window w as (partition by conv_id)) where score < {recency.threshold(0.5)!r} and back > 3"))
def recency_candidates(spark, sf_dir):
    return recency.scores(noisy(spark, sf_dir)).filter((F.col("score") < recency.threshold(0.5)) & (F.col("from_end") > recency.PROTECTED)).select(*KEYS)


@query(_with(f"select conv_id, pos, len({_SENTENCES.format('content')})::bigint sentences from noisy"))
def sentence_count(spark, sf_dir):
    return noisy(spark, sf_dir).select(*KEYS, F.size(text.sentences(F.col("content"))).cast("bigint").alias("sentences"))


@query(_with(f"select conv_id, pos, role, content from ({_s_recency('noisy', 'chat', 0.5)})"))
def stage_recency_tail(spark, sf_dir):
    return recency.recency(noisy(spark, sf_dir), "chat", 0.5, "tail").select(*OUT)


@query()
def summarize_lsa(spark, sf_dir):
    return recency.recency(noisy(spark, sf_dir), "chat", 0.5, "lsa").select(*OUT)


@query(_with(f"select conv_id, query from ({_s_query('noisy')})"))
def rag_query(spark, sf_dir):
    return recency.queries(noisy(spark, sf_dir))


@query(_with(f"select conv_id, pos, round(cosine, 6) cosine from ({_s_relevance('noisy')})"))
def rag_relevance(spark, sf_dir):
    return recency.relevance(noisy(spark, sf_dir)).select(*KEYS, F.round("cosine", 6).alias("cosine"))


@query(_with(f"select conv_id, pos, role, content from ({_s_recency('noisy', 'rag_doc', 0.3)})"))
def stage_recency_rag(spark, sf_dir):
    return recency.recency(noisy(spark, sf_dir), "rag_doc", 0.3, "tail").select(*OUT)


# Budget.


def _ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query()
def token_count(spark, sf_dir):
    return budget.counted(noisy(spark, sf_dir), Counter(_ranks())).select(*KEYS, "tokens")


@query(_with(f"select conv_id, pos, {_TOKENS} tokens from noisy"))
def token_count_chars(spark, sf_dir):
    return budget.counted(noisy(spark, sf_dir)).select(*KEYS, "tokens")


@query(_with(f"select conv_id, sum({_TOKENS})::bigint tokens from noisy group by 1"))
def conv_tokens(spark, sf_dir):
    return Compressor().estimate_tokens(noisy(spark, sf_dir))


@query(_with(f"select conv_id, pos, tool_group, tool_group_size::bigint tool_group_size from ({_s_groups('noisy')})"))
def tool_groups(spark, sf_dir):
    return tools.with_groups(noisy(spark, sf_dir)).select(*KEYS, "tool_group", "tool_group_size")


@query(_with(f"select conv_id, pos, tokens from ({_s_budget('noisy', BUDGET)})"))
def stage_budget(spark, sf_dir):
    return budget.evictions(budget.counted(noisy(spark, sf_dir)), BUDGET).filter("not evicted").select(*KEYS, "tokens")


@query()
def stage_budget_bpe(spark, sf_dir):
    return budget.budget(noisy(spark, sf_dir), 300, Counter(_ranks())).select(*OUT)


@query(_with(f"select conv_id, pos, role, content, cut as compressed, original_content from ({_s_cut('noisy', 40)})"))
def system_truncate(spark, sf_dir):
    return budget.budget(noisy(spark, sf_dir), 40).select(*OUT, "compressed", "original_content")


# Statistics, costs and plans.

_CHAT = [("structure", 0.45), ("filler", 0.7), ("repetition", 0.6), ("resolution", 0.8), ("recency", 0.5)]
_AGENT = [("structure", 0.75), ("filler", 0.4), ("repetition", 0.7), ("resolution", 0.9), ("recency", 0.6)]
_RAG = [("structure", 0.5), ("filler", 0.5), ("repetition", 0.8), ("recency", 0.3)]


def _pipeline(kind: str, level: str, stages: list, limit: int | None):
    src, ctes = _chain(kind, stages, limit)

    def run(spark, sf_dir):
        return Compressor(kind, level, summarizer="tail").compress(noisy(spark, sf_dir), limit).turns.select(*OUT)

    return run, _with(f"select conv_id, pos, role, content from {src}", **ctes)


for _name, _kind, _level, _stages, _limit in (
    ("pipeline_low", "chat", "low", _CHAT[:3], None),
    ("pipeline_medium", "chat", "medium", _CHAT[:4], None),
    ("pipeline_high", "chat", "high", _CHAT, None),
    ("pipeline_agent", "agent", "high", _AGENT, None),
    ("pipeline_rag", "rag_doc", "high", _RAG, None),
):
    _registered[_name], _oracles[_name] = _pipeline(_kind, _level, _stages, _limit)


def _stats_sql(stages: list, level: str, limit: int) -> str:
    """DuckDB: counts before and after a chain with a budget above which no system turn is cut."""
    src, ctes = _chain("chat", stages, limit)
    return _with(f"""select b.conv_id, tb turns_before, kb tokens_before, coalesce(ta, 0) turns_after, coalesce(ka, 0)::bigint tokens_after, '{level}' preset
 from (select conv_id, count(*) tb, sum({_TOKENS})::bigint kb from noisy group by 1) b left join (select conv_id, count(*) ta, sum({_TOKENS})::bigint ka from {src} group by 1) a using (conv_id)""", **ctes)


BIG = 100_000
_STATS = ("conv_id", "turns_before", "tokens_before", "turns_after", "tokens_after")


@query(f"select *, greatest(0, turns_before - turns_after)::bigint turns_removed, greatest(0, tokens_before - tokens_after)::bigint tokens_saved from ({_stats_sql(_CHAT[:4], 'medium', BIG)})")
def compression_stats(spark, sf_dir):
    stats = Compressor().compress(noisy(spark, sf_dir), BIG).stats
    return stats.select(*_STATS, F.col("compression_level").alias("preset"), "turns_removed", "tokens_saved")


@query(f"select conv_id, round(100.0 * greatest(0, tokens_before - tokens_after) / tokens_before, 2)::double token_savings_pct from ({_stats_sql(_CHAT[:4], 'medium', BIG)})")
def savings_pct(spark, sf_dir):
    return Compressor().compress(noisy(spark, sf_dir), BIG).stats.select("conv_id", "token_savings_pct")


@query(f"select conv_id, round(tokens_before / 1000000.0::double * 2.5::double, 8) input_cost_before_usd, round(tokens_after / 1000000.0::double * 2.5::double, 8) input_cost_after_usd, 0.002::double output_cost_usd from ({_stats_sql(_CHAT[:4], 'medium', BIG)})")
def cost_stats(spark, sf_dir):
    stats = Compressor(model="gpt-4o", cost_provider="openai", cost_output_tokens=200).compress(noisy(spark, sf_dir), BIG).stats
    return stats.select("conv_id", "input_cost_before_usd", "input_cost_after_usd", "output_cost_usd")


@query(_with(f"select conv_id, sum({_TOKENS})::bigint tokens, round(sum({_TOKENS}) / 1000000.0::double * 0.8::double, 8) input_cost_usd from noisy group by 1"))
def cost_estimate(spark, sf_dir):
    return Compressor().estimate_cost(noisy(spark, sf_dir), "claude", "claude-3-5-haiku").select("conv_id", "tokens", "input_cost_usd")


_MODELS = "select c_custkey, case c_custkey % 5 when 0 then 'oai' when 1 then 'Claude' when 2 then 'google' when 3 then 'ollama' else 'openai' end as provider, case c_custkey % 7 when 0 then 'gpt-4o-mini-2024' when 1 then 'claude-3-5-sonnet' when 2 then 'models/gemini-1.5-pro' when 3 then 'gpt-4.1-nano' when 4 then 'other' when 5 then '' else 'gpt-4o' end as model from customer"


def _rate_cases(k: int) -> str:
    out = []
    for p, table in costs.PRICES.items():
        for exact in (True, False):
            for m, r in table.items():
                if m != "default":
                    out.append(f"when p = '{p}' and " + (f"model = '{m}'" if exact else f"contains(lower(model), '{m}')") + f" then {r[k]}")
        out.append(f"when p = '{p}' then {table['default'][k]}")
    return "case " + " ".join(out) + " end"


@query(f"select c_custkey, p as rate_provider, ({_rate_cases(0)})::double input_rate, ({_rate_cases(1)})::double output_rate from (select *, case lower(provider) when 'oai' then 'openai' when 'claude' then 'anthropic' when 'ollama' then 'local' else lower(provider) end p from ({_MODELS}))")
def model_rate_lookup(spark, sf_dir):
    _view(spark, sf_dir, "customer")
    return costs.with_rates(spark.sql(_MODELS)).select("c_custkey", "rate_provider", "input_rate", "output_rate")


@query(f"select conv_id, 'turnmill (chat, low): ' || turns_before || ' -> ' || turns_after || ' turns, ' || tokens_before || ' -> ' || tokens_after || ' tokens (' || round(100.0 * greatest(0, tokens_before - tokens_after) / tokens_before, 2)::double || '% saved)' || chr(10) || 'stages: structure, filler, repetition, budget' as summary from ({_stats_sql(_CHAT[:3], 'low', BIG)})")
def summary_text(spark, sf_dir):
    stats = Compressor(compression="low").compress(noisy(spark, sf_dir), BIG).stats
    return stats.select("conv_id", engine.summary().alias("summary"))


def _deltas_sql() -> str:
    """DuckDB: counts of a medium chain to BUDGET, with what each stage took (`deltas`) and the removal warning (`warned`)."""
    src, ctes = _chain("chat", _CHAT[:4], None)
    ctes["c_budget"] = _s_cut(src, BUDGET)
    dropping = [c for c in ctes if c != "c_structure"]
    ctes["counts"] = "select b.conv_id, tb, kb, coalesce(ka, 0)::bigint ka, " + ", ".join(f"coalesce(n_{c}, 0)::bigint n_{c}" for c in dropping) + f" from (select conv_id, count(*) tb, sum({_TOKENS})::bigint kb from noisy group by 1) b" + "".join(f" left join (select conv_id, count(*) n_{c} from {c} group by 1) using (conv_id)" for c in dropping) + f" left join (select conv_id, sum({_TOKENS})::bigint ka from c_budget group by 1) using (conv_id)"
    each = [f"case when {last} <> n_{c} then '\"{c[2:]}\":' || ({last} - n_{c}) end" for last, c in zip(["tb", *(f"n_{c}" for c in dropping)], dropping, strict=False)]
    gone = f"n_{dropping[-2]} - n_c_budget"
    return _with(f"""select conv_id, tb, kb, n_c_budget ta, ka, array_to_string(list_filter([{', '.join(each)}], lambda x: x is not null), ',') deltas,
 case when {gone} > 0 then '"token budget enforced - ' || ({gone}) || ' turns removed to fit {BUDGET} tokens"' else '' end warned from counts""", **ctes)


@query(f"""select conv_id, '{{"conv_id":' || conv_id || ',"turns_before":' || tb || ',"tokens_before":' || kb || ',"turns_after":' || ta || ',"tokens_after":' || ka || ',"turn_delta_by_stage":{{' || deltas || '}},"stages_run":["structure","filler","repetition","resolution","budget"],"warnings_emitted":[' || warned || '],"compression_level":"medium","context_type":"chat","token_budget":{BUDGET},"dry_run":true,"tier_applied":false,"tier_before":0,"tier_after":0,"turns_removed":' || greatest(0, tb - ta) || ',"tokens_saved":' || greatest(0, kb - ka) || ',"token_savings_pct":' || round(100.0 * greatest(0, kb - ka) / kb, 2)::double || '}}' as json from ({_deltas_sql()})""")
def stats_export(spark, sf_dir):
    return Compressor().preview(noisy(spark, sf_dir), BUDGET).stats.select("conv_id", engine.exported().alias("json"))


@query(f"select conv_id, '{{' || deltas || '}}' as deltas, replace(warned, '\"', '') as warned from ({_deltas_sql()})")
def stage_deltas(spark, sf_dir):
    stats = Compressor().compress(noisy(spark, sf_dir), BUDGET).stats
    return stats.select("conv_id", F.to_json("turn_delta_by_stage").alias("deltas"), F.array_join("warnings_emitted", "; ").alias("warned"))


@query(" union all ".join(f"(select conv_id, preset, turns_after, tokens_after from ({_stats_sql(_CHAT[:n], p, BIG)}))" for n, p in ((3, "low"), (4, "medium"), (5, "high"))))
def compare_presets(spark, sf_dir):
    return Compressor(summarizer="tail").compare_presets(noisy(spark, sf_dir), BIG).select("conv_id", "preset", "turns_after", "tokens_after")


def _preset_sql(stages: list, preset: str, ord_: int) -> str:
    src, ctes = _chain("chat", stages, None)
    body = f"select conv_id, '{preset}' preset, {ord_} ord, coalesce(k, 0)::bigint k from (select distinct conv_id from noisy) left join (select conv_id, sum({_TOKENS})::bigint k from ({_s_cut(src, BUDGET)}) group by 1) using (conv_id)"
    return f"({_with(body, **ctes)})"


@query(f"select conv_id, preset from (select *, row_number() over (partition by conv_id order by k > {BUDGET}, case when k <= {BUDGET} then ord else k end, ord) r from ({' union all '.join(_preset_sql(_CHAT[:n], p, i) for i, (n, p) in enumerate(((3, 'low'), (4, 'medium'), (5, 'high'))))})) where r = 1")
def recommend_preset(spark, sf_dir):
    return Compressor(summarizer="tail").recommend_preset(noisy(spark, sf_dir), BUDGET)


@query(f"select conv_id, tokens_after, tokens_after <= {BIG} fits from ({_stats_sql(_CHAT[:4], 'medium', BIG)})")
def fits_budget(spark, sf_dir):
    return Compressor().fits_budget(noisy(spark, sf_dir), BIG)


def _mark(turns: DataFrame, **_) -> DataFrame:
    return turns.withColumn("content", F.when(F.col("role") == "user", F.concat(F.lit("! "), F.col("content"))).otherwise(F.col("content")))


@query(_with("select conv_id, pos, role, case when role = 'user' then '! ' || content else content end as content from noisy"))
def custom_stage(spark, sf_dir):
    from .plans import registry

    registry.register_stage("mark", _mark, before="repetition")
    try:
        return Compressor().compress(noisy(spark, sf_dir), stages=["mark"]).turns.select(*OUT)
    finally:
        registry.unregister_stage("mark")


@query(_with("select conv_id, role, content, (row_number() over (partition by conv_id order by (role <> 'system')::int, pos) - 1)::bigint pos from (select *, row_number() over (partition by conv_id, role = 'system', case when role = 'system' then cast(pos as varchar) else content end order by pos desc) r from noisy) where r = 1"))
def model_dedupe_mock(spark, sf_dir):
    return model_tier.model_tier(noisy(spark, sf_dir), model_tier.Mock(), "dedupe_only").select(*OUT)


_SUMMARY = f"""o as (select * from (select conv_id, pos, role, content, row_number() over (partition by conv_id, content order by pos desc) r from noisy where role <> 'system') where r = 1),
 c as (select conv_id, string_agg(role || ': ' || content, chr(10) || chr(10) order by pos) s from o group by 1 having length(s) >= 500),
 y as (select conv_id, row_number() over (partition by conv_id order by pos) - 1 pos, role, content from noisy join c using (conv_id) where role = 'system'),
 n as (select conv_id, count(*) n from y group by 1)
 select conv_id, pos, role, content from noisy where conv_id not in (select conv_id from c) union all select * from y
 union all select conv_id, coalesce(n, 0), 'assistant', regexp_replace('Summary: ' || left(s, {4 * max(model_tier.LEAST_TOKENS, 64)}), '\\s+$', '') from c left join n using (conv_id)"""


@query(f"with noisy as materialized ({NOISY}), {_SUMMARY}")
def model_summary_mock(spark, sf_dir):
    return model_tier.model_tier(noisy(spark, sf_dir), model_tier.Mock(), "replace_all", 500, 64).select(*OUT)


_NUMBERED = r"list_transform(list(content order by pos), lambda t, i: (i - 1) || ': ' || case when length(replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10), ' ')) > 800 then left(replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10), ' '), 797) || '...' else replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(10), ' ') end)"


@query(_with(f"select conv_id, array_to_string({_NUMBERED}, chr(10)) as listing from noisy group by 1"))
def numbered_turns(spark, sf_dir):
    return sinks.to_strings(noisy(spark, sf_dir)).select("conv_id", model_tier.numbered(F.col("messages")).alias("listing"))


@query("select event_id, array_to_string(case when n <= 1 or len(i) = 0 then range(n) else list_sort(i) end, ',') as kept from (select event_id, event_id % 9 n, list_distinct(list_filter(list_transform(regexp_extract_all(props, '[0-9]+'), lambda x: x::bigint), lambda x: x < event_id % 9)) i from events)")
def keep_indices(spark, sf_dir):
    import pandas as pd

    run = F.pandas_udf(lambda s, n: pd.Series([model_tier.keep_indices(x, int(k)) for x, k in zip(s, n, strict=True)]), "array<int>")
    return _view(spark, sf_dir, "events").select("event_id", F.array_join(run("props", (F.col("event_id") % 9).cast("int")), ",").alias("kept"))


# Sources and sinks.


@query(_with("select conv_id, to_json(list(content order by pos))::varchar as messages from noisy group by 1"))
def roundtrip_strings(spark, sf_dir):
    strings = sinks.to_strings(noisy(spark, sf_dir))
    again = sinks.to_strings(messages.from_strings(strings))
    return again.select("conv_id", F.to_json("messages").alias("messages"))


@query(_with("select conv_id, string_agg(role || ':' || content, chr(1) order by pos) as messages from noisy group by 1"))
def roundtrip_tuples(spark, sf_dir):
    again = sinks.to_pairs(messages.from_pairs(sinks.to_pairs(noisy(spark, sf_dir))))
    return again.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "\x01").alias("messages"))


@query(_with("select conv_id, (row_number() over (partition by conv_id order by pos) - 1)::bigint pos, role, content, tool_call_id, tool_calls_json is not null or tool_call_id is not null keyed from noisy"))
def roundtrip_dicts(spark, sf_dir):
    again = messages.from_json(sinks.to_json(noisy(spark, sf_dir).withColumn("raw_json", F.to_json(F.struct("role", "content", F.from_json("tool_calls_json", "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"), "tool_call_id")))))
    return again.select(*OUT, "tool_call_id", (F.col("tool_calls_json").isNotNull() | F.col("tool_call_id").isNotNull()).alias("keyed"))


@query("select doc_id // 20 conv_id, doc_id pos, 'assistant' as role, text as content from documents union all select doc_id // 20, max(doc_id) + 1, 'user', 'What is said here?' from documents group by 1")
def documents_as_chunks(spark, sf_dir):
    return messages.from_documents(_view(spark, sf_dir, "documents"), F.expr("doc_id div 20"), F.lit("What is said here?")).select(*OUT)


@query(_with(f"select conv_id, pos, role, content, {_TOOL} tool, {_JSON} json, {_KEPT} preserved, role = 'system' as protected, {_ASKS} asks, {_DECIDES} decides, {_AGREES} agrees from noisy"))
def turn_predicates(spark, sf_dir):
    rows = tools.preserved(noisy(spark, sf_dir)).withColumn("json", F.coalesce(jsonops.is_json()("content"), F.lit(False)))
    own = F.col("content")
    return rows.select(*OUT, text.tool_marked().alias("tool"), "json", "preserved", (F.col("role") == "system").alias("protected"), text.only_asks(own).alias("asks"), text.decides(own).alias("decides"), text.agrees(own).alias("agrees"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each conversation before and after a compression to BUDGET."""
    return Compressor(compression="high").compress(noisy(spark, sf_dir), BUDGET).stats.select(*_STATS, "token_savings_pct")
