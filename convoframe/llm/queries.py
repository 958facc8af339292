"""One query for each operator of this package, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.llm.clicks import click_windows
from convoframe.llm.common import read_table
from convoframe.llm.fingerprints import compare_with_edits
from convoframe.llm.langid import identify
from convoframe.llm.langid import train as train_languages
from convoframe.llm.mixing import mix_to_targets
from convoframe.llm.neardup import near_duplicates
from convoframe.llm.overlap import overlap_groups
from convoframe.llm.packing import pack
from convoframe.llm.quality import judge_quality
from convoframe.llm.repair import damaged, repair_report
from convoframe.llm.secrets import BASE_RULES, joined, scan_secrets
from convoframe.llm.sharding import shard_by_size
from convoframe.llm.substrings import remove_repeats
from convoframe.llm.urlfilter import judge_urls


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in BASE_RULES]
    return found.select("doc_id", *[_count(k) for k in base], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=80)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = train_languages(documents.filter(~F.coalesce(held_out, F.lit(False))))
    return identify(documents, model).withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_size(read_table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_targets(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), share=1.5, cap=2.0)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_groups(read_table(spark, sf_dir, "documents").select("doc_id", "text"), width=4, percent=85)


def op12_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_windows(read_table(spark, sf_dir, "clicks"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), dropped_col="dropped")


# Columns of operators that SQL can say, where it cannot say the rest.


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_urlfilter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_neardup": op3_neardup,
    "op4_langid": op4_langid,
    "op5_sharding": op5_sharding,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_urlfilter": op9_urlfilter,
    "op10_repeats": op10_repeats,
    "op11_overlap": op11_overlap,
    "op12_clicks": op12_clicks,
    "op13_repair": op13_repair,
    "mix_targets": mix_targets,
    "quality_base": quality_base,
    "url_rules": url_rules,
}

#: DuckDB SQL by query, where SQL can express it.
ORACLES: dict[str, str] = {
    # What lies between a rule's matches and the matches themselves add up to their places.
    "op2_secrets": r"""with rules(rank, kind, least, pattern) as (values
  (0, 'assign', 8, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 16, '()(AKIA[A-Z0-9]+)'),
  (2, 'hex', 32, '()([0-9a-f]+)'),
  (3, 'private_key', 0, '()(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)'),
  (4, 'github', 0, '()(gh[pousr]_[A-Za-z0-9]{36,})'),
  (5, 'slack', 0, '()(xox[abprs]-[A-Za-z0-9-]{10,})'),
  (6, 'jwt', 0, '()(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*)'),
  (7, 'google', 0, '()(AIza[0-9A-Za-z_-]{35})'),
  (8, 'stripe', 0, '()(sk_live_[0-9A-Za-z]{16,})')),
matches as (
  select doc_id, rank, kind, least, regexp_extract_all(coalesce(text, ''), pattern) as ms, regexp_extract_all(coalesce(text, ''), pattern, 2) as gs, string_split_regex(coalesce(text, ''), pattern) as ps
  from documents cross join rules),
one_by_one as (
  select doc_id, rank, kind, least, unnest(ms) as m, unnest(gs) as g, unnest(ps[1:len(ms)]) as p, generate_subscripts(ms, 1) as i from matches where len(ms) > 0),
placed as (
  select doc_id, rank, kind, least, length(g) as n, length(m) as m, cast(sum(length(p) + length(m)) over (partition by doc_id, rank order by i) as bigint) as e from one_by_one),
spans as (select doc_id, rank, kind, e - m as s, kind || ':' || (e - m) || ':' || e as span from placed where n >= least),
found as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    string_agg(span, ',' order by s, rank) filter (rank <= 2) as base, string_agg(span, ',' order by s, rank) as spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join found f on f.doc_id = d.doc_id""",
    # Equal sets are one class; classes are joined on their shingles, and links followed to the smallest id.
    "op3_neardup": r"""with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sets as (
  select doc_id, list_sort(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct([array_to_string(ws[i:i + 3], ' ') for i in range(1, len(ws) - 2)]) end) as shingles from worded),
classes as (select min(doc_id) as rep, shingles, len(shingles) as n from sets where len(shingles) > 0 group by shingles),
postings as (select rep, n, unnest(shingles) as shingle from classes),
links as (
  select a.rep as a, b.rep as b from postings a join postings b on a.shingle = b.shingle and a.rep < b.rep and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reached as (select rep as a, rep as b from classes union select r.a, e.b from reached r join both_ways e on e.a = r.b),
roots as (select a as rep, min(b) as root from reached group by a)
select s.doc_id, cast(len(s.shingles) as bigint) as n_shingles, coalesce(r.root, s.doc_id) as component_id, s.doc_id = coalesce(r.root, s.doc_id) as kept
from sets s left join classes c on c.shingles = s.shingles left join roots r on r.rep = c.rep""",
    # CRC-32 by its table; rows go one by one for each click, and a window that no later row closes ends with the first batch that leaves it behind.
    "op12_clicks": r"""with recursive crc_table as (
  select list(v order by i) as t from (select i, list_reduce(list_prepend(cast(i as bigint), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)) x),
copied as (select *, unnest(range(0, click_id % 3 + 1)) as j from clicks where click_id is not null and arrived_at is not null),
marked as (
  select click_id, j, arrived_at, client_id, kind, value, ts, props,
    xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(click_id || ':' || j, ''), lambda b: cast(ascii(b) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as c from copied cross join crc_table),
timed as (
  select click_id, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) as hour, c,
    sha256(concat(client_id, '|', kind, '|', cast(floor(100 * value + 0.5) as bigint), '|', epoch_us(ts), '|', props, '|', c % 3)) as hash from marked),
dealt as (select *, ((hour + (c // 10) % 200) - min(hour + (c // 10) % 200) over ()) * 10 // (max(hour + (c // 10) % 200) over () - min(hour + (c // 10) % 200) over () + 1) as batch from timed),
seen as (select b, (select max(hour) from dealt where batch < b) as before, (select max(hour) from dealt where batch <= b) as upto from range(10) r(b)),
kept as (select click_id, batch, hour, hash, before, row_number() over (partition by click_id order by batch, hour, hash) as n from dealt join seen on b = batch where batch = 0 or hour >= before - 24),
walk as (
  select click_id, n, batch, hour, hash, hour as start_hour, hash as opener, true as opens from kept where n = 1
  union all
  select k.click_id, k.n, k.batch, k.hour, k.hash, case when k.hour > w.start_hour + 48 or w.start_hour + 48 < k.before - 24 then k.hour else w.start_hour end,
    case when k.hour > w.start_hour + 48 or w.start_hour + 48 < k.before - 24 then k.hash else w.opener end, k.hour > w.start_hour + 48 or coalesce(w.start_hour + 48 < k.before - 24, false)
  from walk w join kept k on k.click_id = w.click_id and k.n = w.n + 1),
opened as (select click_id, start_hour, opener, lead(batch) over (partition by click_id order by n) as next_batch from walk where opens),
repeats as (
  select click_id, start_hour, count(*) as n_repeats, count(*) filter (hash <> opener) as n_conflicts,
    sum(case when hash <> opener then xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(hash, ''), lambda b: cast(ascii(b) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) else 0 end) as conflict_crc
  from walk cross join crc_table where not opens group by 1, 2)
select o.click_id, o.start_hour, cast(least(coalesce(next_batch, 9), coalesce((select min(b) from seen where upto > o.start_hour + 72), 9)) as bigint) as closed_batch, cast(coalesce(n_repeats, 0) as bigint) as n_repeats,
  cast(coalesce(n_conflicts, 0) as bigint) as n_conflicts, cast(coalesce(conflict_crc, 0) as bigint) as conflict_crc, o.opener as hash
from opened o left join repeats r on r.click_id = o.click_id and r.start_hour = o.start_hour""",
    # A source's target fills up to twice its size; the level of the others rises with each one that is full.
    "mix_targets": r"""with recursive sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, [5.0, 2.0, 1.0][(row_number() over (order by encode(source) nulls last) - 1) % 3 + 1] as w from sized group by source),
filled as (
  select 0 as step, 1.5 * (select sum(source_size) from sources) / (select sum(w) from sources) as level, -1 as n_full
  union all
  select step + 1, (1.5 * (select sum(source_size) from sources) - (select coalesce(sum(2.0 * source_size), 0) from sources where 2.0 * source_size <= level * w)) / (select sum(w) from sources where 2.0 * source_size > level * w), (select count(*) from sources where 2.0 * source_size <= level * w)
  from filled where (select count(*) from sources where 2.0 * source_size <= level * w) <> n_full and exists (select 1 from sources where 2.0 * source_size > level * w)),
final as (select level from filled order by step desc limit 1)
select doc_id, size, source_size, round(least(2.0 * source_size, level * w), 3) as target from sized d join sources s on s.source is not distinct from d.source cross join final""",
    "quality_base": r"""with split as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from documents),
windows as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from split where len(ws) >= 5),
placed as (select doc_id, i, count(*) over (partition by doc_id, ws[i:i + 4]) as n from windows),
covered as (select doc_id, count(distinct i + k) as n from placed cross join range(5) r(k) where n > 1 group by doc_id)
select s.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words, len(ws) < 10 or 100 * coalesce(c.n, 0) > 20 * len(ws) as base_failed
from split s left join covered c on c.doc_id = s.doc_id""",
    "url_rules": r"""with rules(rule, host, path, verdict) as (values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'), ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
cut as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['host', 'path']) as u from pages),
parts as (select page_id, translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, u.path as path from cut),
fits as (
  select page_id, arg_max(rule, length(r.host) + length(r.path)) as rule, arg_max(verdict, length(r.host) + length(r.path)) as verdict from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path) group by page_id)
select p.page_id, p.host, p.path, f.rule, f.verdict as by_rule from parts p left join fits f on f.page_id = p.page_id""",
}
ORACLES["op11_overlap"] = ORACLES["op3_neardup"].replace("80 *", "85 *").replace(", s.doc_id = coalesce(r.root, s.doc_id) as kept", "")


def _repair_oracle() -> str:
    """Row by row the cheapest (cost, letters, text) of each grammar state (b0 nothing, b1 system, b2 user, b3 assistant); of equal ones the least."""

    def then(b: str, cost: str, letter: str, line: str | None = None, where: str = "true") -> str:
        out = f"{b}.o" if line is None else f"{b}.o || case when {b}.o = '' then '' else chr(10) end || {line}"
        return f"case when {b} is not null and {where} then {{'c': {b}.c + {cost}, 'a': {b}.a || '{letter}', 'o': {out}}} end"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    insert = lambda b, role: then(b, "5", "I", f"'{role}:'")
    stays = "fault not in ('blank', 'duplicate')"
    extra = "case when fault = 'truncated' then 5 else 0 end"
    keep = lambda b, initial: then(b, extra, "K", "role || ':' || text", f"{stays} and left(role, 1) = '{initial}'")
    rerole = lambda b, role: then(b, f"1 + {extra}", "R", f"'{role}:' || text", stays)
    nothing = "{'c': cast(0 as bigint), 'a': '', 'o': ''}"
    none = "cast(null as struct(c bigint, a varchar, o varchar))"
    before = "b0, b1, b3"
    step = {
        "b0": then("b0", "2", "D"),
        "b1": least(then("b1", "2", "D"), keep("b0", "s")),
        "b2": least(then("b2", "2", "D"), *[f(b, x) for b in before.split(", ") for f, x in ((keep, "u"), (rerole, "user"))]),
        "b3": least(then("b3", "2", "D"), keep("b2", "a"), rerole("b2", "assistant")),
    }
    # Insertions between rows: user after all but user, assistant after user, user again.
    closed = f"""(select conv_id, n, b0, b1, {least("d2", insert("d3", "user"))} as b2, d3 as b3 from (
      select conv_id, n, b0, b1, d2, {least("b3", insert("d2", "assistant"))} as d3 from (
        select conv_id, n, b0, b1, b3, {least("b2", *[insert(b, "user") for b in before.split(", ")])} as d2 from (%s) x1) x2) x3)"""
    first = f"select conv_id, 0 as n, {nothing} as b0, {none} as b1, {none} as b2, {none} as b3 from convs"
    taken = f"select w.conv_id, r.n as n, {', '.join(f'{v} as {k}' for k, v in step.items())} from walk w join ordered r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1"
    return rf"""with recursive crc_table as (
  select list(v order by i) as t from (select i, list_reduce(list_prepend(cast(i as bigint), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) r(i)) x),
convs as (select distinct conv_id from conversations),
drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda b: cast(ascii(b) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as d
  from conversations cross join crc_table),
damaged as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role, case d when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case d when 0 then 0 when 3 then 2 else 1 end)) as copy from drawn),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from damaged),
ordered as (
  select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    lag(left(role, 1)) over (partition by conv_id order by n) || left(role, 1) as pair from placed),
counts as (
  select conv_id, max(n) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from ordered group by conv_id),
walk as (
  select conv_id, n, b0, b1, b2, b3 from {closed % first}
  union all
  select conv_id, n, b0, b1, b2, b3 from {closed % taken}),
ended as (select w.conv_id, {least("b0", "b3")} as b from walk w left join counts c on c.conv_id is not distinct from w.conv_id where w.n = coalesce(c.n, 0))
select e.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, b.c as cost, b.a as audit, sha256(b.o) as repaired_sha256
from ended e left join counts c on c.conv_id is not distinct from e.conv_id"""


ORACLES["op13_repair"] = _repair_oracle()
