"""The queries of the conversation engine and their SQL oracles.

Times are microseconds since the epoch, so that both engines give the same values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.functions.text import SECOND, micros, parse_score, render
from convoframe.operators import completions as P
from convoframe.operators import contacts as C
from convoframe.operators import context as X
from convoframe.operators import conversations as V
from convoframe.operators import lexicon as L
from convoframe.operators import reduction as M
from convoframe.operators import rounds as R
from convoframe.operators import samples as S
from convoframe.operators import segment as G
from convoframe.operators import scoring as E
from convoframe.operators.messages import TEXT, clean_messages
from convoframe.plans import fixtures as A
from convoframe.plans.incremental import Incremental
from convoframe.sources import csv_source as C_
from convoframe.sources.keyed import Keyed
from convoframe.sources.scratch import checkpoint_root, materialised
from convoframe.sources.snapshots import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- SQL shared by the oracles

_CLEAN = """clean as (
  select cast(id as varchar) as msg_id, CreateTime as create_time, epoch_us(CreateTime) as t, is_sender, is_sender = 1 as mine, talker, type_name, coalesce(msg, '') as original_msg,
    case type_name when '文本' then coalesce(msg, '') when '语音' then case when trim(coalesce(src, '')) <> '' then '[语音转文字: ' || src || ']' else '[语音消息]' end
      when '图片' then '[图片]' when '文件' then '[文件]' when '动画表情' then '[动画表情]' when '引用回复' then '引用回复' else '[' || type_name || ']' end as content,
    row_number() over (order by CreateTime, id) - 1 as ix
  from raw)"""
_RUNS = """flagged as (
  select *, case when lag(ix) over w is null or lag(mine) over w <> mine or (not mine and lag(talker) over w <> talker) or t - lag(t) over w > 90000000 then ix end as starts
  from clean window w as (order by ix)),
runs as (select *, max(starts) over (order by ix rows unbounded preceding) as run from flagged)"""
_ROUNDS = """ahead as (
  select run, ix, t, mine, talker, min(case when mine then ix end) over (order by ix rows between 1 following and unbounded following) as na,
    min(case when mine then t end) over (order by ix rows between 1 following and unbounded following) as nt from runs),
blocks as (select run, bool_or(mine) as mine, min(talker) as talker, max(ix) as last_ix, max(t) as last_t, count(*) as n, arg_max(na, ix) as na, arg_max(nt, ix) as nt from ahead group by run),
asked as (select *, row_number() over (partition by na order by run) as rn from blocks where not mine and na - last_ix <= 10 and nt - last_t <= 300000000),
rounds as (
  select a.na as round_id, a.talker, a.run as other_first_ix, a.last_ix as other_last_ix, a.na as my_first_ix, b.last_ix as my_last_ix, a.last_t as other_last_t, a.nt as reply_t, a.n as other_n, b.n as my_n
  from asked a join blocks b on b.run = a.na where a.rn = 1)"""


def _sql(body: str, *parts: str) -> str:
    raw = "raw as (" + A.MESSAGES.replace("{events}", "events").replace("as string", "as varchar") + ")"
    return "with " + ",\n".join([raw, _CLEAN, *parts]) + "\n" + body


def _samples_sql(body: str, *parts: str) -> str:
    raw = "samples as (" + A.SAMPLES.replace("{conversations}", "conversations").replace("as string", "as varchar") + ")"
    return "with " + ",\n".join([raw, *parts]) + "\n" + body


def _contacts_sql(body: str, *parts: str) -> str:
    raw = "contacts as (" + A.CONTACTS.replace("{customer}", "customer").replace("{nation}", "nation").replace("as string", "as varchar").replace("timestamp_ntz", "timestamp") + ")"
    return "with " + ",\n".join([raw, *parts]) + "\n" + body


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# --- messages and contacts


@query(_sql("select msg_id, t, is_sender, talker, type_name, content, original_msg from clean"))
def q_clean_messages(spark, sf_dir):
    return A.messages(spark, sf_dir).select("msg_id", micros(F.col("create_time")).alias("t"), "is_sender", "talker", "type_name", "content", "original_msg")


@query(_sql("select talker, count(*) as message_count, min(t) as first_t, max(t) as last_t from clean group by talker"))
def q_contact_message_stats(spark, sf_dir):
    stats = C.message_stats(A.messages(spark, sf_dir))
    return stats.select("talker", "message_count", micros(F.col("first_time")).alias("first_t"), micros(F.col("last_time")).alias("last_t"))


@query(_sql("select talker, count(*) as total_messages, count(*) filter (where mine) as my_messages, count(*) filter (where not mine) as other_messages, min(ix) as first_ix from clean group by talker order by total_messages desc, first_ix limit 10"))
def q_contact_statistics_top10(spark, sf_dir):
    return C.contact_statistics(A.timeline(spark, sf_dir), 10)


@query(_sql("select talker, count(*) as messages from clean group by talker order by messages desc, min(ix) limit 1"))
def q_infer_me(spark, sf_dir):
    return C.infer_me(A.timeline(spark, sf_dir))


@query(_contacts_sql("select contact_id, case when trim(remark) <> '' then remark when trim(nickname) <> '' then nickname else right(contact_id, 8) end as display_name, coalesce(nullif(remark, ''), nullif(nickname, ''), right(contact_id, 8)) as summary_name from contacts"))
def q_display_names(spark, sf_dir):
    names = (F.col("remark"), F.col("nickname"), F.col("contact_id"))
    return A.contacts(spark, sf_dir).select("contact_id", C.display_name(*names).alias("display_name"), C.summary_name(*names).alias("summary_name"))


@query(_contacts_sql("select count(*) as total_contacts, cast(sum(message_count) as bigint) as total_messages from contacts"))
def q_contacts_summary(spark, sf_dir):
    return C.summary(A.contacts(spark, sf_dir))


@query(_contacts_sql("select relationship, count(*) as contacts from contacts group by relationship"))
def q_relationship_distribution(spark, sf_dir):
    return C.relationship_distribution(A.contacts(spark, sf_dir))


@query(_contacts_sql("select coalesce(nullif(remark, ''), nullif(nickname, ''), right(contact_id, 8)) as name, contact_id, message_count from contacts order by message_count desc, contact_id limit 5"))
def q_top_contacts(spark, sf_dir):
    return C.most_active(A.contacts(spark, sf_dir), 5)


@query(_contacts_sql("select contact_id, nickname, remark from contacts where lower(nickname) like '%77%' or lower(remark) like '%77%' or lower(contact_id) like '%77%'"))
def q_contact_search(spark, sf_dir):
    return C.search(A.contacts(spark, sf_dir), "77").select("contact_id", "nickname", "remark")


_USERS = "users as (select 'wxid_' || lpad(cast(s_suppkey + 50 as varchar), 8, '0') as contact_id, s_name as nickname, 'supplier ' || s_nationkey as remark from supplier)"


def _users(spark, sf_dir):
    return A.table(spark, sf_dir, "supplier").select(F.concat(F.lit("wxid_"), F.lpad((F.col("s_suppkey") + 50).cast("string"), 8, "0")).alias("contact_id"), F.col("s_name").alias("nickname"), F.concat(F.lit("supplier "), F.col("s_nationkey").cast("string")).alias("remark"))


@query(_contacts_sql("select coalesce(c.contact_id, u.contact_id) as contact_id, coalesce(nullif(c.nickname, ''), nullif(u.nickname, ''), '') as nickname, coalesce(nullif(c.remark, ''), nullif(u.remark, ''), '') as remark, case when c.contact_id is null then '朋友' else relationship end as relationship, coalesce(message_count, 0) as message_count from contacts c full join users u on c.contact_id = u.contact_id", _USERS))
def q_upsert_from_users(spark, sf_dir):
    return C.upsert_users(A.contacts(spark, sf_dir), _users(spark, sf_dir)).select("contact_id", "nickname", "remark", "relationship", "message_count")


def _stats_oracle(kept: str) -> str:
    raw = "raw as (" + A.MESSAGES.replace("{events}", "events").replace("as string", "as varchar") + ")"
    stats = "stats as (select talker, count(*) as n, min(epoch_us(CreateTime)) as lo, max(epoch_us(CreateTime)) as hi from raw group by talker)"
    body = "select coalesce(contact_id, talker) as contact_id, cast(coalesce(n, " + kept + ") as bigint) as message_count, case when contact_id is null then '朋友' else relationship end as relationship, lo as first_t, hi as last_t from contacts full join stats on contact_id = talker"
    return _contacts_sql(body, raw, stats)


def _upserted(spark, sf_dir, reset):
    done = C.upsert_stats(A.contacts(spark, sf_dir), C.message_stats(A.messages(spark, sf_dir)), reset)
    return done.select("contact_id", "message_count", "relationship", micros(F.col("first_contact_date")).alias("first_t"), micros(F.col("last_contact_date")).alias("last_t"))


@query(_stats_oracle("message_count"))
def q_upsert_from_stats(spark, sf_dir):
    return _upserted(spark, sf_dir, False)


@query(_stats_oracle("0"))
def q_reset_counts(spark, sf_dir):
    return _upserted(spark, sf_dir, True)


@query(_contacts_sql("select contact_id, case when contact_id = 'wxid_00000007' then '同事' else relationship end as relationship, case when contact_id = 'wxid_00000007' then 'desk 4' else relationship_detail end as relationship_detail from contacts"))
def q_relationship_update(spark, sf_dir):
    return C.update_relationship(A.contacts(spark, sf_dir), "wxid_00000007", "同事", "desk 4").select("contact_id", "relationship", "relationship_detail")


# --- sequences and rounds


@query(_sql("select ix, t, talker, mine, run from runs", _RUNS))
def q_sequence_runs(spark, sf_dir):
    return A.runs(spark, sf_dir).select("ix", "t", "talker", "mine", "run")


@query(_sql("select * from rounds", _RUNS, _ROUNDS))
def q_rounds(spark, sf_dir):
    return R.extract_rounds(A.runs(spark, sf_dir))


_TEXTS = """texts as (
  select r.*, (select string_agg(content, '<return>' order by ix) from runs m where m.run = r.other_first_ix) as other_text, (select string_agg(content, '<return>' order by ix) from runs m where m.run = r.my_first_ix) as my_text from rounds r)"""


@query(_sql("select round_id, talker, (reply_t - other_last_t) / 1000000.0 as delay_s, other_text, my_text from texts", _RUNS, _ROUNDS, _TEXTS))
def q_round_texts(spark, sf_dir):
    runs = A.runs(spark, sf_dir)
    texts = R.round_texts(A.rounds(runs), runs)
    return texts.select("round_id", "talker", ((F.col("reply_t") - F.col("other_last_t")) / F.lit(float(SECOND))).alias("delay_s"), "other_text", "my_text")


@query(_sql("select ix, t, max(starts) over (order by ix rows unbounded preceding) as island from flags", "flags as (select ix, t, case when lag(t) over (order by ix) is null or t - lag(t) over (order by ix) > 300000000 then ix end as starts from clean)"))
def q_islands(spark, sf_dir):
    return R.islands(A.timeline(spark, sf_dir), 300).select("ix", "t", "island")


_CONTEXT = """context as (
  select round_id, r.talker, reply_t, m.ix, m.t, m.is_sender, m.create_time, m.content, other_first_ix
  from rounds r join runs m on m.t < reply_t and m.t >= reply_t - 259200000000 and ((m.is_sender = 0 and m.talker = r.talker) or m.is_sender = 1))"""
_PREFIX = """mine_at as (select t, count(*) as n from clean where mine group by t), their_at as (select talker, t, count(*) as n from clean where is_sender = 0 group by talker, t),
mine_run as (select t, sum(n) over (order by t) as c from mine_at), their_run as (select talker, t, sum(n) over (partition by talker order by t) as c from their_at),
m_hi as (select round_id, c from rounds asof join mine_run on reply_t > mine_run.t),
lows as (select round_id, talker, reply_t - 259200000000 as low_t from rounds),
m_lo as (select round_id, c from lows asof join mine_run on low_t > mine_run.t),
t_hi as (select round_id, c from rounds asof join their_run on rounds.talker = their_run.talker and reply_t > their_run.t),
t_lo as (select round_id, c from lows asof join their_run on lows.talker = their_run.talker and low_t > their_run.t),
counts as (select r.round_id, cast(coalesce(m_hi.c, 0) - coalesce(m_lo.c, 0) as bigint) as context_mine, cast(coalesce(t_hi.c, 0) - coalesce(t_lo.c, 0) as bigint) as context_theirs
  from rounds r left join m_hi using (round_id) left join m_lo using (round_id) left join t_hi using (round_id) left join t_lo using (round_id))"""


@query(_sql("select round_id, context_mine, context_theirs from counts", _RUNS, _ROUNDS, _PREFIX))
def q_context_counts(spark, sf_dir):
    runs = A.runs(spark, sf_dir)
    return X.context_summary(A.rounds(runs), runs).select("round_id", "context_mine", "context_theirs")


@query(_sql("select r.round_id, count(c.ix) as context_n, count(c.ix) filter (where c.is_sender = 1) as context_mine, count(c.ix) filter (where c.is_sender = 0) as context_theirs, coalesce(round((max(c.t) - min(c.t)) / 3600000000.0, 2), 0.0) as span_hours, min(c.t) as first_t, max(c.t) as last_t from rounds r left join context c on c.round_id = r.round_id group by r.round_id", _RUNS, _ROUNDS, _CONTEXT))
def q_context_summary(spark, sf_dir):
    runs = A.runs(spark, sf_dir)
    return X.context_summary(A.rounds(runs), runs)


_HISTORY = """lines as (
  select round_id, t, 0 as rank, ix, is_sender, create_time, content, talker from context
  union all select round_id, m.t, 1, m.ix, m.is_sender, m.create_time, m.content, r.talker from rounds r join runs m on m.run = r.other_first_ix),
recent as (select *, row_number() over (partition by round_id order by t desc, rank desc, ix desc) as rn from lines),
dated as (
  select *, cast(create_time as date) as d, lag(cast(create_time as date)) over (partition by round_id order by t, rank, ix) as before_d from recent where rn <= 30),
shown as (
  select round_id, t, rank, ix, 0 as part, '————— ' || strftime(create_time, '%Y年%m月%d日') || ' —————' as line from dated where before_d is null or d <> before_d
  union all select round_id, t, rank, ix, 1, '[' || strftime(create_time, '%H:%M:%S') || '] ' || case when is_sender = 1 then '我' else right(talker, 8) end || ': ' || content from dated),
numbered as (select *, row_number() over (partition by round_id order by t desc, rank desc, ix desc, part desc) as back from shown),
history as (select round_id, string_agg(line, chr(10) order by back desc) as history from numbered where back <= 30 group by round_id)"""


def _named_rounds(runs):
    return A.rounds(runs).withColumn("other_name", F.right(F.col("talker"), F.lit(8)))


@query(_sql("select round_id, history from history", _RUNS, _ROUNDS, _CONTEXT, _HISTORY))
def q_history_text(spark, sf_dir):
    runs = A.runs(spark, sf_dir)
    return X.history_lines(_named_rounds(runs), runs, F.lit("我"))


_NAMED = """named as (
  select s.talker, coalesce(case when trim(remark) <> '' then remark end, case when trim(nickname) <> '' then nickname end, right(s.talker, 8)) as other_name,
    case when contact_id is null then '朋友' else relationship end as relationship
  from (select distinct talker from raw) s left join contacts on contact_id = s.talker)"""
_NAMED_HISTORY = _HISTORY.replace("right(talker, 8)", "(select other_name from named n where n.talker = dated.talker)")
_SAMPLES_BODY = """select t.round_id, t.talker, t.reply_t,
  '你是我，正在和' || n.other_name || '聊天。 对方是你的' || n.relationship || '。 现在是' || strftime(make_timestamp(t.reply_t), '%Y年%m月%d日 %H:%M') || '。 """ + S.CLOSING + """' as instruction,
  '历史记录:' || chr(10) || coalesce(h.history, '') || chr(10) || chr(10) || '对方最新消息:' || chr(10) || t.other_text as input, t.my_text as output
from texts t join named n on n.talker = t.talker left join history h on h.round_id = t.round_id"""


@query(_sql(_SAMPLES_BODY, _contacts_sql("").removeprefix("with ").rstrip(), _NAMED, _RUNS, _ROUNDS, _TEXTS, _CONTEXT, _NAMED_HISTORY))
def q_training_samples(spark, sf_dir):
    runs = A.runs(spark, sf_dir)
    return S.training_samples(A.rounds(runs), runs, A.contacts(spark, sf_dir))


@query(_sql("select ix, abs(t - lag(t) over (order by ix)) <= 86400000000 and (talker = lag(talker) over (order by ix) or mine or lag(mine) over (order by ix)) as same_context from clean qualify ix > 0"))
def q_same_context_pairs(spark, sf_dir):
    from convoframe.operators.timeline import running

    pairs = running(A.timeline(spark, sf_dir).select("ix", "t", "talker", "mine"), ["t", "ix"], lasts={"p": F.struct("t", "talker", "mine")}).filter("p is not null")
    return pairs.select("ix", X.same_context(F.col("t"), F.col("p.t"), F.col("talker"), F.col("p.talker"), F.col("mine"), F.col("p.mine")).alias("same_context"))


# --- lexicon


@query(_sql("select count(*) as messages, avg(length(content)) as average_length, avg(case when length(content) <= 10 then 1.0 else 0.0 end) as short_share from clean where mine"))
def q_message_profile(spark, sf_dir):
    return L.message_profile(A.timeline(spark, sf_dir).filter("mine"))


@query(r"""with words as (select doc_id, unnest(regexp_split_to_array(text, '[\s!-@\[-`{-~]+')) as word, generate_subscripts(regexp_split_to_array(text, '[\s!-@\[-`{-~]+'), 1) as pos from documents)
select word, count(*) as n from words where length(word) >= 2 and regexp_full_match(word, '\p{L}+') group by word order by n desc, min(doc_id * 1000000 + pos) limit 50""")
def q_word_frequency(spark, sf_dir):
    return L.word_frequency(A.table(spark, sf_dir, "documents"), "text", "doc_id", 50)


#: Syllables of the fixtures' prose with counts: a small dictionary that cuts runs of letters.
SYLLABLES = {
    "the": 900, "th": 90, "he": 80, "and": 500, "an": 120, "in": 300, "ing": 250, "tion": 220, "on": 150, "er": 200, "ent": 90, "ment": 60, "that": 160, "of": 140, "re": 110, "ou": 100, "eau": 70, "eaux": 40,
    "x": 5, "ch": 130, "sch": 75, "ein": 95, "ich": 65, "keit": 30, "en": 260, "ung": 45, "de": 180, "los": 55, "ción": 35, "que": 85, "s": 50, "t": 45, "e": 60, "n": 40, "a": 70, "é": 20,
}


# Costs to go are made from a run's end, a list whose first is the place's own; then the cheapest ends are followed from its start.
@query("with recursive dict(word, n) as (values " + ", ".join(f"('{w}', {n})" for w, n in SYLLABLES.items()) + r"""),
costs as (select map(list(word), list(cast(round(1000000 * (ln((select sum(n) from dict)) - ln(n))) as bigint))) as m, cast(round(1000000 * ln((select sum(n) from dict))) as bigint) as unknown, max(length(word)) as longest from dict),
runs as (select run, count(*) as n from (select unnest(regexp_extract_all(text, '\p{L}+')) as run from documents) x group by run),
back as (
  select run, length(run) as i, [cast(0 as bigint)] as to_go, cast([] as bigint[]) as ends from runs
  union all
  select run, i - 1, list_prepend(b.c, to_go), list_prepend(-b.k, ends) from (
    select run, i, to_go, ends, list_min(list_filter([{'c': coalesce(m[substr(run, cast(i as int), cast(k as int))], case when k = 1 then unknown end) + to_go[k], 'k': -k} for k in range(1, least(longest, length(run) - i + 1) + 1)], lambda x: x.c is not null)) as b
    from back cross join costs where i > 0) y),
walk as (
  select run, ends, 1 as p from back where i = 0 union all select run, ends, p + ends[p] from walk where p + ends[p] <= length(run))
select substr(w.run, cast(p as int), cast(ends[p] as int)) as word, cast(sum(r.n) as bigint) as n from walk w join runs r on r.run = w.run group by word""")
def q_segmented_words(spark, sf_dir):
    """How often each word of a fixed dictionary, or character outside it, is on the best paths of all documents."""
    words = G.segmented_words(F.col("text"), G.Dictionary(SYLLABLES), G.CUT_ALL)
    return A.table(spark, sf_dir, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(r"""with runs as (select run, count(*) as n from (select unnest(regexp_extract_all(text, '\p{L}+')) as run from documents) x group by run),
places as (select run, n, unnest(range(1, length(run) + 1)) as i from runs),
grams as (select gram, cast(sum(n) as bigint) as n from (select substr(run, cast(i as int), cast(k as int)) as gram, n from (select run, n, i, unnest(range(1, least(5, length(run) - i + 1) + 1)) as k from places) x) y group by gram),
total as (select sum(n) as t from grams where length(gram) = 1),
words as (select gram as word, n from grams where length(gram) between 2 and 4 and n >= 20),
cuts as (select word, n, unnest(range(1, length(word))) as p from words),
together as (
  select c.word, c.n, min(c.n * cast(t as double) / h.n / l.n) as cohesion from cuts c join grams h on h.gram = substr(c.word, 1, cast(p as int)) join grams l on l.gram = substr(c.word, cast(p + 1 as int)) cross join total group by c.word, c.n),
ends as (select substr(gram, 1, length(gram) - 1) as word, sum(n * ln(n)) as s from grams where length(gram) >= 2 group by 1),
starts as (select substr(gram, 2) as word, sum(n * ln(n)) as s from grams where length(gram) >= 2 group by 1),
found as (select t.word, t.n, cohesion, ln(n) - coalesce(a.s, 0) / n as left_entropy, ln(n) - coalesce(b.s, 0) / n as right_entropy from together t left join starts a using (word) left join ends b using (word))
select word, n, round(cohesion, 4) as cohesion, round(left_entropy, 4) as left_entropy, round(right_entropy, 4) as right_entropy from found where cohesion >= 3 and least(left_entropy, right_entropy) >= 1""")
def q_learnt_words(spark, sf_dir):
    """Strings of the documents' letters that hold together and whose neighbours vary."""
    counts = materialised(G.gram_counts(A.table(spark, sf_dir, "documents"), "text", r"\p{L}+", 5), "grams", work=4)
    found = G.learn_words(counts, 4, min_count=20, min_cohesion=3.0, min_entropy=1.0)
    return found.select("word", "n", *[F.round(c, 4).alias(c) for c in ("cohesion", "left_entropy", "right_entropy")])


@query(_sql("select emoji, count(*) as n from (select ix, unnest(regexp_extract_all(content, '\\[([^\\]]+)\\]', 1)) as emoji from clean) x group by emoji order by n desc, min(ix) limit 10"))
def q_placeholder_frequency(spark, sf_dir):
    return L.emoji_frequency(A.timeline(spark, sf_dir), top=10)


@query(_samples_sql("select count(*) as messages, avg(length(output)) as average_length, avg(case when length(output) <= 10 then 1.0 else 0.0 end) as short_share from samples where score >= 6.0"))
def q_filtered_sample_stats(spark, sf_dir):
    return L.message_profile(E.passing(A.samples(spark, sf_dir), 6.0), "output")


# --- scores

# Letters become one ASCII letter, so that both engines see the same word boundaries.
@query(r"""with t as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), '[\p{L}\p{M}]', 'a', 'g') as s from documents),
found as (select doc_id, list_transform(list_reverse(string_split(s, chr(10))), lambda x: regexp_extract_all(x, '\b(\d+(?:\.\d+)?)\b', 1)) as per_line, list_reverse(regexp_extract_all(s, '\b(\d+(?:\.\d+)?)\b', 1)) as every from t)
select doc_id, coalesce(list_filter(list_transform(list_filter(per_line, lambda x: len(x) > 0), lambda x: cast(x[-1] as double)), lambda v: v between 0 and 10)[1],
  list_filter(list_transform(every, lambda x: cast(x as double)), lambda v: v between 0 and 10)[1], 0.0) as score from found""")
def q_score_parse(spark, sf_dir):
    """The score that would be read from each document, were it a reply."""
    return A.table(spark, sf_dir, "documents").select("doc_id", parse_score(F.col("text")).alias("score"))


@query(_samples_sql("select count(*) as total_samples, count(*) filter (where score >= 6.0) as passed_samples, count(*) filter (where score < 6.0) as failed_samples, round(avg(score), 6) as average_score, round(100.0 * count(*) filter (where score >= 6.0) / count(*), 6) as passed_percent from samples"))
def q_eval_report(spark, sf_dir):
    return E.report(A.samples(spark, sf_dir), 6.0).withColumn("average_score", F.round("average_score", 6)).withColumn("passed_percent", F.round("passed_percent", 6))


@query(_samples_sql("select bucket, count(score) as samples from (values ('0-2', 0.0, 2.0), ('2-4', 2.0, 4.0), ('4-6', 4.0, 6.0), ('6-8', 6.0, 8.0), ('8-10', 8.0, 10.0)) b(bucket, lo, hi) left join samples on score >= lo and score < hi group by bucket"))
def q_score_histogram(spark, sf_dir):
    return E.histogram(A.samples(spark, sf_dir))


@query(_samples_sql("select conv_id, turn, score, output from samples where score >= 8.0"))
def q_filter_by_score(spark, sf_dir):
    return E.passing(A.samples(spark, sf_dir), 8.0).select("conv_id", "turn", "score", "output")


@query(_samples_sql("select conv_id, turn, md5(instruction || '|' || input || '|' || output) as key from samples"))
def q_sample_cache_key(spark, sf_dir):
    return E.keyed(A.samples(spark, sf_dir)).select("conv_id", "turn", "key")


@query(_samples_sql("select k.key, count(*) as n from k where k.key not in (select key from k where score >= 6.0) group by k.key", "k as (select score, md5(instruction || '|' || input || '|' || output) as key from samples)"))
def q_cache_misses(spark, sf_dir):
    """Keys that a cache of the samples that passed lacks."""
    keyed = E.keyed(A.samples(spark, sf_dir))
    missing = E.cache_misses(keyed, E.passing(keyed, 6.0).select("key").distinct()).select("key")
    return keyed.join(missing, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


# --- conversations

_RELATED = """theirs as (select talker as contact, t, ix, content from clean where talker <> 'wxid_me'), own as (select t, ix, content from clean where talker = 'wxid_me'),
nearest as (select c.contact, o.ix, o.t, o.content from (select distinct contact from theirs) c cross join own o),
back as (select n.contact, n.ix, n.t - b.t as gap from nearest n asof left join theirs b on n.contact = b.contact and n.t >= b.t),
forth as (select n.contact, n.ix, f.t - n.t as gap from nearest n asof left join theirs f on n.contact = f.contact and n.t <= f.t),
related as (select back.contact, back.ix from back join forth on back.contact = forth.contact and back.ix = forth.ix where least(back.gap, forth.gap) <= 3600000000),
members as (select contact, t, 0 as rank, ix, false as mine, content from theirs union all select r.contact, o.t, 1, o.ix, true, o.content from related r join own o on o.ix = r.ix)"""
_CHUNKS = "placed as (select *, (row_number() over (partition by contact order by t, rank, ix) - 1) // 1000 as chunk from members)"


def _related(spark, sf_dir):
    rows = A.timeline(spark, sf_dir)
    return V.related_messages(rows.filter("talker <> 'wxid_me'").select("talker", "t"), rows.filter("talker = 'wxid_me'").select("ix", "t"))


@query(_sql("select contact, ix from related", _RELATED))
def q_related_messages(spark, sf_dir):
    return _related(spark, sf_dir)


@query(_sql("select contact, count(*) filter (where not mine) as theirs, count(*) filter (where mine) as mine, count(*) as messages from members group by contact having count(*) >= 20", _RELATED))
def q_conversations(spark, sf_dir):
    rows = V.conversations(A.timeline(spark, sf_dir), "wxid_me")
    return rows.groupBy("contact").agg(F.count_if(~F.col("mine")).alias("theirs"), F.count_if("mine").alias("mine"), F.count(F.lit(1)).alias("messages"))


def _chunks(spark, sf_dir):
    return V.chunked(V.conversations(A.timeline(spark, sf_dir), "wxid_me"))


@query(_sql("select contact, chunk, count(*) as message_count, min(ix) as first_ix, max(ix) as last_ix from placed group by contact, chunk", _RELATED, _CHUNKS))
def q_conversation_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).groupBy("contact", "chunk").agg(F.count(F.lit(1)).alias("message_count"), F.min("ix").alias("first_ix"), F.max("ix").alias("last_ix"))


def _offline(prompt: str) -> str:
    """The offline completion of the fixtures: the prompt's first line."""
    return prompt.split("\n")[0]


_LEVEL1 = "level1 as (select contact, chunk, count(*) as message_count, contact || ': ' || count(*) as analysis from placed group by contact, chunk)"
_LEVEL2 = """level2 as (select contact, count(*) as analysis_count, cast(sum(message_count) as bigint) as total_messages, '[' || string_agg('"' || analysis || '"', ',' order by chunk) || ']' as analyses from level1 group by contact)"""


@query(_sql("select * from level1", _RELATED, _CHUNKS, _LEVEL1))
def q_level1(spark, sf_dir):
    bodies = V.chunk_bodies(_chunks(spark, sf_dir)).withColumn("key", V.chunk_key(F.col("contact"), F.lit(""), F.concat_ws(":", "chunk", "body")))
    prompts = bodies.withColumn("prompt", render("{contact}: {n}\n{body}", contact=F.col("contact"), n=F.col("message_count"), body=F.col("body")))
    prompts = materialised(prompts.select("contact", "chunk", "message_count", "key", "prompt"), "prompts")  # asked, and joined to the replies
    replies = P.complete(prompts, _offline).filter("error is null")
    return prompts.join(replies, "key").select("contact", "chunk", "message_count", F.col("response").alias("analysis"))


@query(_sql("select * from level2", _RELATED, _CHUNKS, _LEVEL1, _LEVEL2))
def q_level2(spark, sf_dir):
    return V.merge_by_contact(q_level1(spark, sf_dir))


_MERGED = """bodies as (select contact, (p) // 50 as pos, count(*) as weight, string_agg(content, chr(10) order by t, rank, ix) as text from (select *, row_number() over (partition by contact order by t, rank, ix) - 1 as p from members) x group by 1, 2),
pieces as (select contact, pos, pos // 4 as block, weight, unnest(range(0, greatest(cast(ceil(length(text) / 2000.0) as bigint), 1))) as piece, text from bodies),
cut as (select contact, pos, block, piece, case when piece = 0 then weight else 0 end as weight, case when piece = 0 then 1 else 0 end as leaf, substr(text, cast(piece * 2000 + 1 as int), 2000) as text from pieces),
sized as (
  select *, sum(length(text)) over (partition by contact, block) as whole, coalesce(sum(length(text)) over (partition by contact, block order by pos, piece rows between unbounded preceding and 1 preceding), 0) as before from cut)"""


@query(_sql("""select contact as owner, block, cast(case when whole <= 4000 then 0 else before // 2000 end as int) as grp, count(*) as parts, cast(sum(leaf) as bigint) as leaves, cast(sum(weight) as bigint) as weight,
  cast(sum(length(text)) as bigint) as chars, md5(string_agg(text, '|' order by pos, piece)) as texts from sized group by 1, 2, 3""", _RELATED, _MERGED))
def q_merge_groups(spark, sf_dir):
    """Which stretches of the contacts' conversations, fifty messages a text, a merge of 4000 characters takes together."""
    rows = V.chunked(V.conversations(A.timeline(spark, sf_dir), "wxid_me", min_contact=1, min_conversation=1), 50)
    line = F.array_sort(F.collect_list(F.struct("t", "rank", "ix", "content")))
    texts = rows.groupBy(F.col("contact").alias("owner"), F.col("chunk").alias("pos")).agg(F.count(F.lit(1)).alias("weight"), F.array_join(F.transform(line, lambda x: x["content"]), "\n").alias("text"))
    return M.groups(texts.withColumn("sub", F.lit(0)), 4, 4000).withColumn("texts", F.md5(F.array_join("texts", "|")))


_FINAL = """select count(*) as total_contacts, cast(sum(total_messages) as bigint) as total_messages,
  '[' || string_agg('{"contact":"' || contact || '","analysis":' || to_json(analyses) || '}', ',' order by contact) || ']' as contact_analyses from level2"""


@query(_sql(_FINAL, _RELATED, _CHUNKS, _LEVEL1, _LEVEL2))
def q_final(spark, sf_dir):
    return V.merge_all(q_level2(spark, sf_dir).withColumnRenamed("analyses", "analysis"))


@query(_sql("""select contact, chunk, '[' || string_agg('{"sender":' || to_json(case when mine then '我' else contact end) || ',"content":' || to_json(content) || ',"create_time":"' || strftime(make_timestamp(t), '%Y-%m-%dT%H:%M:%S') || '"}', ',' order by t, rank, ix) || ']' as body from placed group by contact, chunk""", _RELATED, _CHUNKS))
def q_conversation_json(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    return rows.groupBy("contact", "chunk").agg(V.conversation_json(rows).alias("body"))


@query("""with files as (select regexp_extract(coalesce(url, ''), '^[a-z]*://[^/]*', 0) as path, md5(coalesce(html, '')) as fingerprint from pages),
known as (select path, min(fingerprint) as fingerprint from files group by path)
select path, fingerprint, count(*) as copies from files f where not exists (select 1 from known k where k.path = f.path and k.fingerprint = f.fingerprint) group by path, fingerprint""")
def q_manifest_diff(spark, sf_dir):
    """Files a manifest lacks or has with another fingerprint; hosts stand for paths and pages for their versions, of which the manifest knows one each."""
    from convoframe.sources.manifest import unprocessed

    files = A.table(spark, sf_dir, "pages").select(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-z]*://[^/]*", 0).alias("path"), F.md5(F.coalesce("html", F.lit(""))).alias("fingerprint"))
    known = files.groupBy("path").agg(F.min("fingerprint").alias("fingerprint"))
    return unprocessed(files, known).groupBy("path", "fingerprint").agg(F.count(F.lit(1)).alias("copies"))


@query(_sql("select ix, cast(coalesce(sum(case when mine then 1 else 0 end) over w, 0) as bigint) as mine_72h, count(*) over w as all_72h from clean window w as (order by t range between 259200000000 preceding and 1 preceding)"))
def q_rolling_counts(spark, sf_dir):
    """Messages in the 72 hours before each message, from running counts at both ends."""
    rows = A.timeline(spark, sf_dir)
    # Counted among mine (side 0), and among all (side 1) under one talker.
    sides = rows.withColumn("side", F.explode(F.when(F.col("mine"), F.array(F.lit(X.MINE), F.lit(X.THEIRS))).otherwise(F.array(F.lit(X.THEIRS))))).withColumn("talker", F.when(F.col("side") == X.MINE, "").otherwise("*"))
    probes = rows.select(F.col("ix").alias("round_id"), F.lit("*").alias("talker"), F.col("t").alias("reply_t"))
    found = X._merged(sides, X._sided(X._ends(probes, X.HOURS))).filter("_kind = 0")
    pick = lambda side, end: F.max(F.when((F.col("side") == side) & (F.col("_end") == end), F.col("before")))
    counts = {side: pick(side, "high") - pick(side, "low") for side in (X.MINE, X.THEIRS)}
    return found.groupBy("_pid").agg(counts[X.MINE].alias("mine_72h"), counts[X.THEIRS].alias("all_72h")).withColumnRenamed("_pid", "ix")


# --- sources and stores


def _folder(spark, tag: str) -> str:
    """A new folder of the shared scratch place, gone when the application ends."""
    path = f"{checkpoint_root(spark)}/{tag}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@query(ORACLES["q_clean_messages"])
def q_csv_ingest(spark, sf_dir):
    """The messages written as export files, a folder a talker, and read back by their headers."""
    place = _folder(spark, "exports")
    raw = spark.sql(A.MESSAGES, events=A.table(spark, sf_dir, "events"))
    micro = F.date_format("CreateTime", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw.withColumn("CreateTime", micro).withColumn("folder", F.col("talker")).write.partitionBy("folder").option("header", True).option("escape", '"').csv(place)
    rows = C_.raw_messages(spark, [f.path for f in C_.listed(spark, f"{place}/*/*.csv")])
    return clean_messages(rows).select("msg_id", micros(F.col("create_time")).alias("t"), "is_sender", "talker", "type_name", "content", "original_msg")


def _arrived(spark, sf_dir, samples=True):
    """The timeline's tables after the messages came in two parts: those with text first, the others between them later."""
    kept = Incremental(Store(spark, _folder(spark, "timeline-store")))
    rows = A.messages(spark, sf_dir)
    texts = F.coalesce(F.col("type_name") == TEXT, F.lit(False))
    for part in (rows.filter(texts), rows.filter(~texts)):
        commit = kept.add(part)
        kept.render(commit, A.contacts(spark, sf_dir)) if samples else commit.publish()
    return kept


@query(ORACLES["q_rounds"])
def q_incremental_rounds(spark, sf_dir):
    """Rounds kept up to date over two arrivals."""
    return _arrived(spark, sf_dir, samples=False).rounds()


@query(ORACLES["q_training_samples"])
def q_incremental_samples(spark, sf_dir):
    """Samples kept up to date over two arrivals."""
    return _arrived(spark, sf_dir).samples()


@query(_samples_sql("select key, max(score) as score, count(*) filter (where conv_id is not null) as met from k group by key", "k as (select conv_id, score, md5(instruction || '|' || input || '|' || output) as key from samples)"))
def q_keyed_cache(spark, sf_dir):
    """Scores by the content of samples, upserted twice over (a retry), found again for every sample."""
    keyed = E.keyed(A.samples(spark, sf_dir)).select("key", "score")
    cache = Keyed(Store(spark, _folder(spark, "cache-store")), "scores", "key", "key string, score double")
    for _ in range(2):
        cache.upsert(keyed)
    return keyed.select("key").join(cache.find(keyed), "key").groupBy("key").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("met"))
