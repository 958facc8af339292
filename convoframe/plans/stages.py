"""The engine's stages over exports: extract, evaluate, filter, analyse.

Timeline, rounds and samples are in a snapshot store, state and results in Parquet
tables of the output folder, so a stage can run by itself later.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convoframe.config import Options
from convoframe.functions.text import render
from convoframe.operators import completions as P
from convoframe.operators import contacts as C
from convoframe.operators import conversations as V
from convoframe.operators import lexicon as L
from convoframe.operators import reduction as T
from convoframe.operators import rounds as R
from convoframe.operators import scoring as E
from convoframe.operators import segment as G
from convoframe.operators.messages import clean_messages
from convoframe.plans.incremental import Incremental
from convoframe.sources import contacts_source, csv_source, export, manifest
from convoframe.sources.keyed import Keyed
from convoframe.sources.snapshots import Store

CONTACTS = "contact_id string, nickname string, remark string, relationship string, relationship_detail string, message_count long, first_contact_date timestamp_ntz, last_contact_date timestamp_ntz"
CACHE = "key string, score double, response string, instruction string, input string, output string, cached_at timestamp"
#: Relationships named in the summary; the others are in a file of their own.
SHOWN = 1000


@dataclass
class Stage1:
    messages: DataFrame
    contacts: DataFrame
    rounds: DataFrame
    samples: DataFrame
    new_files: int


def stage1(spark: SparkSession, o: Options) -> Stage1:
    """Ingests new and changed files; timeline, rounds and samples follow as far as they are changed.

    All of them change in one commit.  A run that dies before leaves its files unread; one
    that dies after it, before the manifest knows, reads them again, which changes nothing.
    """
    manifest_path = f"{o.output_dir}/manifest.parquet"
    files, rows = csv_source.new_files(spark, o.data_dir, manifest_path)
    users = contacts_source.user_rows(spark, o.data_dir)
    me = users.filter(F.col("contact_id") == o.my_id) if o.my_id else None
    name = C.my_name_of(contacts_source.last_records(me), o.my_id, o.my_name) if me is not None else o.my_name
    kept = stored(spark, o, name)
    if "timeline" not in kept.store.current() and manifest.exists(spark, manifest_path):  # without messages, no file counts as read
        export.set_aside(spark, manifest_path)
        files, rows = csv_source.new_files(spark, o.data_dir, manifest_path)
    commit = kept.add(clean_messages(csv_source.raw_messages(spark, files), o.epoch_unit), files)
    contacts = export.load_state(spark, o.output_dir, "contacts", CONTACTS)
    stats = kept.message_stats(kept.written(commit))
    contacts = C.upsert_stats(C.upsert_users(contacts, contacts_source.first_names(users)), stats)
    contacts = export.save_table(contacts, o.output_dir, "contacts")
    at = kept.render(commit, contacts)
    if files:
        manifest.record(rows, manifest_path)
    kept.store.collect_garbage()
    return Stage1(kept.timeline(at), contacts, kept.rounds(at), kept.samples(at), len(files))


def stored(spark: SparkSession, o: Options, me: str = "我") -> Incremental:
    """The timeline, rounds and samples of an output folder."""
    return Incremental(Store(spark, f"{o.output_dir}/store"), R.RoundRules(o.max_gap, o.max_delay), me)


def language_patterns(timeline: DataFrame) -> dict[str, DataFrame]:
    """The user's words, marks and message profile, and the contact statistics.

    Text without spaces is cut by a dictionary learnt from all messages.
    """
    own, dictionary = timeline.filter("mine"), G.learn_dictionary(timeline, "content")
    return {"words": L.word_frequency(own, top=20, words=G.segmented_words(F.col("content"), dictionary)), "emoji": L.emoji_frequency(own, top=10), "profile": L.message_profile(own), "contacts": C.contact_statistics(timeline, 10)}


def eval_cache(spark: SparkSession, o: Options) -> Keyed:
    """Scores by the content of samples."""
    return Keyed(Store(spark, f"{o.output_dir}/eval_cache"), "scores", "key", CACHE)


def analysis_cache(spark: SparkSession, o: Options) -> Keyed:
    """Analyses by the content of prompts."""
    return Keyed(Store(spark, f"{o.output_dir}/analysis_cache"), "analyses", "key", P.CACHE)


def journal(spark: SparkSession, o: Options, kind: str) -> str:
    """Where replies go as they come, until the cache has them: an address that executors' Python opens."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{o.output_dir}/calls/{kind}")
    place = str(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place))
    return "file://" + place.removeprefix("file:") if place.startswith("file:/") and not place.startswith("file://") else place


def stage2(spark: SparkSession, o: Options, complete: Callable[[str], str] | None = None) -> dict[str, DataFrame]:
    """Scores samples (cached ones are not scored again) and keeps those that pass; without a scorer all pass."""
    kept = stored(spark, o)
    at = kept.store.current()  # one version for all that follows
    if "samples" not in at:
        raise FileNotFoundError("run stage1 first: there are no samples")
    samples = kept.samples(at)
    if not o.scoring or complete is None:
        return {"final": export.save_table(samples, o.output_dir, "final")}
    keyed = E.keyed(samples)
    scored = eval_cache(spark, o)
    cache = scored.read()
    prompt = render(o.prompt, instruction=F.col("instruction"), input=F.col("input"), output=F.col("output"))
    misses = E.cache_misses(keyed, cache).withColumn("prompt", prompt)
    replies = export.save_table(E.scored(P.complete(misses, complete, o.attempts, threads=o.threads, journal=journal(spark, o, "scores"), per_minute=o.per_minute)), o.output_dir, "last_replies")
    good = replies.filter("error is null").join(misses, "key").select("key", "score", "response", "instruction", "input", "output", F.current_timestamp().alias("cached_at"))
    scored.upsert(good)
    P.Journal(journal(spark, o, "scores")).clear()  # the cache has them now
    scores = keyed.join(cache.select("key", "score", "response").unionByName(replies.select("key", "score", "response")), "key")
    scores = export.save_table(E.judged(scores, o.min_score), o.output_dir, "scores")
    final = export.save_table(E.passing(scores, o.min_score), o.output_dir, "final")
    return {"final": final, "report": E.report(scores, o.min_score), "histogram": E.histogram(scores), "details": scores}


def filter_cache(spark: SparkSession, o: Options, min_score: float) -> dict[str, DataFrame]:
    """Passing samples of the score cache with their statistics; nothing is scored."""
    cache = eval_cache(spark, o).read()
    kept = E.passing(cache.filter("output is not null"), min_score)
    named, dictionary = kept.withColumn("ix", F.xxhash64("key")), G.learn_dictionary(cache, "output")
    return {"samples": kept, "report": E.report(cache, min_score), "histogram": E.histogram(cache), "words": L.word_frequency(named, "output", top=20, words=G.segmented_words(F.col("output"), dictionary)), "emoji": L.emoji_frequency(named, "output"), "profile": L.message_profile(kept, "output")}


def cache_size(spark: SparkSession, o: Options) -> int:
    return eval_cache(spark, o).read().count()


def clear_cache(spark: SparkSession, o: Options) -> None:
    eval_cache(spark, o).clear()


def _cached(spark: SparkSession, o: Options, rows: DataFrame, kind: str, call: Callable[[str], str]) -> DataFrame:
    """Adds ``analysis`` to rows with ``key`` and ``prompt``: cached, or called for, cached and logged; failed rows are left out."""
    rows = export.save_table(rows, o.output_dir, f"analysis_{kind}_prompts")
    answered = analysis_cache(spark, o)
    cache = answered.read()
    todo = P.missing(rows, cache)
    replies = export.save_table(P.complete(todo, call, o.analysis_attempts, wait=2.0, threads=o.analysis_threads, journal=journal(spark, o, kind), per_minute=o.per_minute), o.output_dir, f"analysis_{kind}_replies")
    export.save_table(P.log_rows(todo, replies, kind), o.output_dir, "api_log", mode="append")
    fresh = replies.filter("error is null").select("key", "response")
    known = cache.select("key", "response").join(rows.select("key").distinct(), "key", "left_semi").unionByName(fresh)
    done = export.save_table(rows.join(known.withColumnRenamed("response", "analysis"), "key"), o.output_dir, f"analysis_{kind}")
    answered.upsert(fresh.withColumn("cached_at", F.current_timestamp()))
    P.Journal(journal(spark, o, kind)).clear()
    return done


def analyse(spark: SparkSession, o: Options, call: Callable[[str], str], folder: str | None = None) -> dict[str, DataFrame]:
    """Conversations of one folder or all, analysed by chunk, merged by contact, and summed up; what the cache has is not asked again.

    Merges are trees (``reduction``): no prompt holds more than ``prompt_limit`` characters of
    analyses, and a changed chunk asks its path to the top again.
    """
    if folder is not None and folder not in csv_source.folders(spark, o.data_dir):
        raise ValueError(f"there is no folder {folder!r} with messages")
    rows = csv_source.analysis_messages(spark, o.data_dir, folder, o.epoch_unit)
    rows = export.save_table(R.numbered(rows), o.output_dir, "analysis_messages")
    found = C.infer_me(rows).first()
    if found is None:
        raise ValueError("there are no messages to analyse")
    contacts = export.load_state(spark, o.output_dir, "contacts", CONTACTS)

    def named(df: DataFrame) -> DataFrame:
        return C.with_contact(df, contacts, "contact").withColumn("contact_name", C.display_name(F.col("remark"), F.col("nickname"), F.col("contact"))).drop("nickname", "remark", "relationship_detail", "first_contact_date")

    who = {"contact_name": F.col("contact_name"), "relationship": F.col("relationship")}
    bodies = named(V.chunk_bodies(V.chunked(V.conversations(rows, found["talker"]), o.chunk), o.my_name))
    first = bodies.select("contact", "chunk", "message_count", V.chunk_key(F.col("contact"), F.col("relationship"), F.regexp_replace("body", r',"create_time":"[^"]*"', "")).alias("key"), render(o.first_prompt, **who, conversation_count=F.col("message_count"), conversations=F.col("body")).alias("prompt"))
    level1 = _cached(spark, o, first, "level1", call)
    keep = lambda part: lambda df, name: export.save_table(df, o.output_dir, f"analysis_{part}_{name}")

    def merge_one(groups: DataFrame, number: int) -> DataFrame:
        rows = named(groups.withColumnRenamed("owner", "contact")).withColumn("analyses", F.to_json("texts"))
        prompt = render(o.second_prompt, **who, total_messages=F.col("weight"), analysis_count=F.col("parts"), analyses=F.col("analyses"))
        rows = rows.select("contact", "block", "grp", "leaves", "weight", V.chunk_key(F.col("contact"), F.col("relationship"), F.col("analyses")).alias("key"), prompt.alias("prompt"))
        return _cached(spark, o, rows, f"level2_{number}", call).select(F.col("contact").alias("owner"), "block", "grp", "leaves", "weight", F.col("analysis").alias("text"))

    parts = level1.select(F.col("contact").alias("owner"), F.col("chunk").alias("pos"), F.lit(0).alias("sub"), F.col("message_count").alias("weight"), F.col("analysis").alias("text"))
    level2 = T.reduce_tree(parts, merge_one, keep("level2"), o.fan, o.prompt_limit)
    level2 = export.save_table(level2.select(F.col("owner").alias("contact"), F.col("leaves").alias("analysis_count"), F.col("weight").alias("total_messages"), F.col("text").alias("analysis")), o.output_dir, "analysis_level2")

    def merge_all(groups: DataFrame, number: int) -> DataFrame:
        texts = F.concat(F.lit("["), F.array_join("texts", ","), F.lit("]")) if number == 1 else F.to_json("texts")
        rows = groups.withColumn("contact_analyses", texts)
        prompt = render(o.final_prompt, contact_count=F.col("leaves"), total_messages=F.col("weight"), contact_analyses=F.col("contact_analyses"))
        rows = rows.select("owner", "block", "grp", "leaves", "weight", F.md5("contact_analyses").alias("key"), prompt.alias("prompt"))
        return _cached(spark, o, rows, f"final_{number}", call).withColumnRenamed("analysis", "text")

    shown = T.spread(level2, "contact", level2.count(), o.fan)
    shown = shown.withColumn("sub", F.row_number().over(Window.partitionBy("pos").orderBy("contact")))
    shown = shown.select(F.lit("all").alias("owner"), "pos", "sub", F.col("total_messages").alias("weight"), F.to_json(F.struct("contact", "analysis")).alias("text"))
    final = T.reduce_tree(shown, merge_all, keep("final"), o.fan, o.prompt_limit)
    final = final.select(F.col("leaves").alias("total_contacts"), F.col("weight").alias("total_messages"), F.col("text").alias("analysis"))
    return {"level1": level1, "level2": level2, "final": final}


def analysis_cache_stats(spark: SparkSession, o: Options) -> dict[str, int]:
    """Entries of the analysis cache and of the log."""
    log = export.load_table(spark, o.output_dir, "api_log")
    return {"analysis_cache": analysis_cache(spark, o).read().count(), "api_log": log.count() if log is not None else 0}


def _now(spark: SparkSession) -> str:
    return export.as_dicts(spark.range(1).select(F.localtimestamp().alias("now")))[0]["now"]


def save_stage1(spark: SparkSession, o: Options, done: Stage1) -> str:
    """Stage 1 as JSON: messages, rounds and samples as arrays, and one document with counts, words and parameters that names them; its path."""
    place = f"{o.output_dir}/stage1"
    found = language_patterns(done.messages)
    samples = done.samples.orderBy("round_id")
    export.export_json_array(done.messages.drop("t", "mine").orderBy("ix"), f"{place}/messages.json")
    export.export_json_array(done.rounds.orderBy("round_id"), f"{place}/rounds.json")
    export.export_json_array(samples, f"{place}/samples.json")
    export.export_json_array(samples.select("instruction", "input", "output"), f"{o.output_dir}/stage1_training_data.json")
    metadata = {"stage": 1, "total_samples": done.samples.count(), "processing_time": _now(spark), "parameters": {"max_inter_message_gap": o.max_gap, "max_reply_delay": o.max_delay}}
    patterns = {name: export.as_dicts(df) for name, df in found.items()}  # top lists, and one row
    export.export_json(spark, {"metadata": metadata, "language_patterns": patterns, "files": {name: f"{place}/{name}.json" for name in ("messages", "rounds", "samples")}}, f"{o.output_dir}/stage1_results.json")
    return f"{o.output_dir}/stage1_results.json"


def export_contacts(spark: SparkSession, o: Options, path: str | None = None) -> str:
    """All contacts, the most active first, with their summary and the time, as one JSON document; its path, which names the time unless it is given."""
    contacts, now = export.load_state(spark, o.output_dir, "contacts", CONTACTS), _now(spark)
    path = path or f"{o.output_dir}/contacts_export_{now[:19].replace('-', '').replace(':', '').replace('T', '_')}.json"
    head = {"export_time": now, "summary": export.as_dicts(C.summary(contacts))[0]}
    export.export_json_array(contacts.orderBy(F.desc("message_count"), "contact_id"), path, head, "contacts")
    return path


def save_final(spark: SparkSession, o: Options, done: dict[str, DataFrame]) -> None:
    """Stage 2's files: final samples, contacts summary and parameters; with scores also the filtered samples and the report."""
    samples = done["final"].select("instruction", "input", "output")
    export.export_json_lines(samples, f"{o.output_dir}/training_only.json")
    contacts = export.load_state(spark, o.output_dir, "contacts", CONTACTS)
    kinds = export.save_table(contacts.groupBy("relationship").count().orderBy(F.desc("count"), "relationship"), o.output_dir, "relationships")
    export.export_json_array(kinds.orderBy(F.desc("count"), "relationship"), f"{o.output_dir}/relationships.json")  # all of them
    most = kinds.orderBy(F.desc("count"), "relationship").limit(SHOWN)
    summary = {
        "metadata": {"stage": 2, "total_samples": samples.count(), "max_inter_message_gap": o.max_gap, "max_reply_delay": o.max_delay, "scored": "report" in done},
        "contacts_summary": {**export.as_dicts(contacts.agg(F.count(F.lit(1)).alias("total_contacts"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages")))[0], "relationship_kinds": kinds.count(), "relationships": export.as_dicts(most), "most_active": export.as_dicts(C.most_active(contacts, 5))},
    }
    if "report" in done:
        export.export_json_lines(samples, f"{o.output_dir}/training_filtered.json")
        report = export.as_dicts(done["report"])[0] | {"histogram": export.as_dicts(done["histogram"])}
        export.export_json(spark, report, f"{o.output_dir}/evaluation_report.json")
        summary["evaluation_results"] = report
    export.export_json(spark, summary, f"{o.output_dir}/results_summary.json")


def save_analysis(spark: SparkSession, o: Options, done: dict[str, DataFrame], folder: str | None = None) -> str:
    """Each level's analyses as JSON lines, the final one and the cache's statistics as JSON; the report's path."""
    place = f"{o.output_dir}/pattern_analysis"
    export.export_json_lines(done["level1"].select("contact", "chunk", "message_count", "analysis"), f"{place}/first_level_analysis.json")
    export.export_json_lines(done["level2"].select("contact", "analysis_count", "total_messages", "analysis"), f"{place}/second_level_analysis.json")
    final = export.as_dicts(done["final"].select("total_contacts", "total_messages", F.col("analysis").alias("final_analysis")))
    final, stats = (final[0] if final else None), analysis_cache_stats(spark, o)
    export.export_json(spark, final, f"{place}/final_analysis.json")
    export.export_json(spark, stats, f"{place}/cache_statistics.json")
    path = f"{o.output_dir}/analysis_report_{folder or 'all'}.json"
    export.export_json(spark, {"analysis_time": _now(spark), "analyzed_contact": folder, "analysis_type": "single_contact" if folder else "all_contacts", "results": final, "cache": stats, "levels": place}, path)
    return path
