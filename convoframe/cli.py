"""Command line: stage1, stage2, contacts, filter, analyze, full, help."""

from __future__ import annotations

import argparse
import dataclasses
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from convoframe.config import Api, Options, Settings
from convoframe.operators import contacts as C
from convoframe.operators.chat import ANALYSIS, SCORING, chat
from convoframe.plans import stages
from convoframe.sources import csv_source, export


def session(name: str = "convoframe") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="convoframe", description="Conversation data from chat exports.")
    p.add_argument("--config", default="config.json")
    p.add_argument("--data-dir")
    p.add_argument("--output-dir")
    verbs = p.add_subparsers(dest="verb")
    verbs.add_parser("stage1", help="ingest exports, extract rounds and samples")
    verbs.add_parser("stage2", help="score samples and write the final ones")
    verbs.add_parser("full", help="stage1, then stage2 (the default)")
    verbs.add_parser("help", help="this text")
    f = verbs.add_parser("filter", help="select samples from the score cache")
    f.add_argument("--min-score", type=float, default=6.0)
    c = verbs.add_parser("contacts", help="list, search, edit or export contacts")
    c.add_argument("--search")
    c.add_argument("--set", nargs=3, metavar=("ID", "RELATIONSHIP", "DETAIL"))
    c.add_argument("--export", nargs="?", const="", metavar="FILE", help="as JSON; without FILE to one named by the time in the output folder")
    a = verbs.add_parser("analyze", help="analyse conversations without stage1")
    a.add_argument("--contact")
    a.add_argument("--list", action="store_true")
    return p


def client(api: Api | None, extra: dict) -> Callable[[str], str] | None:
    return chat(api.url, api.key, api.model, api.timeout, extra) if api else None


def main(argv: list[str] | None = None, complete=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if args.verb == "help":
        p.print_help()
        return 0
    o = Options.of(Settings(args.config))
    o = dataclasses.replace(o, **{k: v for k, v in (("data_dir", args.data_dir), ("output_dir", args.output_dir)) if v})
    spark = session()
    if args.verb in (None, "stage1", "full"):
        done = stages.stage1(spark, o)
        print(f"new files {done.new_files}, rounds {done.rounds.count()}, samples {done.samples.count()}")
        print(stages.save_stage1(spark, o, done))
    if args.verb in (None, "stage2", "full"):
        done = stages.stage2(spark, o, complete or client(o.score_api, SCORING))
        for name, df in done.items():
            print(name, df.count())
        stages.save_final(spark, o, done)
    if args.verb == "filter":
        for name, df in stages.filter_cache(spark, o, args.min_score).items():
            export.export_json_lines(df, f"{o.output_dir}/filtered_{args.min_score:g}_{name}.json")
            df.show(20)
    if args.verb == "contacts":
        contacts = export.load_state(spark, o.output_dir, "contacts", stages.CONTACTS)
        if contacts.isEmpty():
            print("run stage1 first: there are no contacts")
            return 1
        if args.set:
            contacts = export.save_table(C.update_relationship(contacts, *args.set), o.output_dir, "contacts")
        if args.export is not None:
            print(stages.export_contacts(spark, o, args.export or None))
        (C.search(contacts, args.search) if args.search else C.most_active(contacts, 20)).show(20, False)
    if args.verb == "analyze":
        if args.list:
            print("\n".join(csv_source.folders(spark, o.data_dir)))
            return 0
        call = complete or client(o.analysis_api, ANALYSIS)
        if call is None:
            print("to analyse, enable pattern_analysis in the settings and give it api_url, api_key and model")
            return 1
        done = stages.analyse(spark, o, call, args.contact)
        print(stages.save_analysis(spark, o, done, args.contact))
        done["final"].select("total_contacts", "total_messages", "analysis").show(1, False)
        print(stages.analysis_cache_stats(spark, o))
    return 0


if __name__ == "__main__":
    sys.exit(main())
