"""From export folders to samples: sources, stages and sinks."""

import json

import pytest

from convoframe.config import Options, Settings
from convoframe.plans import stages
from convoframe.sources import contacts_source, csv_source, export

HEADER = "id,CreateTime,is_sender,talker,room_name,type_name,msg,src\n"


def line(i, minute, second, sender, talker, kind="文本", msg="hi", src=""):
    return f'{i},2024-03-01 10:{minute:02d}:{second:02d},{sender},{talker},,{kind},"{msg}",{src}\n'


@pytest.fixture
def data(tmp_path):
    a = tmp_path / "data" / "ann"
    a.mkdir(parents=True)
    body = line(1, 0, 0, 0, "wxid_ann", msg='say ""hello"", you\nthere') + line(2, 0, 20, 1, "wxid_me", msg="ok") + line(3, 5, 0, 0, "wxid_ann", "语音", src="spoken") + line(4, 5, 9, 1, "wxid_me", msg="fine")
    (a / "one.csv").write_text(HEADER + body + "x,not a time,0,wxid_ann,,文本,bad,\n", encoding="utf-8")
    (a / "users.json").write_text(json.dumps({"wxid_ann": {"nickname": "Ann", "remark": " "}, "wxid_me": {"nickname": "Me"}}), encoding="utf-8")
    b = tmp_path / "data" / "bob"
    b.mkdir()
    (b / "m.csv").write_text("localId,talkerId,type,content,createTime,isSender\n" + "".join(f"{i},{'wxid_me' if i % 2 else 'wxid_bob'},1,text {i},2024-03-02 10:00:{i:02d},{i % 2}\n" for i in range(30)), encoding="utf-8")
    (b / "users.json").write_text("not json", encoding="utf-8")
    return tmp_path


def options(root, **more):
    return Options(data_dir=str(root / "data"), output_dir=str(root / "out"), my_id="wxid_me", **more)


def test_stage1_is_incremental(spark, data):
    o = options(data)
    first = stages.stage1(spark, o)
    assert first.new_files == 2
    samples = first.samples.orderBy("round_id").collect()
    assert [s["output"] for s in samples] == ["ok", "fine"]
    assert 'say "hello", you\nthere' in samples[0]["input"] and "[语音转文字: spoken]" in samples[1]["input"]
    assert samples[0]["instruction"].startswith("你是Me，正在和Ann聊天。")
    again = stages.stage1(spark, o)
    assert again.new_files == 0 and again.samples.count() == 2
    (data / "data" / "ann" / "two.csv").write_text(HEADER + line(5, 30, 0, 0, "wxid_ann") + line(6, 30, 5, 1, "wxid_me", msg="new"), encoding="utf-8")
    third = stages.stage1(spark, o)
    assert third.new_files == 1 and third.samples.count() == 3
    assert {r["contact_id"]: r["message_count"] for r in third.contacts.collect()} == {"wxid_ann": 3, "wxid_me": 3}


def test_stage2_scores_once(spark, data):
    calls = spark.sparkContext.accumulator(0)

    def complete(prompt):
        calls.add(1)
        if "fine" in prompt:
            raise OSError("no network")
        return "Score: 8"

    o = options(data, scoring=True, attempts=1)
    stages.stage1(spark, o)
    first = stages.stage2(spark, o, complete)
    assert first["report"].first()["passed_samples"] == 1 and first["report"].first()["total_samples"] == 2
    assert stages.cache_size(spark, o) == 1
    before = calls.value
    stages.stage2(spark, o, complete)
    assert calls.value == before + 1  # the failed one only
    kept = stages.filter_cache(spark, o, 7.0)
    assert kept["samples"].count() == 1 and {r["bucket"]: r["samples"] for r in kept["histogram"].collect()}["8-10"] == 1
    stages.clear_cache(spark, o)
    assert stages.cache_size(spark, o) == 0


def test_analyse(spark, data):
    assert csv_source.folders(spark, str(data / "data")) == ["ann", "bob"]
    calls = spark.sparkContext.accumulator(0)

    def call(prompt):
        calls.add(1)
        return prompt.split("\n")[0]

    o = options(data)
    done = stages.analyse(spark, o, call, "bob")
    row = done["level2"].first()
    assert (row["contact"], row["analysis_count"], row["total_messages"]) == ("wxid_me", 1, 30)  # a tie: who wrote first counts as me
    assert row["analysis"] == "wxid_me (朋友), 30 messages in 1 parts:"
    final = done["final"].first()
    assert final["total_contacts"] == 1 and calls.value == 3
    assert stages.analysis_cache_stats(spark, o) == {"analysis_cache": 3, "api_log": 3}
    again = stages.analyse(spark, o, call, "bob")
    assert calls.value == 3 and again["final"].first()["analysis"] == final["analysis"]
    with pytest.raises(ValueError):
        stages.analyse(spark, o, call, "nobody")


def test_contact_files(spark, data):
    rows = contacts_source.user_rows(spark, str(data / "data"))
    assert {(r.contact_id, r.nickname, r.remark) for r in contacts_source.first_names(rows).collect()} == {("wxid_ann", "Ann", ""), ("wxid_me", "Me", "")}
    assert {r.contact_id: r.remark for r in contacts_source.last_records(rows).collect()} == {"wxid_ann": " ", "wxid_me": None}


def test_exports(spark, tmp_path):
    df = spark.sql("select 1 as a, timestamp_ntz'2024-01-02 03:04:05' as t union all select 2, timestamp_ntz'2024-01-02 03:04:05.000120'")
    export.export_json_array(df.orderBy("a"), str(tmp_path / "x.json"))
    assert [r["t"] for r in json.loads((tmp_path / "x.json").read_text())] == ["2024-01-02T03:04:05", "2024-01-02T03:04:05.000120"]
    saved = export.save_table(df, str(tmp_path), "tab")
    assert export.save_table(saved.filter("a = 1"), str(tmp_path), "tab").count() == 1
    assert export.load_table(spark, str(tmp_path), "none") is None


def test_json_array_of_many_tasks(spark, tmp_path):
    path = tmp_path / "out" / "x.json"
    nested = spark.range(500).repartition(7).orderBy("id").selectExpr(
        "id", "if(id % 5 = 0, null, concat('t\u00fc\"\\n', id)) as text", "timestamp_ntz'2024-01-02 03:04:05' as t",
        "if(id % 2 = 0, null, struct(timestamp'2024-01-02 03:04:05.5' as a, array(timestamp_ntz'2024-01-01', null) as b, map('k', struct(timestamp_ntz'2024-01-03' as c)) as d)) as s",
    )
    for df in (nested, nested.filter("id < 3"), nested.filter("false")):
        export.export_json_array(df, str(path))
        found = json.loads(path.read_text(encoding="utf-8"))
        assert [r["id"] for r in found] == [r["id"] for r in df.collect()]
    export.export_json_array(nested, str(path))
    found = json.loads(path.read_text(encoding="utf-8"))
    assert found[0] == {"id": 0, "text": None, "t": "2024-01-02T03:04:05", "s": None}
    assert found[1] == {"id": 1, "text": 't\u00fc"\n1', "t": "2024-01-02T03:04:05", "s": {"a": "2024-01-02T03:04:05.500000", "b": ["2024-01-01T00:00:00", None], "d": {"k": {"c": "2024-01-03T00:00:00"}}}}
    assert sorted(p.name for p in path.parent.iterdir() if not p.name.startswith(".")) == ["x.json"]


def test_settings(tmp_path):
    s = Settings(tmp_path / "c.json")
    assert not s.exists() and s.get("a.b", 7) == 7
    s.set("a.b.c", 1)
    s.save()
    again = Settings(tmp_path / "c.json")
    assert again.get("a.b.c") == 1 and again.get("a.b.c.d", "no") == "no"
    assert Options.of(again).max_gap == 90 and not Options.of(again).scoring


def test_empty_input(spark, tmp_path):
    (tmp_path / "data").mkdir()
    done = stages.stage1(spark, options(tmp_path))
    assert done.samples.count() == 0
    assert stages.language_patterns(done.messages)["profile"].first()["average_length"] == 0.0


@pytest.fixture
def server():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.headers["Authorization"], body))
            failing = body["model"] == "down" or len(asked) == 1
            self.send_response(500 if failing else 200)
            self.end_headers()
            if not failing:
                self.wfile.write(json.dumps({"choices": [{"message": {"content": " reasons\nScore: 8 \n"}}]}).encode())

        def log_message(self, *_):
            pass

    at = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=at.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{at.server_port}/v1/chat/completions", asked
    at.shutdown()


def test_chat_client(server):
    from urllib.error import HTTPError

    from convoframe.operators.chat import SCORING, chat

    url, asked = server
    call = chat(url, "k", "m", 5, SCORING)
    with pytest.raises(HTTPError):  # the server's first answer is an error
        call("one")
    assert call("two") == "reasons\nScore: 8"
    key, body = asked[-1]
    assert key == "Bearer k" and body == {"model": "m", "messages": [{"role": "user", "content": "two"}], **SCORING}


def test_cli_scores_and_analyses_over_http(spark, data, server, capsys, monkeypatch):
    from convoframe import cli

    monkeypatch.setattr(cli, "session", lambda: spark)
    url, asked = server
    api = {"enabled": True, "api_url": url, "api_key": "k", "model": "m", "timeout": 5}
    settings = {"data_processing": {"data_dir": str(data / "data"), "output_dir": str(data / "out"), "my_wxid": "wxid_me"}}
    config = data / "config.json"
    config.write_text(json.dumps(settings))
    base = ["--config", str(config)]
    assert cli.main([*base, "analyze"]) == 1 and not asked and "pattern_analysis" in capsys.readouterr().out
    config.write_text(json.dumps(settings | {"llm_evaluation": api, "pattern_analysis": api}))
    assert cli.main([*base, "full"]) == 0
    out = data / "out"
    report = json.loads((out / "evaluation_report.json").read_text(encoding="utf-8"))
    assert sum(h["samples"] for h in report["histogram"]) == 2
    assert spark.read.json(str(out / "training_filtered.json")).count() == 2
    summary = json.loads((out / "results_summary.json").read_text(encoding="utf-8"))
    assert summary["metadata"]["total_samples"] == 2 and summary["contacts_summary"]["total_contacts"] >= 1
    first = json.loads((out / "stage1_results.json").read_text(encoding="utf-8"))
    assert first["metadata"]["total_samples"] == 2 and set(first["language_patterns"]) == {"words", "emoji", "profile", "contacts"}
    messages = json.loads((out / "stage1" / "messages.json").read_text(encoding="utf-8"))
    assert [m["ix"] for m in messages] == list(range(len(messages))) and messages[0]["create_time"] == "2024-03-01T10:00:00"
    assert len(json.loads((out / "stage1_training_data.json").read_text(encoding="utf-8"))) == 2
    assert cli.main([*base, "contacts", "--export"]) == 0
    (exported,) = out.glob("contacts_export_*.json")
    exported = json.loads(exported.read_text(encoding="utf-8"))
    assert [c["message_count"] for c in exported["contacts"]] == sorted((c["message_count"] for c in exported["contacts"]), reverse=True)
    assert exported["summary"]["total_contacts"] == len(exported["contacts"]) >= 2 and exported["export_time"] > "2024"
    assert cli.main([*base, "contacts", "--search", "ann", "--set", "wxid_ann", "同事", "desk", "--export", str(data / "c.json")]) == 0
    assert {c["contact_id"]: c["relationship"] for c in json.loads((data / "c.json").read_text(encoding="utf-8"))["contacts"]}["wxid_ann"] == "同事"
    assert cli.main([*base, "analyze", "--contact", "bob"]) == 0
    found = json.loads((out / "analysis_report_bob.json").read_text(encoding="utf-8"))
    assert found["analysis_type"] == "single_contact" and found["results"]["final_analysis"] == "reasons\nScore: 8"
    assert json.loads((out / "pattern_analysis" / "cache_statistics.json").read_text())["analysis_cache"] >= 3


def test_unreadable_state_is_empty(spark, data):
    o = options(data)
    stages.stage1(spark, o)
    for name in ("manifest", "contacts"):
        for part in (data / "out" / f"{name}.parquet").glob("*.parquet"):
            part.write_bytes(b"no parquet")
            (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    again = stages.stage1(spark, o)
    assert again.new_files == 2 and again.samples.count() == 2 and again.contacts.count() >= 2
    assert list((data / "out").glob("contacts.parquet.unreadable-*"))


def test_replacement_cut_short_is_finished(spark, tmp_path):
    place = str(tmp_path)
    export.save_table(spark.range(3), place, "t")
    spark.range(5).write.parquet(f"{place}/t.parquet.new")
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.old")
    assert export.load_table(spark, place, "t").count() == 5
    assert not (tmp_path / "t.parquet.old").exists()


def test_tables_on_the_way_to_another_are_dropped(spark):
    import os

    from convoframe.sources.scratch import last_only, materialised, noted

    with noted() as made, noted() as inner:
        out = last_only(spark, lambda: materialised(materialised(spark.range(7), "first"), "second"))
    assert out.count() == 7 and made == [] and len(inner) == 1 and "/second-" in inner[0]
    there = os.listdir(os.path.dirname(inner[0].removeprefix("file:")))
    assert not any(name.startswith("first-") for name in there)
