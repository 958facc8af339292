"""The export reader: headers of any spelling in one plan, rows with problems, files that change."""

import re

import pytest

from convoframe.config import Options
from convoframe.plans import stages
from convoframe.sources import csv_source

HEADER = "id,CreateTime,is_sender,talker,room_name,type_name,msg,src\n"


def write(root, name, text, encoding="utf-8"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


def paths(spark, root):
    return [f.path for f in csv_source.listed(spark, f"{root}/*/*.csv")]


def test_rows_of_any_header(spark, tmp_path):
    write(tmp_path, "a b+ü/x 1.csv", "﻿id, msg ,\n1,\"say \"\"hi\"\",\nthere\",z\n\n2,,\n3,short\n4,a,b,c\n")
    write(tmp_path, "c/y.csv", "msg,id,id\nm,7,8\n")
    write(tmp_path, "c/empty.csv", "")
    write(tmp_path, "c/head.csv", "id,msg\n")
    write(tmp_path, "c/open.csv", 'id,msg\n1,ok\n2,"never closed\n3,x\n')
    rows = csv_source.read_rows(spark, paths(spark, tmp_path))
    got = {(r["contact_folder"], r["source_file"].rsplit("/", 1)[1], r["file_row"]): (r["fields"], r["problem"]) for r in rows.collect()}
    assert got == {
        ("a b+ü", "x 1.csv", 0): ({"id": "1", "msg": 'say "hi",\nthere', "_c2": "z"}, None),
        ("a b+ü", "x 1.csv", 1): ({"id": "2", "msg": None, "_c2": None}, None),
        ("a b+ü", "x 1.csv", 2): ({"id": "3", "msg": "short", "_c2": None}, None),
        ("a b+ü", "x 1.csv", 3): ({"id": "4", "msg": "a", "_c2": "b"}, "more values than names"),
        ("c", "y.csv", 0): ({"msg": "m", "id": "7"}, None),
        ("c", "open.csv", 0): ({"id": "1", "msg": "ok"}, None),
        ("c", "open.csv", 1): ({"id": "2", "msg": "never closed\n3,x\n"}, "open quotes"),
    }
    assert {(r["file_row"], r["problem"]) for r in csv_source.rejected_rows(rows).collect()} == {(3, "more values than names"), (1, "open quotes")}
    assert csv_source.read_rows(spark, []).collect() == []


def test_one_plan_for_many_spellings(spark, tmp_path):
    for i in range(12):
        names = ["id", "CreateTime", "is_sender", "talker", "msg", f"other{i}"]
        write(tmp_path, f"c/{i}.csv", ",".join(names[i % 5 :] + names[: i % 5]) + "\n" + ",".join((["1", "2024-01-01 00:00:00", "0", "t", "m", "o"])[i % 5 :] + (["1", "2024-01-01 00:00:00", "0", "t", "m", "o"])[: i % 5]) + "\n")
    rows = csv_source.raw_messages(spark, paths(spark, tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Scan binaryFile", plan)) == 1 and "Union" not in plan
    assert {(r["id"], r["talker"], r["msg"]) for r in rows.collect()} == {("1", "t", "m")} and rows.count() == 12


@pytest.mark.parametrize("folder", ["plain", "with space+ü"])
def test_a_changed_file_replaces_what_it_gave(spark, tmp_path, folder):
    line = lambda i, s, who, msg: f"{i},2024-03-01 10:00:{s:02d},{int(who == 'wxid_me')},{who},,文本,{msg},\n"
    o = Options(data_dir=str(tmp_path / "data"), output_dir=str(tmp_path / "out"), my_id="wxid_me")
    write(tmp_path / "data", f"{folder}/m.csv", HEADER + line(1, 0, "a", "hi") + line(2, 5, "wxid_me", "yes"))
    assert [r["output"] for r in stages.stage1(spark, o).samples.collect()] == ["yes"]
    write(tmp_path / "data", f"{folder}/m.csv", HEADER + line(1, 0, "a", "hi") + line(2, 5, "wxid_me", "yes now") + line(3, 50, "a", "more"))
    done = stages.stage1(spark, o)
    assert done.new_files == 1 and [r["output"] for r in done.samples.collect()] == ["yes now"] and done.messages.count() == 3


def test_a_run_that_dies_before_its_commit_reads_its_files_again(spark, tmp_path, monkeypatch):
    o = Options(data_dir=str(tmp_path / "data"), output_dir=str(tmp_path / "out"), my_id="wxid_me")
    write(tmp_path / "data", "c/m.csv", HEADER + "1,2024-03-01 10:00:00,0,a,,文本,hi,\n2,2024-03-01 10:00:09,1,wxid_me,,文本,yes,\n")
    with monkeypatch.context() as patch:
        patch.setattr(stages.Incremental, "render", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            stages.stage1(spark, o)
    with monkeypatch.context() as patch:
        patch.setattr(stages.manifest, "record", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            stages.stage1(spark, o)
    done = stages.stage1(spark, o)
    assert done.new_files == 1 and done.messages.count() == 2 and done.samples.count() == 1
    assert stages.stage1(spark, o).new_files == 0
