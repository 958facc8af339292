import random

from convoframe.operators import rounds as R
from convoframe.streaming.live import live_rounds, message_stream, rounds_out_of_order, talker_counts


def test_live_rounds_equal_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, t = [], 1_700_000_000_000_000
    for i in range(300):
        t += rng.choice((1, 30, 90, 91, 300, 301)) * 1_000_000
        who = rng.choice("mmabc")
        rows.append(("o", t, i, 1 if who == "m" else 0, who))
    schema = "owner string, t long, ix long, is_sender int, talker string"
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : k * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_rounds(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.round_id, r.other_first_ix, r.other_last_ix, r.other_n) for r in spark.table("live").collect()}
    batch = spark.createDataFrame(rows, schema).selectExpr("t", "ix", "is_sender", "talker", "is_sender = 1 as mine")
    expected = {(r.round_id, r.other_first_ix, r.other_last_ix, r.other_n) for r in R.extract_rounds(R.with_runs(batch)).collect()}
    assert got == expected and got


def test_message_stream(spark, tmp_path):
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / "x.csv").write_text("id,CreateTime,is_sender,talker,room_name,type_name,msg,src\n1,2024-03-01 10:00:00,0,t,,文本,hi,\n2,2024-03-01 12:30:00,0,t,,文本,hi,\n", encoding="utf-8")
    counts = talker_counts(message_stream(spark, str(tmp_path / "*")))
    q = counts.writeStream.format("memory").queryName("counts").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.messages for r in spark.table("counts").collect()) == 2


def test_shuffled_arrivals_give_the_batch_rounds(spark, tmp_path, monkeypatch):
    import datetime as dt

    rng = random.Random(11)
    start, rows, t = dt.datetime(2024, 3, 1), [], 0
    for i in range(400):
        t += rng.choice((0, 1, 30, 90, 91, 300, 301))
        who = rng.choice("mmabc")
        rows.append(("o" if i % 3 else "p", start + dt.timedelta(seconds=t), "f", i, 1 if who == "m" else 0, who))
    # Each message comes up to 40 minutes late, and one of a third owner moves the watermark on.
    arrivals = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(2400)))
    arrivals.append(("clock", start + dt.timedelta(days=9), "f", 0, 0, "z"))
    late = ("o", start, "f", 9999, 1, "m")  # far too late: left out
    schema = "owner string, create_time timestamp_ntz, source_file string, file_row long, is_sender int, talker string"
    for k in range(5):
        part = arrivals[k * 90 : k * 90 + 90] + ([late] if k == 4 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rounds = rounds_out_of_order(stream, late="1 hour")
        q = rounds.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(store, before)
    got = {tuple(r) for r in spark.read.schema(rounds.schema).parquet(str(tmp_path / "out")).select("owner", "round_id", "talker", "other_first_ix", "other_last_ix", "other_n").collect()}
    expected = set()
    for owner in "op":
        kept = spark.createDataFrame([r for r in rows if r[0] == owner], schema)
        expected |= {(owner, r.round_id, r.talker, r.other_first_ix, r.other_last_ix, r.other_n) for r in R.extract_rounds(R.with_runs(R.numbered(kept))).collect()}
    assert got == expected and len(got) > 20


def test_ingest_keeps_rounds_and_samples_up_to_date(spark, tmp_path):
    from convoframe.plans.incremental import Incremental
    from convoframe.plans.stages import CONTACTS
    from convoframe.sources.snapshots import Store
    from convoframe.streaming.live import ingest

    head = "id,CreateTime,is_sender,talker,room_name,type_name,msg,src\n"
    (tmp_path / "data" / "a").mkdir(parents=True)
    kept = Incremental(Store(spark, str(tmp_path / "store")))
    contacts = lambda: spark.createDataFrame([], CONTACTS)

    def run():
        q = ingest(message_stream(spark, str(tmp_path / "data" / "*")), kept, contacts, str(tmp_path / "c"))
        q.processAllAvailable()
        q.stop()

    (tmp_path / "data" / "a" / "1.csv").write_text(head + "1,2024-03-01 10:00:00,0,t,,文本,hi,\n2,2024-03-01 10:00:00,0,t,,文本,there,\n", encoding="utf-8")
    run()
    assert kept.rounds().count() == 0
    (tmp_path / "data" / "a" / "2.csv").write_text(head + "3,2024-03-01 10:01:00,1,me,,文本,yes,\n", encoding="utf-8")
    run()
    assert [(r["output"], "hi<return>there" in r["input"]) for r in kept.samples().collect()] == [("yes", True)]
    # The last batch again: the same.
    version = kept.store.current().version
    batch = kept.timeline().filter("content = 'yes'")
    kept.update(batch, contacts(), [r["source_file"] for r in batch.select("source_file").distinct().collect()])
    assert kept.store.current().version == version + 1 and kept.timeline().count() == 3 and kept.samples().count() == 1
