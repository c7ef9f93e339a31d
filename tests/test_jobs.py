import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import jobs as J
from tallyloom.sources import scans, sinks
from tallyloom.streaming import queue as Q

T0 = datetime(2024, 1, 1)
ROWS = [("a", 1, T0, "QUEUED", "HEADER", None, None), ("a", 2, T0, "RUNNING", None, "w1", None), ("a", 3, T0, None, None, None, 5), ("b", 1, T0, "QUEUED", "HEADER", None, None), ("c", 1, T0, "REJECTED", None, None, None), ("b", 2, T0, "PARSED", None, None, None)]


@pytest.fixture
def events(spark):
    return spark.createDataFrame(ROWS, Q.EVENTS)


def test_latest_and_machine(events):
    got = {r.job_id: r for r in J.latest(events).collect()}
    assert (got["a"].state, got["a"].stage, got["a"].claimed_by, got["a"].progress_done) == ("RUNNING", "HEADER", "w1", 5)
    assert [(r.job_id, r.before, r.state) for r in J.illegal_moves(events).collect()] == [("b", "QUEUED", "PARSED")]


def test_claims_and_pages(events):
    latest = J.latest(events)
    assert J.claim(latest).count() == 0 and J.queue(latest, "RUNNING").count() == 1
    with pytest.raises(ValueError):
        J.queue(latest, limit=0)
    assert [r.job_id for r in J.requeue_events(events, F.lit(datetime(2024, 1, 2))).collect()] == ["a"]
    assert J.stale(events, F.lit(T0)).count() == 0


def test_stored_rows_are_replaced(spark, tmp_path):
    df = spark.createDataFrame([("j", 1, 0, "x"), ("j", 1, 1, "y"), ("k", 1, 0, "z")], "job_id string, page_no int, source_row int, narration string")
    sinks.replace_job_rows(sinks.job_rows(df, ["narration"]), str(tmp_path / "rows"))
    sinks.replace_job_rows(sinks.job_rows(df.filter("source_row = 1"), ["narration"]), str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted((r.job_id, r.idx, r.payload) for r in rows.collect()) == [("j", 0, '{"narration":"y"}'), ("k", 0, '{"narration":"z"}')]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"HELLO")
    words = scans.words_of_files(spark, str(tmp_path / "in"), lambda name, raw: [(1, raw.decode(), 0, 0, 10, 10, 99.0), (1, " ", 0, 0, 1, 1, 5.0), (1, "x", 0, 0, 1, 1, -1.0)])
    assert [r.text for r in words.collect()] == ["HELLO"]
    (tmp_path / "l.csv").write_text("narration,credit,debit,label,ledger,contra\nA,1.00,0.00,T1,L,false\n")
    assert scans.labelled_ledger(spark, str(tmp_path / "l.csv")).first().label == "T1"
    sinks.write_csv(spark.createDataFrame([("n",)], "narration string"), str(tmp_path / "out"))
    assert len(spark.read.csv(str(tmp_path / "out"), header=True).columns) == 19


def test_poll_once(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "e"))
    q = Q.poll(Q.events(spark, str(tmp_path / "e")), lambda df: df.select("job_id", F.lit("RUNNING").alias("state")), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    assert q.awaitTermination(60)
    assert {r.job_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "b"}


def test_stale_jobs_come_back(spark, events, tmp_path):
    events.write.parquet(str(tmp_path / "e"))
    out = Q.requeue_stale(Q.events(spark, str(tmp_path / "e")), seconds=1)
    q = out.writeStream.format("memory").queryName("again").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if q.exception():
                raise q.exception()
            if spark.table("again").count():
                break
        assert [tuple(r) for r in spark.table("again").collect()] == [("a", 4, "QUEUED")]
    finally:
        q.stop()
