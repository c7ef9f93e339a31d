from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallyloom import tables
from tallyloom.operators import jobs, layout, lines, quality, rules
from tallyloom.plans import statement
from tallyloom.sources import scans
from tallyloom.streaming import queue


def test_text_layer_and_polygons(spark):
    items = spark.createDataFrame([("d", 1, "w", 10.3, 5.2, 10.4, 9.9)], "doc_id string, page_no int, text string, x0 double, top double, x1 double, bottom double")
    assert tuple(scans.text_layer_words(items).first()) == ("d", 1, "w", 41, 20, 1, 18, 100.0)
    box = [[3.7, 9.1], [8.2, 9.0], [8.2, 12.9], [3.5, 12.0]]
    rows = [("d", 1, " a ", box, 0.5), ("d", 1, "  ", box, 0.9), ("d", 1, None, box, 0.9), ("d", 1, "b", [[0.0, 0.0]] * 4, 0.0)]
    got = scans.polygon_words(spark.createDataFrame(rows, "doc_id string, page_no int, text string, polygon array<array<double>>, confidence float")).collect()
    assert [tuple(r)[2:] for r in got] == [("a", 3, 9, 5, 3, 50.0), ("b", 0, 0, 1, 1, 0.0)]


def test_rasters_are_numbered(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"12")
    render = lambda name, content, dpi: [(f"{name}/page-{n:02d}.png", content) for n in range(1, dpi // 100)] + [(f"{name}/cover.png", b"")]
    pages = scans.rasters_of_files(spark, str(tmp_path), render, 400)
    assert sorted(r.page_no for r in pages.collect()) == [1, 2, 3] and scans.page_counts(pages).first().pages == 3


def test_numbers_of_a_region(spark):
    words = spark.createDataFrame([("d", 1, "Rs.", 10, 10, 10, 10, 90.0), ("d", 1, "1,2O0.00-", 30, 10, 10, 10, 90.0), ("d", 1, "out", 500, 10, 10, 10, 90.0)], scans.WORDS)
    region = spark.createDataFrame([("d", 1, "r", 0, 0, 100, 100)], "doc_id string, page_no int, region string, x0 int, y0 int, x1 int, y1 int")
    assert scans.region_text(words, region).first().text == "Rs. 1,2O0.00-" and scans.region_text(words, region, True).first().text == ". 1,20.00-"


def test_missing_columns(spark):
    old, new = spark.range(1), spark.range(1).withColumn("more", F.lit("x"))
    assert scans.missing_columns(old, new) == [("more", "string")] and scans.missing_columns(new, old) == []


def test_movements_must_be_one_to_one(spark):
    rows = spark.createDataFrame([("d", 0, 1), ("d", 1, 2)], "doc_id string, source_row int, x int")
    classes = spark.createDataFrame([("d", 0, "A"), ("d", 1, "B")], "doc_id string, source_row int, category string")
    assert [r.category for r in rules.movements(rows, classes).orderBy("source_row").collect()] == ["A", "B"]
    for a, b in ((rows.filter("x = 1"), classes), (rows, classes.filter("category = 'A'"))):
        with pytest.raises(Exception, match="differ in number"):
            rules.movements(a, b).collect()


def test_packs_from_tables(spark):
    own = [rules.Rule("mine", "C", ("wobble",), "DEBIT")]
    table = rules.pack_frame(spark, own)
    assert rules.pack_from(table) == rules.checked(own) and len(rules.pack_from(rules.pack_frame(spark))) == 76
    rows = spark.createDataFrame([("WOBBLE FEE", D("0.00"), D("1.00"))], "narration string, credit decimal(18,2), debit decimal(18,2)")
    assert rules.classify(rows, rules.pack_from(table)).first().rule_id == "mine"
    with pytest.raises(ValueError):
        rules.pack_from(rules.pack_frame(spark), most=10)
    with pytest.raises(ValueError):
        rules.pack_from(table.unionByName(table))


def test_layouts_are_registered_once(monkeypatch):
    monkeypatch.setattr(lines, "PROFILES", list(lines.PROFILES))
    lines.register(lines.Profile("mine", traps=[(lines.HEADER, "own bank", "HEADER")]))
    assert lines.profile("mine").key == "mine"
    with pytest.raises(ValueError):
        lines.register(lines.Profile("mine"))


def test_routed_pages_take_their_own_reader(spark):
    text = "01/01/2020  {}  1.00  2.00 Cr"
    of = lambda who: spark.createDataFrame([("d", p, 1, text.format(f"{who}{p}"), 80.0) for p in (1, 2, 3)], "doc_id string, page_no int, line_no int, text string, confidence double")
    classes = spark.createDataFrame([("d", 1, "SCANNED"), ("d", 2, "DIGITAL"), ("d", 3, "SCANNED"), ("d", 4, "DIGITAL")], "doc_id string, page_no int, page_class string")
    parsed = statement.route(of("LAYER "), of("READ "), classes)
    assert [(r.narration, r.source_row) for r in parsed.rows.orderBy("page_no").collect()] == [("READ 1", 0), ("LAYER 2", 1), ("READ 3", 2)]
    assert [(r.page_class, r.lines) for r in parsed.pages.orderBy("page_no").collect()] == [("SCANNED", 1), ("DIGITAL", 1), ("SCANNED", 1), ("DIGITAL", 0)]


def test_intake_and_overrides(spark):
    uploads = spark.createDataFrame([(1, "a.pdf"), (2, "B.PDF"), (3, "c.txt"), (4, None), (5, "e.pdf")], "job_id int, filename string")
    graded = spark.createDataFrame([(1, "PASS", "ok"), (2, "REJECT", "bad"), (3, "PASS", "ok")], "job_id int, verdict string, summary string")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    got = {r.job_id: (r.status, r.state, r.stage) for r in jobs.intake(uploads, graded, now).collect()}
    assert got == {1: (201, "QUEUED", "HEADER"), 2: (201, "REJECTED", None), 3: (415, None, None), 4: (415, None, None), 5: (422, None, None)}
    assert {r.job_id: r.state for r in jobs.intake(uploads, graded, now, blocks=False).collect()}[2] == "QUEUED"
    states = spark.createDataFrame([(1, "PARSED"), (2, "REJECTED")], "job_id int, state string")
    asked = spark.createDataFrame([(1, "PARTNER", "looked at it"), (2, "ARTICLE_CLERK", "looked at it"), (2, "PARTNER", " short ")], "job_id int, role string, reason string")
    entries = jobs.override_entries(states, asked, now)
    assert [(r.job_id, r.detail) for r in entries.collect()] == [(1, "state=PARSED")]
    assert {r.job_id: r.overridden for r in jobs.with_overridden(states, entries).collect()} == {1: True, 2: False}
    assert jobs.lookup(states, 9).count() == 0 and jobs.view(states).columns == list(jobs.SUMMARY)


def test_progress_is_best_effort():
    class Event:
        class progress:
            batchId, numInputRows = 3, 7

    told = []
    ok, bad = queue.Progress(lambda *x: told.append(x)), queue.Progress(lambda *x: 1 / 0)
    ok.onQueryProgress(Event), bad.onQueryProgress(Event)
    assert told == [(3, 7)] and bad.failed == 1


def test_names_and_empty_reports(spark):
    df = spark.createDataFrame([(None,), ([None, "", "ICCBased", "x"],), ([],)], "v array<string>")
    assert [r.n for r in df.select(quality.flat_name(F.col("v")).alias("n")).collect()] == [None, "ICCBased", None]


def test_tables_need_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError):
        tables.shared_dir(Session())
