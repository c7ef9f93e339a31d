import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import layout as L
from tallyloom.operators import quality as Q
from tallyloom.operators import raster as R

WORDS = "doc_id string, page_no int, text string, left int, top int, width int, height int, confidence double"


def test_clusters_follow_a_drifting_baseline(spark):
    rows = [("d", 1, t, x, y, 40, 20, 90.0) for t, x, y in (("a", 0, 100), ("b", 100, 104), ("c", 200, 108), ("d", 300, 112), ("e", 0, 140), ("f", 50, 141))] + [("d", 1, " ", 400, 100, 1, 1, 90.0), ("d", 1, "z", 400, 100, 1, 20, -1.0)]
    got = L.group_into_rows(spark.createDataFrame(rows, WORDS)).orderBy("line_no").collect()
    assert [r.text for r in got] == ["a b c d", "e f"] and got[0].bottom == 132


def test_bands_and_cells(spark):
    rules = spark.createDataFrame([("d", 1, "row", p) for p in (0, 5, 40, 90)] + [("d", 1, "col", p) for p in (0, 100, 200)], "doc_id string, page_no int, axis string, pos int")
    words = spark.createDataFrame([("d", 1, "two", 10, 30, 20, 8, 90.0), ("d", 1, "one", 10, 10, 20, 8, 90.0), ("d", 1, "x", 150, 10, 20, 8, 90.0), ("d", 1, "out", 10, 200, 20, 8, 90.0)], WORDS)
    b = L.bands(rules)
    assert b.filter("axis = 'row'").count() == 2
    assert {(r.row, r.col): r.text for r in L.assign_cells(words, b).collect()} == {(0, 0): "one two", (0, 1): "x"}
    assert [r.text for r in L.rows_to_lines(words, b).collect()] == ["one x two"]


def test_overlay_replaces_by_place(spark):
    t = "doc_id string, page_no int, line_no int, text string, top int, bottom int, confidence double"
    rows = spark.createDataFrame([("d", 1, 0, "A 10.00 10.00", 0, 20, 50.0), ("d", 1, 1, "B 1.00", 30, 50, 50.0), ("d", 1, 2, "C 2.00 3.00", 60, 80, 50.0)], t)
    digits = spark.createDataFrame([("d", 1, 0, "10.00 18.00", 2, 20, 80.0), ("d", 1, 1, "7.00", 45, 65, 80.0)], t)
    assert [r.text for r in L.overlay(rows, digits).orderBy("line_no").collect()] == ["A 10.00 18.00", "B 1.00", "C 2.00 3.00"]


def test_column_roles(spark):
    cells = [("d", 1, r, c, t) for r in range(4) for c, t in enumerate(("01/02/2024", "SOME WORDS", f"{r}1234", "10.00", "1,234.00"))]
    got = L.column_roles(spark.createDataFrame(cells, "doc_id string, page_no int, row int, col int, text string")).first()
    assert (got.date, got.description, got.reference, got.money, got.usable) == (0, 1, 2, [3, 4], True)


def test_capture(spark):
    t = "doc_id string, page_no int, page_class string, has_image boolean, src_w int, src_h int, width_pt double, height_pt double, bits int, colorspace string, codec string"
    rows = [("a", 1, "SCANNED", True, 2550, 3300, 612.0, 792.0, 8, "DeviceGray", "x"), ("b", 1, "SCANNED", True, 1700, 2200, 612.0, 792.0, 8, "DeviceGray", "x"), ("c", 1, "SCANNED", True, 1650, 1275, 612.0, 792.0, 1, "DeviceGray", "x"), ("d", 1, "DIGITAL", False, None, None, None, None, None, None, None), ("e", 1, "SCANNED", False, None, None, None, None, None, None, None)]
    p = Q.inspect(spark.createDataFrame(rows, t))
    assert {r.doc_id: r.verdict for r in Q.verdicts(p).collect()} == {"a": "PASS", "b": "WARN", "c": "REJECT", "d": "PASS", "e": "WARN"}
    assert p.filter("doc_id = 'c'").first().dpi == 150.0


def test_raster():
    page = np.full((200, 300), 255, np.uint8)
    page[[20, 60, 100, 140]] = 0
    page[30:34, 40:60] = 0
    rows, _ = R.detect_grid(page)
    assert rows == [(20, 60), (60, 100), (100, 140)]
    bare = R.remove_rules(page)
    assert bare[20].min() == 255 and bare[31, 50] == 0
    assert R.contrast(page) == 1.0 and abs(R.measure_skew(page)) < 0.5
    shaded = np.tile(np.linspace(100, 220, 300), (200, 1)).astype(np.uint8)
    shaded[90:110, 140:160] -= 60
    out = R.sauvola(shaded)
    assert out[100, 150] == 0 and out[20, 20] == 255
    assert R.to_grey(np.zeros((4, 4, 3), np.uint8)).shape == (4, 4) and R.measure_skew(np.full((9, 9), 255, np.uint8)) is None
    tilted = np.full((300, 300), 255, np.uint8)
    for x in range(40, 260):
        y = int(150 + (x - 150) * np.tan(np.radians(3)))
        tilted[y - 2 : y + 2, x] = 0
    assert abs(R.measure_skew(tilted) - 3) < 0.7 and abs(R.measure_skew(R.deskew(tilted))) < 1


def test_measure(spark):
    page = np.full((40, 60), 255, np.uint8)
    page[20] = 0
    df = spark.createDataFrame([("d", 1, 40, 60, bytearray(page.tobytes()))], "doc_id string, page_no int, height int, width int, pixels binary")
    assert R.measure(df).select(F.round("contrast", 2)).first()[0] == 1.0
