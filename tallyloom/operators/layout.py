"""Positioned words to lines: clustering, bands, cells, columns.

Words have doc_id, page_no, text, left, top, width, height, confidence. Bands are joined by page, as arrays. Clustering
follows a running mean and is a fold over the page's words, as a JVM ``aggregate``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let, record
from ..functions.money import TOKEN
from .lines import DATE

PAGE = ("doc_id", "page_no")


def shaped(words: DataFrame) -> DataFrame:
    """Words without blank or unread ones, with centre, right and bottom."""
    ok = words.filter((F.col("confidence") != -1) & (F.trim("text") != ""))
    return ok.withColumn("centre", F.col("top") + F.col("height") / 2).withColumn("right", F.col("left") + F.col("width")).withColumn("bottom", F.col("top") + F.col("height"))


def row_pitch(words: DataFrame) -> DataFrame:
    """The median height of a page's words."""
    return words.groupBy(*PAGE).agg(F.coalesce(F.median("height"), F.lit(0.0)).alias("pitch"))


def _line(ws: Column) -> Column:
    """A line from words in their order."""
    n = F.size(ws)
    return record(
        text=F.array_join(F.transform(ws, lambda w: w["text"]), " "), top=F.array_min(F.transform(ws, lambda w: w["top"])), bottom=F.array_max(F.transform(ws, lambda w: w["bottom"])), left=F.array_min(F.transform(ws, lambda w: w["left"])),
        right=F.array_max(F.transform(ws, lambda w: w["right"])), confidence=F.aggregate(ws, F.lit(0.0), lambda a, w: a + w["confidence"].cast("double")) / n, word_confidences=F.transform(ws, lambda w: w["confidence"].cast("double")),
    )


def _word() -> Column:
    return F.struct("centre", "left", "text", "top", "bottom", "right", "height", "confidence")


def group_into_rows(words: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Lines of words: a word joins the line while its centre is within ``tolerance`` of the median height of the line's
    mean centre so far."""
    packed = shaped(words).groupBy(*PAGE).agg(F.sort_array(F.collect_list(_word())).alias("ws"), F.median("height").alias("pitch"))
    room = F.when(F.col("pitch") == 0, 1.0).otherwise(F.col("pitch")) * tolerance

    def step(s: Column, w: Column) -> Column:
        near = (F.size(s["line"]) > 0) & (F.abs(w["centre"] - s["total"] / F.size(s["line"])) <= room)
        joined = record(done=s["done"], line=F.concat(s["line"], F.array(w)), total=s["total"] + w["centre"])
        opened = record(done=F.when(F.size(s["line"]) > 0, F.concat(s["done"], F.array(s["line"]))).otherwise(s["done"]), line=F.array(w), total=w["centre"].cast("double"))
        return F.when(near, joined).otherwise(opened)

    none = F.filter("ws", lambda w: F.lit(False))
    start = record(done=F.filter(F.array(none), lambda x: F.lit(False)), line=none, total=F.lit(0.0))
    rows = F.aggregate("ws", start, step, lambda s: F.concat(s["done"], F.array(s["line"])))
    across = lambda ws: F.array_sort(F.transform(ws, lambda w: F.struct(w["left"].alias("x"), w["centre"].alias("y"), w.alias("w"))))
    lines = F.transform(rows, lambda ws: _line(F.transform(across(ws), lambda x: x["w"])))
    return packed.select(*PAGE, F.posexplode(lines).alias("line_no", "l")).select(*PAGE, "line_no", "l.*")


def peaks(hits: DataFrame, gap: int = 4) -> DataFrame:
    """Positions (doc_id, page_no, axis, pos) collapsed: runs whose neighbours are at most ``gap`` apart become their mean."""
    w = Window.partitionBy(*PAGE, "axis").orderBy("pos")
    fresh = F.coalesce((F.col("pos") - F.lag("pos").over(w) > gap).cast("int"), F.lit(1))
    runs = hits.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(w))
    return runs.groupBy(*PAGE, "axis", "__run").agg(F.floor(F.avg("pos")).cast("int").alias("pos")).drop("__run")


def bands(rules: DataFrame, least: dict[str, int] | None = None) -> DataFrame:
    """Bands between consecutive rules of an axis (row, col), of more than the axis's least size: band, start, end."""
    least = least or {"row": 8, "col": 15}
    w = Window.partitionBy(*PAGE, "axis").orderBy("pos")
    size = F.element_at(F.create_map(*[F.lit(x) for kv in least.items() for x in kv]), F.col("axis"))
    pairs = rules.withColumn("end", F.lead("pos").over(w)).filter(F.col("end") - F.col("pos") > size)
    return pairs.select(*PAGE, "axis", (F.row_number().over(w) - 1).alias("band"), F.col("pos").alias("start"), "end")


def _in_band(words: DataFrame, found: DataFrame, position: Column, name: str) -> DataFrame:
    """Words with the first band that holds the position; others go. A page's bands are joined as one array, so words are
    neither multiplied nor grouped."""
    b = found.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("band", "start", "end"))).alias("__bands"))
    keyed = words.withColumn("__p", position).join(b, list(PAGE))
    first = F.try_element_at(F.filter("__bands", lambda x: (F.col("__p") >= x["start"]) & (F.col("__p") < x["end"])), F.lit(1))
    return keyed.withColumn(name, first["band"]).filter(F.col(name).isNotNull()).drop("__p", "__bands")


def rows_to_lines(words: DataFrame, found: DataFrame) -> DataFrame:
    """A line for each row band, however many printed lines it holds; words run by printed line, then left to right."""
    placed = _in_band(shaped(words), found.filter("axis = 'row'"), F.col("centre"), "band")
    packed = placed.groupBy(*PAGE, "band").agg(F.collect_list(_word()).alias("ws"), F.greatest(F.median("height"), F.lit(1.0)).alias("pitch"))
    ordered = F.array_sort(F.transform("ws", lambda w: F.struct(F.bround(w["centre"] / F.col("pitch"), 0).alias("y"), w["left"].alias("x"), w.alias("w"))))
    lines = packed.withColumn("l", _line(F.transform(ordered, lambda x: x["w"])))
    b = found.filter("axis = 'row'").select(*PAGE, "band", "start", "end")
    out = lines.join(b, [*PAGE, "band"])
    return out.select(*PAGE, F.col("band").alias("line_no"), "l.text", F.col("start").alias("top"), F.col("end").alias("bottom"), "l.left", "l.right", "l.confidence", "l.word_confidences")


def assign_cells(words: DataFrame, found: DataFrame) -> DataFrame:
    """The text of each cell that has words: row, col, text; words run by top, then left."""
    w = shaped(words)
    placed = _in_band(_in_band(w, found.filter("axis = 'row'"), F.col("centre"), "row"), found.filter("axis = 'col'"), F.col("left") + F.col("width") / 2, "col")
    return placed.groupBy(*PAGE, "row", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("top", "left", "text"))), lambda x: x["text"]), " ").alias("text"))


def column_roles(cells: DataFrame) -> DataFrame:
    """Per page, what its columns hold, judged by their cells: date, value_date, money, description, reference."""
    filled = cells.filter(F.trim("text") != "")
    per = filled.groupBy(*PAGE, "col").agg(F.count_if(F.col("text").rlike(DATE)).alias("dates"), F.count_if(F.col("text").rlike(TOKEN)).alias("figures"), F.sum(F.length(F.regexp_replace("text", r"[^\p{L}]", ""))).alias("alpha"), F.sum(F.length(F.regexp_replace("text", r"\D", ""))).alias("digits"))
    date, figure = F.col("dates") >= 3, (F.col("dates") < 3) & (F.col("figures") >= 3)
    agg = per.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.when(date, F.col("col")))).alias("d"), F.array_sort(F.collect_list(F.when(figure, F.col("col")))).alias("money"), F.collect_list(F.when(~date & ~figure, F.struct("col", "alpha", "digits"))).alias("rest"))
    most = lambda items, key: F.array_max(F.transform(items, lambda x: F.struct(x[key].alias("n"), (-x["col"]).alias("first"), x["col"].alias("col"))))["col"]
    out = agg.withColumn("description", most(F.col("rest"), "alpha")).withColumn("reference", most(F.filter("rest", lambda x: x["col"] != F.col("description")), "digits"))
    return out.select(*PAGE, F.try_element_at("d", F.lit(1)).alias("date"), F.try_element_at("d", F.lit(2)).alias("value_date"), "money", "description", "reference", ((F.size("d") > 0) & (F.size("money") >= 2)).alias("usable"))


def numeric_band(lines: DataFrame, pages: DataFrame, pad: int = 24) -> DataFrame:
    """Per page with at least five lines with figures, the span in which these stand: band_left, band_right."""
    has = lines.filter(F.col("text").rlike(TOKEN)).select(*PAGE, (F.col("left") + F.floor((F.col("right") - F.col("left")) * 0.45)).alias("l"), F.col("right").alias("r"))
    agg = has.groupBy(*PAGE).agg(F.count("*").alias("n"), F.percentile("l", 0.2).alias("l"), F.percentile("r", 0.9).alias("r")).filter("n >= 5")
    out = agg.join(pages.select(*PAGE, "page_width"), list(PAGE))
    out = out.select(*PAGE, F.greatest(F.lit(0), F.floor("l") - pad).cast("int").alias("band_left"), F.least(F.col("page_width"), F.floor("r") + pad).cast("int").alias("band_right"))
    return out.filter("band_right - band_left >= 50")


def overlay(rows: DataFrame, numeric: DataFrame) -> DataFrame:
    """Lines with their figures taken from the digits-only line that overlaps them most (half their height at least), where
    both have as many; figures are replaced at their own places. ``numeric``: lines in the page's coordinates."""
    n = numeric.select(*PAGE, F.col("line_no").alias("__no"), F.col("text").alias("__text"), F.col("top").alias("__top"), F.col("bottom").alias("__bottom"), F.col("confidence").alias("__conf"))
    keyed = rows.withColumn("__row", F.struct(*rows.columns))
    shared = F.least("bottom", "__bottom") - F.greatest("top", "__top")
    pairs = keyed.join(n, list(PAGE), "left").withColumn("__over", shared)
    best = pairs.groupBy(*PAGE, "__row").agg(F.max_by(F.struct("__text", "__conf", "__over"), F.when(F.col("__over") > 0, F.struct("__over", (-F.col("__no")).alias("o")))).alias("b"))
    old = F.regexp_extract_all(F.col("__row.text"), F.lit(TOKEN), F.lit(0))
    new = F.regexp_extract_all(F.col("b.__text"), F.lit(TOKEN), F.lit(0))
    fits = F.coalesce((F.col("b.__over") >= (F.col("__row.bottom") - F.col("__row.top")) * 0.5) & (F.size(new) > 0) & (F.size(new) == F.size(old)), F.lit(False))
    pieces = F.split(F.regexp_replace(F.col("__row.text"), TOKEN, "\x01"), "\x01")
    text = let(pieces, lambda ps: F.array_join(F.transform(F.arrays_zip(ps.alias("p"), F.concat(new, F.array(F.lit(""))).alias("n")), lambda x: F.concat(x["p"], x["n"])), ""))
    changed = {"text": F.when(fits, text).otherwise(F.col("__row.text")), "confidence": F.when(fits, F.greatest("__row.confidence", "b.__conf")).otherwise(F.col("__row.confidence"))}
    return best.select(*[changed.get(c, F.col(f"__row.`{c}`")).alias(c) for c in rows.columns])


def page_lines(words: DataFrame, found: DataFrame, pages: DataFrame, numeric: DataFrame | None = None) -> DataFrame:
    """Lines of scanned pages: by row bands on pages that have them, else from the words' places; then figures that a second,
    digits-only reading of the money columns (``numeric``: words of the bands) has better. ``pages``: page_width."""
    ruled = found.filter("axis = 'row'").select(*PAGE).distinct()
    by_band = rows_to_lines(words.join(ruled, list(PAGE), "left_semi"), found)
    free = group_into_rows(words.join(ruled, list(PAGE), "left_anti"))
    lines = by_band.unionByName(free.select(*by_band.columns))
    if numeric is None:
        return lines
    bands_ = numeric_band(lines, pages)
    inside = numeric.join(bands_, list(PAGE)).filter("left >= band_left AND left < band_right").select(*numeric.columns)
    return overlay(lines.drop("word_confidences"), group_into_rows(inside))
