"""Capture quality of scanned pages: resolution, findings, verdicts.

Pages have doc_id, page_no, page_class and, of their largest image, src_w, src_h, width_pt, height_pt, bits, colorspace,
codec; a scanned page without an image has no src_w and has_image false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let, record

# Dots per inch, and limits of skew (degrees), contrast, and pages that are sampled or listed.
FLOOR, TARGET, SKEW, CONTRAST, SAMPLED, LISTED = 200, 300, 1.5, 0.35, 3, 6
VERDICTS = ("PASS", "WARN", "REJECT")


def largest_image(images: DataFrame) -> DataFrame:
    """The image with the most pixels of each page (doc_id, page_no, src_w, src_h and more)."""
    rest = [c for c in images.columns if c not in ("doc_id", "page_no")]
    area = F.coalesce(F.col("src_w").cast("long") * F.col("src_h"), F.lit(0))
    return images.groupBy("doc_id", "page_no").agg(F.max_by(F.struct(*rest), area).alias("x")).select("doc_id", "page_no", *[F.col(f"x.{c}") for c in rest])


def effective_dpi(src_w: Column, src_h: Column, width_pt: Column, height_pt: Column) -> Column:
    """dpi_x and dpi_y of a placed image: a turned page swaps the axes, so the pairing whose axes agree best is taken."""

    def pairing(across: Column, down: Column, order: int) -> Column:
        x, y = across / (width_pt / 72.0), down / (height_pt / 72.0)
        return record(apart=F.abs(x - y) / F.greatest(x, y), order=F.lit(order), x=x, y=y)

    known = (src_w > 0) & (src_h > 0) & (width_pt > 0) & (height_pt > 0)
    best = let(F.array_min(F.array(pairing(src_w, src_h, 0), pairing(src_h, src_w, 1))), lambda b: record(dpi_x=F.bround(b["x"], 1), dpi_y=F.bround(b["y"], 1)))
    return F.when(known, best)


def _finding(when: Column, code: str, verdict: str, detail: Column | str) -> Column:
    return F.when(when, record(code=F.lit(code), rank=F.lit(VERDICTS.index(verdict)), detail=F.lit(detail) if isinstance(detail, str) else detail))


def inspect(pages: DataFrame) -> DataFrame:
    """Pages with dpi_x, dpi_y, dpi (the smaller), findings and rank (0 pass, 1 warn, 2 reject). Digital pages always pass."""
    out = pages.withColumn("__d", effective_dpi(F.col("src_w"), F.col("src_h"), F.col("width_pt"), F.col("height_pt")))
    out = out.withColumn("dpi_x", F.col("__d.dpi_x")).withColumn("dpi_y", F.col("__d.dpi_y")).withColumn("dpi", F.least("dpi_x", "dpi_y")).drop("__d")
    scanned, image = F.col("page_class") == "SCANNED", F.coalesce(F.col("has_image"), F.lit(False))
    colour = F.upper(F.coalesce("colorspace", F.lit("")))
    lossy = F.when(F.upper(F.coalesce("codec", F.lit(""))).startswith("DCT"), ", JPEG-compressed").otherwise("")
    shown = F.format_string("%.0f", F.bround("dpi", 0))
    # Codes of findings.
    found = F.array_compact(F.array(
        _finding(scanned & ~image, "NO_IMAGE", "WARN", "page has neither a text layer nor a scanned image"),
        _finding(scanned & image & (F.col("bits") == 1), "BILEVEL", "REJECT", "captured as 1-bit black-and-white"),
        _finding(scanned & image & F.col("dpi").isNull(), "NO_DPI", "WARN", "resolution could not be determined from the page structure"),
        _finding(scanned & image & (F.col("dpi") < FLOOR), "LOW_DPI", "REJECT", F.concat(F.lit("scanned at "), shown, F.lit(f" DPI, below the {FLOOR} DPI floor"))),
        _finding(scanned & image & (F.col("dpi") >= FLOOR) & (F.col("dpi") < TARGET), "MARGINAL_DPI", "WARN", F.concat(F.lit("scanned at "), shown, F.lit(f" DPI, under the {TARGET} DPI target"))),
        _finding(scanned & image & (F.col("bits") > 1) & (colour != "") & ~colour.contains("GRAY"), "COLOUR_SCAN", "WARN", F.concat(F.lit("captured in colour ("), F.col("colorspace"), F.lit(")"), lossy)),
    ))
    return out.withColumn("findings", found).withColumn("rank", F.coalesce(F.array_max(F.transform("findings", lambda f: f["rank"])), F.lit(0)))


def measured(pages: DataFrame) -> DataFrame:
    """Inspected pages with measured skew and contrast: two more findings where they are off."""
    more = F.array_compact(F.array(
        _finding(F.abs("skew") > SKEW, "SKEWED", "WARN", F.concat(F.lit("the page sits "), F.format_string("%+.1f", "skew"), F.lit(" degrees off square"))),
        _finding(F.col("contrast") < CONTRAST, "LOW_CONTRAST", "WARN", F.concat(F.lit("ink and paper are only "), F.format_string("%.2f", "contrast"), F.lit(" apart on a 0-1 scale"))),
    ))
    out = pages.withColumn("findings", F.concat("findings", more))
    return out.withColumn("rank", F.coalesce(F.array_max(F.transform("findings", lambda f: f["rank"])), F.lit(0)))


def verdicts(pages: DataFrame) -> DataFrame:
    """Per document: the worst verdict, the median resolution of scanned pages, whether it is mixed, and one line to show."""
    dpi = F.when(F.col("page_class") == "SCANNED", F.col("dpi"))
    codes = F.array_distinct(F.flatten(F.collect_list(F.transform("findings", lambda f: f["code"]))))
    agg = pages.groupBy("doc_id").agg(F.max("rank").alias("rank"), F.median(dpi).alias("dpi"), (F.count_distinct("page_class") > 1).alias("mixed"), codes.alias("codes"))
    verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.col("rank") + 1)
    has = lambda c: F.array_contains("codes", c)
    shown = F.coalesce(F.concat(F.format_string("%.0f", F.bround("dpi", 0)), F.lit(" DPI")), F.lit("too low a resolution"))
    # The lines that a queue shows.
    line = (
        F.when(F.col("rank") == 0, "Capture quality is good enough to process.")
        .when(has("BILEVEL"), "Scanned in black-and-white. Rescan in greyscale at 300 DPI.")
        .when(has("LOW_DPI"), F.concat(F.lit("Scanned at "), shown, F.lit(". Rescan at 300 DPI greyscale.")))
        .when(has("MARGINAL_DPI"), "Below the 300 DPI target — expect more rows to need checking.")
        .otherwise("Capture quality is usable but flawed; see the findings.")
    )
    return agg.select("doc_id", verdict.alias("verdict"), "dpi", "mixed", line.alias("summary"))


def findings_by_code(pages: DataFrame) -> DataFrame:
    """Per document and code, in the order of first appearance: the first finding, its first pages and how many more."""
    each = pages.select("doc_id", "page_no", F.posexplode("findings").alias("place", "f"))
    agg = each.groupBy("doc_id", F.col("f.code").alias("code")).agg(F.min(F.struct("page_no", "place", F.col("f.detail").alias("detail"))).alias("first"), F.array_sort(F.collect_list("page_no")).alias("all"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first.page_no", "first.place"))
    return agg.select("doc_id", place.alias("ord"), "code", F.col("first.detail").alias("detail"), F.slice("all", 1, LISTED).alias("pages"), F.greatest(F.size("all") - LISTED, F.lit(0)).alias("more"))


def sample_pages(pages: DataFrame, limit: int = SAMPLED) -> DataFrame:
    """At most ``limit`` scanned pages of each document, evenly spread from the first to the last."""
    w = Window.partitionBy("doc_id")
    seen = pages.filter("page_class = 'SCANNED'").select("doc_id", "page_no", (F.row_number().over(w.orderBy("page_no")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.bround(i * (F.col("n") - 1) / F.lit(float(max(1, limit - 1))), 0).cast("int"))
    return seen.filter((F.col("n") <= limit) | F.array_contains(spread, F.col("k"))).select("doc_id", "page_no")


def flat_name(value: Column) -> Column:
    """The first name of a wrapped one (an array of strings); null if there is none."""
    return F.try_element_at(F.filter(value, lambda v: v.isNotNull() & (v != "")), F.lit(1))


def distinct_findings(pages: DataFrame) -> DataFrame:
    """Per document, one finding of each code: in the order of first appearance, as it last appeared."""
    each = pages.select("doc_id", "page_no", F.posexplode("findings").alias("place", "f"))
    at = F.struct("page_no", "place")
    agg = each.groupBy("doc_id", F.col("f.code").alias("code")).agg(F.min(at).alias("first"), F.max_by("f", at).alias("f"))
    verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.col("f.rank") + 1)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("first.page_no", "first.place"))
    return agg.select("doc_id", place.alias("ord"), "code", verdict.alias("verdict"), F.col("f.detail").alias("detail"))


def render(pages: DataFrame) -> DataFrame:
    """Per document, the grading of its capture as printed lines."""
    scanned = F.count_if(F.col("page_class") == "SCANNED")
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"), scanned.alias("scanned"))
    shown = F.concat(F.array_join(F.col("pages").cast("array<string>"), ", "), F.when(F.col("more") > 0, F.format_string(", ... (+%d more)", "more")).otherwise(""))
    rank = pages.select(F.explode("findings").alias("f")).select("f.code", "f.rank").distinct()
    name = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.col("rank") + 1)
    by_code = findings_by_code(pages).join(F.broadcast(rank), "code")  # a handful of codes
    block = F.array(F.concat(F.lit("  ["), name, F.lit("] "), F.col("code"), F.lit("  pages "), shown), F.concat(F.lit(" " * 8), F.col("detail")))
    blocks = by_code.groupBy("doc_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))), lambda x: x["b"])).alias("blocks"))
    out = verdicts(pages).join(counts, "doc_id").join(blocks, "doc_id", "left")
    label = lambda text, value: F.concat(F.lit(f"{text:<22}"), value)
    digital = F.col("n") - F.col("scanned")
    resolution = F.when(F.col("dpi").isNotNull(), label("  effective DPI", F.concat(F.format_string("%.0f", F.bround("dpi", 0)), F.lit(" (median over scanned pages)"))))
    resolution = resolution.when(F.col("scanned") == 0, label("  effective DPI", F.lit("n/a - a text layer, nothing was scanned")))
    body = F.array_compact(F.concat(
        F.array(
            F.concat(F.lit("Quality gate - "), F.col("doc_id").cast("string")), F.lit("=" * 64), label("verdict", F.col("verdict")), label("", F.col("summary")), F.lit(""), F.lit("PAGES"),
            label("  pages", F.col("n").cast("string")), label("  scanned / digital", F.concat_ws(" / ", F.col("scanned").cast("string"), digital.cast("string"))),
            F.when(F.col("mixed"), F.lit("  -> mixed: capture checks apply to scanned pages only")), resolution, F.lit(""), F.lit("FINDINGS"),
        ),
        F.coalesce("blocks", F.array(F.lit("  none"))),
    ))
    return out.select("doc_id", F.array_join(body, "\n").alias("report"))
