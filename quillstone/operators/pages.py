"""Checks and choices over the words of extracted pages.

Words are (doc_id, page, x0, y0, x1, y1, text); pages are (doc_id, page, width, height).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact

EDGES = ("x0", "y0", "x1", "y1")


def word_problems(words: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, error_code: documents with a page without words, or with a box that is no finite rectangle inside its page."""
    p = pages.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), "width", "height")
    each = p.join(words, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")), "left")
    finite = F.lit(True)
    for e in EDGES:
        finite = finite & F.col(e).isNotNull() & ~F.isnan(e)
    inside = finite & (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= F.col("width")) & (F.col("y1") <= F.col("height")) & (F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1"))
    empty = F.count_if(F.col("doc_id").isNull()) > 0
    bad = F.count_if(F.col("doc_id").isNotNull() & ~inside) > 0
    code = F.when(empty, "PAGE_WITHOUT_WORDS").when(bad, "WORD_BOX_INVALID")
    return each.groupBy(F.col("d").alias("doc_id")).agg(code.alias("error_code")).where("error_code is not null")


def outside(boxes: DataFrame, regions: DataFrame, margin: float = 0.0) -> DataFrame:
    """The boxes that overlap no region of their page, regions grown by ``margin``."""
    r = regions.select(F.col("doc_id").alias("d"), F.col("page").alias("p"), *[F.col(e).alias(f"r{e}") for e in EDGES])
    overlap = (F.col("x0") < F.col("rx1") + margin) & (F.col("x1") > F.col("rx0") - margin) & (F.col("y0") < F.col("ry1") + margin) & (F.col("y1") > F.col("ry0") - margin)
    return boxes.join(r, (F.col("doc_id") == F.col("d")) & (F.col("page") == F.col("p")) & overlap, "left_anti")


def low_confidence(detections: DataFrame, least: float = 0.9) -> DataFrame:
    """Documents with a detection below ``least``: doc_id, n."""
    return detections.where(F.col("confidence") < least).groupBy("doc_id").agg(F.count("*").alias("n"))


def header_pages(lines: DataFrame, marker: str) -> DataFrame:
    """doc_id, page: pages that hold the marker, letters and digits only."""
    found = lines.where(F.contains(compact(F.col("text")), compact(F.lit(marker))))
    return found.select("doc_id", "page").distinct()


def style(items: DataFrame) -> DataFrame:
    """doc_id, size (median of the positive ones, else 9), font (of the largest, then widest, item)."""
    size = F.coalesce(F.median(F.when(F.col("size") > 0, F.col("size"))), F.lit(9.0))
    font = F.max_by("font", F.struct("size", (F.col("x1") - F.col("x0")).alias("width"), "font"))
    return items.groupBy("doc_id").agg(size.alias("size"), F.coalesce(F.nullif(font, F.lit("")), F.lit("helv")).alias("font"))
