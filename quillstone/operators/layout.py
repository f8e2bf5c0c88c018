"""Operators over page layouts and cell grids: spatial, nearest and prefix joins, profiles, columns, lines.

words: doc_id, page, x0, y0, x1, y1, text; cells: doc_id, sheet, row, col, value, cell_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import account_code, compact

BAND = 50.0


def overlaps(a: str, b: str, tolerance: float = 0.0) -> Column:
    """Rectangles of two aliases overlap by more than ``-tolerance``."""
    c = lambda s, x: F.col(f"{s}.{x}")
    return (c(a, "x0") < c(b, "x1") + tolerance) & (c(b, "x0") < c(a, "x1") + tolerance) & (c(a, "y0") < c(b, "y1") + tolerance) & (c(b, "y0") < c(a, "y1") + tolerance)


def _banded(df: DataFrame, low: str, high: str) -> DataFrame:
    """A row for each band of ``BAND`` that [low, high] touches: turns a range join into an equi-join."""
    return df.withColumn("band", F.explode(F.sequence(F.floor(F.col(low) / BAND), F.floor(F.col(high) / BAND))))


def attach_to_lines(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Each span (span_id, doc_id, page, y0, y1) with the first line (line_ord) that overlaps it vertically."""
    l = _banded(lines.select("doc_id", "page", "line_ord", F.col("y0").alias("ly0"), F.col("y1").alias("ly1")), "ly0", "ly1")
    s = _banded(spans, "y0", "y1")
    hits = s.join(l, ["doc_id", "page", "band"]).where(F.least("y1", "ly1") > F.greatest("y0", "ly0"))
    return hits.groupBy("span_id", "doc_id", "page").agg(F.min("line_ord").alias("line_ord"))


def nearest_owner(companies: DataFrame, rfcs: DataFrame) -> DataFrame:
    """Each company (doc_id, company_id, page, y0) with the nearest rfc of its document: page distance first."""
    r = rfcs.select("doc_id", "rfc", F.col("page").alias("rp"), F.col("y0").alias("ry"))
    far = F.abs(F.col("page") - F.col("rp")) * 10000 + F.abs(F.col("y0") - F.col("ry"))
    return companies.join(r, "doc_id").groupBy("doc_id", "company_id").agg(F.min_by("rfc", F.struct(far, F.col("rfc"))).alias("rfc"))


def bank_parents(rows: DataFrame) -> DataFrame:
    """rows(doc_id, page, row_ord, code, is_bank) with parent_bank: the previous row of the page is a bank row, or the
    latest bank row before has a code that begins this one's."""
    w = Window.partitionBy("doc_id", "page").orderBy("row_ord")
    digits = F.regexp_replace("code", r"\D", "")
    base = rows.withColumns({"digits": digits, "prev_bank": F.coalesce(F.lag("is_bank").over(w), F.lit(False))})
    starts = base.select("doc_id", "row_ord", "digits", F.explode(F.sequence(F.lit(1), F.greatest(F.length("digits") - 1, F.lit(1)))).alias("n"))
    starts = starts.where(F.col("n") < F.length("digits")).select("doc_id", "row_ord", F.substring("digits", F.lit(1), F.col("n")).alias("root"))
    roots = base.where("is_bank").select("doc_id", F.col("row_ord").alias("root_ord"), F.col("digits").alias("root"))
    found = starts.join(roots, ["doc_id", "root"]).where("root_ord < row_ord").groupBy("doc_id", "row_ord").agg(F.max("root_ord").alias("root_ord"))
    out = base.join(found, ["doc_id", "row_ord"], "left")
    return out.select("doc_id", "page", "row_ord", "code", "is_bank", (F.col("prev_bank") | F.col("root_ord").isNotNull()).alias("parent_bank"))


def dedupe_detections(detections: DataFrame) -> DataFrame:
    """The first (by ord) of each category, page, rounded rectangle and normalised text."""
    w = Window.partitionBy("doc_id", "category", "page", *[F.round(c, 1) for c in ("x0", "y0", "x1", "y1")], compact(F.col("original"))).orderBy("ord")
    return detections.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def family_scores(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, family, score: weighted share of a family's anchors (family, anchor, weight) that the lines contain.

    Anchors are a small rule table; lines are scanned once, as the anchors come as one array.
    """
    rules = anchors.agg(F.collect_list(F.struct("family", "anchor", "weight")).alias("a")).scalar()
    total = anchors.groupBy("family").agg(F.sum("weight").alias("total"))
    tried = lines.select("doc_id", compact(F.col("text")).alias("c"), rules.alias("rules")).select("doc_id", "c", F.explode("rules").alias("r"))
    seen = tried.where(F.contains("c", compact(F.col("r.anchor")))).select("doc_id", "r.family", "r.anchor", "r.weight").distinct()
    return seen.groupBy("doc_id", "family").agg(F.sum("weight").alias("w")).join(total, "family").select("doc_id", "family", (F.col("w") / F.col("total")).alias("score"))


def chosen_family(scores: DataFrame, least: float = 0.5, lead: float = 0.1) -> DataFrame:
    """doc_id, family: the best, if it reaches ``least`` and leads by ``lead``."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "family")
    ranked = scores.withColumns({"n": F.row_number().over(w), "second": F.lead("score").over(w)}).where("n = 1")
    ok = (F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(0.0)) >= lead - 1e-12)
    return ranked.select("doc_id", F.when(ok, F.col("family")).alias("family"), "score")


#: Header labels of the spreadsheet profiles.
PROFILE_C = ["NOCUENTA", "NATURALEZA", "CUENTA", "SALDOINICIAL", "DEBE", "HABER", "SALDOFINAL"]
PROFILE_B = ["CUENTA", "SALDOINICIAL", "DEBE", "HABER", "SALDOFINAL"]
PROFILE_A = [["CARGOS", "ABONOS"], ["DEUDOR", "ACREEDOR"]]


def header_profiles(cells: DataFrame, rows: int = 50) -> DataFrame:
    """doc_id, profile, sheet, header_row: the first header within ``rows`` rows that fits profile C, B or A."""
    row = cells.where(F.col("row") <= rows).groupBy("doc_id", "sheet", "row").agg(F.collect_set(compact(F.col("value"))).alias("labels"))
    w = Window.partitionBy("doc_id", "sheet").orderBy("row")
    row = row.withColumns({"after": F.lead("labels").over(w), "next_row": F.lead("row").over(w)})
    has = lambda c, xs: F.size(F.array_except(F.array(*map(F.lit, xs)), c)) == 0
    b = has("labels", PROFILE_B[1:]) & (F.array_contains("labels", "CUENTA") | F.array_contains("labels", "CUENTADESCRIPCION"))
    both = F.array_union(F.col("labels"), F.when(F.col("next_row") == F.col("row") + 1, F.coalesce("after", F.array())).otherwise(F.array().cast("array<string>")))
    a = has(both, PROFILE_A[0]) & has(both, PROFILE_A[1])
    profile = F.when(has("labels", PROFILE_C), "C").when(b, "B").when(a, "A")
    found = row.withColumn("profile", profile).where("profile is not null")
    first = found.groupBy("doc_id").agg(F.min(F.struct("sheet", "row", F.col("profile"))).alias("f"))
    return first.select("doc_id", "f.profile", "f.sheet", F.col("f.row").alias("header_row"))


def money_columns(cells: DataFrame, header_row: int = 0, least: int = 3, window: int = 50) -> DataFrame:
    """doc_id, sheet, money_cols: columns numeric in ``least`` of the first ``window`` account rows."""
    first = cells.where(F.col("row") > header_row)
    accounts = first.where((F.col("col") == 1) & account_code(F.col("value")).rlike(r"^\d+(\.\d+)*$")).select("doc_id", "sheet", "row")
    w = Window.partitionBy("doc_id", "sheet").orderBy("row")
    accounts = accounts.withColumn("n", F.row_number().over(w)).where(F.col("n") <= window).drop("n")
    numeric = F.replace(F.col("value"), F.lit(","), F.lit("")).try_cast("decimal(38,10)").isNotNull()
    hits = first.where(F.col("col") > 1).join(accounts, ["doc_id", "sheet", "row"]).where(numeric)
    cols = hits.groupBy("doc_id", "sheet", "col").count().where(F.col("count") >= least)
    return cols.groupBy("doc_id", "sheet").agg(F.sort_array(F.collect_list("col")).alias("money_cols"))


def visual_lines(words: DataFrame, tolerance: float = 1.25) -> DataFrame:
    """words with line_no: a new line begins where the top moves by more than ``tolerance`` from the word above."""
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0")
    step = (F.col("y0") - F.lag("y0").over(w) > tolerance) | F.lag("y0").over(w).isNull()
    return words.withColumn("__s", step.cast("int")).withColumn("line_no", F.sum("__s").over(w)).drop("__s")


def positioned_ledger(words: DataFrame) -> DataFrame:
    """Lines with an account among the first three words and four amounts at the end: doc_id, page, line_no, account_code, amounts."""
    lines = visual_lines(words).groupBy("doc_id", "page", "line_no").agg(F.sort_array(F.collect_list(F.struct("x0", "text"))).alias("w"))
    texts = F.transform("w", lambda x: x["text"])
    money = F.filter(texts, lambda t: t.rlike(r"^-?\(?[\d,]+\.\d{2}\)?$"))
    code = F.get(F.filter(F.slice(texts, 1, 3), lambda t: t.rlike(r"^\d{2,}(?:[.-]\d+)*$")), F.lit(0))
    out = lines.select("doc_id", "page", "line_no", code.alias("account_code"), F.when(F.size(money) >= 4, F.slice(money, -4, 4)).alias("amounts"))
    return out.where("account_code is not null and amounts is not null")


def inherited_bounds(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, width, height, bounds) with the last known bounds of the same page size."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    donor = F.last(F.when(F.col("bounds").isNotNull(), F.struct("width", "height", "bounds")), ignorenulls=True).over(w)
    out = pages.withColumn("donor", donor)
    same = (F.col("donor.width") == F.col("width")) & (F.col("donor.height") == F.col("height"))
    return out.select("doc_id", "page", "width", "height", F.coalesce("bounds", F.when(same, F.col("donor.bounds"))).alias("bounds"))
