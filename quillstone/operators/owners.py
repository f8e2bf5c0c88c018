"""Where an owner's values occur: cells, comments, properties, repeated header lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact


def occurrences(parts: DataFrame, owners: DataFrame) -> DataFrame:
    """parts(doc_id, part, text) with each owner value (doc_id, field, original) that they contain.

    The values of a document, a handful, come beside its parts as one array: no pair of rows is formed that
    doesn't match.
    """
    held = owners.where(F.length("original") > 0).groupBy("doc_id").agg(F.collect_set(F.struct("field", "original")).alias("o"))
    hits = parts.join(held, "doc_id").select("doc_id", "part", "text", F.explode("o").alias("v"))
    return hits.where(F.contains("text", F.col("v.original"))).select("doc_id", "part", "v.field", "v.original")


def repetitions(lines: DataFrame, owners: DataFrame, least: int = 5) -> DataFrame:
    """lines(doc_id, page, line_ord, text) that contain the compact owner name, ``least`` characters or more."""
    own = owners.where(F.length(compact(F.col("original"))) >= least).groupBy("doc_id").agg(F.collect_set(compact(F.col("original"))).alias("o"))
    hit = lines.withColumn("c", compact(F.col("text"))).join(own, "doc_id").select("doc_id", "page", "line_ord", "c", F.explode("o").alias("v"))
    return hit.where(F.contains("c", F.col("v"))).select("doc_id", "page", "line_ord").distinct()


def first_by_category(detections: DataFrame, categories: list[str]) -> DataFrame:
    """One row a document with the first (by ord) original of each category."""
    return detections.groupBy("doc_id").agg(*[F.min_by(F.when(F.col("category") == c, F.col("original")), F.when(F.col("category") == c, F.col("ord"))).alias(c) for c in categories])


def missing_categories(detections: DataFrame, required: DataFrame) -> DataFrame:
    """doc_id, missing: the categories that a document's family requires (family, category) and that weren't found."""
    need = required.groupBy("family").agg(F.collect_set("category").alias("need"))
    have = detections.groupBy("doc_id", "family").agg(F.collect_set("category").alias("have"))
    return have.join(need, "family").select("doc_id", F.sort_array(F.array_except("need", "have")).alias("missing"))
