"""Checks of outputs against inputs: ordered ledgers, multisets, leakage, retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relations import AMOUNTS


def ledger_differences(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("account_code", *AMOUNTS)) -> DataFrame:
    """doc_id, line_ord, differs (names): lines that are missing, added or changed, by position."""
    keys = ["doc_id", "line_ord"]
    l = before.select(*keys, F.struct(*columns).alias("l"))
    r = after.select(*keys, F.struct(*columns).alias("r"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns]))
    out = l.join(r, keys, "full").select(*keys, F.when(F.col("l").isNull(), F.array(F.lit("added"))).when(F.col("r").isNull(), F.array(F.lit("missing"))).otherwise(differs).alias("differs"))
    return out.where(F.size("differs") > 0)


def multiset_difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """columns, n_before, n_after: tuples that don't occur equally often."""
    rows = before.select(*columns, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*columns, F.lit(0).alias("b"), F.lit(1).alias("a")))
    return rows.groupBy(*columns).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after")).where("n_before <> n_after")


def leakage(outputs: DataFrame, originals: DataFrame) -> DataFrame:
    """doc_id, part, n_leaks: parts (doc_id, part, text) that still contain one of their document's originals.

    The text stands beside each original, not in the lambda as an outer column: the optimizer takes such a column for the
    lambda's own variable where their ids meet (the second column a session reads), and filters below the join without it.
    """
    own = originals.where(F.length("original") > 0).groupBy("doc_id").agg(F.collect_set("original").alias("o"))
    beside = F.arrays_zip(F.col("o").alias("o"), F.array_repeat("text", F.size("o")).alias("t"))
    n = F.size(F.filter(beside, lambda x: x["t"].contains(x["o"])))
    return outputs.join(own, "doc_id").select("doc_id", "part", n.alias("n_leaks")).where("n_leaks > 0")


def failed_ids(report: DataFrame) -> DataFrame:
    """file_id, problem of a report (file_id, success): the ids that failed; contradictory or malformed ones named."""
    g = report.groupBy("file_id").agg(F.bool_or("success").alias("any"), F.bool_and("success").alias("every"))
    problem = F.when(~F.col("file_id").rlike("^[0-9A-Fa-f]{32}$"), "BAD_ID").when(F.col("any") & ~F.col("every"), "CONTRADICTORY")
    return g.select("file_id", problem.alias("problem"), "every").where("not every or problem is not null").select("file_id", "problem")


def selected_for_retry(sources: DataFrame, report: DataFrame) -> DataFrame:
    """The sources (file_id, ...) whose id failed."""
    return sources.join(failed_ids(report).where("problem is null").select("file_id"), "file_id", "left_semi")


def safe_error(code: Column, known: list[str], fallback: str) -> Column:
    return F.when(code.isin(*known), code).otherwise(fallback)
