"""Trial balances derived from the star-schema tables, for tests and benchmarks.

One document is an entity (supplier nation) and a month; accounts are part brands; amounts are integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, entity, period, account_code, saldo_inicial, debe, haber, saldo_final: dense, with running balances."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_shipdate")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("entity"))
    part = table(spark, sf_dir, "part").select("p_partkey", account_of("p_brand").alias("account_code"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    period = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    flow = li.join(supplier, li["l_suppkey"] == supplier["s_suppkey"]).join(part, li["l_partkey"] == part["p_partkey"])
    moves = flow.groupBy("entity", period.alias("period"), "account_code").agg(
        F.sum(F.when(F.col("l_returnflag") != "R", cents).otherwise(0)).alias("debe"), F.sum(F.when(F.col("l_returnflag") == "R", cents).otherwise(0)).alias("haber")
    )
    #: every account an entity ever uses has a row in every month between the first and last of the data
    span = moves.agg(F.min("period").alias("lo"), F.max("period").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    dense = moves.select("entity", "account_code").distinct().select("entity", "account_code", F.explode(F.sequence(lo, hi)).alias("period"))
    full = dense.join(moves, ["entity", "period", "account_code"], "left").fillna(0, ["debe", "haber"])
    before = Window.partitionBy("entity", "account_code").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    opening = F.coalesce(F.sum(F.col("debe") - F.col("haber")).over(before), F.lit(0))
    out = full.withColumn("saldo_inicial", opening).withColumn("saldo_final", F.col("saldo_inicial") + F.col("debe") - F.col("haber"))
    doc = F.concat_ws("-", "entity", "period")
    return out.select(doc.alias("doc_id"), "entity", "period", "account_code", "saldo_inicial", "debe", "haber", "saldo_final")


def account_of(brand: str):
    """``Brand#7`` as the code ``101.07``."""
    return F.concat(F.lit("101."), F.lpad(F.regexp_replace(brand, r"\D", ""), 2, "0"))


def relation_fixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ledger, documents): every month of every entity, and variants of the first month's documents that take every branch.

    Variants: ``-x`` dashed codes and ``-z`` zero-padded codes (exact), ``-p`` without every fifth account
    (projection), ``-a`` other amounts (ambiguous), ``-c`` one account under two spellings (collision).
    """
    base = derived_ledger(spark, sf_dir)
    first = table(spark, sf_dir, "lineitem").agg(F.min(F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).alias("first")).scalar()
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("account_code"))
    base = base.withColumn("line_ord", order - 1)
    kinds = F.array(*map(F.lit, ("", "x", "z", "p", "a", "c")))
    rows = base.withColumn("kind", F.explode(F.when(F.col("period") == first, kinds).otherwise(F.array(F.lit("")))))
    rows = rows.where((F.col("kind") != "p") | (F.col("line_ord") % 5 != 4))
    code = (
        F.when(F.col("kind") == "x", F.translate("account_code", ".", "-"))
        .when(F.col("kind") == "z", F.concat(F.lit("0"), F.col("account_code")))
        .otherwise(F.col("account_code"))
    )
    shifted = lambda c: F.when(F.col("kind") == "a", F.col(c) + F.col("line_ord") + 1).otherwise(F.col(c))
    rows = rows.select(
        F.when(F.col("kind") == "", F.col("doc_id")).otherwise(F.concat_ws("-", "doc_id", "kind")).alias("doc_id"), "entity", "period", "kind", "line_ord", code.alias("account_code"),
        F.lit(None).cast("string").alias("nature"), *[shifted(c).alias(c) for c in ("saldo_inicial", "debe", "haber", "saldo_final")],
    )
    twice = rows.where((F.col("kind") == "c") & (F.col("line_ord") == 0)).withColumn("account_code", F.translate("account_code", ".", "-")).withColumn("line_ord", F.lit(1000))
    rows = rows.unionByName(twice)
    rows = stored(rows)
    docs = rows.select("doc_id", "entity", "period").distinct()
    docs = docs.select(
        "doc_id", F.concat(F.lit("AAA010101"), F.lpad(F.col("entity").cast("string"), 3, "0")).alias("owner_rfc"), F.concat(F.lit("Empresa "), F.col("entity").cast("string")).alias("owner_name"),
        F.floor(F.col("period") / 12).cast("int").alias("year"), (F.col("period") % 12 + 1).cast("int").alias("month"), F.lit(None).cast("date").alias("print_date"), "entity",
    )
    return rows, docs
