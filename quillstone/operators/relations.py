"""How ledger documents relate: collisions, keyed comparison, classification, leftovers.

Ledger rows are (doc_id, line_ord, account_code, nature, saldo_inicial, debe, haber, saldo_final); documents are (doc_id,
owner_rfc, owner_name, year, month, print_date).  Pairs are found by an equi-join on a blocking key, the account code
without leading zeros, which every pair that shares an account by code or by alias also shares; no pair of documents
without a common account is ever formed, but for documents with a collision, which relate to all others and are
only paired on request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import account_alias, account_code, normalize
from ..functions.values import period_index

AMOUNTS = ("saldo_inicial", "debe", "haber", "saldo_final")
EXACT, PROJECTION, SERIES, AMBIGUOUS, STANDALONE = "exact_equivalent", "projection", "series", "ambiguous", "standalone"
COLLISION = "ACCOUNT_NORMALIZATION_COLLISION"


def with_codes(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("norm_code", account_code(F.col("account_code")))


def normalization_collisions(ledger: DataFrame) -> DataFrame:
    """doc_id, norm_code, codes: normalised codes that more than one raw code has in a document."""
    raw = with_codes(ledger).groupBy("doc_id", "norm_code").agg(F.sort_array(F.collect_set("account_code")).alias("codes"))
    return raw.where(F.size("codes") > 1)


def line_map(ledger: DataFrame) -> DataFrame:
    """One row a document and normalised code, the last by line_ord; with nature '' for null and the blocking key."""
    lines = with_codes(ledger)
    row = F.struct("line_ord", *AMOUNTS, F.col("nature"))
    last = lines.groupBy("doc_id", "norm_code").agg(F.max_by(row, F.col("line_ord")).alias("r"))
    nature = F.coalesce(normalize(F.col("r.nature")), F.lit(""))
    return last.select("doc_id", "norm_code", F.coalesce(account_alias(F.col("norm_code")), F.col("norm_code")).alias("alias"), *[F.col(f"r.{a}").alias(a) for a in AMOUNTS], nature.alias("nature"))


def monetary_fingerprint(line: str = "") -> Column:
    return F.struct(*[F.coalesce(F.col(f"{line}{a}"), F.lit(0)).alias(a) for a in AMOUNTS])


def metadata_conflicts(l: str, r: str) -> Column:
    """Array of the conflicts of two documents: both sides present and different."""
    differ = lambda name, a, b: F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(name))
    col = lambda side, c: F.col(f"{side}.{c}")
    text = lambda side, c: F.nullif(normalize(col(side, c)), F.lit(""))
    period = lambda side: period_index(col(side, "year"), col(side, "month"))
    return F.array_compact(F.array(
        differ("OWNER_RFC_CONFLICT", text(l, "owner_rfc"), text(r, "owner_rfc")),
        differ("OWNER_NAME_CONFLICT", text(l, "owner_name"), text(r, "owner_name")),
        differ("PERIOD_CONFLICT", period(l), period(r)),
        differ("PRINT_DATE_CONFLICT", col(l, "print_date"), col(r, "print_date")),
    ))


def shared_accounts(ledger: DataFrame, within: list[str] | None = None) -> DataFrame:
    """left, right (left < right), and both sides' line of every account that two documents share.

    By normalised code, or, where a code is on one side only, by an alias that is unique among each side's unmatched
    codes.  ``within``: columns of ledger that both documents must share, as a further blocking key.
    """
    extra = within or []
    m = line_map(ledger)
    if extra:
        m = m.join(ledger.select("doc_id", *extra).distinct(), "doc_id")
    side = lambda p: m.select(*[F.col(c).alias(f"{p}_{c}") for c in m.columns])
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in ("alias", *extra)] + [F.col("l_doc_id") < F.col("r_doc_id")]
    pairs = side("l").join(side("r"), on)
    same = pairs.where("l_norm_code = r_norm_code").withColumn("by_alias", F.lit(False))
    #: aliases that differ in spelling: rare, so the windows below see few rows
    other = pairs.where("l_norm_code <> r_norm_code")
    pair = ["l_doc_id", "r_doc_id"]
    taken_l = same.select(*pair, "l_norm_code")
    taken_r = same.select(*pair, "r_norm_code")
    free = other.join(taken_l, [*pair, "l_norm_code"], "left_anti").join(taken_r, [*pair, "r_norm_code"], "left_anti")
    w = Window.partitionBy(*pair, "l_alias")
    unique = free.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__n").withColumn("by_alias", F.lit(True))
    return same.unionByName(unique.select(*same.columns))


def _rows_equal() -> Column:
    amounts = F.lit(True)
    for a in AMOUNTS:
        amounts = amounts & (F.coalesce(F.col(f"l_{a}"), F.lit(0)) == F.coalesce(F.col(f"r_{a}"), F.lit(0)))
    return amounts & ((F.col("l_nature") == "") | (F.col("r_nature") == "") | (F.col("l_nature") == F.col("r_nature")))


def pair_statistics(ledger: DataFrame, documents: DataFrame, within: list[str] | None = None) -> DataFrame:
    """left, right, shared, equal, forward/backward continuity, rows of both sides."""
    shared = shared_accounts(ledger, within)
    stats = shared.groupBy(F.col("l_doc_id").alias("left"), F.col("r_doc_id").alias("right")).agg(
        F.count("*").alias("shared"),
        F.count_if(_rows_equal()).alias("equal"),
        F.count_if(F.col("l_saldo_final").eqNullSafe(F.col("r_saldo_inicial"))).alias("forward"),
        F.count_if(F.col("r_saldo_final").eqNullSafe(F.col("l_saldo_inicial"))).alias("backward"),
    )
    rows = with_codes(ledger).groupBy("doc_id").agg(F.countDistinct("norm_code").alias("rows"))
    return stats.join(rows.select(F.col("doc_id").alias("left"), F.col("rows").alias("left_rows")), "left").join(
        rows.select(F.col("doc_id").alias("right"), F.col("rows").alias("right_rows")), "right"
    )


def infer_relations(ledger: DataFrame, documents: DataFrame, within: list[str] | None = None, expand_collisions: bool = False) -> DataFrame:
    """left, right, relation, confidence, shared_accounts, conflicts, coverage: one row for each related pair.

    A document with a code collision is ambiguous against every other one.  ``expand_collisions`` forms those pairs
    with documents (of the same ``within``) that it shares no account with, too.
    """
    stats = pair_statistics(ledger, documents, within)
    bad = normalization_collisions(ledger).select("doc_id").distinct()
    if expand_collisions:
        ids = documents.select("doc_id", *[F.col(c).alias(f"of_{c}") for c in within or []])
        of = bad.join(documents, "doc_id").select(F.col("doc_id").alias("c"), *(within or []))
        on = [F.col(c) == F.col(f"of_{c}") for c in within or []] + [F.col("c") != F.col("doc_id")]
        wide = of.join(ids, on).select(F.least("c", "doc_id").alias("left"), F.greatest("c", "doc_id").alias("right")).distinct()
        stats = wide.join(stats, ["left", "right"], "full")
    mark = lambda side: bad.select(F.col("doc_id").alias(side), F.lit(True).alias(f"{side}_bad"))
    stats = stats.join(mark("left"), "left", "left").join(mark("right"), "right", "left")
    meta = documents.select("doc_id", F.struct("owner_rfc", "owner_name", "year", "month", "print_date").alias("m"))
    stats = stats.join(meta.select(F.col("doc_id").alias("left"), F.col("m").alias("lm")), "left").join(meta.select(F.col("doc_id").alias("right"), F.col("m").alias("rm")), "right")
    step = period_index(F.col("rm.year"), F.col("rm.month")) - period_index(F.col("lm.year"), F.col("lm.month"))
    continuity = F.when(step == 1, F.col("forward")).when(step == -1, F.col("backward"))
    shared, smaller = F.col("shared"), F.least("left_rows", "right_rows")
    coverage, ratio = shared / smaller, continuity / shared
    collided = F.coalesce("left_bad", "right_bad", F.lit(False))
    rule = (
        F.when(collided, "collision")
        .when((shared == F.col("left_rows")) & (shared == F.col("right_rows")) & (F.col("equal") == shared), EXACT)
        .when((shared >= 3) & (coverage >= 0.8) & (F.col("equal") == shared), PROJECTION)
        .when((shared >= 3) & (ratio >= 0.8), SERIES)
        .when((shared >= 3) & (coverage >= 0.5), AMBIGUOUS)
    )
    found = stats.withColumn("rule", rule).where("rule is not null").withColumn("meta", metadata_conflicts("lm", "rm"))
    conflicts = (
        F.when(F.col("rule") == "collision", F.array(F.lit(COLLISION)))
        .when(F.col("rule") == SERIES, F.array_remove("meta", "PERIOD_CONFLICT"))
        .when((F.col("rule") == AMBIGUOUS) & (F.size("meta") == 0), F.array(F.lit("CONTENT_MISMATCH")))
        .otherwise(F.col("meta"))
    )
    confidence = (
        F.when(F.col("rule").isin("collision", EXACT), 1.0)
        .when(F.col("rule") == PROJECTION, F.least(F.lit(0.99), 0.80 + 0.19 * coverage))
        .when(F.col("rule") == SERIES, F.least(F.lit(0.99), 0.80 + 0.19 * ratio))
        .otherwise(F.least(F.lit(0.89), coverage))
    )
    relation = F.when(F.col("rule") == "collision", AMBIGUOUS).otherwise(F.col("rule"))
    return found.select("left", "right", relation.alias("relation"), confidence.alias("confidence"), F.coalesce("shared", F.lit(0)).alias("shared_accounts"), conflicts.alias("conflicts"), F.round(F.when(F.col("rule") == SERIES, ratio).otherwise(coverage), 6).alias("coverage"))


def standalone(documents: DataFrame, relations: DataFrame) -> DataFrame:
    """Documents in no exact, projection or series relation."""
    linked = relations.where(F.col("relation").isin(EXACT, PROJECTION, SERIES))
    ends = linked.select(F.explode(F.array("left", "right")).alias("doc_id")).distinct()
    return documents.join(ends, "doc_id", "left_anti").select(F.col("doc_id").alias("left"), F.lit(None).cast("string").alias("right"), F.lit(STANDALONE).alias("relation"), F.lit(1.0).alias("confidence"))
