"""Whole runs over a folder of XML trial balances: discover, and apply with staging by group.

Discovery is one lazy DataFrame graph; executors never raise on a document's content, whose problems are columns.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keyed import Pseudonyms
from ..operators import groups as G
from ..operators import relations as R
from ..sources import files, xml


@dataclass
class Discovery:
    documents: DataFrame
    ledger: DataFrame
    relations: DataFrame
    groups: DataFrame
    summary: DataFrame


def discover(spark: SparkSession, path: str, pseudo: Pseudonyms, auto_resolve: bool = False) -> Discovery:
    """Documents, their ledger rows, relations and groups."""
    found = xml.documents(files.input_files(spark, path, (".xml",)))
    none = F.lit(None).cast("string")
    ledger = xml.ledger(found)
    broken = ledger.where("line_error is not null").select(F.col("doc_id").alias("path")).distinct().withColumn("bad", F.lit("XML_AMOUNT_INVALID"))
    docs = found.join(broken, "path", "left").select(
        F.col("path").alias("doc_id"), "owner_rfc", none.alias("owner_name"), none.alias("owner_address"), none.alias("owner_certificate"), "year", "month",
        F.lit(None).cast("date").alias("print_date"), "is_signed", "modified", F.coalesce("error_code", "bad").alias("error_code"), "text",
    )
    good = docs.where("error_code is null")
    ledger = ledger.join(good.select("doc_id"), "doc_id", "left_semi")
    rel = R.infer_relations(ledger, good)
    if auto_resolve:
        members = G.auto_groups(good, rel, pseudo)
    else:
        edges = rel.where(F.col("relation").isin(*G.LINKS)).select("left", "right")
        members = G.connected_components(good.select("doc_id"), edges).withColumn("entity_id", none)
    return Discovery(docs, ledger, rel, members, G.group_summary(members, rel))


def group_plans(d: Discovery, pseudo: Pseudonyms, strict: bool = True, strip_signature: bool = False) -> DataFrame:
    """One row a group: entity key, synthetic owner, month offset, error_code (conflicts, signatures that are to stay, tax ids)."""
    members = d.groups.join(d.documents, "doc_id").withColumn("is_source", F.lit(False))
    keys = G.entity_key(members.select("group_id", "entity_id", "is_source", "owner_rfc", "owner_name"))
    facts = members.groupBy("group_id").agg(
        F.array_distinct(F.collect_list(F.length(F.trim("owner_rfc")))).alias("rfc_lengths"), F.bool_or("is_signed").alias("signed"), F.max("entity_id").alias("entity_id")
    ).join(d.summary, "group_id").join(keys, "group_id")
    facts = facts.withColumns({"source_rfc_length": F.lit(None).cast("int"), "has_source": F.lit(False)})
    blocked = G.blocking_conflicts(F.col("conflicts"), F.col("entity_id").isNotNull(), F.col("entity_id"), F.lit(None).cast("string"), strict)
    state = facts.select("group_id", F.when(F.size(blocked) > 0, F.get(blocked, F.lit(0))).when(F.col("signed") & F.lit(not strip_signature), "XML_SIGNED").alias("blocked"))
    return G.plans(facts, pseudo).join(state, "group_id").withColumn("error_code", F.coalesce("error_code", "blocked")).drop("blocked")


def rewritten(d: Discovery, plans: DataFrame, pseudo: Pseudonyms) -> DataFrame:
    """doc_id, group_id, new_text, output name: the documents of the groups whose plan has no error."""
    ready = plans.where("error_code is null").select("group_id", "entity_key", "rfc")
    docs = d.documents.where("error_code is null").join(d.groups.select("doc_id", "group_id"), "doc_id").join(ready, "group_id")
    y, m = pseudo.exercise_and_period(F.col("year").cast("string"), F.lpad(F.col("month").cast("string"), 2, "0"), F.col("entity_key"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.pmod(F.conv(F.substring(pseudo.token("date-fallback", F.col("modified"), 8), 1, 7), 16, 10).cast("int"), F.lit(20_000)))
    made = lambda df, name, c: df.select(*[x for x in df.columns if x != name], F.explode(F.array(c)).alias(name))  # noqa: E731  a generator: not folded into what uses it
    docs = docs.withColumns({"new_year": y, "new_month": m, "offset": pseudo.month_offset(F.col("entity_key")), "drawn": F.date_format(day, "yyyy-MM-dd")})
    moved = lambda c: F.when(c == F.last_day(c), F.last_day(F.add_months(c, F.col("offset")))).otherwise(F.add_months(c, F.col("offset")))
    docs = made(docs, "new_modified", xml.shifted_day(F.col("modified"), moved, F.col("drawn")))
    # a column a step: each step names its text several times
    for attribute, value in (("RFC", "rfc"), ("Anio", "new_year"), ("Mes", "new_month"), ("FechaModBal", "new_modified")):
        docs = made(docs, "text", xml.with_attribute(F.col("text"), attribute, F.col(value)))
    docs = made(docs, "text", xml.without_signature(F.col("text")))
    text = F.col("text")
    name = F.concat(F.lit("anonimizado_"), pseudo.token("output-file", F.col("doc_id"), 16), F.lit(".xml"))
    leaked = (F.col("owner_rfc").isNotNull() & text.contains(F.col("owner_rfc"))) | (F.col("modified").isNotNull() & text.contains(F.concat(F.lit('FechaModBal="'), F.col("modified"), F.lit('"'))))
    return docs.select("doc_id", "group_id", name.alias("name"), text.alias("new_text"), F.when(leaked, "RESIDUAL_VALUE").alias("error_code"))


def publish(out: DataFrame, folder: str) -> dict[str, str]:
    """Write whole groups to a local or mounted folder: a group with any error, or any existing output, is left out.

    Files are staged by the executors under a temporary folder there, and renamed group by group by the driver.  Returns the
    state of each group.
    """
    stage = os.path.join(folder, f".stage-{uuid.uuid4().hex}")

    def put(rows) -> None:
        for r in rows:
            place = os.path.join(stage, r["group_key"])
            os.makedirs(place, exist_ok=True)
            with open(part := os.path.join(place, r["name"] + ".part"), "w", encoding="utf-8", newline="") as f:
                f.write(r["new_text"])
            os.replace(part, os.path.join(place, r["name"]))

    os.makedirs(stage)
    keyed = out.withColumn("group_key", F.sha2(F.col("group_id").cast("string"), 256))
    keyed.where("error_code is null").select("group_key", "name", "new_text").foreachPartition(put)
    states: dict[str, str] = {}
    for r in keyed.groupBy("group_id", "group_key").agg(F.count("*").alias("n"), F.count("error_code").alias("bad")).toLocalIterator():
        place = os.path.join(stage, r["group_key"])
        names = sorted(os.listdir(place)) if os.path.isdir(place) else []
        if r["bad"] or len(names) != r["n"] or any(os.path.exists(os.path.join(folder, x)) for x in names):
            states[r["group_id"]] = "GROUP_FAILED"
            continue
        moved = []
        try:
            for x in names:
                os.replace(os.path.join(place, x), os.path.join(folder, x))
                moved.append(x)
            states[r["group_id"]] = "GROUP_COMMITTED"
        except OSError:
            for x in moved:
                os.remove(os.path.join(folder, x))
            states[r["group_id"]] = "GROUP_FAILED"
    import shutil

    shutil.rmtree(stage, ignore_errors=True)
    return states
