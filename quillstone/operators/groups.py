"""Groups of related documents: components, identities, conflicts, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import Pseudonyms
from ..functions.text import normalize
from ..sources.shared import stored
from .relations import AMBIGUOUS, COLLISION, EXACT, PROJECTION, SERIES, STANDALONE

LINKS = (EXACT, PROJECTION, SERIES)


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """doc_id, group_id (smallest doc_id of the component).  nodes(doc_id), edges(left, right).

    Each round takes the smallest label of the neighbours and then the label of that label, so that long chains halve;
    each round is written to the shared folder.
    """
    both = edges.select("left", "right").union(edges.select(F.col("right").alias("left"), F.col("left").alias("right"))).distinct()
    both = both.select(F.col("left").alias("a"), F.col("right").alias("b"))
    cut = stored
    state = cut(nodes.select("doc_id", F.col("doc_id").alias("label")))
    both = cut(both)
    for _ in range(rounds):
        near = both.join(state, both["b"] == state["doc_id"]).groupBy("a").agg(F.min("label").alias("n"))
        stepped = state.join(near, state["doc_id"] == near["a"], "left").select("doc_id", F.least("label", F.coalesce("n", "label")).alias("label"), F.col("label").alias("old"))
        hop = stepped.select(F.col("doc_id").alias("h"), F.col("label").alias("far"))
        moved = cut(stepped.join(hop, stepped["label"] == hop["h"]).select("doc_id", "far", "old"))
        changed = moved.where("far <> old").limit(1).count()
        state = moved.select("doc_id", F.col("far").alias("label"))
        if not changed:
            return state.select("doc_id", F.col("label").alias("group_id"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def group_relation(relation: Column, count: Column) -> Column:
    """Aggregate: the relation of a group from those of its edges (null rows for members without one)."""
    has = lambda x: F.coalesce(F.bool_or(relation == x), F.lit(False))
    return F.when(has(PROJECTION), PROJECTION).when(has(EXACT), EXACT).when(has(SERIES), SERIES).when(count == 1, STANDALONE).otherwise(AMBIGUOUS)


def auto_identity(documents: DataFrame) -> DataFrame:
    """documents with identity (null: never linked) and auto_state."""
    text = lambda c: F.nullif(normalize(F.col(c)), F.lit(""))
    fields = F.array_compact(F.array(text("owner_name"), text("owner_address"), text("owner_certificate")))
    rfc = text("owner_rfc")
    identity = F.when(rfc.isNotNull(), F.concat(F.lit("RFC:"), rfc)).when(F.size(fields) >= 2, F.concat(F.lit("META:"), F.array_join(fields, "|")))
    state = F.when(rfc.isNotNull(), "AUTO_RESOLVED_RFC").when(F.size(fields) >= 2, "AUTO_RESOLVED_METADATA").otherwise("AUTO_SPLIT")
    return documents.withColumns({"identity": identity, "auto_state": state})


def auto_groups(documents: DataFrame, relations: DataFrame, pseudo: Pseudonyms | None = None) -> DataFrame:
    """doc_id, group_id, identity, auto_state, entity_id: components within one identity."""
    known = auto_identity(documents)
    ids = known.where("identity is not null").select("doc_id", "identity")
    edges = relations.where(F.col("relation").isin(*LINKS)).join(ids.select(F.col("doc_id").alias("left"), F.col("identity").alias("li")), "left")
    edges = edges.join(ids.select(F.col("doc_id").alias("right"), F.col("identity").alias("ri")), "right").where("li = ri").select("left", "right")
    out = connected_components(known.select("doc_id"), edges).join(known.select("doc_id", "identity", "auto_state"), "doc_id")
    entity = F.when(F.col("identity").isNotNull(), F.concat(F.lit("auto_entity_"), F.lower(pseudo.token("auto-entity", F.col("identity"), 16)))) if pseudo else F.lit(None).cast("string")
    return out.withColumn("entity_id", entity)


def metadata_source(members: DataFrame) -> DataFrame:
    """group_id, source: the member with most identity fields, then temporal fields, then rows; then the smallest id.

    members: group_id, doc_id, identity_fields, temporal_fields, rows.
    """
    order = F.struct(-F.col("identity_fields"), -F.col("temporal_fields"), -F.col("rows"), F.col("doc_id"))
    return members.groupBy("group_id").agg(F.min_by("doc_id", order).alias("source"))


def blocking_conflicts(conflicts: Column, confirmed: Column, entity_id: Column, source: Column, strict: bool = True) -> Column:
    """The conflicts that block a group, sorted."""
    if not strict:
        return F.array().cast("array<string>")
    owner_ok = confirmed & (entity_id.isNotNull() | source.isNotNull())
    time_ok = confirmed & source.isNotNull()
    return F.array_sort(F.array_distinct(F.filter(conflicts, lambda c: (
        (c.startswith("OWNER_") & ~owner_ok) | (c.isin("PERIOD_CONFLICT", "PRINT_DATE_CONFLICT") & ~time_ok) | (c == COLLISION)
    ))))


def entity_key(members: DataFrame) -> DataFrame:
    """group_id, entity_key.  members: group_id, entity_id, is_source, owner_rfc, owner_name."""
    text = lambda c: F.nullif(normalize(F.col(c)), F.lit(""))
    rfc, name = text("owner_rfc"), text("owner_name")
    only = lambda c, p: F.when(F.count_distinct(c) == 1, F.concat(F.lit(p), F.max(c)))
    of_source = lambda c, p: F.concat(F.lit(p), F.max(F.when(F.col("is_source"), c)))
    key = F.coalesce(F.max("entity_id"), of_source(rfc, "RFC:"), of_source(name, "NAME:"), only(rfc, "RFC:"), only(name, "NAME:"), F.concat(F.lit("GROUP:"), F.col("group_id")))
    return members.groupBy("group_id").agg(key.alias("entity_key"))


def group_summary(members: DataFrame, relations: DataFrame) -> DataFrame:
    """group_id, n_documents, relation, confidence, conflicts of the edges inside each group."""
    m = members.select("doc_id", "group_id")
    inside = relations.where(F.col("relation").isin(*LINKS)).join(m.select(F.col("doc_id").alias("left"), F.col("group_id").alias("g")), "left")
    inside = inside.join(m.select(F.col("doc_id").alias("right"), F.col("group_id").alias("g2")), "right").where("g = g2")
    rows = m.select("group_id", "doc_id", F.lit(None).cast("string").alias("relation"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("array<string>").alias("conflicts"))
    rows = rows.unionByName(inside.select(F.col("g").alias("group_id"), F.lit(None).cast("string").alias("doc_id"), "relation", "confidence", "conflicts"))
    n = F.count("doc_id")
    return rows.groupBy("group_id").agg(n.alias("n_documents"), group_relation(F.col("relation"), n).alias("relation"), F.coalesce(F.min("confidence"), F.lit(1.0)).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("conflicts")))).alias("conflicts"))


def series_pairs(manifest: DataFrame) -> DataFrame:
    """Consecutive members of declared series: group_id, doc_id, next_doc, problem.  manifest: group_id, doc_id, period."""
    w = Window.partitionBy("group_id").orderBy("period", "doc_id")
    nxt = manifest.withColumns({"next_doc": F.lead("doc_id").over(w), "next_period": F.lead("period").over(w)})
    problem = F.when(F.col("period").isNull(), "SERIES_PERIOD_MISSING").when(F.col("period") == F.col("next_period"), "SERIES_PERIOD_DUPLICATE")
    return nxt.select("group_id", "doc_id", "next_doc", problem.alias("problem"))


def plans(groups: DataFrame, pseudo: Pseudonyms) -> DataFrame:
    """One row a group with its synthetic owner.  groups: group_id, entity_key, rfc_lengths (array), source_rfc_length, relation, has_source."""
    lengths = F.array_distinct("rfc_lengths")
    length = F.coalesce(F.when(F.size(lengths) > 1, F.col("source_rfc_length")), F.when(F.size(lengths) == 1, F.get(lengths, F.lit(0))), F.when(F.size(lengths) == 0, 12))
    error = F.when(length.isNull(), "RFC_TYPE_CONFLICT").when(~length.isin(12, 13), "RFC_LENGTH_UNSUPPORTED")
    key = F.col("entity_key")
    name = F.when(length == 13, pseudo.person(key)[0]).otherwise(pseudo.company(key)[0])
    return groups.select(
        "group_id", "entity_key", "relation", name.alias("name"), pseudo.rfc(F.repeat(F.lit("A"), length), key).alias("rfc"),
        pseudo.address(key)[0].alias("address"), pseudo.population(key)[0].alias("population"), pseudo.month_offset(key).alias("month_offset"),
        (F.col("has_source") & (F.col("relation") != SERIES)).alias("canonical_dates"), error.alias("error_code"),
    )
