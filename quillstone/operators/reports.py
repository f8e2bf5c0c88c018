"""Reports without original values: counts, summaries, relations by hashed ids, manifest proposals."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import Pseudonyms
from .relations import EXACT, PROJECTION, SERIES


def category_counts(detections: DataFrame) -> DataFrame:
    """doc_id, counts (map of category to count)."""
    n = detections.groupBy("doc_id", "category").count()
    return n.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "count")))).alias("counts"))


def summary(results: DataFrame) -> DataFrame:
    """One row: files, ok, failed, groups.  results: doc_id, success, group_id."""
    return results.agg(F.count("*").alias("files"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.countDistinct("group_id").alias("groups"))


def relation_rows(relations: DataFrame, pseudo: Pseudonyms) -> DataFrame:
    """Undirected relations with keyed ids in place of the documents' names."""
    ids = F.sort_array(F.array(pseudo.token("report-file", F.col("left"), 32), pseudo.token("report-file", F.col("right"), 32)))
    return relations.where("right is not null").select(ids.alias("ids"), "relation", F.round("confidence", 4).alias("confidence"), "conflicts").dropDuplicates(["ids", "relation"])


def detection_rows(detections: DataFrame, pseudo: Pseudonyms) -> DataFrame:
    """doc_id, category, keyed hash of the original, confidence."""
    names = [r["category"] for r in detections.select("category").distinct().collect()]  # the categories are 18 at most
    hashed = F.lit(None).cast("string")
    for n in names:
        hashed = F.when(F.col("category") == n, pseudo.token(f"report-{n}", F.col("original"), 64)).otherwise(hashed)
    return detections.select("doc_id", "category", hashed.alias("hash"), F.round("confidence", 4).alias("confidence"))


def proposal(groups: DataFrame) -> DataFrame:
    """One row for each exact, projection or series group: group_id, relation, files (sorted by period, then name)."""
    kept = groups.where(F.col("relation").isin(EXACT, PROJECTION, SERIES))
    rows = kept.groupBy("group_id", "relation").agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("relation") == SERIES, F.col("period")).alias("p"), "doc_id"))).alias("m"))
    return rows.select("group_id", "relation", F.transform("m", lambda x: x["doc_id"]).alias("files"))


def write_json(payload: dict, path: str) -> None:
    """A new local file, complete or not there; never over another one."""
    if os.path.exists(path):
        raise FileExistsError(path)
    with open(part := f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, indent=2)
    os.replace(part, path)
