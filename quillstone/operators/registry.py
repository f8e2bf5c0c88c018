"""Persistent assignments of synthetic values: unique within a namespace, one writer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGNMENTS = "namespace string, identifier_hmac string, token_type string, synthetic_value string, algorithm_version int"


def upsert(existing: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved, new rows, collisions).

    resolved: every asked row with the value that holds for it; new rows: to append to the table; collisions: asked
    identifiers whose value another identifier has (namespace, identifier_hmac, synthetic_value), not assigned.
    The smallest identifier keeps a value that several new ones ask for.
    """
    keys = ["namespace", "identifier_hmac", "algorithm_version"]
    asked = asked.groupBy(*keys).agg(F.min("token_type").alias("token_type"), F.min("synthetic_value").alias("synthetic_value"))
    held = existing.select(*keys, F.col("synthetic_value").alias("held"))
    joined = asked.join(held, keys, "left")
    fresh = joined.where("held is null").drop("held")
    taken = existing.select("namespace", "synthetic_value", "algorithm_version", F.lit("").alias("first"))
    claims = fresh.groupBy("namespace", "synthetic_value", "algorithm_version").agg(F.min("identifier_hmac").alias("first"))
    owner = taken.unionByName(claims).groupBy("namespace", "synthetic_value", "algorithm_version").agg(F.min("first").alias("owner"))
    judged = fresh.join(owner, ["namespace", "synthetic_value", "algorithm_version"])
    new = judged.where("owner = identifier_hmac").select("namespace", "identifier_hmac", "token_type", "synthetic_value", "algorithm_version")
    collided = judged.where("owner <> identifier_hmac").select("namespace", "identifier_hmac", "synthetic_value")
    resolved = joined.where("held is not null").select(*keys, "token_type", F.col("held").alias("synthetic_value")).unionByName(new.select(*keys, "token_type", "synthetic_value"))
    return resolved, new, collided


def collisions(assignments: DataFrame) -> DataFrame:
    """Synthetic values that more than one identifier of a namespace maps to."""
    return assignments.groupBy("namespace", "synthetic_value").agg(F.countDistinct("identifier_hmac").alias("identifiers")).where("identifiers > 1")


def append(new: DataFrame, path: str) -> None:
    """Append to the table at ``path``: the caller is the one writer."""
    new.write.mode("append").partitionBy("algorithm_version").parquet(path)
