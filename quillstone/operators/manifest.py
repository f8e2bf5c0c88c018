"""Declared groups against what was found: missing files, files of no group, several tax ids under one name, content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize
from .relations import AMOUNTS, with_codes


def joined(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """manifest(group_id, file) with error_code: a declared file that isn't among documents(doc_id)."""
    held = documents.select(F.col("doc_id").alias("file")).distinct().withColumn("found", F.lit(True))
    return manifest.join(held, "file", "left").select("group_id", "file", F.when(F.col("found").isNull(), "MANIFEST_FILE_MISSING").alias("error_code"))


def unassigned(manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents that no declared group names."""
    return documents.join(manifest.select(F.col("file").alias("doc_id")).distinct(), "doc_id", "left_anti")


def names_with_several_ids(owners: DataFrame) -> DataFrame:
    """owners(name, rfc): name, rfcs (sorted): normalised names that occur with more than one tax id."""
    some = owners.select(normalize(F.col("name")).alias("name"), normalize(F.col("rfc")).alias("rfc")).where("name <> '' and rfc <> ''")
    return some.groupBy("name").agg(F.sort_array(F.collect_set("rfc")).alias("rfcs")).where(F.size("rfcs") > 1)


def content_keys(ledger: DataFrame) -> DataFrame:
    """doc_id, content: digest of the rows in their order, by normalised code and amounts."""
    row = F.concat_ws("|", "norm_code", *[F.coalesce(F.col(a), F.lit(0)).cast("string") for a in AMOUNTS])
    rows = with_codes(ledger).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_ord", row.alias("row")))).alias("rows"))
    return rows.select("doc_id", F.sha2(F.array_join(F.transform("rows", lambda x: x["row"]), "\n"), 256).alias("content"))


def schema_warning(namespace: Column, schema_location: Column) -> Column:
    """What is wrong with a schemaLocation: an odd number of tokens, or a location that isn't below its own namespace; else null."""
    tokens = F.filter(F.split(schema_location, r"\s+"), lambda t: t != "")
    pairs = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 2, F.lit(0)), F.lit(2))
    astray = F.exists(pairs, lambda i: (F.get(tokens, i) == namespace) & ~F.startswith(F.get(tokens, i + 1), namespace))
    return F.when(F.size(tokens) % 2 == 1, "SCHEMA_LOCATION_ODD_TOKEN_COUNT").when((F.size(tokens) > 0) & astray, "SCHEMA_LOCATION_NAMESPACE_MISMATCH")
