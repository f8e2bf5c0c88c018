"""Input files, manifests and retry reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".pdf", ".xls", ".xlsx", ".xlsm", ".xml")
GROUP_ID = r"^[A-Za-z0-9_.-]{1,128}$"
RFC_LIKE = r"(?i)^[A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3}$"


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def input_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, name, suffix, adapter, length, content of the supported files of one folder (not below it) or one file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    out = files.select("path", name.alias("name"), suffix_of(F.col("path")).alias("suffix"), "length", "content").where(F.col("suffix").isin(*suffixes))
    adapter = F.when(F.col("suffix") == ".xml", "xml").when(F.col("suffix") == ".pdf", "pdf").when(F.col("suffix") == ".xls", "xls").otherwise("xlsx")
    return out.withColumn("adapter", adapter)


def manifest(spark: SparkSession, text: str) -> DataFrame:
    """group_id, relation, file, entity_id, metadata_source of a JSON or YAML manifest; ValueError if it breaks a rule."""
    import re

    try:
        held = json.loads(text)
    except ValueError:
        import yaml

        held = yaml.safe_load(text)
    rows, seen, ids = [], set(), set()
    for section in ("groups", "series"):
        for g in (held or {}).get(section) or []:
            relation = g.get("relation", "series") if section == "groups" else "series"
            if not re.match(GROUP_ID, str(g.get("id", ""))) or re.match(RFC_LIKE, g["id"]) or g["id"] in ids:
                raise ValueError("bad or repeated group id")
            if relation not in ("exact_equivalent", "projection", "series"):
                raise ValueError("unknown relation")
            files = g.get("files") or []
            if len(files) < 2 or seen & set(files) or len(set(files)) < len(files):
                raise ValueError("a group needs two files or more, each in one group only")
            if g.get("metadata_source") and g["metadata_source"] not in files:
                raise ValueError("metadata_source is not among the files")
            if g.get("entity_id") and (not re.match(GROUP_ID, g["entity_id"]) or re.match(RFC_LIKE, g["entity_id"])):
                raise ValueError("bad entity id")
            ids.add(g["id"])
            seen |= set(files)
            rows += [(g["id"], relation, f, g.get("entity_id"), g.get("metadata_source")) for f in files]
    return spark.createDataFrame(rows, "group_id string, relation string, file string, entity_id string, metadata_source string")


def report_states(spark: SparkSession, path: str) -> DataFrame:
    """file_id, success of a version 3 report."""
    held = spark.read.schema("version int, archivos array<struct<id_archivo:string,exitoso:boolean>>").json(path, multiLine=True)
    return held.where("version = 3").select(F.explode("archivos").alias("a")).select(F.col("a.id_archivo").alias("file_id"), F.col("a.exitoso").alias("success"))
