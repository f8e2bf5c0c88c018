"""Incremental discovery: an extension, as batches of files are the only input that needs parity.

A file stream of new XML documents is parsed batch by batch; relations of a batch are inferred against the ledger rows kept
so far, so that each pair is judged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relations as R
from ..sources import xml


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New .xml files, in any case, of a folder as rows (path, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[xX][mM][lL]").load(path)


def start(source: DataFrame, history: str, relations_to: str, checkpoint: str):
    """Append each batch's ledger to ``history`` and its relations, new against all, to ``relations_to``."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        docs = xml.documents(rows).where("error_code is null").persist()
        new = xml.ledger(docs).where("line_error is null")
        meta = docs.select(F.col("path").alias("doc_id"), "owner_rfc", F.lit(None).cast("string").alias("owner_name"), "year", "month", F.lit(None).cast("date").alias("print_date"))
        new.write.mode("append").parquet(f"{history}/ledger")
        meta.write.mode("append").parquet(f"{history}/documents")
        found = R.infer_relations(spark.read.parquet(f"{history}/ledger"), spark.read.parquet(f"{history}/documents"))
        fresh = meta.select("doc_id")
        mine = found.join(fresh.withColumnRenamed("doc_id", "left"), "left", "left_semi").union(
            found.join(fresh.withColumnRenamed("doc_id", "right"), "right", "left_semi").select(*found.columns).join(fresh.withColumnRenamed("doc_id", "left"), "left", "left_anti").select(*found.columns)
        )
        mine.write.mode("append").parquet(relations_to)
        docs.unpersist()

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
