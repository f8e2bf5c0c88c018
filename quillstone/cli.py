"""``python -m quillstone.cli INPUT [--output FOLDER] [--auto-resolve] [--report FILE]``: the seed comes from QUILLSTONE_SEED."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.keyed import Pseudonyms
from .operators import reports
from .plans import batch


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser()
    p.add_argument("input")
    p.add_argument("--output")
    p.add_argument("--auto-resolve", action="store_true")
    p.add_argument("--no-strict", action="store_true")
    p.add_argument("--report")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    pseudo = Pseudonyms(spark, os.environ.get("QUILLSTONE_SEED", ""))
    d = batch.discover(spark, a.input, pseudo, a.auto_resolve)
    plans = batch.group_plans(d, pseudo, strict=not a.no_strict)
    states = batch.publish(batch.rewritten(d, plans, pseudo), a.output) if a.output else {}
    failed = d.documents.where("error_code is not null").count() + plans.where("error_code is not null").count() + sum(s != "GROUP_COMMITTED" for s in states.values())
    if a.report:
        files = d.documents.select(pseudo.token("report-file", F.col("doc_id"), 32).alias("id_archivo"), F.col("error_code").isNull().alias("exitoso"), F.col("error_code").alias("codigo_error"))
        rows = [r.asDict() for r in files.toLocalIterator()]
        related = [r.asDict() for r in reports.relation_rows(d.relations, pseudo).toLocalIterator()]
        reports.write_json({"version": 3, "archivos": rows, "relaciones": related, "resumen": {"archivos": len(rows), "fallidos": failed}}, a.report)
    return 2 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
