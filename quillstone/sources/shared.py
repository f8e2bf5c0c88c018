"""Intermediate results in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder of ``spark.checkpoint.dir`` and read from there: cuts lineage, survives lost executors.

    A folder of its own is set only where the session names none, as in tests.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quillstone-"))
    return df.checkpoint()
