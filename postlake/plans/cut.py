"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder named by spark.checkpoint.dir. Where none is named, a local
    master gets a folder of its own (tests) and any other master keeps the lineage."""
    sc = df.sparkSession.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            return df
        known = "file://" + tempfile.mkdtemp(prefix="postlake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return df.checkpoint()
