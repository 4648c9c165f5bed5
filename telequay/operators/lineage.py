"""Cut lineage where several branches of a job read one result."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode without that setting a temporary one for the session."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed in the folder that ``spark.checkpoint.dir`` names.

    So branches don't compute it again, plans stay small, and a lost executor costs
    nothing of it.  In local mode without that setting a temporary folder is used.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
