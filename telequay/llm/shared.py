"""Things several operators need: the shared folder, tables written to cut lineage, seeds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``.  Where that is unset in local mode (tests)
    a temporary folder is made once for the session and used instead; on a cluster
    there is no such folder, so an unset one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        base = _OWN[app]
    return f"{base.rstrip('/')}/tq-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    So its shuffle files are of no more use and go at once.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        fs, root = filesystem(path)
        fs.delete_dir(root)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI or plain path of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.removeprefix("file:"))


def uniform(*cols) -> F.Column:
    """A number in (0, 1) that only depends on the columns: 52 bits of an md5, plus a half.

    DuckDB can compute the same number, so sampled results have an oracle.
    """
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, n: int) -> list[str]:
    """n column names that ``df`` does not have, whatever their case."""
    taken = {c.lower() for c in df.columns}
    names = (f"tq_{i}" for i in range(len(taken) + n))
    return [x for x in names if x not in taken][:n]


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Repartition by the columns, or round-robin without any, at the session's width."""
    n = width(df.sparkSession)
    return df.repartition(n, *cols) if cols else df.repartition(n)
