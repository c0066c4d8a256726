"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``).

Lineage is cut by writing Parquet there: unlike ``checkpoint()`` this computes
the plan once, compresses, and lets later scans prune columns.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset (tests), a folder of our own that goes when Python ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, folder, True)
        at = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None, once: bool = False) -> DataFrame:
    """``df`` as a Parquet table, reread with the schema it had: computed once, whatever is lost later.

    ``by`` makes a folder for each value of a column, so that scans read only those they ask for. ``once``: nothing
    else runs ``df``, so its shuffle files go when the table stands, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    if once:
        spark.conf.set(_CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        if once:
            spark.conf.set(_CLEANUP, before)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time for ``sweep``."""
    return len(_made)


def sweep(spark: SparkSession, since: int, keep: list[DataFrame]) -> None:
    """Deletes the tables written since the mark, except those that ``keep`` reads. For when all that is still to be computed comes from ``keep``."""
    bare = lambda path: (path.partition(":")[2] if ":" in path else path).lstrip("/")
    folders = {bare(f.rpartition("/")[0]) for df in keep for f in df.inputFiles()}
    used = folders | {f.rpartition("/")[0] for f in folders if "=" in f.rpartition("/")[2]}  # a folder for each value of a column
    for path in _made[since:]:
        if bare(path) not in used:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _made[since:] = [p for p in _made[since:] if bare(p) in used]
