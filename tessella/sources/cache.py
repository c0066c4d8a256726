"""Tables that are kept between sessions, under a key of what they are made from.

A table's key has two parts. The first is a digest of the plans of its inputs (without the numbers that Spark gives expressions anew each
time) and of a specification, the second one of the input files' paths, sizes and times. A table with both is read again; when one
with the same first part is written, those with another second part are stale and go. Inputs that don't come from
files alone have no versions, so nothing is kept for them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .shared import shared_dir, written

_NUMBERS = re.compile(r"#\d+L?|(?<=plan_id=)\d+|(?<=namedlambdavariable\()\)|\b[xyz]_\d+\b")
#: Leaves of a plan whose rows are in no file.
_LOOSE = re.compile(r"LogicalRDD|LocalRelation|LocalTableScan|ExistingRDD|StreamingRelation")


def _digest(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:24]


class Cache:
    """Kept tables below a folder that all executors share; ``hits`` and ``misses`` count this object's requests."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or f"{shared_dir(spark)}/kept").rstrip("/")
        self.hits = self.misses = 0

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, inputs: list[DataFrame]) -> str:
        """Paths, sizes and times of all input files, from one listing of each of their folders."""
        files = sorted({f for df in inputs for f in df.inputFiles()})
        known = {}
        for folder in sorted({f.rpartition("/")[0] for f in files}):
            path, fs = self._path(folder.replace("%20", " "))
            for status in fs.listStatus(path):
                known[status.getPath().getName()] = known.get(status.getPath().getName(), ()) + ((folder, status.getLen(), status.getModificationTime()),)
        return json.dumps([[f, sorted(known.get(f.rpartition("/")[2], ()))] for f in files])

    def key(self, inputs: list[DataFrame], spec: object) -> tuple[str, str] | None:
        """Both parts of the key; None where an input's rows are not all from files."""
        plans = [df._jdf.queryExecution().analyzed().toString() for df in inputs]
        if any(_LOOSE.search(p) for p in plans) or not all(df.inputFiles() for df in inputs):
            return None
        schemas = [df.schema.json() for df in inputs]
        return _digest(*[_NUMBERS.sub("", p) for p in plans], *schemas, json.dumps(spec, sort_keys=True, default=str)), _digest(self._versions(inputs))

    def table(self, name: str, inputs: list[DataFrame], spec: object, build: Callable[[], DataFrame]) -> DataFrame:
        """The table that ``build`` makes of ``inputs`` as ``spec`` says: kept if there is one, else built, written and kept."""
        key = self.key(inputs, spec)
        if key is None:
            return written(build(), name)
        at = f"{self.folder}/{name}-{key[0]}-{key[1]}"
        path, fs = self._path(at)
        if fs.exists(self._path(f"{at}/_SUCCESS")[0]):
            self.hits += 1
            return self.spark.read.parquet(at)
        self.misses += 1
        new = f"{self.folder}/_{uuid.uuid4().hex}"  # renamed when complete, so that a table is there as a whole or not at all
        df = build()
        df.write.option("compression", "zstd").parquet(new)
        self._drop(f"{name}-{key[0]}-")
        fs.rename(self._path(new)[0], path)
        return self.spark.read.schema(df.schema).parquet(at)

    def _drop(self, prefix: str) -> None:
        path, fs = self._path(self.folder)
        for status in fs.listStatus(path) if fs.exists(path) else ():
            if status.getPath().getName().startswith(prefix):
                fs.delete(status.getPath(), True)

    def tables(self) -> list[str]:
        """Names of the kept tables."""
        path, fs = self._path(self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if not s.getPath().getName().startswith("_")) if fs.exists(path) else []

    def clear(self, name: str | None = None) -> None:
        """Deletes all kept tables, or those of one name."""
        for kept in self.tables():
            if name is None or kept.startswith(f"{name}-"):
                self._drop(kept)
