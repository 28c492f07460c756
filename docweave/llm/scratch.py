"""Written intermediate tables in the cluster's shared folder.

``spark.checkpoint.dir`` names that folder; only where it is unset and Spark runs in
this process alone (tests, a laptop) a local one is made, on a cluster that is an error.  A staged table survives lost executors and cuts
the lineage.  ``Scratch.drop`` removes what a finished operator no longer needs;
the rest goes when the driver ends.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        jvm_dir = sc._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            found = jvm_dir.get()
    if not found and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="docweave-")
        sc.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; files in the shared folder do no harm
        pass


class Scratch:
    """Staged tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        _open.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self._paths.pop(id(df), None)
            if path:
                _delete(self.spark, path)


@atexit.register
def _cleanup() -> None:
    for spark, root in _open:
        _delete(spark, root)
