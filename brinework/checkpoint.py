"""Cutting lineage with tables written to the shared checkpoint folder.

Iterative operators and operators that use an intermediate result more than
once write it as Parquet below ``spark.checkpoint.dir`` and read it back.  The
folder is shared by all executors, so a lost executor costs no recomputation
of earlier rounds, and the columnar files keep statistics for later plans.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
#: Folders of all workspaces of this process.
_ROOTS: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one of our own where it is unset.

    On a cluster a folder of the driver's machine isn't shared, so there the
    setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    if not _OWN_DIR:
        own = tempfile.mkdtemp(prefix="brinework-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_DIR.append("file://" + own)
    return _OWN_DIR[0]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> int:
    """Deletes the tables of every workspace of this process and gives their number.

    For between jobs: results that were returned and not yet written read them.
    """
    done = len(_ROOTS)
    while _ROOTS:
        _delete(spark, _ROOTS.pop())
    return done


class Workspace:
    """Written intermediate tables of one operator call.

    ``cut`` writes and reads back; ``drop`` deletes a table that no later plan
    reads.  Tables that a returned (lazy) result still reads must stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _ROOTS.append(self.root)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")
