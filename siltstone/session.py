"""Session defaults, and where work that must outlive an executor is written."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[*]", app: str = "siltstone", **conf: str) -> SparkSession:
    """A session with the defaults above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies under spark.checkpoint.dir. Where that is unset in local mode (tests, a laptop) a temporary
    folder of this machine is used, and the setting is made for the session; a cluster must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/siltstone-{uuid.uuid4().hex}"
    _to_remove.append((spark, path))
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as the session has cores, if its files give fewer (one row group is one task)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


_to_remove: list[tuple[SparkSession, str]] = []


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to a shared folder and read it back.

    The lineage ends at the files, so a lost executor costs no recomputation of what lies before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def remove_staged() -> None:
    """Remove the folders that this process has staged (at its end, if the session still lives)."""
    while _to_remove:
        spark, path = _to_remove.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the gateway may have gone by then
            return
