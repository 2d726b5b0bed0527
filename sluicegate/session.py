"""Session settings and shared scratch space."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def pin_session(spark: SparkSession) -> SparkSession:
    """Settings every plan here relies on; all can be changed on a running session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


_GIVEN: dict[str, list[str]] = {}


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sluicegate-")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the cluster's shared checkpoint folder.

    That is ``spark.checkpoint.dir``, or else the folder set with ``setCheckpointDir``. Only a session whose
    tasks all run on this machine (a laptop, a test) may name none; it gets a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if re.fullmatch(r"local(\[[^\[\]]*\])?", context.master) is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    folder = f"{root.rstrip('/')}/sluicegate-{uuid.uuid4().hex}"
    _GIVEN.setdefault(context.applicationId, []).append(folder)
    return folder


def drop_stored(spark: SparkSession) -> int:
    """Delete every folder that :func:`shared_dir` has named in this application; the number deleted.

    Results that still read them must have been written or collected.
    """
    files, conf, dropped = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), 0
    for folder in _GIVEN.pop(spark.sparkContext.applicationId, []):
        path = files.Path(folder)
        dropped += bool(path.getFileSystem(conf).delete(path, True))
    return dropped


def ensure_checkpoints(spark: SparkSession) -> None:
    """Long iterative jobs (boosting) need a checkpoint folder to cut their lineage."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: its readers no longer depend on
    the upstream plan, nor on any executor that computed it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
