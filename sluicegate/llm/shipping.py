"""Session set-up for operators that run Python in tasks."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import sluicegate
from sluicegate.session import pin_session

_SHIPPED: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Pins the session, gives workers this package, and keeps batches of long texts small.

    The package goes through Spark's own file distribution, once per application, so tasks find it wherever
    the driver was started.
    """
    pin_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(sluicegate.__file__)))
        folder = os.path.realpath(tempfile.mkdtemp(prefix="sluicegate-code-"))
        ignored = shutil.ignore_patterns("__pycache__")
        shutil.copytree(f"{root}/sluicegate", f"{folder}/code/sluicegate", ignore=ignored)
        context.addPyFile(shutil.make_archive(f"{folder}/sluicegate", "zip", f"{folder}/code"))
        _SHIPPED.add(context.applicationId)
    return spark
