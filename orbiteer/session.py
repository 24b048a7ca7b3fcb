"""Session settings that the library's results rely on."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

#: Times are UTC without a zone; plans adapt to the sizes they meet.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "orbiteer", **settings: str) -> SparkSession:
    """A session with ``SETTINGS`` and, over them, ``settings`` (dots written as double underscores)."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; only where that is unset and the master is local, as
    in a test, a temporary one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="orbiteer-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")
