"""Folders for streaming state and staged tables, on storage that all machines share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple] = []  # (JVM, Hadoop's configuration, path): usable after the session has stopped


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir or, where that is unset on one machine, under the
    warehouse; it goes when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path))
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: what several outputs share is computed once."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(jvm, conf, path: str) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clean() -> None:
    for own in _made:
        with contextlib.suppress(Exception):
            _remove(*own)
