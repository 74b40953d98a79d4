"""Session settings, and stable copies of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def build_session(app: str = "anchorline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; `master` stays the cluster's if not given."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false").config(
        "spark.ui.showConsoleProgress", "false"
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings. Warehouse times carry no zone, so the session is pinned to UTC; AQE may
    split a skewed join even if an aggregate above it then needs one more shuffle. The number of shuffle partitions
    is left to the session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A table of a few driver-made rows. It goes through Arrow into the plan itself, so Spark knows its size."""
    names = T.StructType.fromDDL(schema).names
    return spark.createDataFrame(pd.DataFrame(list(rows), columns=names, dtype=object), schema)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster. Only local mode may fall back on a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="anchorline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_MADE: ContextVar[list[str] | None] = ContextVar("paths of the open scratch block", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one written table in the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _MADE.get() is not None:
        _MADE.get().append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within this block queries are built and their results written; at its end the tables that they have written
    to the shared folder on the way are deleted. Results that are not written yet cannot be read afterwards."""
    token = _MADE.set([])
    try:
        yield
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        hadoop = spark._jvm.org.apache.hadoop.fs
        for path in made:
            place = hadoop.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stable(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and go on from there: work is not repeated, and a lost executor
    cannot make it come out differently. Column names and types are kept."""
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
