"""Small helpers that several operators share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import anchorline
from anchorline.session import configure


def ship_package(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless they find it on their own path. Once for each context."""
    root = Path(anchorline.__file__).parent
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sent = getattr(spark.sparkContext, "_anchorline_sent", False)
    if sent or root.parent.resolve() in known or "site-packages" in root.parts:
        return
    file = Path(tempfile.mkdtemp(prefix="anchorline-code-"), "anchorline.zip")  # Spark serves it from the driver
    with zipfile.ZipFile(file, "w") as packed:
        for source in sorted(root.rglob("*.py")):
            packed.write(source, Path("anchorline", source.relative_to(root)))
    spark.sparkContext.addPyFile(str(file))
    spark.sparkContext._anchorline_sent = True


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings for text rows, which are large: Python workers get a few hundred at a time."""
    configure(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply a function of column lists to each Arrow batch of `df`; the result has `schema`."""
    want = df.sparkSession.createDataFrame([], schema).schema
    arrow = None

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        if arrow is None:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(want)
        for part in parts:
            made = rows(part.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(batches, want)
