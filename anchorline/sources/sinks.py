"""Writers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def write_groups(df: DataFrame, path: str, by: str = "event_group", compression: str = "gzip",
                 mode: str = "errorifexists") -> None:
    """Flat files, one folder per group. Large groups become several files, written in parallel."""
    (
        df.write.mode(mode).partitionBy(by)
        .option("header", True).option("compression", compression).csv(path)
    )


def write_datasets(frames: Mapping[str, DataFrame], path: str, fmt: str = "parquet",
                   mode: str = "errorifexists") -> dict[str, str]:
    """One folder per named table; returns {name: folder}."""
    written = {}
    for name, df in frames.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(target)
        written[name] = target
    return written
