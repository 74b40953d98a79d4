"""Delimited extracts and cohort lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def read_extract(spark: SparkSession, folder: str, prefix: str, schema: str | T.StructType,
                 recursive: bool = False, **options: str) -> DataFrame:
    """All files whose name starts with `prefix`, as one table; '.gz' files are read as they are.
    Each file's header has to agree with the schema, so a shifted column fails instead of passing."""
    reader = (
        spark.read.schema(_struct(schema))
        .option("header", True).option("enforceSchema", False)
        .option("pathGlobFilter", f"{prefix}*")
        .option("recursiveFileLookup", recursive)
    )
    return reader.options(**options).csv(folder)


def read_typed_csv(spark: SparkSession, path: str, schema: str | T.StructType, date_format: str = "M/d/yyyy",
                   keep_corrupt: bool = True) -> DataFrame:
    """CSV with declared types and date format. Values that do not parse become NULL; the raw line is
    kept in `_corrupt_record` if wanted."""
    fields = _struct(schema)
    if keep_corrupt and CORRUPT not in fields.names:
        fields = T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(fields)
        .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("dateFormat", date_format)
        .csv(path)
    )


def read_positional(spark: SparkSession, path: str, schema: str | T.StructType, **options: str) -> DataFrame:
    """CSV whose columns are named by position; the header line is skipped and not believed."""
    return (
        spark.read.schema(_struct(schema)).option("header", True).option("enforceSchema", True)
        .options(**options).csv(path)
    )


def require_clean(df: DataFrame) -> DataFrame:
    """Make the query fail at the first row that did not parse, and drop the raw-line column. The message
    names all columns, so that all are parsed whichever of them a query needs."""
    values = F.to_json(F.struct(*(c for c in df.columns if c != CORRUPT)))
    bad = F.raise_error(F.concat(F.lit("line does not fit the schema: "), F.col(CORRUPT), F.lit(" -> "), values))
    return df.where(F.when(F.col(CORRUPT).isNull(), F.lit(True)).otherwise(bad.cast("boolean"))).drop(CORRUPT)
