"""Resolve, restrict and extend the cohort."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions.concepts import ACCOUNT_ALIAS
from anchorline.operators.firsts import first_rows, nulls_last
from anchorline.session import small_table


def cohort_from_list(spark: SparkSession, ids: Iterable, key: str = "alias", key_type: str = "string") -> DataFrame:
    """A cohort typed in by hand. Large cohorts are read as tables instead."""
    return small_table(spark, ((i,) for i in dict.fromkeys(ids)), f"{key} {key_type}")


def resolve_cohort(ids: DataFrame, encntr_alias: DataFrame, encounter: DataFrame,
                   alias_type: int = ACCOUNT_ALIAS, extra: Sequence[str] = ()) -> DataFrame:
    """Account numbers -> encounters: distinct (encntr_id, person_id, alias, *extra)."""
    wanted = (
        encntr_alias.where(F.col("encntr_alias_type_cd") == F.lit(alias_type))
        .select("encntr_id", "alias")
        .join(ids.select("alias"), "alias", "left_semi")
    )
    return (
        wanted.join(encounter.select("encntr_id", "person_id", *extra), "encntr_id")
        .select("encntr_id", "person_id", "alias", *extra)
        .distinct()
    )


def restrict(df: DataFrame, cohort: DataFrame, on: str | list[str]) -> DataFrame:
    """Keep rows whose key is in the cohort; never multiplies rows."""
    return df.join(cohort, on, "left_semi")


def attach(df: DataFrame, facts: DataFrame, on: str | list[str]) -> DataFrame:
    """Left-outer attach of facts; subjects without a fact stay, several facts give several rows."""
    return df.join(facts, on, "left")


def first_anchor(df: DataFrame, key: str, anchor: str, tie: Sequence[str] = (),
                 drop_null_key: bool = False) -> DataFrame:
    """Earliest anchor row per subject; rows without a subject id together count as one subject."""
    if drop_null_key:
        df = df.where(F.col(key).isNotNull())
    return first_rows(df, [key], [nulls_last(anchor), *tie])
