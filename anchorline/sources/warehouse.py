"""The clinical warehouse tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "encntr_alias": "encntr_id long, alias string, encntr_alias_type_cd long",
    "encounter": "encntr_id long, person_id long, reg_dt_tm timestamp_ntz, disch_dt_tm timestamp_ntz, "
                 "reason_for_visit string",
    "person": "person_id long, birth_dt_tm timestamp_ntz, race_cd long, sex_cd long",
    "clinical_event": "event_id long, parent_event_id long, encntr_id long, person_id long, event_cd long, "
                      "event_class_cd long, event_end_dt_tm timestamp_ntz, result_val string, "
                      "result_units_cd long, valid_until_dt_tm timestamp_ntz",
    "ce_date_result": "event_id long, result_dt_tm timestamp_ntz, valid_until_dt_tm timestamp_ntz",
    "ce_med_result": "event_id long, admin_dosage double, dosage_unit_cd long, infusion_rate double, "
                     "infusion_unit_cd long, iv_event_cd long",
    "code_value": "code_value long, display string",
    "orders": "order_id long, encntr_id long, catalog_cd long, current_start_dt_tm timestamp_ntz",
    "order_detail": "order_id long, oe_field_meaning_id long, oe_field_display_value string, "
                    "updt_dt_tm timestamp_ntz",
}


class Tables:
    """The warehouse tables as attributes, each opened at its first use: a query lists the files of the
    tables it reads, and of no others."""

    encntr_alias: DataFrame
    encounter: DataFrame
    person: DataFrame
    clinical_event: DataFrame
    ce_date_result: DataFrame
    ce_med_result: DataFrame
    code_value: DataFrame
    orders: DataFrame
    order_detail: DataFrame

    def __init__(self, scan: Callable[[str], DataFrame]):
        self._scan = scan

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        table = self._scan(name)
        setattr(self, name, table)
        return table


def load(spark: SparkSession, folder: str, fmt: str = "parquet") -> Tables:
    """Scans of `folder`/<table> with declared schemas; nothing is inferred."""
    root = folder.rstrip("/")
    return Tables(lambda name: spark.read.schema(SCHEMAS[name]).format(fmt).load(f"{root}/{name}"))
