"""Code lists, names and limits of the study."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from anchorline.session import small_table

# ---- Fixed values: results are only right with exactly these. ----

# Warehouse codes
ACCOUNT_ALIAS = 619
CLASS_DATE = 99985
CLASS_NUMERIC = 159
CLASS_MED = 158
INDEX_START = 1149292336
INDEX_STOP = 1149297359
RESUSCITATION_ORDERS = [356259461, 2985032863, 2985032927]
RESUSCITATION_DETAIL = 229
WEIGHT = 30107
KILOGRAM = 170

# Rows that end later than this day are the current version
OPEN_ENDED_AFTER = dt.date(2099, 12, 31)

ELECTROLYTES = {
    30724: "Calcium Lvl",
    32170: "Potassium Lvl",
    32387: "Magnesium Lvl",
    522187789: "Ca Ion WB",
}

VITALS = {
    31806: "Hct",
    31854: "Hgb",
    30098: "Systolic Blood Pressure",
    134401648: "Arterial Systolic BP 1",
    30065: "Peripheral Pulse Rate",
    119822527: "Apical Heart Rate",
    30094: "Respiratory Rate",
    10739818: "SpO2 percent",
}

TEMPERATURES = {
    30100: "Temperature",
    119822492: "Temperature Tympanic",
    119822505: "Temperature Rectal",
    119822517: "Temperature Axillary",
    119822523: "Temperature Intravascular",
    119822536: "Temperature Oral",
    172563303: "Temperature Skin",
    172563306: "Temperature Esophageal",
    172563327: "Temperature Brain",
    263779626: "Temperature Bladder",
    10679282: "Temperature Sensor",
}

ARTERIAL_PRESSURES = {
    119822453: "Mean Arterial Pressure",
    173814326: "Mean Arterial Pressure (Invasive)",
}

HEART_RATES = {
    30065: "Peripheral Pulse Rate",
    119822527: "Apical Heart Rate",
}

SEVERITY = {
    31806: "Hct",
    10662250: "FIO2 (%)",
    30094: "Respiratory Rate",
    53807854: "POC A pH",
    31090: "Creatinine Lvl",
    32170: "Potassium Lvl",
    32619: "Sodium Lvl",
    34402: "WBC",
    134422765: "Glasgow Coma Score",
}

RESUSCITATION_MEDS = {
    37556392: "calcium chloride",
    37556106: "AMIODarone",
    37558066: "sodium bicarbonate",
    37556849: "EPINephrine",
    37556042: "adenosine",
    37556077: "alteplase",
    37557428: "lidocaine",
    37557691: "norepinephrine",
    37557816: "phenylephrine",
    37558389: "DOPamine",
    63003651: "DOBUTamine",
    37556211: "atropine",
    37558405: "Dextrose 50% in Water IV",
    37557486: "magnesium sulfate",
    37557647: "naloxone",
    37557668: "neostigmine",
    37556992: "flumazenil",
}

# Names used after lower-casing
ANTIARRHYTHMICS = ["amiodarone", "lidocaine"]
EVENT_MEDS = [
    "amiodarone",
    "lidocaine",
    "dopamine",
    "norepinephrine",
    "epinephrine",
    "phenylephrine",
    "vasopressin",
    "dobutamine",
    "milrinone",
]
# The anchor binds to the first branch only
ELECTROLYTE_MEDS_PATTERN = r"^potassium|phosphate|calcium chloride|calcium gluconate|magnesium sulfate"
CHARTED_MEDICATION_PATTERN = r"^CPR Medication"
EXCLUDED_FACILITY = "SE Southeast"
EXCLUDED_DISPOSITION = "Cadaver Organ Donor"
INPATIENT = "Inpatient"

# Measurement groups: (group, names, low, high); keep low <= x < high. A third mark "exclusive"
# makes the low end open. `None` means no limit.
EVENT_GROUPS = [
    ("sbp", ["systolic blood pressure", "arterial systolic bp 1"], 40.0, 300.0, "inclusive"),
    ("dbp", ["diastolic blood pressure", "arterial diastolic bp 1"], 20.0, 200.0, "inclusive"),
    ("map", ["mean arterial pressure (invasive)", "mean arterial pressure"], 20.0, 200.0, "inclusive"),
    ("hr", ["apical heart rate", "peripheral pulse rate"], 0.0, None, "exclusive"),
    ("rr", ["respiratory rate"], 3.0, 50.0, "inclusive"),
    ("spo2", ["spo2 percent"], 0.0, None, "exclusive"),
    ("hgb", ["hgb"], None, None, "inclusive"),
    ("hct", ["hct"], None, None, "inclusive"),
]
TEMPERATURE_GROUP = "temp"
TEMPERATURE_WORD = "temperature"

# Ids per extract batch
EXTRACT_BATCH = 75

# ---- End of fixed values. ----

CONCEPT_SETS = {
    "electrolytes": ELECTROLYTES,
    "vitals": VITALS,
    "temperatures": TEMPERATURES,
    "arterial_pressures": ARTERIAL_PRESSURES,
    "heart_rates": HEART_RATES,
    "severity": SEVERITY,
    "resuscitation_meds": RESUSCITATION_MEDS,
}


def concepts_table(spark: SparkSession) -> DataFrame:
    """The code lists as one small table (concept_set, code, display)."""
    rows = [(name, code, text) for name, codes in CONCEPT_SETS.items() for code, text in codes.items()]
    return small_table(spark, rows, "concept_set string, code long, display string")


def limits_table(spark: SparkSession) -> DataFrame:
    """The measurement groups as one small table, one row per event name."""
    rows = [
        (group, name, low, high, mark == "exclusive")
        for group, names, low, high, mark in EVENT_GROUPS
        for name in names
    ]
    return small_table(
        spark, rows, "event_group string, event string, low double, high double, low_open boolean"
    )
