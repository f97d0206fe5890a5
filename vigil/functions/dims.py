"""Small dimension tables (fixed size, so broadcasting them is always safe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source system's registry.
# Raw attack ids and names:
ATTACK_REGISTRY = {
    0: "Normal",
    8: "Tank Overflow Attack",
    9: "Chemical Depletion Attack",
    10: "Membrane Damage Attack",
    11: "pH Manipulation Attack",
    12: "Slow Ramp Attack",
    13: "Reconnaissance Scan",
    14: "Denial of Service",
    15: "Replay Attack",
    16: "Valve Manipulation Attack",
}
# Raw attack id -> dense class id used by the classifiers:
ID_REMAP = {0: 0, 8: 1, 9: 2, 10: 3, 11: 4, 12: 5, 13: 6, 14: 7, 15: 8, 16: 9}
# Dense class id -> display name:
CLASS_NAMES = {
    0: "Normal Operation", 1: "Tank Overflow Attack", 2: "Chemical Depletion Attack",
    3: "Membrane Damage Attack", 4: "pH Manipulation Attack", 5: "Slow Ramp Attack",
    6: "Reconnaissance Scan", 7: "Denial of Service", 8: "Replay Attack",
    9: "Valve Manipulation Attack",
}
# Dense class id -> alert level:
ALERT_LEVELS = {0: "INFO", 1: "CRITICAL", 2: "HIGH", 3: "HIGH", 4: "CRITICAL",
                5: "HIGH", 6: "MEDIUM", 7: "MEDIUM", 8: "MEDIUM", 9: "HIGH"}
# Validator physical limits (raw units): column -> (min, max)
PHYSICAL_LIMITS = {
    "FIT_101": (0, 100), "LIT_101": (0, 1200), "AIT_202": (0, 1400),
    "DPIT_301": (0, 1000), "PIT_501": (0, 2500), "TEMP_101": (0, 500),
    "Acid_Tank_Level": (0, 100),
}
# Cleaner clip limits (raw units):
CLIP_LIMITS = {
    "LIT_101": (0, 1200), "LIT_301": (0, 1200), "LIT_401": (0, 1200),
    "AIT_202": (0, 1400), "DPIT_301": (0, 1000), "PIT_501": (0, 2500),
}
# Normal-state expected ranges (raw units):
NORMAL_RANGES = {"LIT_101": (200, 900), "AIT_202": (600, 850),
                 "DPIT_301": (0, 500), "PIT_501": (400, 1500)}
# Columns the training notebook drops (leaky counters, constants, metadata):
DEAD_COLS = [
    "UF_Last_Backwash", "Turbidity_UF", "UF_Runtime",
    "RO_Runtime", "RO_Fouling_Factor", "RO_Last_Cleaning",
    "TDS_Feed", "TDS_Permeate", "RO_Cleaning_Active",
    "Energy_P101", "Energy_P301", "Energy_P501", "Energy_Total",
    "P_102", "P_202", "P_204", "P_206",
    "P_301", "P_401", "P_404", "P_502", "P_603",
    "High_Fouling_Alarm", "System_Run",
    "Timestamp", "ATTACK_NAME", "MITRE_ID", "ts",
]
# Ensemble weights (gradient boosting, MLP, sequence model) and thresholds:
ENSEMBLE_WEIGHTS = (0.40, 0.35, 0.25)
ALERT_CONFIDENCE = 0.55
ALERT_COOLDOWN_S = 10.0
# ---------------------------------------------------------------------------


def map_lookup(mapping: dict, key, default=None) -> Column:
    """Literal map lookup; unmapped keys give ``default`` (null by default)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.try_element_at(m, key if isinstance(key, Column) else F.col(key))
    return v if default is None else F.coalesce(v, F.lit(default))


def literal_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small fixed table as a JVM-side literal relation (no Python RDD
    scan): ``ddl`` like ``"a int, b string, c array<string>"``."""
    from pyspark.sql.types import _parse_datatype_string
    schema = _parse_datatype_string(ddl)
    structs = []
    for r in rows:
        fields = []
        for v, f in zip(r, schema.fields):
            if isinstance(v, (list, tuple)):
                lit = F.array(*[F.lit(x) for x in v]).cast(f.dataType) if v else F.array().cast(f.dataType)
            else:
                lit = F.lit(v).cast(f.dataType)
            fields.append(lit.alias(f.name))
        structs.append(F.struct(*fields))
    return spark.range(1).select(F.inline(F.array(*structs)))


def dim(spark: SparkSession, mapping: dict, key: str, value: str, key_type="int",
        value_type="string") -> DataFrame:
    return literal_table(spark, list(mapping.items()), f"{key} {key_type}, {value} {value_type}")


def attack_registry(spark: SparkSession) -> DataFrame:
    return dim(spark, ATTACK_REGISTRY, "attack_id", "attack_name")


def limits_table(spark: SparkSession, limits: dict) -> DataFrame:
    return literal_table(spark, [(k, float(a), float(b)) for k, (a, b) in limits.items()],
                         "column string, lo double, hi double")


# Severity of each raw attack id in the remediation knowledge base.
ATTACK_SEVERITY = {8: "CRITICAL", 9: "HIGH", 10: "CRITICAL", 11: "HIGH", 12: "MEDIUM",
                   13: "MEDIUM", 14: "CRITICAL", 15: "HIGH", 16: "HIGH"}

REMEDIATION_SCHEMA = ("attack_id int, severity string, immediate array<string>, "
                      "investigation array<string>, prevention array<string>")


def remediation_table(spark: SparkSession, kb: dict | None = None) -> DataFrame:
    """Remediation dimension (J1): ``kb = {id: {severity, immediate[],
    investigation[], prevention[]}}``; defaults to the severities with no
    advice text.  Advice can also be loaded with :func:`read_remediation`."""
    kb = kb or {k: {"severity": v} for k, v in ATTACK_SEVERITY.items()}
    rows = [(int(k), v.get("severity"), v.get("immediate", []), v.get("investigation", []),
             v.get("prevention", [])) for k, v in kb.items()]
    return literal_table(spark, rows, REMEDIATION_SCHEMA)


def read_remediation(spark: SparkSession, path: str) -> DataFrame:
    """Remediation knowledge base from JSON lines with the schema above."""
    return spark.read.schema(REMEDIATION_SCHEMA).json(path)


def attach_dimension(df: DataFrame, dim_df: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Equi left join of a small, fixed-size dimension (broadcast) with
    defaults for missing keys (J1)."""
    out = df.join(F.broadcast(dim_df), key, "left")
    for c, d in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), d if isinstance(d, Column) else F.lit(d)))
    return out
