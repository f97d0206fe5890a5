"""Sensor-run data model: register / coil dictionaries and the 84-column schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Holding registers in address order (address = list index):
# (name, scale, unit).  Engineering value = raw / scale.
REGISTERS = [
    ("FIT_101", 10, "m3/h"), ("LIT_101", 1, "L"), ("MV_101", 1, ""),
    ("AIT_201", 10, "NTU"), ("AIT_202", 100, "pH"), ("AIT_203", 1, "mV"),
    ("FIT_201", 10, "m3/h"), ("MV_201", 1, ""), ("Acid_Tank_Level", 1, "%"),
    ("Chlorine_Tank_Level", 1, "%"), ("Coagulant_Tank_Level", 1, "%"), ("Bisulfate_Tank_Level", 1, "%"),
    ("DPIT_301", 10, "kPa"), ("FIT_301", 10, "m3/h"), ("LIT_301", 1, "L"),
    ("MV_301", 1, ""), ("MV_302", 1, ""), ("MV_303", 1, ""), ("MV_304", 1, ""),
    ("UF_Runtime", 1, "s"), ("UF_Fouling_Factor", 1, "%"), ("UF_Last_Backwash", 1, "s"),
    ("Turbidity_UF", 10, "NTU"),
    ("AIT_401", 10, "mg/L"), ("AIT_402", 1, "mV"), ("FIT_401", 10, "m3/h"), ("LIT_401", 1, "L"),
    ("AIT_501", 1, "uS/cm"), ("AIT_502", 1, "mV"), ("AIT_503", 1, "ppb"), ("AIT_504", 100, "pH"),
    ("FIT_501", 10, "m3/h"), ("FIT_502", 10, "m3/h"), ("FIT_503", 10, "m3/h"), ("FIT_504", 10, "m3/h"),
    ("PIT_501", 10, "bar"), ("PIT_502", 10, "bar"), ("PIT_503", 10, "bar"),
    ("RO_Runtime", 1, "s"), ("RO_Fouling_Factor", 1, "%"), ("RO_Last_Cleaning", 1, "s"),
    ("TDS_Feed", 1, "ppm"), ("TDS_Permeate", 1, "ppm"),
    ("FIT_601", 10, "m3/h"),
    ("Water_Temperature", 10, "C"), ("Ambient_Temperature", 10, "C"),
    ("Energy_P101", 1, "kWh"), ("Energy_P301", 1, "kWh"), ("Energy_P501", 1, "kWh"), ("Energy_Total", 1, "kWh"),
    ("Turbidity_Raw", 10, "NTU"), ("Chlorine_Residual", 10, "mg/L"),
]
# Coils in address order (address = list index): (name, type).
COILS = [
    ("P_101", "pump"), ("P_102", "pump"), ("P_201", "pump"), ("P_202", "pump"), ("P_203", "pump"),
    ("P_204", "pump"), ("P_205", "pump"), ("P_206", "pump"), ("P_301", "pump"), ("P_302", "pump"),
    ("P_401", "pump"), ("P_402", "pump"), ("P_403", "pump"), ("P_404", "pump"), ("UV_401", "device"),
    ("P_501", "pump"), ("P_502", "pump"), ("P_601", "pump"), ("P_602", "pump"), ("P_603", "pump"),
    ("UF_Backwash_Active", "state"), ("RO_Cleaning_Active", "state"),
    ("Chemical_Low_Alarm", "alarm"), ("High_Fouling_Alarm", "alarm"), ("Energy_Monitor_Enable", "config"),
    ("High_Level_Alarm", "alarm"), ("High_Pressure_Alarm", "alarm"), ("System_Run", "state"),
]
LABEL_COLUMNS = ["ATTACK_ID", "ATTACK_NAME", "MITRE_ID"]
# ---------------------------------------------------------------------------

REGISTER_NAMES = [r[0] for r in REGISTERS]
COIL_NAMES = [c[0] for c in COILS]
INT_REGISTERS = {n for n in REGISTER_NAMES if n.startswith("MV_")}


def sensor_schema(timestamp_as_string: bool = True) -> T.StructType:
    """Timestamp + 52 registers + 28 coils + 3 labels = 84 columns, as written
    by the logger (registers already divided by their scale)."""
    fields = [T.StructField("Timestamp", T.StringType() if timestamp_as_string else T.TimestampType())]
    for n in REGISTER_NAMES:
        fields.append(T.StructField(n, T.IntegerType() if n in INT_REGISTERS else T.DoubleType()))
    for n in COIL_NAMES:
        fields.append(T.StructField(n, T.StringType()))   # 'True'/'False'/1/0 on disk; normalised on load
    fields += [T.StructField("ATTACK_ID", T.IntegerType()), T.StructField("ATTACK_NAME", T.StringType()),
               T.StructField("MITRE_ID", T.StringType())]
    return T.StructType(fields)


def register_table(spark: SparkSession) -> DataFrame:
    from vigil.functions.dims import literal_table
    return literal_table(spark, [(n, i, s, u) for i, (n, s, u) in enumerate(REGISTERS)],
                         "name string, address int, scale int, unit string")


def coil_table(spark: SparkSession) -> DataFrame:
    from vigil.functions.dims import literal_table
    return literal_table(spark, [(n, i, t) for i, (n, t) in enumerate(COILS)],
                         "name string, address int, type string")


def decode_registers(raw: Column, registers=REGISTERS) -> list[Column]:
    """Array of raw register ints (address order) -> named engineering values
    raw / scale; scale 1 keeps the integer (P10)."""
    out = []
    for i, (n, s, _) in enumerate(registers):
        v = F.try_element_at(raw, F.lit(i + 1))
        out.append((v if s == 1 else v.cast("double") / s).alias(n))
    return out


def decode_coils(bits: Column, coils=COILS) -> list[Column]:
    """Array of coil bits (address order) -> named booleans (P10)."""
    return [F.try_element_at(bits, F.lit(i + 1)).cast("boolean").alias(n) for i, (n, _) in enumerate(coils)]


def encode_value(x: Column, scale: int) -> Column:
    """Inverse scaling int(x * scale), truncating like ``int()`` (P10)."""
    return (x * scale).cast("long") if scale != 1 else x.cast("long")


def identify(df: DataFrame, address_col: str, dictionary: DataFrame, out: str = "name") -> DataFrame:
    """Address -> name reverse lookup, 'Unknown' default (P11).  The
    dictionary is a fixed 52 / 28 row table, so the broadcast is bounded."""
    d = dictionary.select(F.col("address").alias("_addr"), F.col("name").alias(out))
    j = df.join(F.broadcast(d), F.col(address_col) == F.col("_addr"), "left").drop("_addr")
    return j.withColumn(out, F.coalesce(F.col(out), F.lit("Unknown")))
