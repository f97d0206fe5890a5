"""Recorded runs: discovery, typed CSV load, normalisation, label-state files,
single readings (S1-S5, S11) and the projections applied on load (P2-P5, P7-P9)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.dims import ID_REMAP, map_lookup
from vigil.functions.schema import COIL_NAMES, LABEL_COLUMNS, sensor_schema
from vigil.operators.labels import add_elapsed, asof_join
from vigil.operators.timeline import Timeline

RUN_TL = Timeline(run="run_id", order=("Timestamp",), t="elapsed_seconds", label="ATTACK_ID")
BOOL_TRUE = ("true", "1", "1.0")
BOOL_FALSE = ("false", "0", "0.0")


def to_bool(c: Column) -> Column:
    """'True'/'False'/1/0 -> boolean; null stays null (P3, without the
    reference's null -> True coercion)."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*BOOL_TRUE), True).when(s.isin(*BOOL_FALSE), False)


def normalise_booleans(df: DataFrame, columns: list[str] | None = None,
                       exclude=("run_id", "ATTACK_ID", "ATTACK_NAME", "MITRE_ID")) -> DataFrame:
    """P3.  Given columns are cast; without a list, string/int columns whose
    non-null values all lie in the boolean value set are detected with ONE
    aggregation pass and cast.  Key and label columns are never touched."""
    if columns is None:
        cand = [c for c, t in df.dtypes if c not in exclude and t in ("string", "int", "bigint", "tinyint")]
        if not cand:
            return df
        allowed = BOOL_TRUE + BOOL_FALSE
        r = df.agg(*[F.coalesce(F.bool_and(F.lower(F.trim(F.col(c).cast("string"))).isin(*allowed)),
                                F.lit(False)).alias(c) for c in cand]).first()
        columns = [c for c in cand if r[c]]
    return df.select(*[to_bool(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def bools_to_int8(df: DataFrame) -> DataFrame:
    """boolean columns -> tinyint 0/1."""
    return df.select(*[F.col(c).cast("tinyint").alias(c) if t == "boolean" else F.col(c) for c, t in df.dtypes])


def drop_if_present(df: DataFrame, cols) -> DataFrame:
    """Drop listed columns that exist (P5)."""
    return df.drop(*[c for c in cols if c in df.columns])


def remap_classes(df: DataFrame, raw: str = "ATTACK_ID", out: str = "class_id", mapping=ID_REMAP) -> DataFrame:
    """Raw attack id -> dense class id (unmapped -> null) and binary label."""
    return df.withColumn(out, map_lookup(mapping, raw)).withColumn("is_attack", (F.col(raw) > 0).cast("int"))


def parse_timestamp(c: Column) -> Column:
    """ISO text -> TIMESTAMP_NTZ (wall clock; parse and cast back use the same
    zone, so the result does not depend on it); malformed -> null."""
    ts = F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))
    return ts.cast("timestamp_ntz")


def load_run(spark: SparkSession, path: str, run_id: int | None = None) -> DataFrame:
    """Typed CSV scan -> timestamp -> run id -> elapsed seconds -> booleans.
    Without ``run_id`` the run id comes from the file (see :func:`discover_runs`)."""
    df = spark.read.schema(sensor_schema()).option("header", True).option("mode", "PERMISSIVE").csv(path)
    df = df.withColumn("Timestamp", parse_timestamp(F.col("Timestamp")))
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(int(run_id)))
    df = normalise_booleans(df, COIL_NAMES)
    return add_elapsed(df, RUN_TL, "Timestamp")


def discover_runs(spark: SparkSession, root: str, name: str = "master_dataset.csv",
                  min_runs: int = 2) -> DataFrame:
    """Every ``name`` under ``root`` (recursive), else every ``*.csv``;
    run ids 1..n by sorted path.  The distinct file list is tiny (one row per
    file), so numbering it and broadcasting it back is bounded by the file
    count, not the data."""
    def read(glob):
        return (spark.read.schema(sensor_schema()).option("header", True)
                .option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(root)
                .withColumn("_path", F.col("_metadata.file_path")))
    df = read(name)
    if df.limit(1).count() == 0:
        df = read("*.csv")
    paths = df.select("_path").distinct()
    paths = paths.withColumn("run_id", F.dense_rank().over(Window.orderBy("_path")).cast("int"))
    n = paths.count()
    if n < min_runs:
        raise ValueError(f"need at least {min_runs} runs under {root}, found {n}")
    df = df.join(F.broadcast(paths), "_path").drop("_path")
    df = df.withColumn("Timestamp", parse_timestamp(F.col("Timestamp")))
    df = normalise_booleans(df, COIL_NAMES)
    return add_elapsed(df, RUN_TL, "Timestamp")


def load_dataset(spark: SparkSession, path: str, fmt: str = "parquet") -> tuple[DataFrame, dict]:
    """S3: error if missing; returns the frame and rows / columns / bytes."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    df = spark.read.format(fmt).option("header", True).load(path)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs) \
        if os.path.isdir(path) else os.path.getsize(path)
    return df, {"rows": df.count(), "columns": len(df.columns), "bytes": size}


def load_feature_table(spark: SparkSession, path: str, key: list[str], label: str) -> tuple[DataFrame, list[str]]:
    """One table holding key + features + label (no positional pairing of
    separate files); returns it and the feature column list."""
    df = spark.read.parquet(path)
    feats = [c for c in df.columns if c not in set(key) | {label}]
    return df, feats


LABEL_STATE_SCHEMA = "ATTACK_ID int, ATTACK_NAME string, MITRE_ID string, timestamp string, _corrupt_record string"


def read_label_states(spark: SparkSession, path: str) -> DataFrame:
    """Label-state JSON documents (one per file or line); corrupt or empty
    ones are dropped, so the previous state stays in force for the as-of join."""
    df = (spark.read.schema(LABEL_STATE_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    df = df.filter(F.col("_corrupt_record").isNull() & F.col("timestamp").isNotNull()).drop("_corrupt_record")
    return df.select(F.coalesce("ATTACK_ID", F.lit(0)).alias("ATTACK_ID"),
                     F.coalesce("ATTACK_NAME", F.lit("Normal")).alias("ATTACK_NAME"),
                     F.coalesce("MITRE_ID", F.lit("")).alias("MITRE_ID"),
                     parse_timestamp(F.col("timestamp")).alias("Timestamp"))


def label_readings(readings: DataFrame, states: DataFrame, run: str | None = None) -> DataFrame:
    """J4 applied to capture: each reading takes the latest label state at or
    before its timestamp; before the first state it is Normal (0)."""
    r = readings.drop(*[c for c in LABEL_COLUMNS if c in readings.columns])
    if run is None:
        r = r.withColumn("_run", F.lit(0))
        states = states.withColumn("_run", F.lit(0))
        run = "_run"
    tl = Timeline(run=run, order=("Timestamp",))
    j = asof_join(r, states, tl, LABEL_COLUMNS, prefix="")
    j = j.select(*[c for c in j.columns if c not in LABEL_COLUMNS],
                 F.coalesce("ATTACK_ID", F.lit(0)).alias("ATTACK_ID"),
                 F.coalesce("ATTACK_NAME", F.lit("Normal")).alias("ATTACK_NAME"),
                 F.coalesce("MITRE_ID", F.lit("T0")).alias("MITRE_ID"))
    return j.drop("_run") if "_run" in j.columns else j


def parse_reading(text: Column, ph_cols=("AIT_202",)) -> Column:
    """S11: 'k=v, k=v' -> map<string,double>; pH given as <= 14 is scaled x100."""
    m = F.str_to_map(F.regexp_replace(text, r"\s+", ""), F.lit(","), F.lit("="))
    m = F.transform_values(m, lambda k, v: v.cast("double"))
    return F.transform_values(m, lambda k, v: F.when(k.isin(*ph_cols) & (v <= 14), F.floor(v * 100).cast("double"))
                              .otherwise(v))
