"""Writers: datasets, report tables, features, splits, episode reports (K1-K4, K8, K9)."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One line of text as a table, through Spark's writer: any store it knows."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path).first()["value"]


def append_rows(df: DataFrame, path: str, columns: list[str], fmt: str = "parquet") -> None:
    """K1: fixed column order, missing columns as null, append.  Spark's file
    commit replaces the reference's 100-row buffer."""
    have = set(df.columns)
    out = df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])
    out.write.mode("append").format(fmt).save(path)


def write_dataset(df: DataFrame, path: str, run: str = "run_id", sort: list[str] | None = None) -> None:
    """K2: partitioned by run (partition pruning on later reads), rows sorted
    by time inside each file."""
    if run in df.columns and sort:
        # by run and time range: a long run becomes several tasks and files
        w = df.repartitionByRange(run, *sort).sortWithinPartitions(run, *sort)
    else:
        w = df.sortWithinPartitions(*sort) if sort else df
    (w.write.mode("overwrite").partitionBy(run) if run in df.columns else w.write.mode("overwrite")).parquet(path)


def write_reports(reports: dict[str, DataFrame], folder: str) -> None:
    """K3: each report table as JSON lines under ``folder/<name>``."""
    for name, df in reports.items():
        df.write.mode("overwrite").json(os.path.join(folder, name))


def write_features(df: DataFrame, path: str, feature_cols: list[str]) -> None:
    """K4: one Parquet table plus the ordered feature list next to it."""
    df.write.mode("overwrite").parquet(path)
    write_text(df.sparkSession, os.path.join(path, "_feature_columns"), json.dumps(feature_cols))


def write_split(df: DataFrame, label: str, path: str, normal=0) -> None:
    """K8: normal-only and attack-only parts as partitions of one table."""
    df.withColumn("is_attack", (F.col(label) != normal).cast("int")).write.mode("overwrite").partitionBy("is_attack").parquet(path)


def write_episode_report(episodes: DataFrame, totals: DataFrame, path: str) -> None:
    """K9: episode table and totals as JSON."""
    episodes.write.mode("overwrite").json(os.path.join(path, "episodes"))
    totals.write.mode("overwrite").json(os.path.join(path, "totals"))
