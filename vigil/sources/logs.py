"""Text logs written by the capture jobs, scanned into typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEDULE_RE = r"\[\s*(\d+)\]\s+(.+?)\s+@\s+([0-9.]+)\s*min\s+dur=\s*(\d+)s"
EXEC_RE = r"^\[([0-9-]+ [0-9:]+)\] \[(\w+)\] (.*)$"


def read_schedule(spark: SparkSession, path: str) -> DataFrame:
    """``[ n] name @ m min dur= s`` lines -> seq, attack_name, start_min,
    duration_s, start_s, end_s (S6); other lines are skipped."""
    t = spark.read.text(path).withColumn("_path", F.col("_metadata.file_path"))
    ok = t.filter(F.col("value").rlike(SCHEDULE_RE))
    g = lambda i: F.regexp_extract("value", SCHEDULE_RE, i)
    out = ok.select("_path", g(1).cast("int").alias("seq"), F.trim(g(2)).alias("attack_name"),
                    g(3).cast("double").alias("start_min"), g(4).cast("int").alias("duration_s"))
    out = out.dropDuplicates(["_path", "seq"])
    return (out.withColumn("start_s", F.col("start_min") * 60)
               .withColumn("end_s", F.col("start_min") * 60 + F.col("duration_s"))
               .withColumnRenamed("_path", "source"))


def read_execution_log(spark: SparkSession, path: str) -> DataFrame:
    """``[ts] [LEVEL] msg`` lines -> ts, level, event, attack_name,
    duration_s, rows (S7).  event in START / COMPLETE / FAILED / ROWS / OTHER."""
    t = spark.read.text(path).withColumn("source", F.col("_metadata.file_path"))
    ok = t.filter(F.col("value").rlike(EXEC_RE))
    g = lambda i: F.regexp_extract("value", EXEC_RE, i)
    x = ok.select("source", F.to_timestamp(g(1), "yyyy-MM-dd HH:mm:ss").alias("ts"),
                  g(2).alias("level"), g(3).alias("msg"))
    start = F.regexp_extract("msg", r"ATTACK START: (.+?) \((\d+)s\)", 1)
    dur = F.regexp_extract("msg", r"ATTACK START: (.+?) \((\d+)s\)", 2)
    comp = F.regexp_extract("msg", r"ATTACK COMPLETE: (.+)$", 1)
    fail = F.regexp_extract("msg", r"ATTACK FAILED: (.+)$", 1)
    rows = F.regexp_extract("msg", r"^Rows: (\d+)", 1)
    event = (F.when(start != "", "START").when(comp != "", "COMPLETE").when(fail != "", "FAILED")
             .when(rows != "", "ROWS").otherwise("OTHER"))
    name = F.when(start != "", start).when(comp != "", comp).when(fail != "", fail)
    return x.select("source", "ts", "level", event.alias("event"), F.trim(name).alias("attack_name"),
                    F.when(dur != "", dur.cast("int")).alias("duration_s"),
                    F.when(rows != "", rows.cast("long")).alias("rows"), "msg")


def run_totals(exec_log: DataFrame) -> DataFrame:
    """Per log: scheduled attack seconds, episodes started, rows written
    (null when the log ends without a Rows line)."""
    return exec_log.groupBy("source").agg(
        F.sum(F.when(F.col("event") == "START", F.col("duration_s"))).alias("attack_s"),
        F.count_if(F.col("event") == "START").alias("episodes"),
        F.max("rows").alias("rows"))
