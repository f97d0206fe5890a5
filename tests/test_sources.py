"""Run loading, discovery, label states, logs, decoding, sinks."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from vigil.functions import schema as SC
from vigil.sources import logs as LG
from vigil.sources import runs as R
from vigil.sources import sinks as K

# Fixture lines in the capture jobs' log formats.
SCHEDULE = """ATTACK SCHEDULE
======================================================================
[ 1] Denial of Service                   @   2.0min  dur= 120s
[ 2] Tank Overflow Attack                @   6.5min  dur= 75s
[ 3] Reconnaissance Scan                 @  10.0min  dur= 300s
"""
EXEC = """[2031-01-02 03:00:00] [INFO] Schedule generated:
[2031-01-02 03:02:00] [INFO] ▶ ATTACK START: Denial of Service (120s)
[2031-01-02 03:04:00] [INFO] ✓ ATTACK COMPLETE: Denial of Service
[2031-01-02 03:06:30] [INFO] ▶ ATTACK START: Tank Overflow Attack (75s)
[2031-01-02 03:30:00] [INFO] Rows: 400
"""


def _csv_run(path, n, t0, attack_at=None):
    cols = [f.name for f in SC.sensor_schema().fields]
    with open(path, "w") as f:
        f.write(",".join(cols) + "\n")
        for i in range(n):
            row = []
            for c in cols:
                if c == "Timestamp":
                    row.append(f"2026-03-13T17:{t0 + i // 60:02d}:{i % 60:02d}.{(i * 7) % 1000:03d}000")
                elif c in SC.COIL_NAMES:
                    row.append("True" if i % 2 else "False")
                elif c == "ATTACK_ID":
                    row.append("8" if attack_at and attack_at[0] <= i < attack_at[1] else "0")
                elif c == "ATTACK_NAME":
                    row.append("Tank Overflow Attack" if attack_at and attack_at[0] <= i < attack_at[1] else "Normal")
                elif c == "MITRE_ID":
                    row.append("T0")
                elif c in SC.INT_REGISTERS:
                    row.append(str(i % 3))
                else:
                    row.append(f"{100 + i * 0.5:.1f}")
            f.write(",".join(row) + "\n")


def test_discover_and_load_runs(spark):
    d = tempfile.mkdtemp(prefix="vigil-runs-")
    for k, n in [(1, 30), (2, 20)]:
        os.makedirs(os.path.join(d, f"run_0{k}"))
        _csv_run(os.path.join(d, f"run_0{k}", "master_dataset.csv"), n, 10 * k, (5, 12))
    df = R.discover_runs(spark, d)
    assert df.count() == 50
    assert sorted(r.run_id for r in df.select("run_id").distinct().collect()) == [1, 2]
    assert dict(df.dtypes)["P_101"] == "boolean"
    first = df.filter("run_id = 1").orderBy("Timestamp").select("elapsed_seconds").first()[0]
    assert first == 0.0
    one = R.load_run(spark, os.path.join(d, "run_01", "master_dataset.csv"), run_id=7)
    assert one.select("run_id").distinct().first()[0] == 7


def test_label_states_asof(spark):
    d = tempfile.mkdtemp(prefix="vigil-states-")
    docs = [{"ATTACK_ID": 8, "ATTACK_NAME": "Tank Overflow Attack", "MITRE_ID": "T0831",
             "timestamp": "2026-03-13T17:00:10"},
            {"ATTACK_ID": 0, "ATTACK_NAME": "Normal", "MITRE_ID": "T0", "timestamp": "2026-03-13T17:00:20"}]
    with open(os.path.join(d, "a.json"), "w") as f:
        f.write(json.dumps(docs[0]) + "\n" + '{"ATTACK_ID": 9, "ATTA' + "\n" + json.dumps(docs[1]) + "\n")
    states = R.read_label_states(spark, d)
    assert states.count() == 2
    readings = spark.createDataFrame([(i,) for i in range(0, 30, 5)], "s int").select(
        "s", F.to_timestamp_ntz(F.format_string("2026-03-13 17:00:%02d", "s")).alias("Timestamp"))
    lab = {r.s: r.ATTACK_ID for r in R.label_readings(readings, states).collect()}
    assert lab == {0: 0, 5: 0, 10: 8, 15: 8, 20: 0, 25: 0}


def test_logs(spark):
    d = tempfile.mkdtemp(prefix="vigil-logs-")
    with open(os.path.join(d, "attack_timeline.log"), "w") as f:
        f.write(SCHEDULE)
    with open(os.path.join(d, "execution_details.log"), "w", encoding="utf-8") as f:
        f.write(EXEC)
    sch = LG.read_schedule(spark, os.path.join(d, "attack_timeline.log"))
    assert sch.count() == 3 and sch.agg(F.sum("duration_s")).first()[0] == 495
    ex = LG.read_execution_log(spark, os.path.join(d, "execution_details.log"))
    tot = LG.run_totals(ex).first()
    assert (tot.attack_s, tot.episodes, tot.rows) == (195, 2, 400)


def test_decode_and_identify(spark):
    raw = list(range(52))
    df = spark.createDataFrame([(raw, [1] * 28)], "r array<int>, c array<int>")
    dec = df.select(*SC.decode_registers(F.col("r")), *SC.decode_coils(F.col("c"))).first()
    assert dec.FIT_101 == 0.0 and dec.LIT_101 == 1 and dec.AIT_202 == 0.04 and dec.P_101 is True
    addr = spark.createDataFrame([(4,), (99,)], "address int")
    names = {r.address: r.name for r in SC.identify(addr, "address", SC.register_table(spark)).collect()}
    assert names == {4: "AIT_202", 99: "Unknown"}


def test_parse_reading_and_bools(spark):
    df = spark.createDataFrame([("AIT_202=7.2, LIT_101=650",)], "t string")
    m = df.select(R.parse_reading(F.col("t")).alias("m")).first().m
    assert m["AIT_202"] == 720.0 and m["LIT_101"] == 650.0
    b = spark.createDataFrame([("True", 1, "x"), ("false", 0, "y"), (None, None, "z")], "a string, b int, c string")
    out = R.normalise_booleans(b)
    assert dict(out.dtypes) == {"a": "boolean", "b": "boolean", "c": "string"}
    assert [r.a for r in out.collect()] == [True, False, None]
    assert dict(R.bools_to_int8(out).dtypes)["a"] == "tinyint"


def test_sinks(spark):
    d = tempfile.mkdtemp(prefix="vigil-sinks-")
    df = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 8)], "run_id int, x double, ATTACK_ID int")
    K.append_rows(df, os.path.join(d, "log"), ["run_id", "x", "missing"])
    back = spark.read.parquet(os.path.join(d, "log"))
    assert back.columns == ["run_id", "x", "missing"] and back.count() == 2
    K.write_split(df, "ATTACK_ID", os.path.join(d, "split"))
    assert spark.read.parquet(os.path.join(d, "split")).filter("is_attack = 1").count() == 1
    K.write_dataset(df, os.path.join(d, "ds"), sort=["x"])
    assert spark.read.parquet(os.path.join(d, "ds")).count() == 2
