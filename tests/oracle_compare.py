"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v, digits=9):
    import datetime
    import decimal
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.{digits}g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x, digits) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x, digits)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict(), digits)
    if hasattr(v, "toArray"):
        return norm(list(v.toArray()), digits)
    return v


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT",
                 "smallint": "SMALLINT", "tinyint": "TINYINT"}


def compare(spark, sf_dir, names=None, digits=9, verbose=True):
    from vigil.plans.registry import ORACLES, QUERIES
    con = duck(sf_dir)
    results = {}
    for name in names or list(QUERIES):
        t0 = time.time()
        try:
            sdf = QUERIES[name](spark, sf_dir)
            scols = sdf.columns
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            results[name] = ("SPARK_ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:24s} SPARK_ERROR {results[name][1]}", flush=True)
            continue
        ts = time.time() - t0
        sql = ORACLES.get(name)
        if sql is None:
            results[name] = ("ROWS_ONLY", len(srows))
            if verbose:
                print(f"{name:24s} rows-only n={len(srows)} {ts:.1f}s", flush=True)
            continue
        try:
            cur = con.execute(sql)
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = ("ORACLE_ERROR", str(e).splitlines()[0][:300])
            if verbose:
                print(f"{name:24s} ORACLE_ERROR {results[name][1]}", flush=True)
            continue
        status = "OK"
        detail = ""
        stypes = dict(sdf.dtypes)
        otypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
        bad_types = [(c, stypes[c], otypes.get(c)) for c in scols
                     if SPARK_TO_DUCK.get(stypes[c], stypes[c]) != otypes.get(c)]
        if sorted(scols) != sorted(ocols):
            status, detail = "COLS", f"spark={scols} oracle={ocols}"
        elif bad_types:
            status, detail = "TYPES", str(bad_types)
        elif len(srows) != len(orows):
            status, detail = "COUNT", f"spark={len(srows)} oracle={len(orows)}"
        else:
            order = sorted(range(len(scols)), key=lambda i: scols[i])
            oidx = {c: i for i, c in enumerate(ocols)}
            def key(r):
                return tuple((x is None, str(type(x)), x) for x in r)
            s_n = sorted((tuple(norm(r[i], digits) for i in order) for r in srows), key=key)
            o_n = sorted((tuple(norm(r[oidx[scols[i]]], digits) for i in order) for r in orows), key=key)
            bad = [(a, b) for a, b in zip(s_n, o_n) if a != b]
            if bad:
                status, detail = "VALUES", f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
            else:
                exact = sorted((tuple(norm(r[i], 17) for i in order) for r in srows), key=key) == \
                    sorted((tuple(norm(r[oidx[scols[i]]], 17) for i in order) for r in orows), key=key)
                if not exact:
                    status = "OK~"
        results[name] = (status, detail)
        if verbose:
            print(f"{name:24s} {status:6s} n={len(srows)} {ts:.1f}s {detail[:400]}", flush=True)
    return results


if __name__ == "__main__":
    from vigil.session import get_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    if os.environ.get("VIGIL_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["VIGIL_TZ"])
    if os.environ.get("VIGIL_CHUNK_ROWS"):
        spark.conf.set("vigil.window.chunkRows", os.environ["VIGIL_CHUNK_ROWS"])
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = {k: v for k, v in res.items() if v[0] not in ("OK", "OK~", "ROWS_ONLY")}
    print("SUMMARY", len(res), "queries,", len(bad), "failing:", sorted(bad))
