"""SparkSession defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "vigil",
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    On a cluster ``master`` stays ``None`` and the launcher decides; the
    shuffle partition count is left to AQE coalescing unless given.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there.  Where the setting is unset, as in
    local tests, a fresh temporary folder serves for the application; on a
    cluster that is an error, since executors could not read it.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(sc.applicationId)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="vigil-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_OWN: dict[str, str] = {}      # application -> the folder made for it


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``vigil`` importable in the Python workers of every executor
    (pandas UDFs, applyInPandas, streaming state functions pickle references
    to it): zip the package once per application and ``addPyFile`` it.  The
    zip goes to the shared checkpoint folder when that is a local/shared
    mount, else next to the driver (``addPyFile`` serves it to executors)."""
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    d = ensure_checkpoint_dir(spark)
    if "://" in d and not d.startswith("file:"):
        d = tempfile.mkdtemp(prefix="vigil-pkg-")
    d = d.replace("file://", "").replace("file:", "")
    os.makedirs(d, exist_ok=True)
    path = os.path.join(d, f"vigil-{app}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(app)
