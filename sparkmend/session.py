"""Session helpers: a local session for tests/bench and the shared
checkpoint folder taken from the cluster's own setting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "sparkmend") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()
_ZIP: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers once per
    SparkContext (``addPyFile`` of a zip built on the driver), so pandas
    UDFs that call package functions import on every executor."""
    global _ZIP
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    if _ZIP is None:
        import zipfile

        root = os.path.dirname(os.path.abspath(__file__))
        fd, path = tempfile.mkstemp(prefix="sparkmend-", suffix=".zip")
        os.close(fd)
        with zipfile.ZipFile(path, "w") as z:
            for base, _dirs, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(base, f)
                        z.write(full, os.path.join("sparkmend", os.path.relpath(full, root)))
        _ZIP = path
    sc.addPyFile(_ZIP)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; a scratch one is made only for
    a local master (tests), as executors elsewhere could not share it."""
    sc = spark.sparkContext
    already = sc.getCheckpointDir()
    if already:  # set once per context (each set makes a new sub-folder)
        return already
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="sparkmend-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", current)
    sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
