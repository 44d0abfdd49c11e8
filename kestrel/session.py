"""Session construction and the shared checkpoint folder.

Library functions never create a session themselves; they take DataFrames.
This module is for scripts, tests and the bench.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "kestrel",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Local/test session with AQE on, UTC clock and no web UI."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '*')}]"
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("KESTREL_DRIVER_MEMORY", "16g")))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` names a folder that the driver and all executors
    share and is used as is. Where it is unset, a scratch folder is made for a
    local master only: on a cluster a machine-local folder would lose data with
    its machine, so that case raises.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if cur:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(cur)
        return cur
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    path = tempfile.mkdtemp(prefix="kestrel-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per Spark application.

    Functions run on executors are pickled by reference to their module, so a
    worker must be able to import it wherever the driver was started.
    """
    sc = spark.sparkContext
    if getattr(sc, "_kestrel_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="kestrel-pkg-"), "kestrel_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(top, n)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    sc.addPyFile(target)
    sc._kestrel_shipped = True


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder and package on the workers: call before running queries."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
