"""Session helpers: settings for our own programs, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and the benchmark. Clusters bring their own session."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pinfold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def ship(spark: SparkSession) -> None:
    """Adds this package to the Python workers, once per application.

    Needed where the executors have no copy of the repository on their path.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="pinfold-"), "pinfold_package.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("pinfold", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def ship_active() -> None:
    """As ship, for the running session; column functions that need Python on the workers have no other."""
    s = SparkSession.getActiveSession()
    if s is not None:
        ship(s)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
