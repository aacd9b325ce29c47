"""SparkSession factory."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app: str = "gritstone", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; partitions follow the cores in local mode only."""
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app).master(master or f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": cores,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gritstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_gritstone_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="gritstone-")), "gritstone.zip")
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    context.addPyFile(target)
    context._gritstone_shipped = True
