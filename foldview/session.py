"""What the engine needs of a session."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers that see this folder import the package from it, wherever the driver was started."""
    home, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, home])
    return spark


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, the warehouse's on a cluster and a temporary one on a single machine.

    A cluster whose warehouse is still the default, a folder of the driver's own disk, has none: that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark, "_foldview_work", None)
    if not found:
        master = spark.sparkContext.master
        alone = master.startswith("local") and not master.startswith("local-cluster")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not alone and warehouse.removeprefix("file:").replace("//", "/") == f"{os.getcwd()}/spark-warehouse":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="foldview-") if alone else f"{warehouse}/_foldview"
        spark._foldview_work = found
    return found.rstrip("/")
