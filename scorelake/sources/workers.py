"""Python workers must be able to import this package, wherever the driver was started."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

HOME = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    env = spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if HOME not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, HOME])
