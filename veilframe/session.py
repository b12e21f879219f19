"""Session builder with the settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build(app: str = "veilframe", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow on; keyword arguments override any setting.

    ``local[cores]`` is only the fallback master: under spark-submit the
    submitted master wins.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if "spark.master" not in settings and not os.environ.get("SPARK_MASTER"):
        builder = builder.master(f"local[{cores}]")
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
