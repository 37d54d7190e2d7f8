"""Session settings shared by the bench, the tests and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with adaptive execution, UTC and Arrow on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
