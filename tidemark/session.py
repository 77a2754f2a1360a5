"""Session set-up shared by tests, the bench and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    app: str = "tidemark", cores: int | str = 8, partitions: int = 8, **conf: str
) -> SparkSession:
    """A local session in UTC with ANSI arithmetic and adaptive execution.

    On a cluster use the session that the submit script made; nothing in
    the operators depends on this function.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
