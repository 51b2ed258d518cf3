"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",  # catalogue times and day buckets are UTC
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Pixels stay where (raster, word address) put them while they join on that and the date as well.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Plans here are built from many small expressions; do not record a call site for each of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(app_name: str = "terradelta") -> SparkSession.Builder:
    """A session builder with the settings applied; master and sizes are left to the caller."""
    build = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        build = build.config(key, value)
    return build


def fan_out(spark: SparkSession) -> int:
    """Partitions to give a small table just before each of its rows unfolds to many.

    A fixed number, because adaptive execution would merge partitions that are still small.
    """
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local(cpus: int | str = 8, memory: str = "8g", **settings: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; dots in names are written as ``__``."""
    build = builder()
    for key, value in settings.items():
        build = build.config(key.replace("__", "."), value)
    spark = (
        build
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
