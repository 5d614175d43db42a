"""The Spark session of tests and benchmarks."""

import os
import tempfile

from pyspark.sql import SparkSession


def make_session(cores: str | None = None, **settings: str) -> SparkSession:
    cores = cores or os.environ.get("BENCH_CPUS") or "8"
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyproof")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tallyproof-tests-"))
    spark.sparkContext.setLogLevel("ERROR")
    return spark
