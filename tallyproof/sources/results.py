"""Writing a result: one folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_result(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Write every table, empty ones with their schema."""
    for name, table in tables.items():
        table.write.mode("errorifexists").format(format).save(f"{path}/{name}")


def read_result(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
