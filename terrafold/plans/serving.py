"""Entry point C: the serving tables of one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import labels, serving
from ..sources.writers import Run


def build(tx: DataFrame, projects: DataFrame, rents: DataFrame, reference: DataFrame) -> dict[str, DataFrame]:
    """developer_stats, area_stats, rent_benchmarks, area_aliases."""
    return {
        "developer_stats": serving.developer_stats(projects),
        "area_stats": serving.area_stats(tx, projects),
        "rent_benchmarks": serving.rent_benchmarks(rents, ["area_name", "bedrooms"], "date", "annual_amount", "actual_area"),
        "area_aliases": labels.area_aliases(reference),
    }


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> str:
    """Write all tables to a run and publish it if none is empty."""
    run = Run(spark, folder)
    for name, df in tables.items():
        run.write(name, df)
    run.publish({f"empty_{n}": int(spark.read.parquet(f"{run.path}/{n}").isEmpty()) for n in tables})
    return run.path
