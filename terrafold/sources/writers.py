"""Sinks: tables, small reports, and runs that are published only when their gates hold."""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

MAX_REPORT_ROWS = 1000


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, format: str = "parquet") -> None:
    """One distributed write."""
    writer = df.write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_split(parts: dict[str, DataFrame], folder: str) -> None:
    """Each part to a folder of its name."""
    for name, df in parts.items():
        write_table(df, f"{folder}/{name}")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text through Spark's file systems, so that any store will do."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small document."""
    write_text(spark, json.dumps(value, default=str, sort_keys=True), path)


def markdown(df: DataFrame, title: str, rows: int = MAX_REPORT_ROWS) -> str:
    """A report table of at most ``rows`` rows."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join([f"## {title}", "", *head, *body, ""])


class Run:
    """A versioned output (S18): ``runs/<id>/...`` and a pointer that moves last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.id = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ") + "-" + uuid.uuid4().hex[:8]
        self.path = f"{folder}/runs/{self.id}"
        self._manifest("RUNNING")

    def _manifest(self, status: str, **more: object) -> None:
        write_json(self.spark, {"build_id": self.id, "status": status, **more}, f"{self.path}/manifest")

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> None:
        write_table(df, f"{self.path}/{name}", partition_by)

    def publish(self, violations: dict[str, int]) -> None:
        """Move the pointer to this run if nothing is violated, else mark it failed and raise."""
        bad = {k: n for k, n in violations.items() if n}
        if bad:
            self._manifest("FAILED", violations=bad)
            raise RuntimeError(f"run {self.id} is not published: {bad}")
        self._manifest("SUCCESS")
        write_json(self.spark, {"build_id": self.id, "path": self.path}, f"{self.folder}/latest")


def latest_run(spark: SparkSession, folder: str) -> str:
    """Path of the published run."""
    return json.loads(spark.read.text(f"{folder}/latest").first()[0])["path"]
