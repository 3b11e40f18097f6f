"""What several operators of this subpackage need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.sources.shared import looked_up, materialise, new_folder, small_batches  # noqa: F401  (used beside what is here)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
