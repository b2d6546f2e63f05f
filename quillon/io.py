"""Named tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``<sf_dir>/<name>.parquet``, a file or a folder of files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer input splits than cores, dealt to all cores: for work that costs far more than moving the rows.

    A table of many splits, as all large ones are, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
