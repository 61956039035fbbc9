"""Readers for the tables of the data model, column-pruned and typed.

Every reader is lazy; filters and projections of the caller reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str, *columns: Column | str) -> DataFrame:
    """One parquet table under ``root``; with ``columns`` only those are read."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


def texts(spark: SparkSession, root: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table of texts on which CPU-heavy work follows.

    A table that is read by fewer tasks than there are cores is small, however it is stored; only
    then its rows are spread by ``key``, else nothing is shuffled.
    """
    df = table(spark, root, name, key, *columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
