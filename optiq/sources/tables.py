"""Parquet table access for the driver-provided tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from optiq.session import SPREAD_CONF

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters into the scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-distribute rows on ``key`` to the number of partitions that the
    session names in ``spark.optiq.spread.partitions``; without that setting the
    scan's own splits stay. Local sessions set it, since their inputs are single
    files; on a cluster scans have splits enough."""
    want = df.sparkSession.conf.get(SPREAD_CONF, None)
    return df.repartition(int(want), key) if want else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows shuffled on all their columns to four tasks a core, where little is read and much
    is computed from each row: the files may be cut into fewer tasks than there are cores."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *df.columns)
