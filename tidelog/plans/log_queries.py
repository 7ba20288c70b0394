"""Queries over the emulated log."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query


@query(
    "agg_external_count_by_dt",
    "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY 1",
)
def agg_external_count_by_dt(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dt")).agg(F.count("*").alias("n"))
