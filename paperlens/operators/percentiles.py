"""Percentiles of many values within distributions of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlens.operators.frames import lookup_join, running_max


def normalize(
    requests: DataFrame, distribution: DataFrame, key: str, x: str, value: str, name: str = "normalized"
) -> DataFrame:
    """``requests`` with the percentile of ``x`` in the distribution (key, value, ptile) of its key.

    The percentile of the last value strictly below x: 0 if there is none, 1 if all are
    below (so also without a distribution), null for null. Requests and values are sorted
    together and the largest percentile so far is carried along, in slices, so that
    neither a long distribution nor many requests of one key gather in one task.
    """
    known = distribution.groupBy(key, F.col(value).cast("double").alias("_v")).agg(F.max("ptile").alias("_p"))
    tops = known.groupBy(key).agg(F.max("_v").alias("_top"))
    asked = F.col(x).cast("double")
    probes = (
        requests.where(F.col(key).isNotNull() & asked.isNotNull() & ~F.isnan(asked))
        .select(key, asked.alias("_v"), F.lit(None).cast("double").alias("_p"))
    )
    marks = known.unionByName(probes).groupBy(key, "_v").agg(F.max("_p").alias("_p"))
    below = running_max(marks, [key], ["_v"], "_p", "_below").select(key, "_v", "_below")
    answer = (
        F.when(asked.isNull(), F.lit(None).cast("double"))
        .when(F.col("_top").isNull(), F.lit(1.0))
        .when(F.isnan(asked), F.lit(0.0))
        .when(asked > F.col("_top"), F.lit(1.0))
        .otherwise(F.coalesce("_below", F.lit(0.0)))
    )
    placed = lookup_join(requests.withColumn("_v", asked), below, [key, "_v"], how="left")
    return (
        lookup_join(placed, tops, key, how="left")
        .select(*requests.columns, answer.alias(name))
    )
