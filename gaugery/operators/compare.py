"""Runs side by side: metrics of two lanes, their differences and winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(left: DataFrame, right: DataFrame, left_name: str = "left", right_name: str = "right") -> DataFrame:
    """left, right: suite, metric, value. One row per suite and metric of either, with delta and the winner's name.

    Delta and winner are null where a side is missing, the winner also on ties. The greater value wins.
    """
    if left_name == right_name:
        raise ValueError("two lanes need two names")
    both = left.select("suite", "metric", F.col("value").alias("left_value")).join(right.select("suite", "metric", F.col("value").alias("right_value")), ["suite", "metric"], "full_outer")
    delta = F.col("left_value") - F.col("right_value")
    winner = F.when(delta > 0, F.lit(left_name)).when(delta < 0, F.lit(right_name))
    return both.select("suite", "metric", "left_value", "right_value", delta.alias("delta"), winner.alias("winner"))


def lane_name(label: str | None, path: str | None, default: str) -> str:
    return label or path or default
