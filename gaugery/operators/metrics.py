"""Aggregates of sample scores. Metric names hold commas and colons, so they are keys of maps, never columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_scores(samples: DataFrame, keys: Sequence[str] = (), scores: str = "scores") -> DataFrame:
    """One row per keys and metric: the sum of a score over all samples that were run, those without it counting 0."""
    own = samples.withColumn("__k", F.struct(F.lit(0), *keys))
    total = own.groupBy("__k").agg(F.count(F.lit(1)).alias("samples"))
    summed = own.select("__k", *keys, F.explode(scores).alias("metric", "value")).groupBy("__k", *keys, "metric").agg(F.sum("value").alias("total"))
    return summed.join(total, "__k").select(*keys, "metric", (F.col("total") / F.col("samples")).alias("value"), "samples")


def perplexities(logprob: Column, words: Column, size: Column) -> Column:
    """word_perplexity, byte_perplexity and bits_per_byte of a corpus, from sums."""
    lp, w, b = F.sum(logprob), F.sum(words), F.sum(size)
    return F.struct(F.exp(-lp / F.nullif(w, F.lit(0))).alias("word_perplexity"), F.exp(-lp / F.nullif(b, F.lit(0))).alias("byte_perplexity"), (-lp / F.nullif(b, F.lit(0)) / F.log(F.lit(2.0))).alias("bits_per_byte"))


def row_perplexities(logprob: Column, words: Column, size: Column) -> Column:
    """The same of a row by itself."""
    return F.struct(F.exp(-logprob / words).alias("word_perplexity"), F.exp(-logprob / size).alias("byte_perplexity"), (-logprob / size / F.log(F.lit(2.0))).alias("bits_per_byte"))


def perplexity(logprob: Column) -> Column:
    return F.exp(-F.avg(logprob))


def greedy_accuracy(is_greedy: Column) -> Column:
    return F.coalesce(F.avg(is_greedy.cast("double")), F.lit(0.0))


def micro(correct: Column, all_: Column) -> Column:
    """Sum of right ones over the sum of all, or 0."""
    return F.coalesce(F.sum(correct) / F.nullif(F.sum(all_), F.lit(0)), F.lit(0.0))


def preference(more: Column, less: Column) -> Column:
    """How often the first is likelier, and the mean gap."""
    return F.struct(F.avg((more > less).cast("double")).alias("pct_stereotype"), F.avg(F.abs(more - less)).alias("ll_diff"))


def invalid_count(extracted: Column) -> Column:
    return F.count_if(extracted == "[invalid]")


def token_stats(n: Column) -> Column:
    return F.struct(F.min(n).alias("min"), F.avg(n).alias("avg"), F.max(n).alias("max"))


def low_metrics(results: DataFrame, threshold: float, allowed: DataFrame) -> DataFrame:
    """Metrics at or below a threshold that aren't on the list of (suite, metric) for which that is known."""
    return results.filter(F.col("value") <= threshold).join(allowed, ["suite", "metric"], "left_anti")
