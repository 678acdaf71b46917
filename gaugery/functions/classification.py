"""Aggregates over predicted and true labels: counts by partial aggregation, the rest arithmetic on one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(above: Column, below: Column) -> Column:
    return F.when(below == 0, 0.0).otherwise(above / F.when(below != 0, below))


def f1_for_label(prediction: Column, gold: Column, label) -> Column:
    """0 where there is no true positive."""
    tp = F.count_if((prediction == label) & (gold == label)).cast("double")
    return _ratio(2.0 * tp, F.count_if(prediction == label) + F.count_if(gold == label))


def macro_f1(prediction: Column, gold: Column, labels: Sequence) -> Column:
    """Mean over the given labels, those that don't occur counting 0; 0 without labels."""
    parts = [f1_for_label(prediction, gold, x) for x in labels]
    return sum(parts[1:], parts[0]) / float(len(parts)) if parts else F.lit(0.0)


def matthews(prediction: Column, gold: Column, positive=1) -> Column:
    """Matthews correlation of a binary outcome, 0 where it isn't defined; doubles throughout, as the product is large."""
    p, g = prediction == positive, gold == positive
    tp, tn, fp, fn = (F.count_if(x).cast("double") for x in (p & g, ~p & ~g, p & ~g, ~p & g))
    return _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def accuracy(prediction: Column, gold: Column) -> Column:
    return F.coalesce(F.avg((prediction == gold).cast("double")), F.lit(0.0))
