"""Vectorised Python functions that are made when they are first used, as making one needs a session."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gaugery.ship import ship


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas function on Arrow batches as a function of columns; it brings the package to the executors."""

    def wrap(f: Callable) -> Callable[..., Column]:
        def call(*columns) -> Column:
            ship(SparkSession.active())
            return F.pandas_udf(f, returns)(*columns)

        call.__doc__ = f.__doc__
        return call

    return wrap
