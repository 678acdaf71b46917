"""Seeded orders that agree with Python's generator, so that results can be repeated outside Spark."""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugery.functions.arrow import arrow_udf
from gaugery.operators.selection import MOST_DRAWN


def shared_permutations(rows: int, size: int, seed: int) -> list[list[int]]:
    """One generator over all rows in order: the n-th row's order depends on all before it."""
    r, out = random.Random(seed), []
    for _ in range(rows):
        order = list(range(size))
        r.shuffle(order)
        out.append(order)
    return out


def shuffle_choices(df: DataFrame, choices: str, gold: int, size: int, seed: int = 0, row_idx: str = "row_idx") -> DataFrame:
    """Choices in the order that a generator shared by all rows gives, and gold_label, the letter at which the gold one
    then stands. The orders are made on the driver, as each depends on the ones before, and joined by row number; more than
    MOST_DRAWN rows are an error."""
    rows = df.count()
    if rows > MOST_DRAWN:
        raise ValueError(f"choices of {rows} rows; one generator shared by all rows is for {MOST_DRAWN} at most")
    drawn = shared_permutations(rows, size, seed)
    orders = df.sparkSession.createDataFrame(pa.table({row_idx: pa.array(range(rows), pa.int64()), "__order": pa.array(drawn, pa.list_(pa.int32()))}))
    out = df.join(orders, row_idx)
    moved = F.transform("__order", lambda i: F.get(choices, i))
    letter = F.char(64 + F.array_position("__order", F.lit(gold)))
    return out.withColumn("options", moved).withColumn("gold_label", letter).drop("__order")


@arrow_udf("array<int>")
def text_order(text: pd.Series, size: pd.Series) -> pd.Series:
    """An order of `size` things, seeded by a text of the row."""

    def one(t: str, n: int) -> list[int]:
        order = list(range(n))
        random.Random(str(t)).shuffle(order)
        return order

    return pd.Series([one(t, n) for t, n in zip(text, size, strict=True)])


def shuffle_pair(first: Column, second: Column) -> tuple[Column, Column]:
    """Two texts in an order seeded by the first, and 1 where the first still comes first, else 0."""
    order = text_order(first, F.lit(2))
    both = F.array(F.btrim(first), F.btrim(second))
    return F.transform(order, lambda i: F.get(both, i)), (F.get(order, F.lit(0)) == 0).cast("int")


def sampled_shots(row: int, pool: Sequence[int], k: int, seed: int = 0) -> list[int]:
    """Exemplars of a row, drawn by a generator of its own from the pool without it."""
    return random.Random(seed + row).sample([i for i in pool if i != row], k=min(k, max(0, len(pool) - (row in pool))))


@arrow_udf("array<bigint>")
def sampled_rows(row_idx: pd.Series, pool: pd.Series, k: pd.Series, seed: pd.Series) -> pd.Series:
    """`sampled_shots` of each row; the pool is an array of row numbers."""
    return pd.Series([sampled_shots(int(i), [int(x) for x in p], int(n), int(s)) for i, p, n, s in zip(row_idx, pool, k, seed, strict=True)])
