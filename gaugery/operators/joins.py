"""Requests and outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_outputs(requests: DataFrame, outputs: DataFrame, keys: Sequence[str], strict: bool = True) -> DataFrame:
    """Outputs by request key, in whatever order they came; with strict, each request must have one output and each output a request."""
    if not strict:
        return requests.join(outputs, list(keys))
    asked, got = requests.withColumn("__asked", F.lit(True)), outputs.withColumn("__got", F.lit(True))
    both = asked.join(got, list(keys), "full_outer")
    fault = F.when(F.col("__asked").isNull(), F.raise_error(F.lit("an output without its request"))).when(F.col("__got").isNull(), F.raise_error(F.lit("a request without its output")))
    return both.filter(F.coalesce(fault.cast("boolean"), F.lit(True))).drop("__asked", "__got")


def zip_by_row(left: DataFrame, right: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """Line by line."""
    return left.join(right, row_idx)


def others(rows: DataFrame, pool: DataFrame, key: str, same: Sequence[str]) -> DataFrame:
    """Every row with the exemplars of its group that differ from it in content, so copies of the row are left out too.

    As many rows as that are; where a number or the first few are wanted, `count_others` and `first_others` make no pairs.
    """
    p = pool.select(key, *[F.col(c).alias(f"shot_{c}") for c in same])
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"shot_{c}"))
    return rows.join(p, key).filter(~equal)


def _content(same: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in same])


def count_others(rows: DataFrame, pool: DataFrame, key: str, same: Sequence[str], name: str = "others") -> DataFrame:
    """Every row with the number of exemplars of its group that differ from it in content: all less its own copies."""
    copies = pool.groupBy(key, *same).agg(F.count(F.lit(1)).alias("__own"))
    all_ = copies.groupBy(key).agg(F.sum("__own").alias("__all"))
    own = copies.select(F.col(key).alias("__key"), F.to_json(_content(same), {"ignoreNullFields": "false"}).alias("__same"), "__own")
    joined = rows.join(all_, key, "left").withColumn("__json", F.to_json(_content(same), {"ignoreNullFields": "false"}))
    joined = joined.join(own, (F.col(key) == F.col("__key")) & (F.col("__json") == F.col("__same")), "left")
    left = F.coalesce("__all", F.lit(0)) - F.coalesce("__own", F.lit(0))
    return joined.withColumn(name, left.cast("bigint")).drop("__own", "__all", "__key", "__same", "__json")


def first_others(rows: DataFrame, pool: DataFrame, key: str, same: Sequence[str], order: str, k: int, name: str = "shots") -> DataFrame:
    """Every row with the first k exemplars of its group, by `order`, that differ from it in content, as an array of structs.

    A group's first k serve every row whose content isn't among them; for each content that is, the first k without it are
    taken once. So the pool is read at most k times over, and no row meets its whole group.
    """
    whole = F.struct(*[F.col(c) for c in dict.fromkeys([order, *same])])
    json = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    p = pool.select(F.col(key).alias("__key"), F.col(order).alias("__at"), whole.alias("__shot"), json(_content(same)).alias("__same"))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("__at"))
    listed = lambda df, *by: df.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__shot"))), lambda x: x["__shot"]).alias(name))
    first = p.withColumn("__k", rank("__key")).filter(F.col("__k") <= k).drop("__k")
    general = listed(first, "__key").withColumnRenamed(name, "__general")
    without = first.select("__key", F.col("__same").alias("__not")).distinct()
    rest = p.join(without, "__key").filter(F.col("__same") != F.col("__not"))
    own = listed(rest.withColumn("__k", rank("__key", "__not")).filter(F.col("__k") <= k), "__key", "__not")
    # A content that is all of its group leaves nothing.
    own = without.join(own, ["__key", "__not"], "left").withColumn("__among", F.lit(True))
    keyed = rows.withColumn("__json", json(_content(same)))
    out = keyed.join(general, F.col(key) == F.col("__key"), "left").drop("__key").join(own, (F.col(key) == F.col("__key")) & (F.col("__json") == F.col("__not")), "left").drop("__key", "__not", "__json")
    none = F.array().cast(out.schema["__general"].dataType)
    return out.withColumn(name, F.coalesce(F.when(F.col("__among"), F.coalesce(name, none)), "__general", none)).drop("__general", "__among")
