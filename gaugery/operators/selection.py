"""Row identity, caps, explicit rows, orders, subsets, few-shot exemplars.

Rows are known by `row_idx`, dense from 0 in the order of the files. It is a column, so a cap is a filter on it and
stays true on any number of executors, where `limit` would not.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugery.scratch import materialise

DEFAULT_SEED = 7
#: Rows up to which Python's generator draws an order on the driver.
MOST_DRAWN = 5_000_000


def with_row_idx(df: DataFrame, name: str = "row_idx") -> DataFrame:
    """Dense row numbers in the order of df: its rows are written with their partition and place, and a count per partition
    gives each its offset, so no row is sorted or moved. Tables of files are better numbered by `sources.read_rows`."""
    marked = materialise(df.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "rows")
    sizes = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    return marked.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__offset") + F.col("__at")).drop("__part", "__at", "__offset")


def limit_rows(df: DataFrame, max_rows: int | None, row_idx: str = "row_idx") -> DataFrame:
    return df if max_rows is None else df.filter(F.col(row_idx) < max_rows)


def select_rows(df: DataFrame, indices: Sequence[int] | None, max_rows: int | None = None, row_idx: str = "row_idx") -> DataFrame:
    """The rows of the given numbers with `pos`, their place in that list, which may repeat; then the cap.

    A negative number is a ValueError, one beyond the table an IndexError.
    """
    if indices is None:
        return limit_rows(df, max_rows, row_idx).withColumn("pos", F.col(row_idx))
    if any(i < 0 for i in indices):
        raise ValueError("row numbers can't be negative")
    if indices and max(indices) >= (rows := df.count()):
        raise IndexError(f"row {max(indices)} of {rows}")
    wanted = list(indices)[:max_rows]
    asked = df.sparkSession.createDataFrame([(i, p) for p, i in enumerate(wanted)], f"`{row_idx}` bigint, pos bigint")
    return df.join(F.broadcast(asked), row_idx)  # as many rows as the caller listed


def parse_order(order: str | None) -> tuple[str, str | int | None]:
    """native, shuffle, shuffle|<seed>, hash, hash|<seed>, length|asc, length|desc."""
    kind, _, rest = (order or "native").strip().lower().partition("|")
    if kind == "native" and not rest:
        return "native", None
    if kind in ("shuffle", "hash"):
        return kind, int(rest) if rest else DEFAULT_SEED
    if kind == "length" and rest in ("asc", "desc"):
        return "length", rest
    raise ValueError(f"no such order: {order}")


def order_rows(df: DataFrame, order: str | None, length: Column | None = None, row_idx: str = "row_idx", streamed: bool = False) -> DataFrame:
    """df with `exec_pos`, the place of each row in the order, dense from 0; ties keep their native order.

    A shuffle is that of Python's generator over the native order, so results can be repeated outside Spark; it is drawn on
    the driver and is an error beyond MOST_DRAWN rows, where `hash`, an order by seeded hashes of row numbers, is for any
    size. Lengths and hashes are ranked by a range partitioning, a count per partition giving the offsets.
    """
    kind, how = parse_order(order)
    if streamed and kind != "native":
        raise ValueError("a stream has its native order only")
    if kind == "shuffle":
        rows = df.select(row_idx).count()
        if rows > MOST_DRAWN:
            raise ValueError(f"a shuffle of {rows} rows; the order hash|{how} is for more than {MOST_DRAWN}")
        places = list(range(rows))
        random.Random(how).shuffle(places)
        ranked = with_row_idx(df.orderBy(F.col(row_idx).asc_nulls_last()), "__rank")  # rows, as ids may repeat or be null
        shuffled = df.sparkSession.createDataFrame(pa.table({"__rank": pa.array(places, pa.int64()), "exec_pos": pa.array(range(rows), pa.int64())}))
        return ranked.join(shuffled, "__rank").drop("__rank")
    keys = [F.col(row_idx)] if kind == "native" else [F.col("__len").desc() if how == "desc" else F.col("__len").asc(), F.col(row_idx)]
    sized = df if kind == "native" else df.withColumn("__len", F.xxhash64(F.lit(how), F.col(row_idx)) if kind == "hash" else length)
    return with_row_idx(sized.orderBy(*keys), "exec_pos").drop("__len")


def resolve_subsets(tree: dict, paths: Sequence[str] | str) -> list[str]:
    """Leaf values under dotted paths of a category tree, in order and without repeats; `all` is every leaf."""
    leaves: dict[str, None] = {}

    def gather(node) -> None:
        if isinstance(node, dict):
            for x in node.values():
                gather(x)
        else:
            leaves[node] = None

    for path in [paths] if isinstance(paths, str) else paths:
        node = tree
        for part in [] if path.strip().lower() == "all" else path.strip().lower().split("."):
            if not isinstance(node, dict) or part not in node:
                raise ValueError(f"no such subset: {path}")
            node = node[part]
        gather(node)
    return list(leaves)


def subset_token(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def subset_rows(df: DataFrame, category: Column, leaves: Sequence[str]) -> DataFrame:
    """Rows of the given leaves by normalised category; none at all is an error."""
    kept = df.filter(subset_token(category).isin(*[x.lower() for x in leaves]))
    if kept.isEmpty():
        raise ValueError(f"no rows in {', '.join(leaves)}")
    return kept


def interleave(parts: Sequence[DataFrame], order: str = "row_idx") -> DataFrame:
    """Rows of several tables in turn: the first of each, the second of each, and so on, with `turn` and `source_pos`.

    All are ranked by one sort, and a table's first rank is taken off its rows' ranks.
    """
    marked = [p.withColumn("source_pos", F.lit(i)) for i, p in enumerate(parts)]
    placed = with_row_idx(reduce(DataFrame.unionByName, marked).orderBy("source_pos", order), "turn")
    first = placed.groupBy("source_pos").agg(F.min("turn").alias("__first"))  # one row per table
    out = placed.join(F.broadcast(first), "source_pos").withColumn("turn", F.col("turn") - F.col("__first"))
    return out.select(*parts[0].columns, "turn", "source_pos").orderBy("turn", "source_pos")


def fewshot(df: DataFrame, group: str, example: Column, k: int, row_idx: str = "row_idx", glue: str = "\n\n") -> DataFrame:
    """One row per group: the first k examples in native order as an array and joined as a prefix."""
    first = Window.partitionBy(group).orderBy(row_idx)
    kept = df.withColumn("__k", F.row_number().over(first)).select(group, F.col(row_idx).alias("__i"), example.alias("__x"), "__k")
    shots = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__x"))), lambda s: s["__x"])
    return kept.filter(F.col("__k") <= k).groupBy(group).agg(shots.alias("shots")).withColumn("prefix", F.array_join("shots", glue))


def fewshot_backoff(shot_lengths: Column, own_length: Column, new_tokens: int, limit: int) -> Column:
    """The most exemplars, from the first, with which a request and its answer stay under the limit; never below 0."""
    sums = F.transform(F.sequence(F.lit(0), F.size(shot_lengths)), lambda k: F.struct(k.alias("k"), F.aggregate(F.slice(shot_lengths, F.lit(1), k), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("sum")))
    fits = F.filter(sums, lambda s: s["sum"] + own_length + new_tokens < limit)
    return F.coalesce(F.array_max(F.transform(fits, lambda s: s["k"])), F.lit(0))
