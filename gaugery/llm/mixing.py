"""Mixing sources to target weights by Pareto order sampling.

A document of a source whose target is c times its words is due c copies. The whole part of c is certain and is taken
as such; what is left, f, is its inclusion probability in a sample drawn by Pareto order: documents are ranked by
(u / (1-u)) / (f / (1-f)), their random odds over their inclusion odds, u being a digest of seed and id, and the lowest
ranks are taken until the source's remaining words are reached. By a weight, from a column or from its size, a document
is due more copies than another of its source, so inclusion probabilities are unequal; one that is due a whole number of
copies short of the most ranks after all that are due a part.

The cut is found without ordering a source anywhere: ranks are dealt into 4096 cells whose words are summed by a
partial aggregate, the cell that holds the cut is found from those sums, and is split into 4096 cells again; only the
documents of that last cell, about one in sixteen million, are ordered. The sample's last place goes to the document
not yet taken whose size is nearest to the words still missing. Targets
come from the table of sources, one row each, by the closed form of capping and resharing; it is ordered in one task, good
for some ten million sources.

Defined cases: a null text has size 0 and takes 0. The null source is a source of its own, last in order. Rows that
repeat source and id share a draw, hence their fate. A source without words has target 0. A null id draws as the text
'null'. Empty tables give empty results. Names starting with `__g_` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugery.llm.common import join_groups, materialise, words

#: A column's name, or a function of the size in words.
Weight = str | Callable[[Column], Column] | None

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_COPIES = 2
SEED = "mix-1"
CELLS = 4096
#: A written table of sources with no more rows than this is broadcast.
FEW_SOURCES = 50_000
#: Inclusion odds of a document that is due no part of a copy, as a divisor.
LAST = 1e15


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: __g_source (struct of is-null and name), source_size, target.

    The level at which all sources share is that at which those with the least cap per weight are capped.
    """
    by = sizes.groupBy("__g_source").agg(F.sum("__g_size").alias("source_size"))
    ranked = by.withColumn("__g_w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy("__g_source")) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("__g_cap", F.col("source_size") * most).withColumn("__g_ratio", F.col("__g_cap").cast("double") / F.col("__g_w"))
    order = Window.orderBy("__g_ratio", "__g_source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("__g_ratio", "__g_source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("__g_ratio", "__g_source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(float(total_share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__g_cap").over(order), F.lit(0))) / F.sum("__g_w").over(after)
    step = ranked.withColumn("__g_level", level)
    # The first source that isn't capped fixes the level of it and of all after it.
    held = step.withColumn("__g_first", F.min(F.when(F.col("__g_ratio") > F.col("__g_level"), F.struct("__g_ratio", "__g_source", "__g_level"))).over(whole))
    free = F.col("__g_first").isNotNull() & (F.struct("__g_ratio", "__g_source") >= F.struct(F.col("__g_first.__g_ratio"), F.col("__g_first.__g_source")))
    return held.select("__g_source", "source_size", F.when(free, F.col("__g_w") * F.col("__g_first.__g_level")).otherwise(F.col("__g_cap").cast("double")).alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in (0, 1): the first 12 hex digits of an MD5, between their steps."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 48)


def _cut(cells: DataFrame, key: list[str], cell: str, need: str, before: str) -> DataFrame:
    """The cell of each key in which the sum of words reaches `need`, with the words before it."""
    order = Window.partitionBy(*key).orderBy(cell)
    run = cells.withColumn("__g_run", F.sum("__g_words").over(order) + F.col(before))
    hit = run.filter((F.col("__g_run") >= F.col(need)) & (F.col("__g_run") - F.col("__g_words") < F.col(need)))
    return hit.select(*key, F.col(cell).alias(f"{cell}_cut"), (F.col("__g_run") - F.col("__g_words")).alias(f"{cell}_before"))


def _by_source(rows: DataFrame, sources: DataFrame, size: str, few: bool) -> DataFrame:
    """Left join with a written table of one row per source: broadcast if there are few, else by `join_groups`."""
    if few:
        return rows.join(F.broadcast(sources), "__g_source", "left")
    return join_groups(rows, sources, ["__g_source"], size, F.col("__g_id"))


def full_texts(size: Column, least: int = 50, weight: float = 2.0) -> Column:
    """A weight by size: texts of `least` words or more are due `weight` times the copies of shorter ones."""
    return F.when(size >= least, F.lit(weight)).otherwise(F.lit(1.0))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, weight: Weight) -> DataFrame:
    drawn = docs.withColumns(
        {
            "__g_id": F.col(id_col),
            "__g_source": F.struct(F.col(source_col).isNull().alias("last"), F.col(source_col).alias("name")),
            "__g_size": F.size(words(F.col(text_col))).cast("bigint"),
            "__g_u": draw(F.col(id_col), seed),
        }
    )
    own = F.col(weight) if isinstance(weight, str) else weight(F.col("__g_size")) if weight else F.lit(1.0)
    return drawn.withColumn("__g_weight", F.coalesce(own.cast("double"), F.lit(1.0)))


def _ranked(rows: DataFrame, due: DataFrame, most: int, few: bool) -> DataFrame:
    """rows with copies due, their whole part, the rest, the rank, and its cells."""
    rows = _by_source(rows, due, "__g_source_size", few).withColumn("__g_due", F.coalesce(F.least(F.lit(float(most)), F.col("__g_rate") * F.col("__g_weight")), F.lit(0.0)))
    rows = rows.withColumn("__g_whole", F.floor("__g_due").cast("bigint")).withColumn("__g_f", F.col("__g_due") - F.col("__g_whole"))
    part = F.when(F.col("__g_f") > 0, (1 - F.col("__g_f")) / F.col("__g_f")).otherwise(LAST)
    odds = (F.col("__g_u") / (1 - F.col("__g_u"))) * F.when(F.col("__g_due") < most, part)
    # odds / (1 + odds) keeps the order and lies in (0, 1).
    place = F.col("__g_rank") / (1 + F.col("__g_rank")) * CELLS
    return rows.withColumn("__g_rank", odds).withColumn("__g_c1", F.floor(place).cast("int")).withColumn("__g_c2", F.floor((place - F.floor(place)) * CELLS).cast("int"))


def _who() -> Column:
    return F.struct("__g_rank", F.col("__g_id").isNull().alias("none"), F.col("__g_id").alias("id"))


def _wanted() -> Column:
    return F.col("__g_rank").isNotNull() & (F.col("__g_need") > 0)


def _inside(ranked: DataFrame) -> DataFrame:
    """ranked, joined with the cuts, with whether the ordered sample has the row."""
    below = (F.col("__g_c1") < F.col("__g_k1")) | ((F.col("__g_c1") == F.col("__g_k1")) & (F.col("__g_c2") < F.col("__g_k2")))
    at = (F.col("__g_c1") == F.col("__g_k1")) & (F.col("__g_c2") == F.col("__g_k2")) & (_who() <= F.col("__g_end"))
    return ranked.withColumn("__g_in", F.when(_wanted(), F.col("__g_k1").isNull() | below | F.coalesce(at, F.lit(False))).otherwise(False))


def _cuts(ranked: DataFrame, few: bool) -> DataFrame:
    """One row per source: the words needed beyond certain copies, the cells and the rank of the cut, and the gap left."""
    key = ["__g_source"]
    tries = ranked.filter("__g_rank is not null and __g_size > 0")
    certain = ranked.groupBy(*key).agg((F.first("__g_target") - F.sum(F.col("__g_whole") * F.col("__g_size"))).alias("__g_need"), F.count(F.lit(1)).alias("__g_rows"))
    first = tries.groupBy(*key, "__g_c1").agg(F.sum("__g_size").alias("__g_words")).join(certain, key).withColumn("__g_zero", F.lit(0).cast("bigint"))
    one = materialise(_cut(first, key, "__g_c1", "__g_need", "__g_zero").join(certain, key), "mix-cells")
    in_one = _by_source(tries, one, "__g_rows", few).filter(F.col("__g_c1") == F.col("__g_c1_cut"))
    second = in_one.groupBy(*key, "__g_c1", "__g_c2", "__g_need", "__g_c1_before").agg(F.sum("__g_size").alias("__g_words"))
    two = _cut(second, [*key, "__g_c1", "__g_need"], "__g_c2", "__g_need", "__g_c1_before")
    two = materialise(two.join(certain.select(*key, "__g_rows"), key).withColumnRenamed("__g_c1", "__g_k1"), "mix-cells")
    last = _by_source(tries, two, "__g_rows", few).filter((F.col("__g_c1") == F.col("__g_k1")) & (F.col("__g_c2") == F.col("__g_c2_cut")))
    ties = last.groupBy(*key, "__g_need", "__g_c2_before", "__g_rank", "__g_id").agg(F.sum("__g_size").alias("__g_words"))
    order = Window.partitionBy(*key).orderBy("__g_rank", F.col("__g_id").asc_nulls_last())
    run = ties.withColumn("__g_run", F.sum("__g_words").over(order) + F.col("__g_c2_before"))
    # The last rank that still fits ends the ordered sample; what is then missing is the gap.
    fits = run.filter(F.col("__g_run") <= F.col("__g_need"))
    ends = fits.groupBy(*key).agg(F.max(_who()).alias("__g_end"), F.max("__g_run").alias("__g_run"))
    lows = two.select(*key, "__g_k1", F.col("__g_c2_cut").alias("__g_k2"), "__g_c2_before")
    cuts = certain.join(lows, key, "left").join(ends, key, "left")
    return cuts.withColumn("__g_gap", F.col("__g_need") - F.coalesce("__g_run", "__g_c2_before")).drop("__g_run", "__g_c2_before")


def _needed(id_col: str, text_col: str, source_col: str, weight: Weight) -> list[str]:
    return [f"`{c}`" for c in dict.fromkeys([id_col, text_col, source_col, *([weight] if isinstance(weight, str) else [])])]


def _copies(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], total_share: float, most: int, seed: str, weight: Weight, whole: bool
) -> DataFrame:
    """With whole, docs, else a row for each of its rows, with __g_id, __g_size, __g_source, __g_source_size, __g_target and
    __g_copies. docs is read once for the sizes, and again with whole alone."""
    needed = _needed(id_col, text_col, source_col, weight)
    sizes = materialise(_drawn(docs.select(*needed), id_col, text_col, source_col, seed, weight).select("__g_id", "__g_source", "__g_size", "__g_u", "__g_weight"), "mix")
    drawn = _drawn(docs, id_col, text_col, source_col, seed, weight) if whole else sizes
    due = targets(sizes, weights, total_share, most).withColumnsRenamed({"source_size": "__g_source_size", "target": "__g_target"})
    if weight:
        due = due.join(sizes.groupBy("__g_source").agg(F.sum(F.col("__g_weight") * F.col("__g_size")).alias("__g_ws")), "__g_source")
        due = due.withColumn("__g_rate", F.col("__g_target") / F.when(F.col("__g_ws") > 0, F.col("__g_ws"))).drop("__g_ws")
    else:
        due = due.withColumn("__g_rate", F.col("__g_target") / F.when(F.col("__g_source_size") > 0, F.col("__g_source_size")))
    due = materialise(due, "mix-targets")
    few = due.count() <= FEW_SOURCES  # of sources; every table by source has as many rows at most
    ranked = _ranked(sizes, due, most, few)
    cuts = materialise(_cuts(ranked, few), "mix-cuts")
    # The document that closes the gap best is the last of the sample, if it comes nearer than none.
    miss = F.abs(F.col("__g_size") - F.col("__g_gap"))
    closer = _inside(_by_source(ranked, cuts, "__g_rows", few)).filter(_wanted() & ~F.col("__g_in") & (F.col("__g_size") > 0) & (miss < F.col("__g_gap")))
    fill = closer.groupBy("__g_source").agg(F.min(F.struct(miss.alias("miss"), _who().alias("who"))).getField("who").alias("__g_fill"))
    cuts = materialise(cuts.join(fill, "__g_source", "left"), "mix-fill")
    done = _inside(_by_source(_ranked(drawn, due, most, few), cuts, "__g_rows", few))
    extra = F.col("__g_in") | F.coalesce(_wanted() & (_who() == F.col("__g_fill")), F.lit(False))
    return done.withColumn("__g_copies", F.col("__g_whole") + extra.cast("bigint"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: int = MOST_COPIES,
    seed: str = SEED,
    weight: Weight = None,
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken (words, copies counted).

    weight: a positive column, or a function of the size, by which documents of a source are due more or fewer copies; null
    counts as 1.
    """
    done = _copies(docs.select(*_needed(id_col, text_col, source_col, weight)), id_col, text_col, source_col, weights, total_share, most, seed, weight, False)
    return done.select(
        F.col("__g_id").alias(id_col),
        F.col("__g_source.name").alias(source_col),
        F.col("__g_size").alias("size"),
        F.col("__g_source_size").alias("source_size"),
        F.col("__g_target").alias("target"),
        F.col("__g_copies").alias("copies"),
        (F.col("__g_copies") * F.col("__g_size")).alias("taken"),
    )


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    total_share: float = TOTAL_SHARE,
    most: int = MOST_COPIES,
    seed: str = SEED,
    weight: Weight = None,
) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, all columns as they were; texts aren't shuffled."""
    done = _copies(docs, id_col, text_col, source_col, weights, total_share, most, seed, weight, True)
    repeated = done.filter("__g_copies > 0").withColumn("__g_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__g_copies"))))
    return repeated.select(*[f"`{c}`" for c in docs.columns])
