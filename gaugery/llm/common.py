"""What the operators of this subpackage share: tables, word rules, scratch tables, joins that bear hot groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugery.scratch import materialise

#: A word: code points other than the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Bits of a bitmap for each of its keys, the fewest, and the most that are sent: 262,144 rows of 64 bits.
KEY_BITS = 8
LEAST_BITS = 1 << 15
MOST_BITS = 1 << 24
CELLS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id is never learned from, so it counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def words(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: Column, hot: int = 1000) -> DataFrame:
    """Left join of rows with groups, where groups has one row per keys and any group may hold a large share of rows.

    The `hot` largest groups (a fixed bound) are broadcast; rows of those leave the shuffle key by a salt from
    `spread` and so are dealt evenly; the rest meet their group by a shuffle on the keys.
    """
    names = [c for c in groups.columns if c not in keys]
    top = groups.orderBy(F.col(size).desc(), *keys).limit(hot).select(*keys, F.struct(*names).alias("__g_hot"))
    salted = rows.join(F.broadcast(top), keys, "left").withColumn(
        "__g_salt", F.when(F.col("__g_hot").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(100_003)) + 1).otherwise(F.lit(0).cast("bigint"))
    )
    # Not a literal 0: the optimiser would take the salt out of the shuffle key.
    rest = groups.select(*keys, F.struct(*names).alias("__g_cold"), F.pmod(F.col(size), F.lit(1)).cast("bigint").alias("__g_salt"))
    joined = salted.join(rest, [*keys, "__g_salt"], "left")
    found = F.coalesce("__g_hot", "__g_cold")
    return joined.select(*rows.columns, *[found[n].alias(n) for n in names])


def _bit(keys: list[Column], bits: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def bitmap(groups: DataFrame, keys: list[str], most_bits: int = MOST_BITS) -> tuple[DataFrame, int]:
    """A bitmap of the keys of groups (a written table), as a table of words of 64 bits to broadcast, and its bits."""
    bits = LEAST_BITS
    while bits < min(most_bits, KEY_BITS * groups.count()):
        bits *= 2
    at = groups.select(_bit([F.col(k) for k in keys], bits).alias("at"))
    words_of = at.groupBy(F.shiftright("at", 6).alias("__g_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("__g_bits"))
    return words_of, bits


def marked(rows: DataFrame, keys: list[Column], words_of: DataFrame, bits: int, name: str) -> DataFrame:
    """rows with a boolean: whether their keys are in the bitmap, which may be said of others too."""
    at = _bit(keys, bits)
    placed = rows.withColumns({"__g_word": F.shiftright(at, 6), "__g_spot": (at % 64).cast("int")}).join(F.broadcast(words_of), "__g_word", "left")
    return placed.withColumn(name, F.coalesce(F.getbit("__g_bits", "__g_spot") == 1, F.lit(False))).drop("__g_word", "__g_bits", "__g_spot")


def flagged(rows: DataFrame, column: Column, wanted: DataFrame, most_bits: int = MOST_BITS, how: str = "left_semi") -> DataFrame:
    """Rows whose column may be among the only column of wanted, a written table: a bitmap is broadcast, of eight bits a row of
    wanted and at most `most_bits`; false hits stay, about one row in eight, and more beyond that size.

    how="left_anti" gives the other rows.
    """
    pages, bits = bitmap(wanted, wanted.columns, most_bits)
    seen = marked(rows, [column], pages, bits, "__g_flag")
    return seen.filter(F.col("__g_flag") if how == "left_semi" else ~F.col("__g_flag")).drop("__g_flag")


def _drawn(rows: DataFrame, keys: list[str], most: dict | int) -> DataFrame:
    """At most `most` of the rows (label, keys) of each label, each once, in the scratch folder: those of the least hashes
    of their keys in 64 cells of each label, so that no label's rows meet in one task. A row that repeats takes places as
    often, so a sample may be smaller than its bound, never larger."""
    rows = rows.select("label", *keys).withColumn("h", F.xxhash64(*keys, F.lit(3)))
    limit = F.lit(most) if isinstance(most, int) else F.coalesce(*[F.when(F.col("label") == k, F.lit(v)) for k, v in most.items()], F.lit(0))
    cell = Window.partitionBy("label", F.pmod("h", F.lit(CELLS))).orderBy("h", *keys)
    # The first bound is one that Spark applies before the shuffle.
    high = most if isinstance(most, int) else max(most.values())
    placed = rows.withColumn("place", F.row_number().over(cell)).filter(F.col("place") <= high // CELLS + 1)
    drawn = placed.filter((F.col("place") - 1) * CELLS + F.pmod("h", F.lit(CELLS)) < limit)
    return materialise(drawn.select("label", *keys).distinct(), "drawn")


def row_sample(rows: DataFrame, most: dict | int) -> DataFrame:
    """label and text of a bounded sample: of rows (id, label, text), at most `most` of each label (a number, or one by
    label), in the scratch folder.

    Rows are drawn, not ids: of an id that repeats each row keeps its own label and text. Rows that are equal in all three
    count once. Nulls are left out. The rows are read twice, for the draw and for the texts of the drawn.
    """
    known = rows.filter("id is not null and label is not null and text is not null").select("id", "label", "text", F.xxhash64("text").alias("hash"))
    drawn = _drawn(known, ["id", "hash"], most)
    texts = flagged(known, F.col("hash"), drawn.select("hash")).join(F.broadcast(drawn), ["label", "id", "hash"])
    return materialise(texts.dropDuplicates(["label", "id", "hash"]).select("label", "text"), "sample")


def labelled_sample(labels: DataFrame, docs: DataFrame, most: dict | int) -> DataFrame:
    """label and text of a bounded sample where labels (id, label) stand apart from docs (id, text): at most `most` rows of
    each label, as of `row_sample`. An id's label holds for all its texts, and every label for an id that has several."""
    drawn = _drawn(labels.filter("id is not null and label is not null"), ["id"], most)
    return row_sample(docs.select("id", "text").join(F.broadcast(drawn), "id"), most)


def carried(columns: list[str], taken: list[str]) -> dict[str, str]:
    """Names under which input columns are carried beside the result's own: one that clashes gets `_in` at its end."""
    out: dict[str, str] = {}
    for c in columns:
        name = c
        while name in taken or (name != c and name in columns) or name in out.values():
            name += "_in"
        out[c] = name
    return out
