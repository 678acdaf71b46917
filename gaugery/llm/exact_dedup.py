"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. Rows are grouped by byte length, with partial aggregation. A length that one row alone has ends the matter for it.
2. Rows of shared lengths are grouped by length and a hash of their first characters; a row alone in its group is done.
3. Rows of groups of two or more compute the full hash.

Only lengths, hashes and ids travel. What survives a step is sent back as a bitmap of hashed keys, of about eight bits a
group and at most MOST_BITS; a false hit costs one hash and changes no result, and beyond that size more rows hash. Texts
never travel to be compared.

Defined cases: a null text counts as empty, and all empty texts are equal. The row with the largest id of a group
stays; a null id never wins against another, and in a group of null ids alone keep_id is null and no row is kept but
by `deduplicate`, which keeps one. Rows that repeat an id and its text share their verdict in `decide`; of such rows
`deduplicate` keeps the one whose columns together have the least hash, and one of rows that are equal in all. Empty
tables give empty results. Other columns are carried as they are; names starting with `__g_` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import MOST_BITS, bitmap, join_groups, marked, materialise

PREFIX_CHARS = 64
KEYS = ["__g_len", "__g_pfx", "__g_full"]


def _full(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _sized(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumns({"__g_text": text, "__g_len": F.octet_length(text)})


def _prefix(prefix_chars: int) -> Column:
    return F.xxhash64(F.substring("__g_text", 1, prefix_chars))


def _shared(rows: DataFrame, keys: list[str], label: str, most_bits: int) -> tuple[DataFrame, int]:
    """The bitmap of the keys that two rows or more have."""
    groups = materialise(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys), label)
    pages, bits = bitmap(groups, keys, most_bits)
    return materialise(pages, label), bits


def refiner(docs: DataFrame, text_col: str = "text", prefix_chars: int = PREFIX_CHARS, most_bits: int = MOST_BITS):
    """A function that adds __g_len, __g_pfx and __g_full to rows of docs; the last two are null where a step ended the
    matter. docs is read twice, for lengths and for prefixes; the function's rows are a third reading."""
    sized = _sized(docs.select(text_col), text_col)
    lengths, length_bits = _shared(sized, ["__g_len"], "exact-lengths", most_bits)

    def by_length(rows: DataFrame) -> DataFrame:
        seen = marked(rows, [F.col("__g_len")], lengths, length_bits, "__g_alive")
        return seen.withColumn("__g_pfx", F.when(F.col("__g_alive"), _prefix(prefix_chars)))

    prefixes, prefix_bits = _shared(by_length(sized).filter("__g_alive").select("__g_len", "__g_pfx"), ["__g_len", "__g_pfx"], "exact-prefixes", most_bits)

    def refined(rows: DataFrame) -> DataFrame:
        seen = marked(by_length(_sized(rows, text_col)), [F.col("__g_len"), F.col("__g_pfx")], prefixes, prefix_bits, "__g_again")
        return seen.withColumn("__g_full", F.when(F.col("__g_pfx").isNotNull() & F.col("__g_again"), _full(F.col("__g_text")))).drop("__g_alive", "__g_again")

    return refined


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256 (the digest of every text, as a record)."""
    own = docs.select(F.col(id_col), F.col(text_col))
    refined = refiner(own, text_col, prefix_chars, most_bits)(own)
    hashed = materialise(refined.select(id_col, *KEYS, F.coalesce("__g_full", _full(F.col("__g_text"))).alias("text_sha256")), "exact")
    groups = hashed.filter(F.col("__g_full").isNotNull()).groupBy(*KEYS).agg(F.max(id_col).alias("__g_keep"), F.count(F.lit(1)).alias("__g_n")).filter("__g_n > 1")
    joined = join_groups(hashed, groups, KEYS, "__g_n", F.col(id_col))
    alone = F.col("__g_n").isNull()
    keep = F.when(alone, F.col(id_col)).otherwise(F.col("__g_keep"))
    return joined.select(
        id_col,
        keep.alias("keep_id"),
        F.coalesce("__g_n", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col(id_col) == keep, alone).alias("kept"),
        "text_sha256",
    )


def _row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; maps, which have no order, by their sorted entries as JSON."""
    plain = lambda f: F.col(f"`{f.name}`") if "map<" not in f.dataType.simpleString() else F.to_json(F.struct(F.col(f"`{f.name}`")), {"sortKeys": "true"})
    return F.xxhash64(*[plain(f) for f in docs.schema.fields if f.dataType.typeName() not in ("variant", "void")])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that stay, all columns as they were; of rows that repeat id and text, one.

    Keys, ids and hashes of rows decide which row of a group stays; then docs is read once more, and rows that no other
    could equal pass without a shuffle. Of the others only the row that stays is carried beyond the join, and only rows
    that repeat in all columns are compared as such.
    """
    refined = refiner(docs.select(text_col), text_col, prefix_chars, most_bits)
    whole = refined(docs.withColumn("__g_row", _row_hash(docs)))
    keyed = materialise(whole.filter(F.col("__g_full").isNotNull()).select(F.col(id_col).alias("__g_id"), "__g_row", *KEYS), "exact")
    rows = keyed.groupBy(*KEYS, "__g_id", "__g_row").agg(F.count(F.lit(1)).alias("__g_m"))
    # Of the largest id, nulls last, the least hash.
    best = F.max(F.struct(F.col("__g_id").isNotNull().alias("some"), F.col("__g_id").alias("id"), F.bitwise_not("__g_row").alias("row"), F.col("__g_m").alias("m")))
    groups = rows.groupBy(*KEYS).agg(best.alias("__g_best"), F.sum("__g_m").alias("__g_n")).filter("__g_n > 1")
    groups = groups.select(*KEYS, "__g_n", F.col("__g_best.id").alias("__g_keep"), F.bitwise_not("__g_best.row").alias("__g_keep_row"), F.col("__g_best.m").alias("__g_m"))
    alive = whole.filter(F.col("__g_full").isNotNull())
    joined = join_groups(alive, groups, KEYS, "__g_n", F.col("__g_row"))
    stays = joined.filter(F.col("__g_n").isNull() | (F.col(id_col).eqNullSafe(F.col("__g_keep")) & (F.col("__g_row") == F.col("__g_keep_row"))))
    out = [f"`{c}`" for c in docs.columns]
    once = stays.filter("__g_m > 1").dropDuplicates([*KEYS])
    rest = whole.filter(F.col("__g_full").isNull()).select(*out)
    return rest.unionByName(stays.filter("coalesce(__g_m, 1) = 1").select(*out)).unionByName(once.select(*out))
