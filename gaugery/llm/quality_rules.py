"""Quality rules by distribution divergence.

A text's histograms of character classes and of common words are compared with those of its language, summed over all
documents, by the Jensen-Shannon distance (base 2, so from 0 to 1); a text whose mean of the two is too great goes. Texts
shorter than `least_words` aren't judged by divergence, as their histograms say little. Base rules on words, symbols,
lines and repeated word triples come with it.

One pass over the texts writes the counts of each row; references are sums of those, and judging reads the counts
again. References of up to 1000 languages are broadcast; of more, those with most rows are, and the others are met by a
shuffle. Everything is SQL functions. Repeated triples are found inside the row, where there are any: 64-bit hashes of the
triples are sorted with their places beside them, and equal neighbours mark their places.

Defined cases: a null text has no words, fails the base rules and is not kept. A null language is
compared with the reference over all rows. A histogram that is empty on either side has distance 0.
Rows are judged each by itself, repeated or not; a null id is carried. Other columns are not read. Empty tables give
empty results. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import join_groups, materialise, words

LEAST_WORDS = 100
#: Of the mean of both distances: on the supplied tables more than 98 % of the documents that are labelled good and pass the
#: base rules lie below it, and fewer than half of those labelled bad.
MOST_DISTANCE = 0.235
#: So many references are broadcast.
LANGUAGES = 1000
#: Function words of the languages, by which word histograms are kept.
COMMON_WORDS = (
    "the of and to in is that for it with as was on be at by this from or an are "
    "der die das und ist nicht ein eine zu den von mit auf für als auch dem sich "
    "le la les de des et en un une est que qui dans pour pas sur au du "
    "el los las y que es del por con para una no su al lo se"
).split()
COMMON = tuple(dict.fromkeys(COMMON_WORDS))
#: One character stands for each common word while they are counted.
CODES = "".join(map(chr, range(0x30, 0x30 + len(COMMON))))
SYMBOLS = "#*$%&|<>"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, lang, the base counts, and the histograms chars and commons, one row per row of docs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), text.alias("t"), words(F.col(text_col)).alias("w"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rest = F.regexp_replace("t", r"[a-z\x20\x09-\x0D]+", "")
    code = F.create_map(*[F.lit(x) for pair in zip(COMMON, CODES, strict=True) for x in pair])
    codes = F.array_join(F.transform(F.filter("w", lambda x: x.isin(*COMMON)), lambda x: F.element_at(code, x)), "")
    b = a.select(
        "id", "lang", "w", F.size("w").alias("n"), F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"), rest.alias("rest"), lines.alias("lines"), codes.alias("codes"),
    )
    three = F.when(F.col("n") >= 3, F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    c = b.select(
        "id", "lang", "n", "word_chars", "rest", "codes", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length("rest").alias("n_rest"), three.alias("h"),
    )
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    d = c.withColumn("placed", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at"))))).otherwise(none)).drop("h")
    same = lambda x, k: F.coalesce(x["h"] == F.get("placed", k)["h"], F.lit(False))
    marked = F.filter("placed", lambda x, k: same(x, k - 1) | same(x, k + 1))
    e = d.withColumn("places", F.sort_array(F.transform(marked, lambda x: x["at"]))).drop("placed")
    covered = F.aggregate(F.transform("places", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1), x + 3) - x)), F.lit(0), lambda s, x: s + x)
    count = lambda chars: _without(F.col("rest"), chars)
    f = e.select(
        "id", "lang", "n", "word_chars", "n_dup_lines", "codes", covered.cast("bigint").alias("n_repeat_words"), (F.col("word_chars") - F.col("n_rest")).alias("lower"), "n_rest",
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("upper"), count("0123456789").alias("digit"), count(SYMBOLS).alias("symbols"), F.length(F.regexp_replace("rest", r"[\x00-\x7f]+", "")).alias("beyond"),
    )
    chars = [F.col("lower"), F.col("upper"), F.col("digit"), F.col("symbols"), F.col("n_rest") - F.col("beyond") - F.col("upper") - F.col("digit") - F.col("symbols"), F.col("beyond")]
    counts = [F.octet_length("codes") - F.octet_length(F.replace("codes", F.lit(x), F.lit(""))) for x in CODES]
    whole = lambda xs: F.array(*[x.cast("bigint") for x in xs])
    return f.select(
        "id", "lang", F.col("n").cast("bigint").alias("n_words"), "word_chars", F.col("symbols").cast("bigint").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        whole(chars).alias("chars"), whole([*counts, F.col("n") - F.octet_length("codes")]).alias("commons"), F.col("word_chars").alias("chars_total"), F.col("n").cast("bigint").alias("commons_total"),
    )


def references(measured: DataFrame) -> DataFrame:
    """Sums of the histograms: one row per language, and one with lang null for all."""
    sums = lambda c, n: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    both = [sums("chars", 6).alias("ref_chars"), sums("commons", len(COMMON) + 1).alias("ref_commons"), F.sum("chars_total").alias("ref_chars_total"), F.sum("commons_total").alias("ref_commons_total"), F.count(F.lit(1)).alias("rows")]
    by = measured.filter("lang is not null").groupBy("lang").agg(*both)
    return by.unionByName(measured.agg(*both).withColumn("lang", F.lit(None).cast("string")), allowMissingColumns=True)


def js_distance(x: Column, y: Column, x_total: Column, y_total: Column) -> Column:
    """Between two arrays of counts with the given sums, which should be columns of a table, not expressions."""
    half = lambda u, v: F.when(u > 0, u * F.log2(2 * u / (u + v))).otherwise(0.0)
    parts = F.zip_with(x, y, lambda u, v: half(u / x_total, v / y_total) + half(v / y_total, u / x_total))
    distance = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda s, z: s + z) / 2))
    return F.when((x_total > 0) & (y_total > 0), distance).otherwise(0.0)


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = LEAST_WORDS, most: float = MOST_DISTANCE
) -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept."""
    measured = materialise(measure(docs, id_col, text_col, lang_col), "quality")
    refs = materialise(references(measured), "quality-refs")
    pooled = refs.filter("lang is null").first()  # one row of fixed width
    own = refs.filter("lang is not null")
    if own.count() <= LANGUAGES:
        known = measured.join(F.broadcast(own), "lang", "left")
    else:
        # Rows without a language may be many, so they stay out of the shuffle.
        known = join_groups(measured.filter("lang is not null"), own, ["lang"], "rows", F.struct("id", "n_words", "word_chars"), LANGUAGES)
        known = known.unionByName(measured.filter("lang is null"), allowMissingColumns=True)
    array = lambda c: F.coalesce(F.col(c), F.array(*[F.lit(int(x or 0)) for x in pooled[c]]).cast("array<bigint>"))
    number = lambda c: F.coalesce(F.col(c), F.lit(int(pooled[c] or 0)))
    known = known.withColumns({f"js_{k}": js_distance(F.col(h), array(f"ref_{h}"), F.col(f"{h}_total"), number(f"ref_{h}_total")) for k, h in (("chars", "chars"), ("words", "commons"))})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = (F.col("n_words") < least_words) | ((F.col("js_chars") + F.col("js_words")) / 2 <= most)
    return known.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "js_chars", "js_words", (~failed & fits).alias("kept"))
