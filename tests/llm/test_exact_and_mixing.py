import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gaugery.llm import exact_dedup, mixing, queries
from gaugery.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n string, __x string"


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "en", s, "n", None) for i, t, s in texts], DOCS)


@pytest.mark.parametrize("name", ["op3_url_filter", "op5_exact_dedup", "op6_near_dedup", "op8_quality_rules", "op9_mixing"])
def test_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


CASES = [(1, "a", "s"), (2, None, "s"), (3, "", "s"), (4, "a", None), (5, "a" * 100 + "x", "s"), (6, "a" * 100 + "y", "s"), (7, "é", "s"), (8, "a", "s"), (9, "word " * 50_000, "s"), (10, "word " * 50_000, "s")]


@pytest.mark.parametrize(("prefix_chars", "most_bits"), [(64, 1 << 27), (0, 1), (3, 1 << 16)])
def test_groups_of_equal_texts(spark, prefix_chars, most_bits):
    got = {r["doc_id"]: r for r in exact_dedup.decide(rows(spark, CASES), prefix_chars=prefix_chars, most_bits=most_bits).collect()}
    want = defaultdict(list)
    for i, t, _ in CASES:
        want[t or ""].append(i)
    for t, ids in want.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_deduplicate_keeps_columns_and_one_row_of_each_text(spark):
    docs = rows(spark, [*CASES, (8, "a", "s"), (None, "b", "s"), (None, "b", "s")])
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 3, 5, 6, 7, 8, 10]


def test_each_step_hashes_only_what_the_one_before_left(spark):
    texts = ["a" * n for n in range(1, 40)] + ["b" * 100, "c" * 100, "d" * 100 + "x", "d" * 100 + "y", "e" * 101, "e" * 101]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r["text"]: r for r in exact_dedup.refiner(docs)(docs).collect()}
    # Lengths of one row, prefixes of one row, and the rest; a bitmap of few bits may let others through.
    assert sum(r["__g_pfx"] is not None for r in got.values()) <= 8 and all(got[t]["__g_pfx"] is not None for t in texts[39:])
    assert sum(r["__g_full"] is not None for r in got.values()) <= 5 and all(got[t]["__g_full"] is not None for t in texts[41:])


def test_of_rows_that_repeat_id_and_text_the_choice_is_defined(spark):
    cells = [(1, "t", k, {"k": str(k)}) for k in range(6)] + [(None, "t", 9, None), (1, "t", 3, {"k": "3"}), (2, "u", 0, {})]
    schema = "doc_id long, text string, __x int, m map<string,string>"
    kept = {tuple(sorted((r["doc_id"], r["__x"]) for r in exact_dedup.deduplicate(spark.createDataFrame(cells[k:] + cells[:k], schema).repartition(1 + k)).collect())) for k in range(3)}
    assert len(kept) == 1 and sorted(i for i, _ in next(iter(kept))) == [1, 2]


def test_empty_tables(spark):
    none = rows(spark, [])
    assert exact_dedup.decide(none).count() == 0
    assert exact_dedup.deduplicate(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(none).count() == 0


def test_targets_are_capped_and_reshared(spark):
    docs = rows(spark, [(i, "w " * n, s) for i, (n, s) in enumerate([(100, "a"), (900, "b"), (500, "c"), (300, None)])])
    got = {r["source"]: r["target"] for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    # 2700 words by weights 3, 1, 2, 3: a and the null source stop at 200 and 600, then 1900 go to b and c as 1 to 2, and c stops at 1000.
    assert got == {"a": 200.0, None: 600.0, "c": 1000.0, "b": 900.0}


def test_mixture_comes_near_its_targets_and_repeats(spark):
    docs = rows(spark, [(i, "w " * (1 + i * 37 % 60), "abc"[i % 3]) for i in range(600)] + [(600, None, "a"), (601, "", "b"), (None, "w w", None)])
    first, again = ({r["doc_id"]: r for r in mixing.mix(docs.repartition(n)).collect()} for n in (1, 5))
    assert {i: r["taken"] for i, r in first.items()} == {i: r["taken"] for i, r in again.items()}
    by = defaultdict(lambda: [0, 0])
    for r in first.values():
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    for taken, target in by.values():
        assert abs(taken - target) <= 15
    assert first[600]["taken"] == first[601]["taken"] == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    # A text without words has no taken words, but comes as often as its copies say.
    assert out.count() == sum(r["copies"] for r in first.values())


def test_columns_named_like_the_mixture_s_own_are_carried(spark):
    docs = spark.createDataFrame([(i, "w w", "ab"[i % 2], "t", 1, 2, 3) for i in range(40)], "doc_id long, text string, source string, target string, source_size int, copies int, taken int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {(r["target"], r["source_size"], r["copies"], r["taken"]) for r in out.collect()} == {("t", 1, 2, 3)}


def test_weights_favour_documents(spark):
    docs = rows(spark, [(i, "w " * 10, "a") for i in range(400)]).selectExpr("*", "if(doc_id < 200, 3.0, 1.0) as favour")
    got = mixing.mix(docs, weights=(1,), total_share=0.5, weight="favour").collect()
    heavy, light = (sum(r["copies"] for r in got if (r["doc_id"] < 200) == k) for k in (True, False))
    assert heavy + light == 200 and 130 < heavy < 170


def test_inclusion_is_unequal_and_targets_are_reached(spark):
    # Texts of 10 and of 100 words: the long ones are due twice as many copies.
    sized = [(i, "w " * (100 if i % 2 else 10), "a") for i in range(4000)]
    half = mixing.mix(rows(spark, sized), weights=(1,), total_share=0.5, weight=mixing.full_texts).collect()
    rate = 0.5 * (10 + 100) / (10 + 2 * 100)
    for r in (0, 1):
        share = sum(x["copies"] for x in half if x["doc_id"] % 2 == r) / 2000
        assert abs(share - rate * (1 + r)) < 0.03
    assert abs(sum(x["taken"] for x in half) - 0.5 * 220_000) <= 50
    # Where the most copies hold back the long ones, and where whole numbers of copies are due, short ones make up for it.
    for share in (1.0, 1.5, 2.0):
        got = mixing.mix(rows(spark, sized), weights=(1,), total_share=share, weight=mixing.full_texts).collect()
        assert abs(sum(x["taken"] for x in got) - share * 220_000) <= 50 and max(x["copies"] for x in got) <= 2
    even = mixing.mix(rows(spark, [(i, "w " * (100 if i % 2 else 200), "a") for i in range(60)]), weights=(1,), total_share=1.25, weight=lambda size: F.when(size >= 200, 1.0).otherwise(0.5)).collect()
    assert abs(sum(x["taken"] for x in even) - 1.25 * 9000) <= 100


def test_supplied_documents_keep_one_of_each_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert exact_dedup.deduplicate(docs).count() == docs.selectExpr("coalesce(text, '') t").distinct().count()
