import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugery.llm import near_dedup as nd
from gaugery.llm.common import table
from gaugery.llm.components import components


def brute(texts, k, percent=80):
    sets = {i: nd.shingle_set(t, k) for i, t in texts if i is not None}
    own = {i: i for i in sets}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                own[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in ids}


def check(spark, texts, k, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, sig string")
    got = {r["doc_id"]: r for r in nd.link(docs, shingle=k, **options).collect()}
    for i, (n, c) in brute(texts, k).items():
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (n, c, i == c)


def family(r, base, n, share):
    """Copies of a text with some words changed."""
    return [" ".join(w if r.random() > share else f"x{r.randrange(10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force_with_families_around_the_threshold(spark, k):
    r = random.Random(k)
    texts, words = [], [f"w{i}" for i in range(400)]
    for share in (0.01, 0.03, 0.05, 0.07):
        base = [r.choice(words) for _ in range(120)]
        texts += family(r, base, 25, share) + [" ".join(base)]
    texts += ["", None, "one", "One", "a b", "A  b", "a b", "word " * 30_000, " \t\n", "ÀB c d e f", "àB c d e f"]
    r.shuffle(texts)
    check(spark, list(enumerate(texts)), k)


def test_open_buckets_are_finished_in_blocks(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(300)}" for _ in range(100)]
    # Of different lengths too, so that neighbouring size classes meet.
    texts = family(r, base, 60, 0.06) + [t for n in (75, 82, 88, 95) for t in family(r, base[:n], 12, 0.03)]
    check(spark, list(enumerate(texts)), 2, block=8)


def test_one_outlier_in_a_large_bucket_costs_linear_rows(spark):
    n = 100_000
    crowd = spark.range(n + 1).select(F.col("id").alias("node"), F.lit(88).cast("long").alias("size"), F.lit(5).cast("long").alias("key"), F.lit(n + 1).cast("long").alias("n"))
    comps = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("component"))
    sent = nd._sent(nd._parted(crowd, comps, 80, nd.BLOCK)).groupBy("g", "kind", "x", "y").agg(F.sum("side").alias("others"), F.count(F.lit(1)).alias("rows")).collect()
    assert sum(x["rows"] for x in sent) < 1.02 * n and max(x["rows"] for x in sent) < 2 * nd.BLOCK
    assert all(x["others"] == 1 for x in sent) and {x["g"] for x in sent} == {20}


def test_repeated_ids_are_one_document(spark):
    r = random.Random(11)
    base = [[f"w{r.randrange(500)}" for _ in range(80)] for _ in range(3)]
    near = lambda b: " ".join(w if k != 40 else f"x{r.randrange(1000)}" for k, w in enumerate(b))
    a, b, c = (" ".join(x) for x in base)
    rows = [(1, a), (2, b), (3, near(base[0])), (3, near(base[1])), (4, c), (5, near(base[2])), (5, "one two"), (6, "one two"), (6, None), (7, None), (None, a)]
    for seed in range(4):
        order = random.Random(seed).sample(rows, len(rows))
        got = nd.link(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert len(got) == len(rows)
        assert {(x["doc_id"], x["component_id"]) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (None, None)}


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in nd.link(docs, shingle=2).collect()}
    assert got == {(None, None, True), (1, 1, True), (2, 2, True)}
    assert nd.link(docs.limit(0)).count() == 0
    assert nd.deduplicate(docs.limit(0)).count() == 0


def test_deduplicate(spark):
    docs = spark.createDataFrame([(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (2, "g h i j k l", "z")], "doc_id long, text string, id string")
    out = nd.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 2]


def test_pruning_rarely_drops_a_true_pair():
    least = nd.fewest_matches(96, nd.BATCH, 80, nd.MISS)
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 30, (20_000, 96), np.uint32)
    y = np.where(r.random(x.shape) < 0.8, x, x + 1)
    assert len(nd.survives(x, y, least, nd.BATCH)[0]) == len(x)
    assert len(nd.survives(x, np.where(r.random(x.shape) < 0.2, x, x + 1), least, nd.BATCH)[0]) < 20


def test_signatures_estimate_similarity():
    a, b = nd.shingle_hashes([b"%d" % i for i in range(1000)], 1), nd.shingle_hashes([b"%d" % i for i in range(250, 1250)], 1)
    same = (nd.signature(a, 512) == nd.signature(b, 512)).mean()
    assert abs(same - 0.6) < 0.08


def test_shared_counts_intersections():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(12)]
    for cells in (24, 4_000_000):
        got = nd.shared(sets, cells)
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                assert got[i, j] == len(np.intersect1d(x, y)) or i == j


def test_components_of_chains_stars_and_cycles(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(200, 201), (201, 202), (202, 200), (7, 7)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)]
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    own = {}

    def top(x):
        own.setdefault(x, x)
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        if a != b:
            a, b = top(a), top(b)
            own[max(a, b)] = min(a, b)
    assert got == {x: top(x) for x in own}


def test_supplied_documents(spark, sf_dir):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    check(spark, texts, 2)
