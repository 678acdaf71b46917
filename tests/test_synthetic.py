import random

import pytest
from pyspark.sql import functions as F

from gaugery.functions import qa_text
from gaugery.operators import shuffles
from gaugery.sources import synthetic


@pytest.mark.parametrize("name", sorted(synthetic.TASKS))
def test_rows_hold_their_answers_and_fit(spark, name):
    count = lambda t: len(t.split())
    units = synthetic.fit_units(name, 1200, count)
    assert count(synthetic.make(name, 0, units)[0]) <= 1200 < count(synthetic.make(name, 0, units * 3 + 60)[0]) + 400
    rows = synthetic.synthetic_rows(spark, name, 5, units)
    got = rows.select("row_idx", "targets", qa_text.contains_fraction(F.col("prompt"), F.col("targets")).alias("x")).collect()
    assert len({tuple(r["targets"]) for r in got}) == 5 and all(r["x"] == 1 for r in got)
    assert sorted(map(str, rows.repartition(3).collect())) == sorted(map(str, rows.collect()))


def test_documents_around_a_question(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "q", 4), (1, "r", 29)], "row_idx long, question string, doc_id long")
    got = {r["row_idx"]: r["prompt"] for r in synthetic.documents_question(asked, docs, 6).collect()}
    assert "text 4\n" in got[0] and "text 29\n" in got[1] and all(p.count("Document ") == 6 for p in got.values())


def test_seeded_orders(spark):
    r, want = random.Random(0), []
    for _ in range(8):
        x = [("n", "a"), ("n", "b"), ("n", "c"), ("y", "d")]
        r.shuffle(x)
        want.append(([t for _, t in x], "ABCD"[[k for k, _ in x].index("y")]))
    df = spark.createDataFrame([(i, ["a", "b", "c", "d"]) for i in range(8)], "row_idx long, c array<string>")
    got = shuffles.shuffle_choices(df, "c", 3, 4).orderBy("row_idx").collect()
    assert [(x["options"], x["gold_label"]) for x in got] == want
    rows = [("I slept", "I ran"), ("x", " y ")]
    pair, label = shuffles.shuffle_pair(F.col("a"), F.col("b"))
    for x, (a, b) in zip(spark.createDataFrame(rows, "a string, b string").select(pair.alias("p"), label.alias("l")).collect(), rows, strict=True):
        order = [0, 1]
        random.Random(a).shuffle(order)
        assert x["p"] == [[a.strip(), b.strip()][i] for i in order] and x["l"] == int(order[0] == 0)
    assert shuffles.sampled_shots(3, range(10), 4) == random.Random(3).sample([i for i in range(10) if i != 3], k=4)
