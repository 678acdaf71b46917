import base64
import hashlib
import io
import json
import os
import pickle
import random
import subprocess
import sys
import tarfile
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugery.operators import compare, joins, metrics, reshape, selection, shuffles
from gaugery.plans import spec_run
from gaugery.plans.run import build, evaluate, hash_scorer, python_scorer, recorded
from gaugery.plans.suites import SUITES, Suite, get
from gaugery.sources import readers, sinks
from gaugery.streaming import scoring


def test_suites_have_names_kinds_and_plans(spark):
    assert len(SUITES) > 160 and get("boolq").choices
    with pytest.raises(KeyError):
        get("nothing")
    with pytest.raises(NotImplementedError):
        get("swe_bench_pro")
    text = "q?\n\n (A) a b (B) c (C) d (D) e  f\n\n The story.\n\nEnds"
    got = build(spark.createDataFrame([(text, [" e f"])], "input string, outputs array<string>"), get("scrolls_quality")).first()
    assert got["gold"] == 3
    assert got["choices"] == ["a b", "c", "d", "e f"] and got["prompt"] == "The story.\n\nEnds\n\nQuestion: q?\nAnswer:"


ROWS = {
    "boolq": ({"passage": "P", "question": "is it so", "label": 1}, "P\nQuestion: is it so?\nAnswer:", ["no", "yes"], 1),
    "mnli": ({"premise": " A ", "hypothesis": "b", "label": 2}, "A\nQuestion: b. True, False or Neither?\nAnswer:", ["True", "Neither", "False"], 2),
    "careqa": ({"question": "q", "op1": "w", "op2": "x", "op3": "y", "op4": " z", "cop": 2}, "Question: q\nA. w\nB. x\nC. y\nD. z\nAnswer:", list("ABCD"), 1),
    "copa": ({"premise": "It rained.", "question": "cause", "choice1": "Clouds.", "choice2": "Sun.", "label": 0}, "It rained because", ["clouds.", "sun."], 0),
    "sciq": ({"support": " ", "question": "q", "distractor1": "a", "distractor2": "b", "distractor3": "c", "correct_answer": " d"}, "Question: q\nAnswer:", ["a", "b", "c", "d"], 3),
    "moral_stories": ({"norm": "be GOOD", "situation": "x", "intention": "y", "moral_action": "m", "immoral_action": "i"}, "Be good X Y", ["m", "i"], 0),
    "ceval": ({"question": "q", "A": "1", "B": "2", "C": "3", "D": "4", "answer": "C"}, "q\nA. 1\nB. 2\nC. 3\nD. 4\n答案：", list("ABCD"), 2),
    "eus_trivia": ({"question": "q", "candidates": ["x", "y "], "answer": 1}, "Galdera: q\nA: x\nB: y\nErantzuna:", ["A", "B"], 1),
    "mathqa": ({"Problem": "p", "options": "a ) 1 , b ) 2 , 000 , c ) x y , d ) 4 , e ) none", "correct": "b"}, "Question: p\nAnswer:", ["1", "2 , 000", "x y", "4", "none"], 1),
    "winogrande": ({"sentence": "The _ ran fast.", "option1": "cat", "option2": "dog", "answer": "2"}, "The", ["cat ran fast.", "dog ran fast."], 1),
    "hellaswag": ({"ctx_a": "A man [x] runs", "ctx_b": "he FALLS", "activity_label": "Run", "endings": [" a [title] b", "c"], "label": 1}, "Run: A man runs He falls", ["a. b", "c"], 1),
    "arabicmmlu": ({"Subject": "S", "Level": "High", "Country": None, "Context": "", "Question": " q ", "Option 1": "x", "Option 2": "y", "Option 3": None, "Option 4": None, "Option 5": None, "Answer Key": "B"}, "This is a S question for high school. Select the correct answer!\n\nQuestion: q\nA. x\nB. y\n\nAnswer:", ["A", "B"], 1),
    "ethics_deontology": ({"scenario": " s", "excuse": "e ", "label": 0}, 'Question: Would most people believe this reasonable or unreasonable to say? "s e"\nAnswer:', ["unreasonable", "reasonable"], 0),
    "kobest_copa": ({"premise": "비가 왔다.", "question": "원인", "alternative_1": "a", "alternative_2": "b", "label": 1}, "비가 왔다 왜냐하면", ["a", "b"], 1),
    "wic": ({"sentence1": "a bank there", "sentence2": "banks", "start1": 2, "end1": 6, "label": 0}, "Sentence 1: a bank there\nSentence 2: banks\nQuestion: Is the word 'bank' used in the same way in the two sentences above?\nAnswer:", ["no", "yes"], 0),
    "xnli_es_spanish_bench": ({"premise": "Hola.", "hypothesis": "Adiós", "label": 2}, "", ["Hola, ¿correcto? Sí, adiós.", "Hola, ¿correcto? Así que, adiós.", "Hola, ¿correcto? No, adiós."], 2),
    "scrolls_contractnli": ({"input": "hyp\n\ntext one\n\ntwo", "outputs": ["Entailment"]}, "text one\n\ntwo\n\nHypothesis: hyp\nConclusion:", ["Not mentioned", "Entailment", "Contradiction"], 1),
    "agieval": ({"passage": None, "question": " q", "options": ["(A)one", "(B) two"], "label": "B"}, "Question: q\nA. one\nB. two\n\nAnswer:", ["A", "B"], 1),
    "click": ({"paragraph": "", "question": "q", "choices": ["x", "y"], "answer": "y", "id": "KIIP_1"}, "주어진 질문을 천천히 읽고, 적절한 정답을 A, B 중에 골라 알파벳 하나로 답하시오.\n\n질문: q\n보기:\nA:x, B: y\n정답:", ["A", "B"], 1),
    "record": ({"query": "q @placeholder", "entities": ["x", "y"], "passage": "a.\n@highlight\nb\n@highlight\nc", "answers": ["y"]}, "record query: q @placeholder entities: x, y passage: a. b. c", ["x", "y"], 1),
    "aexams_physics": ({"question": "q", "A": "1", "B": "2", "C": "3", "D": "4", "answer": "D"}, "قم بالإجابة على مايلي في مجال الفيزياء\n\nq\nA. 1\nB. 2\nC. 3\nD. 4\nالجواب:", list("ABCD"), 3),
    "xnli_eu": ({"premise": "a", "hypothesis": "b", "label": 0}, "a, ezta? b", ["Bai, b", "Gainera, b", "Ez, b"], 0),
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows_become_samples(spark, name):
    row, prompt, choices, gold = ROWS[name]
    df = spark.read.option("dropFieldIfAllNull", "false").json(spark.sparkContext.parallelize([json.dumps(row)]))
    got = build(df, get(name)).first()
    assert (got["prompt"], got["choices"], got["gold"]) == (prompt, choices, gold)


def outputs_of(spark, lps):
    rows = [(i, j, x, x == max(row), 1) for i, row in enumerate(lps) for j, x in enumerate(row)]
    return recorded(spark.createDataFrame(rows, "row_idx long, choice_idx int, logprob double, is_greedy boolean, token_count int"))


def test_suites_with_scores_of_their_own(spark):
    found = lambda df, name, lps: {r["metric"]: r["value"] for r in evaluate(df, get(name), outputs_of(spark, lps)).metrics.collect()}
    pairs = spark.createDataFrame([(0, "a", "b"), (1, "c", "d")], "row_idx long, sent_more string, sent_less string")
    assert found(pairs, "crows_pairs", [[-1.0, -2.0], [-3.0, -1.0]]) == {"pct_stereotype": 0.5, "ll_diff": 1.5}
    bias = spark.createDataFrame([(0, "s", "o")], "row_idx long, sentence string, occupation string")
    got = found(bias, "simple_cooccurrence_bias", [[-1.0, -1.0, -0.5, -9.0]])
    assert got["pct_male_preferred"] == 1 and got["likelihood_diff"] == pytest.approx(-1 + 0.693147 + 0.5 - 0.0002, abs=1e-3)
    truth = spark.createDataFrame([(0, "q", (["a", "b", "c"], [1, 0, 1]), (["a", "b", "c"], [1, 0, 1]))], "row_idx long, question string, mc1_targets struct<choices:array<string>,labels:array<int>>, mc2_targets struct<choices:array<string>,labels:array<int>>")
    assert found(truth, "truthfulqa_mc1", [[-2.0, -1.0, -3.0]]) == {"acc": 0.0}
    assert found(truth, "truthfulqa_mc2", [[-1.0, -1.0, -1.0]])["acc"] == pytest.approx(2 / 3)
    web = spark.createDataFrame([(0, "q", ["Bob Dylan", "Bob", " Al "])], "row_idx long, question string, answers array<string>")
    assert build(web, get("webqs")).first()["choices"] == ["Al", "Bob"]
    assert found(web, "webqs", [[-1.0, -2.0]]) == {"em": 1.0}
    blank = spark.createDataFrame([(0, "The _ ran.", "cat", "dog", "2")], "row_idx long, sentence string, option1 string, option2 string, answer string")
    from gaugery.plans.run import likelihood_requests

    asked = likelihood_requests(build(blank, get("xwinograd_en")), get("xwinograd_en")).orderBy("choice_idx").collect()
    assert [(r["context"], r["continuation"]) for r in asked] == [("The cat", " ran."), ("The dog", " ran.")]
    assert found(blank, "xwinograd_en", [[-2.0, -1.0]]) == {"acc,ll": 1.0, "acc,ll_avg": 1.0}


def test_exemplars_come_before_the_question(spark):
    from gaugery.plans.run import with_shots

    pool = spark.createDataFrame([(i, "hard_law", f"q{i}", ["a", "b", "c", "d"], i % 4) for i in range(5)], "row_idx long, subject string, question string, choices array<string>, answer int")
    rows = spark.createDataFrame([(0, "hard_law", "x", ["1", "2", "3", "4"], 2), (1, "art", "y", ["1", "2", "3", "4"], 0)], pool.schema)
    got = {r["row_idx"]: r for r in build(with_shots(rows, pool, get("mmlu"), 2, "subject"), get("mmlu")).collect()}
    head = "The following are multiple choice questions (with answers) about "
    assert got[0]["prompt"] == head + "hard law.\n\nq0\nA. a\nB. b\nC. c\nD. d\nAnswer: A\n\nq1\nA. a\nB. b\nC. c\nD. d\nAnswer: B\n\nx\nA. 1\nB. 2\nC. 3\nD. 4\nAnswer:"
    assert got[1]["prompt"] == head + "art.\n\ny\nA. 1\nB. 2\nC. 3\nD. 4\nAnswer:" and got[0]["gold"] == 2
    assert set(evaluate(with_shots(rows, pool, get("mmlu"), 2, "subject"), get("mmlu")).metrics.select("metric").toPandas()["metric"]) == {"acc,ll", "acc,ll_avg"}


def test_rows_that_need_more_than_a_template(spark):
    problems = [{"question": "Q1  _  .", "answer": " B", "options": ["a", "b", "c", "d"]}, {"question": "Q2?", "answer": "A", "options": ["e", "f", "g", "h"]}, {"question": "Q3", "answer": "D", "options": ["i", "j", "k", "l"]}]
    articles = spark.createDataFrame([(0, "Text.", repr(problems)), (1, "Other.", repr(problems[1:2]))], "row_idx long, article string, problems string")
    got = build(articles, get("race")).orderBy("row_idx").collect()
    assert [r["prompt"] for r in got] == ["Article: Text.\n\nQ1  _  .", "Article: Text.\n\n _  .b\nQ2?", "Article: Text.\n\n _  .b\nQuestion: Q2?\nAnswer: e\nQ3", "Article: Other.\n\nQ2?"]
    assert [(r["row_idx"], r["gold"], r["choices"][0]) for r in got] == [(0, 1, "a"), (1, 0, "e"), (2, 3, "i"), (3, 0, "e")]
    flat = [(i, (1, q, a), f"P{q}", f"q{q}", t, l) for i, (q, a, t, l) in enumerate([(1, 0, "x", 0), (0, 0, "u", 1), (0, 1, "v", 0), (1, 1, "y", 0)])]
    multi = spark.createDataFrame(flat, "row_idx long, idx struct<paragraph:int,question:int,answer:int>, paragraph string, question string, answer string, label int")
    got = build(multi, get("multirc")).orderBy("row_idx").collect()
    assert [r["targets"] for r in got] == [["0"], []]
    assert got[0]["prompt"].endswith("numbers only.\n\nPassage:\nP0\n\nQuestion: q0\nAnswer options:\n0. u\n1. v\nIndices:")
    wsc = spark.createDataFrame([(0, "Mark told ( Pete ) that he did n't know , ok .", "he", 6, "Mark", 1)], "row_idx long, text string, span2_text string, span2_index int, span1_text string, label int")
    assert build(wsc, get("wsc")).first()["prompt"] == 'Passage: Mark told (Pete) that *he* didn\'t know, ok.\nQuestion: In the passage above, does the pronoun "*he*" refer to "*Mark*"?\nAnswer:'
    pool = spark.createDataFrame([(i, "Computer Science", f"p{i} ", ["1", "N/A", " 2"], "B", c) for i, c in enumerate(["A: Let's think step by step. Two.", "Because", None])], "row_idx long, category string, question string, options array<string>, answer string, cot_content string")
    rows = spark.createDataFrame([(0, "computer science", " q", ["x", " ", "y"], "b", "")], pool.schema)
    from gaugery.plans.rows import prepared

    head = "The following are multiple choice questions (with answers) about computer science. Think step by step and then finish your answer with 'the answer is (X)' where X is the correct letter choice."
    got = build(prepared("mmlu_pro", rows, pool=pool, shots=2), get("mmlu_pro")).first()
    shot = lambda i, said: f"\n\n\nQuestion:\np{i}\nOptions:\nA. 1\nB. 2\n{said}\n\n"
    assert got["prompt"] == head + shot(0, "Answer: Let's think step by step. Two.") + shot(1, "Answer: Because") + "\nQuestion:\nq\nOptions:\nA. x\nB. y\nAnswer: Let's think step by step."
    assert got["targets"] == ["B"] and got["fewshot_count"] == 2
    assert build(rows, get("mmlu_pro_plus")).first()["prompt"].startswith(head + "\nQuestion:\nq\n")
    code = spark.createDataFrame([(0, ["def", "f", "\n", "x"], ["Say", "\n", "it ."])], "row_idx long, code_tokens array<string>, docstring_tokens array<string>")
    assert [(r["prompt"], r["targets"]) for r in [build(code, get("code2text_go")).first()]] == [("def f x", ["Say it ."])]
    news = spark.createDataFrame([(0, " T", "B\n", "La verdad.", "u")], "row_idx long, web_headline string, web_text string, summary string, web_url string")
    say = lambda text: python_scorer(lambda xs: [{"row_idx": x["row_idx"], "text": text} for x in xs], "row_idx long, text string")
    got = evaluate(news, get("noticia"), say("la VERDAD pura\nmás"))
    assert got.samples.first()["prompt"].endswith("Este es el cuerpo de la noticia:\nB\n") and {r["metric"]: r["value"] for r in got.metrics.collect()} == {"rouge1": pytest.approx(0.8), "average_len": 3.0}


def test_long_contexts(spark):
    say = lambda text: python_scorer(lambda xs: [{"row_idx": x["row_idx"], "text": text} for x in xs], "row_idx long, text string")
    rows = spark.createDataFrame([(0, "C. ", "What?\nAnswer: ", "Answer:", ["", "The cat", "The cat", "dog"], ["cat", "dog"]), (1, "D. ", "Who?", "Say:", ["dog"], ["cat", "dog"])], "row_idx long, context string, input string, answer_prefix string, answers array<string>, all_classes array<string>")
    got = evaluate(rows, get("longbench_qasper_e"), say("a cat"))
    assert [r["prompt"] for r in got.samples.orderBy("row_idx").collect()] == ["C. What?\nAnswer: ", "D. Who?Say:"]
    assert {r["metric"]: r["value"] for r in got.metrics.collect()} == {"score": 0.5, "qa_f1_score": 0.5}
    got = evaluate(rows, get("longbench_trec"), say("\ndog it is\ncat"))
    assert {r["metric"]: r["value"] for r in got.metrics.collect()} == {"score": 1.0, "classification_score": 1.0} or got.metrics.count() == 2
    with pytest.raises(Exception, match="answer"):
        evaluate(rows.withColumn("answers", F.array(F.lit(" "))), get("longbench_lcc"), say("x")).metrics.collect()


def test_rolling_scores_by_windows(spark):
    from gaugery.plans.run import Windows

    rows = spark.createDataFrame([(0, "a b c d e f g"), (1, ""), (2, "x")], "row_idx long, text string")
    ids = lambda c: F.transform(F.filter(F.split(c, " "), lambda x: x != ""), F.ascii)
    count = lambda asked: asked.select("row_idx", "choice_idx", (-F.size("continuation_ids") - F.size("context_ids") / 100).alias("logprob"), F.lit(False).alias("is_greedy"), F.size("continuation_ids").alias("token_count"))
    got = {r["row_idx"]: r for r in evaluate(rows, get("c4"), count, windows=Windows(ids, 3, 0)).samples.collect()}
    # Three windows, the last of one token after as many more as fill the input.
    assert (got[0]["logprob"], got[0]["token_count"]) == (pytest.approx(-7.05), 7) and got[1]["token_count"] == 0 and got[2]["logprob"] == pytest.approx(-1.01)
    asked = evaluate(rows, get("c4"), hash_scorer, windows=Windows(ids, 3, 0), order="length|desc").samples
    assert [r["row_idx"] for r in asked.orderBy("exec_pos").collect()] == [0, 2, 1]


def test_exemplars_without_the_row(spark):
    rows = spark.createDataFrame([(i, "g" if i < 9 else "h", c) for i, c in enumerate(["a", "a", "b", "c", "b", "a", "d", None, "e", "z", "z"])], "row_idx long, k string, c string")
    want = {}
    for r in rows.collect():
        want[r["row_idx"]] = [x["row_idx"] for x in rows.orderBy("row_idx").collect() if x["k"] == r["k"] and x["c"] != r["c"]]
    got = joins.first_others(rows, rows, "k", ["c"], "row_idx", 3).collect()
    assert len(got) == 11 and all([s["row_idx"] for s in r["shots"]] == want[r["row_idx"]][:3] for r in got)
    assert {r["row_idx"]: r["others"] for r in joins.count_others(rows, rows, "k", ["c"]).collect()} == {i: len(x) for i, x in want.items()}
    drawn = rows.select("row_idx", shuffles.sampled_rows("row_idx", F.array(*map(F.lit, range(5))), F.lit(2), F.lit(3)).alias("s")).collect()
    assert all(r["s"] == shuffles.sampled_shots(r["row_idx"], range(5), 2, 3) and r["row_idx"] not in r["s"] for r in drawn)


def test_every_prompt_parses():
    from gaugery.plans.spec import _slot

    for s in SUITES.values():
        if s.prompt:
            assert s.prompt.count("{") == s.prompt.count("}") == len(_slot.findall(s.prompt)), s.name


def test_multiple_choice_with_recorded_outputs(spark):
    rows = spark.createDataFrame([(0, "P", "q", 1), (1, "P", "q", 0)], "row_idx long, passage string, question string, label int")
    outputs = spark.createDataFrame([(0, 0, -1.0, False, 1), (0, 1, -2.0, False, 4), (1, 1, -1.0, False, 1), (1, 0, -1.0, True, 1)], "row_idx long, choice_idx int, logprob double, is_greedy boolean, token_count int")
    got = evaluate(rows, get("boolq"), recorded(outputs))
    assert {r["metric"]: r["value"] for r in got.metrics.collect()} == {"acc,ll": 0.5, "acc,ll_avg": 1.0}
    assert [r["prediction"] for r in got.samples.orderBy("row_idx").collect()] == ["yes", "no"]
    with pytest.raises(Exception, match="without its output"):
        evaluate(rows, get("boolq"), recorded(outputs.limit(0))).metrics.collect()


def test_extra_metrics_and_other_kinds(spark):
    rows = spark.createDataFrame([(i, f"s{i}", i % 2) for i in range(40)], "row_idx long, sentence string, label int")
    found = {r["metric"] for r in evaluate(rows, get("cola"), hash_scorer).metrics.collect()}
    assert found == {"acc,ll", "acc,ll_avg", "mcc,ll", "mcc,ll_avg"}
    text = spark.createDataFrame([(i, f"a b c{i}") for i in range(10)], "row_idx long, text string")
    assert {r["metric"] for r in evaluate(text, get("c4")).metrics.collect()} == {"word_perplexity", "byte_perplexity", "bits_per_byte"}
    got = {r["metric"]: r["value"] for r in evaluate(text, get("lambada")).metrics.collect()}
    assert set(got) == {"acc,ll", "ppl,ll"} and got["ppl,ll"] > 1
    with pytest.raises(NotImplementedError):
        evaluate(text, get("humaneval"))
    with pytest.raises(ValueError):
        evaluate(text, get("nq_open"))


def test_generated_answers(spark):
    rows = spark.createDataFrame([(0, "q", "work #### 1,200"), (1, "r", "so #### 5")], "row_idx long, question string, answer string")
    say = python_scorer(lambda xs: [{"row_idx": x["row_idx"], "text": "The answer is 1200.\nQuestion: 5"} for x in xs], "row_idx long, text string", batch=1)
    got = evaluate(rows, get("gsm8k"), say)
    assert {r["metric"]: r["value"] for r in got.metrics.collect()} == {"acc,num": 0.5}
    assert {r["prediction"] for r in got.samples.collect()} == {"The answer is 1200.\n"}
    echo = python_scorer(lambda xs: [{"row_idx": x["row_idx"], "text": "the Answer"} for x in xs], "row_idx long, text string")
    qa = spark.createDataFrame([(0, "q", ["zz", "answer", ""])], "row_idx long, question string, answer array<string>")
    assert {r["metric"]: r["value"] for r in evaluate(qa, get("nq_open"), echo).metrics.collect()} == {"em": 1.0, "f1": 1.0}
    many = spark.createDataFrame([(0, "p", [(0, 1), (1, 0), (2, 1)])], "row_idx long, prompt string, answers array<struct<answer_idx:int,label:int>>")
    two = python_scorer(lambda xs: [{"row_idx": 0, "text": "0 and 1"}], "row_idx long, text string")
    assert {r["metric"]: r["value"] for r in evaluate(many, get("multirc"), two).metrics.collect()} == {"em": 0.0, "f1a": 0.5}
    kinds = {s.scorer: s for s in SUITES.values() if s.kind == "generate" and s.scorer not in (None, "ifeval", "indices")}
    base = spark.createDataFrame([(0, "p", ["t", "A"], ["t"], ["o", "t"])], "row_idx long, prompt string, other array<string>, targets array<string>, options array<string>")
    for scorer in kinds:
        evaluate(base, Suite("x", "generate", scorer=scorer), echo).metrics.collect()
    inst = spark.createDataFrame([(0, "p", ["punctuation:no_comma", "no:such"], ["{}", "{}"])], "row_idx long, prompt string, instruction_id_list array<string>, kwargs array<string>")
    got = {r["metric"]: r["value"] for r in evaluate(inst, get("ifeval"), echo).metrics.collect()}
    assert got["prompt_level_strict_acc"] == 0 and got["inst_level_strict_acc"] == 0.5


@pytest.mark.parametrize("ids", [[*range(22), 5], [*range(22), None], [0, *range(20), None, None]])
def test_shuffle_keeps_each_row_whatever_its_id(spark, ids):
    """Rows without an id are last in the native order."""
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3)
    want = sorted(ids, key=lambda i: (i is None, i))
    random.Random(7).shuffle(want)
    got = selection.order_rows(df, "shuffle|7", row_idx="doc_id").collect()
    assert sorted((r["exec_pos"], r["doc_id"]) for r in got) == list(enumerate(want))


def test_orders_and_selection(spark):
    df = spark.createDataFrame([(i, i * 7 % 5) for i in range(23)], "row_idx long, n int").repartition(3)
    places = lambda order: [r["row_idx"] for r in selection.order_rows(df, order, F.col("n")).orderBy("exec_pos").collect()]
    ids = list(range(23))
    assert places("native") == ids and places("length|asc") == sorted(ids, key=lambda i: i * 7 % 5) and places("length|desc") == sorted(ids, key=lambda i: -(i * 7 % 5))
    hashed = places("hash|5")
    assert sorted(hashed) == ids and hashed != ids and hashed == places("hash|5") != places("hash|6")
    for order, seed in (("shuffle", 7), ("shuffle|3", 3)):
        want = ids[:]
        random.Random(seed).shuffle(want)
        assert places(order) == want
    with pytest.raises(ValueError):
        selection.parse_order("length|up")
    with pytest.raises(ValueError):
        selection.order_rows(df, "shuffle", streamed=True)
    got = selection.select_rows(df, [4, 1, 4], 2).orderBy("pos").collect()
    assert [r["row_idx"] for r in got] == [4, 1]
    with pytest.raises(ValueError):
        selection.select_rows(df, [-1])
    with pytest.raises(IndexError):
        selection.select_rows(df, [99])
    assert selection.limit_rows(df, 4).count() == 4
    numbered = [r["i"] for r in selection.with_row_idx(spark.range(100).repartition(7), "i").collect()]
    assert sorted(numbered) == list(range(100))


def test_subsets_and_shots(spark):
    tree = {"stem": {"math": "math", "cs": {"ml": "machine_learning"}}, "law": "law"}
    assert selection.resolve_subsets(tree, ["stem.cs", "law", "stem"]) == ["machine_learning", "law", "math"] and len(selection.resolve_subsets(tree, "all")) == 3
    with pytest.raises(ValueError):
        selection.resolve_subsets(tree, "stem.art")
    df = spark.createDataFrame([(0, "Machine Learning"), (1, "law")], "row_idx long, c string")
    assert selection.subset_rows(df, F.col("c"), ["machine_learning"]).count() == 1
    with pytest.raises(ValueError):
        selection.subset_rows(df, F.col("c"), ["x"])


def test_reshaping(spark):
    squad = spark.read.json(spark.sparkContext.parallelize([json.dumps({"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a"}, {"text": "b"}]}, {"id": "2", "question": "r", "answers": []}]}]}]})]))
    assert [(r["id"], r["answers"]) for r in reshape.flatten_squad(squad).collect()] == [("1", ["a", "b"]), ("2", [])]
    coqa = spark.createDataFrame([("s", ["q1", "q2"], ["a1", "a2"])], "story string, questions array<string>, answers array<string>")
    got = reshape.flatten_turns(coqa).orderBy("turn").collect()
    assert [(r["question"], r["history_answers"], r["turns"]) for r in got] == [("q1", [], 2), ("q2", ["a1"], 2)]
    race = spark.createDataFrame([("a", [("q1",), ("q2",)])], "article string, problems array<struct<question:string>>")
    assert [len(r["previous_problems"]) for r in reshape.flatten_problems(race).orderBy("problem_idx").collect()] == [0, 1]
    row = spark.createDataFrame([("I saw _ there", ["x", "y"], "it was he", 7)], "s string, o array<string>, t string, at int")
    heads, tail = reshape.blank_parts(F.col("s"), F.col("o"))
    got = row.select(heads.alias("h"), tail.alias("t"), reshape.replace_span(F.col("t"), F.col("at"), F.lit("he"), F.lit("Bob")).alias("r")).first()
    assert (got["h"], got["t"], got["r"]) == (["I saw x", "I saw y"], " there", "it was Bob")
    paper = spark.read.json(spark.sparkContext.parallelize([json.dumps({"title": "t", "qas": [{"question": "q", "answers": [{"unanswerable": False, "yes_no": None, "free_form_answer": "", "extractive_spans": ["a", "b"]}, {"unanswerable": True, "yes_no": True, "free_form_answer": "f", "extractive_spans": []}]}]})]))
    assert [(r["answer"], r["answer_type"]) for r in reshape.paper_answers(paper).collect()] == [("a, b", "extractive"), ("unanswerable", "unanswerable")]
    zipped = spark.createDataFrame([(1, ["A", "B"], ["x", "y"])], "i int, label array<string>, text array<string>")
    assert [(r["item_idx"], r["label"], r["text"]) for r in reshape.columns_to_rows(zipped, ["label", "text"]).collect()] == [(0, "A", "x"), (1, "B", "y")]


def test_windows_and_chunks(spark):
    df = spark.createDataFrame([(list(range(12)), [90, 91, 92]), ([7], [])], "ids array<int>, prefix array<int>")
    got = [(r["context_ids"], r["window_ids"]) for r in reshape.rolling_windows(df, "ids", 5, -1).collect()]
    assert got == [([-1], [0, 1, 2, 3, 4]), ([4], [5, 6, 7, 8, 9]), ([6, 7, 8, 9], [10, 11]), ([-1], [7])]
    got = [(r["context_ids"], r["chunk_ids"]) for r in reshape.continuation_chunks(df, "prefix", "ids", 5, -1).collect()]
    assert got == [([92], [0, 1, 2, 3, 4]), ([4], [5, 6, 7, 8, 9]), ([6, 7, 8, 9], [10, 11]), ([-1], [7])]


def test_requests(spark):
    from gaugery.operators import requests

    df = spark.createDataFrame([("p", [("a", "b")], None), ("q", None, [1, 2, 3])], "p string, s array<struct<prompt:string,target:string>>, ids array<int>")
    got = df.select(requests.chat(F.col("p"), F.col("s")).alias("m"), requests.length(F.col("ids"), None, F.col("p")).alias("n")).collect()
    assert [[m["content"] for m in r["m"]] for r in got] == [["a", "b", "p"], ["q"]] and [r["n"] for r in got] == [1, 3]
    assert df.select(requests.length(messages=requests.chat(F.col("p"))).alias("n")).first()["n"] == 5
    assert df.select(requests.generation(F.col("p"), stops=("x",)).alias("r")).first()["r"]["stop"] == ["x"]
    with pytest.raises(ValueError):
        requests.generation()
    assert df.select(requests.choices_length(F.col("p"), F.array(F.lit("ab"), F.lit("c"))).alias("n")).first()["n"] == 4


def test_comparison_and_means(spark):
    a = spark.createDataFrame([("s", "m", 1.0), ("s", "n", 0.5)], "suite string, metric string, value double")
    b = spark.createDataFrame([("s", "m", 1.0), ("s", "o", 0.5)], "suite string, metric string, value double")
    got = {r["metric"]: (r["delta"], r["winner"]) for r in compare.compare(a, b, "x", "y").collect()}
    assert got == {"m": (0.0, None), "n": (None, None), "o": (None, None)}
    with pytest.raises(ValueError):
        compare.compare(a, b, "x", "x")
    none = spark.createDataFrame([], "scores map<string,double>")
    assert metrics.mean_scores(none).count() == 0
    with pytest.raises(Exception, match="without its request"):
        joins.join_outputs(spark.range(1), spark.range(2), ["id"]).collect()


def test_sources(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/test.jsonl", '{"a": 1, "b": "é"}\n{"a": 2}\n')
        z.writestr("x/test.csv", "a,b\n1,x\n2,y\n")
    got = readers.read(spark, readers.Source(str(tmp_path / "a.zip"), "jsonl_in_archive", "a int, b string")).orderBy("line_no").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, "é"), (2, None)]
    got = readers.read(spark, readers.Source(str(tmp_path / "a.zip"), "csv_in_archive", "a int, b string")).orderBy("line_no").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, "x"), (2, "y")]
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("l.jsonl", '{"a": 1, "b": "x\u2028y\u0085z"}\r\n\n{"a": 2, "b": "\\u000c"}')
        z.writestr("q.csv", 'n,"b",a\r\n1,"two\r\nlines, and ""quotes""",7\r\n2,y,\r\n')
        z.writestr("l.json", '[{"a": 1}, {"a": 2, "b": "z"}]')
        z.writestr("m.json", '{"k": {"a": 3}, "j": {"b": "w"}}')
        z.writestr("n.json", '{"data": [{"title": "t", "paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "a"}]}]}]}]}')
        z.writestr("d.xml", '<?xml version="1.0"?><Set><Question id="7"><Text>what</Text><Answer>a</Answer><Answer>b &amp; c</Answer></Question><Question id="8"><Text>why</Text></Question></Set>')
        z.writestr("bad.jl", '{"a": \n')
        z.writestr("s.en", "one\ntwo\n")
        z.writestr("s.es", "uno\ndos\n")
    of = lambda kind, schema=None, **options: readers.read(spark, readers.Source(str(tmp_path / "b.zip"), kind, schema, options)).collect()
    assert [(r["a"], r["b"]) for r in of("jsonl_in_archive", "a int, b string", members="jsonl$")] == [(1, "x\u2028y\u0085z"), (2, "\u000c")]
    assert [(r["line_no"], r["a"], r["b"], r["n"]) for r in of("csv_in_archive", "a int, b string, n long")] == [(0, 7, 'two\r\nlines, and "quotes"', 1), (1, None, "y", 2)]
    assert [(r["line_no"], r["a"], r["b"]) for r in of("json_array_in_archive", "a int, b string", members="^l.json$")] == [(0, 1, None), (1, 2, "z")]
    assert {(r["id"], r["a"], r["b"]) for r in of("json_by_id_in_archive", "a int, b string", members="^m")} == {("k", 3, None), ("j", None, "w")}
    nested = readers.read(spark, readers.Source(str(tmp_path / "b.zip"), "json_in_archive", "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string>>>>>>>>", {"members": "^n"}))
    assert [(r["context"], r["answers"]) for r in reshape.flatten_squad(nested).collect()] == [("c", ["a"])]
    (doc,) = of("xml_in_archive", "Question array<struct<_id:int,Text:string,Answer:array<string>>>")
    assert [(q["_id"], q["Text"], q["Answer"]) for q in doc["Question"]] == [(7, "what", ["a", "b & c"]), (8, "why", None)]
    assert {(r["source"], r["target"]) for r in of("parallel_lines_in_archive", source=r"\.en$", target=r"\.es$")} == {("one", "uno"), ("two", "dos")}
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        of("jsonl_in_archive", "a int", members="bad")
    with pytest.raises(Exception, match="digest"):
        of("jsonl_in_archive", "a int", members="jsonl$", sha256="0" * 64)
    good = hashlib.sha256((tmp_path / "b.zip").read_bytes()).hexdigest()
    assert len(of("jsonl_in_archive", "a int", members="jsonl$", sha256=good)) == 2
    (tmp_path / "cache").mkdir()
    for i, name in enumerate(("old.arrow", "new.arrow")):
        table = pa.table({"q": [f"{name}{k}" for k in range(3)], "n": pa.array(range(3), pa.int32())})
        with pa.OSFile(str(tmp_path / "cache" / name), "wb") as f, (pa.ipc.new_stream if i else pa.ipc.new_file)(f, table.schema) as w:
            w.write_table(table)
        os.utime(tmp_path / "cache" / name, (1_700_000_000 + i, 1_700_000_000 + i))
    cached = lambda **o: readers.read(spark, readers.Source(str(tmp_path / "cache" / "*.arrow"), "arrow_file", "n long, q string", o))
    assert cached().count() == 6 and [r["q"] for r in cached(newest="true").orderBy("n").collect()] == ["new.arrow0", "new.arrow1", "new.arrow2"]
    tests = [{"input": "1", "output": "2", "testtype": "stdin"}]
    wrapped = base64.b64encode(zlib.compress(pickle.dumps(json.dumps(tests)))).decode()
    held = spark.createDataFrame([(wrapped,), (json.dumps(tests),), (None,)], "t string").select(readers.hidden_tests_column("t").alias("x")).collect()
    assert [r["x"] and [y.asDict() for y in r["x"]] for r in held] == [tests, tests, None]
    with pytest.raises(ValueError):
        readers.hidden_tests(base64.b64encode(zlib.compress(pickle.dumps(Suite))).decode())
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w:gz") as t:
        info = tarfile.TarInfo("../out.txt")
        t.addfile(info, io.BytesIO(b""))
    with pytest.raises(ValueError):
        list(readers.members(data.getvalue(), ""))
    (tmp_path / "b.txt").write_text("a\nctx\nq?\nA.one\nB.two\n\nc\nctx2\nr?\nA.x\nB.y\n")
    got = readers.read(spark, readers.Source(str(tmp_path / "b.txt"), "blocks")).collect()
    assert [(r["label"], r["options"]) for r in got] == [("a", ["one", "two"]), ("c", ["x", "y"])]
    (tmp_path / "m.json").write_text('{"k1": {"q": "a"}, "k2": {"q": "b"}}')
    assert {(r["id"], r["q"]) for r in readers.read(spark, readers.Source(str(tmp_path / "m.json"), "json_by_id", "q string")).collect()} == {("k1", "a"), ("k2", "b")}
    (tmp_path / "s.txt").write_text("a\nb\n")
    (tmp_path / "t.txt").write_text("x\ny\n")
    got = readers.read(spark, readers.Source([str(tmp_path / "s.txt"), str(tmp_path / "t.txt")], "parallel_lines")).collect()
    assert {(r["source"], r["target"]) for r in got} == {("a", "x"), ("b", "y")}
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        n = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {n}><si><t>hi</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {n}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>')
    assert readers.read(spark, readers.Source(str(tmp_path / "w.xlsx"), "xlsx")).first()["cells"] == ["hi", "", "5"]
    spark.range(50).repartition(4).write.parquet(str(tmp_path / "p"))
    assert sorted(r["row_idx"] for r in readers.read_rows(spark, readers.Source(str(tmp_path / "p"))).collect()) == list(range(50))


def test_specifications(spark, tmp_path):
    spark.createDataFrame([("P", "q", 1), ("P2", "r", 0)], "passage string, question string, label int").write.parquet(str(tmp_path / "rows"))
    spec = {"engine": {"type": "hash"}, "model": {"label": "m"}, "tests": [{"type": "boolq", "path": str(tmp_path / "rows"), "max_rows": 1}]}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    results, document = spec_run.run(spark, spec_run.load(str(tmp_path / "s.json")))
    assert results[0].samples.count() == 1 and set(document["tests"][0]["metrics"]) == {"acc,ll", "acc,ll_avg"}
    sinks.write_json(document, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text()) == document
    assert "spec_run.run" in spec_run.as_python(spec) and "acc" in sinks.render([{"metric": "acc", "value": 0.5}])
    for bad in ("{}", '{"engine": {}, "model": {}}'):
        with pytest.raises(ValueError):
            spec_run.load(bad)
    with pytest.raises(KeyError):
        spec_run.run(spark, {**spec, "engine": {"type": "x"}})
    with pytest.raises(ValueError):
        spec_run.run(spark, {**spec, "tests": [{**spec["tests"][0], "odd": 1}]})
    listed = subprocess.run([sys.executable, "-m", "gaugery", "suites"], capture_output=True, text=True, timeout=60)
    assert listed.returncode == 0 and "boolq" in listed.stdout


def test_streams(spark, tmp_path, sf_dir):
    asked = spark.range(100).selectExpr("id as row_idx", "0 as choice_idx", "concat('c', id) as context", "' x' as continuation")
    asked.repartition(10).write.parquet(str(tmp_path / "in"))
    stream = scoring.request_stream(spark, str(tmp_path / "in"), "row_idx long, choice_idx int, context string, continuation string", 3)
    scoring.score_stream(stream, hash_scorer, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 4
    key = lambda df: sorted((r["row_idx"], r["logprob"]) for r in df.select("row_idx", "logprob").collect())
    assert key(got) == key(hash_scorer(asked))
    scored = stream.selectExpr("row_idx % 2 as k", "cast(row_idx % 4 = 0 as double) as s", "row_idx % 10 = 0 as invalid")
    assert {(r["k"], r["samples"], r["mean"], r["invalid"]) for r in scoring.drain(scoring.running_mean(scored, ["k"], "s"), "means").collect()} == {(0, 50, 0.5, 10), (1, 50, 0.0, 0)}
    (tmp_path / "ev").mkdir()
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "ev" / "a"))
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(str(tmp_path / "ev" / "a"))
    counted = scoring.drain(scoring.windowed_counts(events), "windows")
    want = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert counted.count() == want.count() and counted.agg(F.sum("n")).first()[0] == want.agg(F.sum("count")).first()[0]


def test_the_library_does_not_need_the_llm_subpackage():
    code = "import sys; sys.modules['gaugery.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') and k[2].isdigit() for k in q) and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], timeout=60).returncode == 0
