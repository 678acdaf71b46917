"""Queries over the supplied tables, one for each operator of the engine, with the SQL that says the same."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugery.functions import bleu, classification, ifeval, labels, math_text, numeric, qa_text, rouge, text
from gaugery.functions import multiple_choice as mc
from gaugery.operators import compare, joins, metrics, requests, reshape, selection
from gaugery.plans.registry import query

#: Sums of doubles differ in their last digits with the order of addition, so results of such are rounded on both sides.
DIGITS = 9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of four choices whose log-probabilities are the first four values of an embedding, as no model runs here,
    with gold; token counts 1 to 4."""
    e = table(spark, sf_dir, "embeddings")
    one = lambda i: F.struct(F.lit(i).alias("choice_idx"), F.col("embedding")[i].cast("double").alias("logprob"), F.lit(1 + i).alias("token_count"))
    return e.select("vec_id", (F.col("label") % 4).alias("gold"), F.array(*map(one, range(4))).alias("choices"))


_MC_SQL = """
WITH c AS (SELECT vec_id, label % 4 AS gold, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS lp FROM embeddings),
n AS (SELECT *, [lp[1] / 1, lp[2] / 2, lp[3] / 3, lp[4] / 4] AS ln FROM c),
b AS (SELECT *, list_position(lp, list_max(lp)) - 1 AS raw_best, list_position(ln, list_max(ln)) - 1 AS norm_best FROM n)
"""


@query("mc_accuracy", _MC_SQL + "SELECT count(*) AS samples, avg((raw_best = gold)::INT::DOUBLE) AS acc_ll, avg((norm_best = gold)::INT::DOUBLE) AS acc_ll_avg FROM b")
def mc_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices exploded into requests, scored, gathered again, argmax, mean."""
    asked = reshape.explode_choices(_scored(spark, sf_dir))
    scored = asked.select("vec_id", "gold", "choice_idx", "choice.logprob", "choice.token_count")
    got = reshape.gather_choices(scored, ["vec_id", "gold"]).select(mc.outcome(F.col("choices"), F.col("gold")).alias("x"))
    return got.agg(F.count(F.lit(1)).alias("samples"), F.avg("x.raw_acc").alias("acc_ll"), F.avg("x.norm_acc").alias("acc_ll_avg"))


@query("mc_samples", _MC_SQL + "SELECT vec_id, gold, raw_best, norm_best, (raw_best = gold)::INT::DOUBLE AS raw_acc, (norm_best = gold)::INT::DOUBLE AS norm_acc FROM b")
def mc_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("vec_id", "gold", mc.outcome(F.col("choices"), F.col("gold")).alias("x")).select("vec_id", "gold", "x.*")


@query(
    "exam_score",
    """
WITH c AS (SELECT vec_id, label % 4 AS gold, [round(embedding[1]::DOUBLE, 1), round(embedding[2]::DOUBLE, 1), round(embedding[3]::DOUBLE, 1), round(embedding[4]::DOUBLE, 1)] AS lp FROM embeddings)
SELECT vec_id, CASE WHEN lp[gold + 1] = list_max(lp) THEN 1.0::DOUBLE / len(list_filter(lp, lambda x: x = list_max(lp))) ELSE 0.0 END AS acc_exam FROM c
""",
)
def exam_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    tied = F.transform("choices", lambda c: F.struct(c["choice_idx"].alias("choice_idx"), F.round(c["logprob"], 1).alias("logprob"), c["token_count"].alias("token_count")))
    return _scored(spark, sf_dir).select("vec_id", mc.exam_score(tied, F.col("gold")).alias("acc_exam"))


_PERMS = mc.label_permutations(4, 0.25)


@query(
    "label_permutation",
    "WITH p AS (SELECT vec_id, label % 4 AS gold, ["
    + ", ".join("(" + " + ".join(f"embedding[{(k * 4 + list(p).index(c)) % 16 + 1}]::DOUBLE" for k, p in enumerate(_PERMS)) + f") / {len(_PERMS)}" for c in range(4))
    + "] AS s FROM embeddings) SELECT vec_id, list_position(s, list_max(s)) - 1 AS predicted, (list_position(s, list_max(s)) - 1 = gold)::INT::DOUBLE AS accuracy FROM p",
)
def label_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label log-probabilities of a balanced set of permutations, averaged by the choice that each label stood for."""
    e = table(spark, sf_dir, "embeddings")
    scores = F.array(*[F.array(*[F.col("embedding")[(k * 4 + at) % 16].cast("double") for at in range(4)]) for k in range(len(_PERMS))])
    best = mc.argmax(mc.permuted_average(4, _PERMS, scores))
    return e.select("vec_id", best.alias("predicted"), (best == F.col("label") % 4).cast("double").alias("accuracy"))


@query(
    "mc_softmax_mass",
    """
WITH c AS (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, embedding[4]::DOUBLE] AS lp FROM embeddings),
x AS (SELECT vec_id, list_transform(lp, lambda v: exp(v - list_max(lp))) AS ex FROM c)
SELECT vec_id, round((ex[1] + ex[2]) / list_sum(ex), 9) AS acc FROM x
""",
)
def mc_softmax_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability mass of the true ones (the first two) among all choices."""
    p = mc.softmax(mc.logprobs(F.col("choices")))
    return _scored(spark, sf_dir).select("vec_id", F.round(F.get(p, F.lit(0)) + F.get(p, F.lit(1)), DIGITS).alias("acc"))


@query(
    "cooccurrence_bias",
    """
WITH l AS (SELECT vec_id, ln(exp(embedding[1]::DOUBLE) + exp(embedding[2]::DOUBLE)) AS f, ln(exp(embedding[3]::DOUBLE) + exp(embedding[4]::DOUBLE)) AS m FROM embeddings)
SELECT round(avg(f - m), 9) AS likelihood_diff, avg((m > f)::INT::DOUBLE) AS pct_male_preferred FROM l
""",
)
def cooccurrence_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = [F.col("embedding")[i].cast("double") for i in range(4)]
    x = table(spark, sf_dir, "embeddings").select(mc.logsumexp(lp[0], lp[1]).alias("f"), mc.logsumexp(lp[2], lp[3]).alias("m"))
    return x.agg(F.round(F.avg(F.col("f") - F.col("m")), DIGITS).alias("likelihood_diff"), F.avg((F.col("m") > F.col("f")).cast("double")).alias("pct_male_preferred"))


@query("stereotype_preference", "SELECT avg((embedding[1] > embedding[2])::INT::DOUBLE) AS pct_stereotype, round(avg(abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE)), 9) AS ll_diff FROM embeddings")
def stereotype_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    more, less = (F.col("embedding")[i].cast("double") for i in (0, 1))
    p = table(spark, sf_dir, "embeddings").agg(metrics.preference(more, less).alias("p"))
    return p.select("p.pct_stereotype", F.round("p.ll_diff", DIGITS).alias("ll_diff"))


@query(
    "cls_f1_mcc",
    """
WITH p AS (SELECT (n_chars > 1500)::INT AS pred, quality AS gold FROM documents JOIN labels USING (doc_id)),
c AS (SELECT count(*) FILTER (pred = 1 AND gold = 1)::DOUBLE AS tp, count(*) FILTER (pred = 1 AND gold = 0)::DOUBLE AS fp,
             count(*) FILTER (pred = 0 AND gold = 1)::DOUBLE AS fn, count(*) FILTER (pred = 0 AND gold = 0)::DOUBLE AS tn FROM p)
SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS acc, round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 9) AS f1_macro,
       round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM c
""",
)
def cls_f1_mcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") > 1500).cast("int").alias("pred"), F.col("quality").alias("gold"))
    pred, gold = F.col("pred"), F.col("gold")
    found = {"acc": classification.accuracy(pred, gold), "f1": classification.f1_for_label(pred, gold, 1), "f1_macro": classification.macro_f1(pred, gold, [0, 1]), "mcc": classification.matthews(pred, gold)}
    return p.agg(*[F.round(v, DIGITS).alias(k) for k, v in found.items()])


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a prediction for one benchmark passage, by the rest of its id over the number of passages."""
    b = table(spark, sf_dir, "benchmark")
    n = b.agg((F.max("item_id") + 1).alias("n")).first()["n"]
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prediction"), (F.col("doc_id") % n).alias("item_id"))
    return docs.join(b.withColumnRenamed("text", "reference"), "item_id")


_PAIRED = "p AS (SELECT d.doc_id, coalesce(d.text, '') AS prediction, b.text AS reference FROM documents d JOIN benchmark b ON d.doc_id % (SELECT max(item_id) + 1 FROM benchmark) = b.item_id)"
_QA = r"translate(lower({0}), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~', '')".replace('\\"', '"')
_BLANKS = r"[\s\x1c-\x1f\x{{85}}\p{{Z}}]+"


def _qa_tokens(c: str) -> str:
    return "list_filter(regexp_split_to_array(" + _QA.format(c) + ", '" + _BLANKS.format() + "'), lambda t: t NOT IN ('', 'a', 'an', 'the'))"


@query(
    "qa_token_f1",
    f"""
WITH {_PAIRED},
t AS MATERIALIZED (SELECT doc_id, {_qa_tokens('prediction')} AS a, {_qa_tokens('reference')} AS b FROM p),
l AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(a) AS w FROM t) GROUP BY doc_id, w),
r AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(b) AS w FROM t) GROUP BY doc_id, w),
c AS (SELECT l.doc_id, sum(least(l.n, r.n))::DOUBLE AS common FROM l JOIN r ON l.doc_id = r.doc_id AND l.w = r.w GROUP BY l.doc_id)
SELECT t.doc_id, (array_to_string(a, ' ') = array_to_string(b, ' '))::INT::DOUBLE AS em,
       CASE WHEN len(a) = 0 OR len(b) = 0 THEN (len(a) = len(b))::INT::DOUBLE ELSE round(2 * coalesce(common, 0) / (len(a) + len(b)), 9) END AS f1,
       CASE WHEN coalesce(common, 0) = 0 THEN 0.0::DOUBLE ELSE round(2 * common / (len(a) + len(b)), 9) END AS f1_shared
FROM t LEFT JOIN c USING (doc_id)
""",
)
def qa_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paired(spark, sf_dir).select("doc_id", qa_text.normalise(F.col("prediction")).alias("a"), qa_text.normalise(F.col("reference")).alias("b"))
    t = p.select("doc_id", (F.col("a") == F.col("b")).cast("double").alias("em"), text.tokens(F.col("a")).alias("a"), text.tokens(F.col("b")).alias("b"))
    n = t.select("doc_id", "em", F.size("a").alias("na"), F.size("b").alias("nb"), qa_text.common_count(F.col("a"), F.col("b")).alias("n"))
    f1 = lambda empty: F.round(qa_text.f1_of(F.col("n"), F.col("na"), F.col("nb"), empty), DIGITS)
    return n.select("doc_id", "em", f1(1.0).alias("f1"), f1(None).alias("f1_shared"))


@query("contains_rate", f"WITH {_PAIRED} SELECT count(*) AS samples, avg(contains(lower(prediction), lower(reference))::INT::DOUBLE) AS em_contains FROM p")
def contains_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(spark, sf_dir).agg(F.count(F.lit(1)).alias("samples"), F.avg(qa_text.contains(F.col("prediction"), F.col("reference"))).alias("em_contains"))


@query(
    "contains_fraction",
    f"WITH {_PAIRED} SELECT doc_id, round(len(list_filter(['the', 'zzzz', reference], lambda o: contains(lower(prediction), lower(o)))) / 3.0::DOUBLE, 9) AS em FROM p",
)
def contains_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = F.array(F.lit("the"), F.lit("zzzz"), F.col("reference"))
    return _paired(spark, sf_dir).select("doc_id", F.round(qa_text.contains_fraction(F.col("prediction"), outputs), DIGITS).alias("em"))


@query(
    "perplexity_corpus",
    r"""
WITH d AS (SELECT coalesce(text, '') AS t, -(doc_id % 97 + 1)::DOUBLE / 4 AS lp FROM documents),
s AS (SELECT sum(lp) AS lp, sum(len(list_filter(regexp_split_to_array(t, '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '')))::DOUBLE AS w, sum(strlen(t))::DOUBLE AS b FROM d)
SELECT round(exp(-lp / w), 9) AS word_perplexity, round(exp(-lp / b), 9) AS byte_perplexity, round(-lp / b / ln(2.0::DOUBLE), 9) AS bits_per_byte FROM s
""",
)
def perplexity_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    d = table(spark, sf_dir, "documents").select((-(F.col("doc_id") % 97 + 1).cast("double") / 4).alias("lp"), text.token_count(t).alias("w"), text.byte_count(t).alias("b"))
    p = d.agg(metrics.perplexities(F.col("lp"), F.col("w"), F.col("b")).alias("p"))
    return p.select(*[F.round(f"p.{k}", DIGITS).alias(k) for k in ("word_perplexity", "byte_perplexity", "bits_per_byte")])


@query("greedy_match_ppl", "SELECT avg((doc_id % 3 = 0)::INT::DOUBLE) AS acc_ll, round(exp(-avg(-(doc_id % 97 + 1)::DOUBLE / 40)), 9) AS ppl_ll FROM documents")
def greedy_match_ppl(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 == 0).alias("g"), (-(F.col("doc_id") % 97 + 1).cast("double") / 40).alias("lp"))
    return d.agg(metrics.greedy_accuracy(F.col("g")).alias("acc_ll"), F.round(metrics.perplexity(F.col("lp")), DIGITS).alias("ppl_ll"))


@query(
    "word_counts",
    r"""
SELECT doc_id, len(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\p{Z}]+')) AS split_words,
       len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '')) AS words, strlen(coalesce(text, '')) AS bytes FROM documents
""",
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.split_word_count(t).alias("split_words"), text.token_count(t).alias("words"), text.byte_count(t).alias("bytes"))


@query(
    "fewshot_topk",
    """
WITH r AS (SELECT lang, text, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents)
SELECT lang, count(*) AS shots, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY doc_id) AS prefix FROM r WHERE k <= 3 GROUP BY lang
""",
)
def fewshot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    shots = selection.fewshot(d, "lang", F.coalesce("text", F.lit("")), 3, row_idx="doc_id")
    return shots.select("lang", F.size("shots").cast("bigint").alias("shots"), "prefix")


@query(
    "fewshot_backoff",
    """
WITH l AS (SELECT doc_id, n_chars % 50 AS a, n_chars % 70 AS b, n_chars % 90 AS c, n_chars % 200 AS own FROM documents)
SELECT doc_id, CASE WHEN a + b + c + own + 32 < 256 THEN 3 WHEN a + b + own + 32 < 256 THEN 2 WHEN a + own + 32 < 256 THEN 1 ELSE 0 END AS shots FROM l
""",
)
def fewshot_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", selection.fewshot_backoff(F.array(n % 50, n % 70, n % 90), n % 200, 32, 256).alias("shots"))


@query(
    "turn_history",
    """
SELECT conv_id, turn, coalesce(string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history,
       count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations
""",
)
def turn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    h = reshape.history(c, "conv_id", "turn", ["role", "text"])
    said = F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n")
    turns = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    return h.join(turns, "conv_id").select("conv_id", "turn", said.alias("history"), "turns")


@query(
    "grouped_refs",
    """
WITH s AS (SELECT conv_id, role, min(turn) AS turn FROM conversations WHERE trim(role) <> '' GROUP BY ALL)
SELECT conv_id, string_agg(role, '|' ORDER BY turn) AS refs, (SELECT role FROM conversations c WHERE c.conv_id = s.conv_id ORDER BY turn LIMIT 1) AS role FROM s GROUP BY conv_id
""",
)
def grouped_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reshape.group_lists(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", ["role"], "refs")
    return g.select("conv_id", F.array_join("refs", "|").alias("refs"), "role")


@query("grouped_structs", "SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id")
def grouped_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = reshape.group_structs(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["turn", "role"], "t")
    return g.select("conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ",").alias("turns"))


@query(
    "numeric_extract",
    """
SELECT o_orderkey, CASE WHEN o_totalprice = floor(o_totalprice) THEN o_totalprice::BIGINT::VARCHAR ELSE rtrim(rtrim(printf('%.2f', o_totalprice), '0'), '.') END AS answer FROM orders
""",
)
def numeric_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" costs a lot.\nThe answer is $"), F.format_number("o_totalprice", 2), F.lit("."))
    return table(spark, sf_dir, "orders").select("o_orderkey", numeric.numeric_answer(said).alias("answer"))


@query(
    "numeric_match",
    "SELECT count(*) AS samples, avg((l_quantity::BIGINT % 2 = 0)::INT::DOUBLE) AS acc_num, count(*) FILTER (l_quantity::BIGINT % 2 = 1 AND l_quantity::BIGINT % 5 = 0) AS invalid FROM lineitem",
)
def numeric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("bigint")
    wrong = F.when(q % 5 == 0, F.lit("I can't tell.")).otherwise(F.concat(F.lit("so it is "), (q + 1).cast("string")))
    said = F.when(q % 2 == 0, F.concat(F.lit("thinking\n#### "), q.cast("string"), F.lit(".00"))).otherwise(wrong)
    x = table(spark, sf_dir, "lineitem").select(numeric.numeric_answer(said).alias("a"), q.cast("string").alias("g"))
    return x.agg(F.count(F.lit(1)).alias("samples"), F.avg(numeric.numbers_equal(F.col("a"), F.col("g")).cast("double")).alias("acc_num"), metrics.invalid_count(F.col("a")).alias("invalid"))


@query(
    "numeric_variants",
    """
SELECT p_partkey, p_size::VARCHAR AS reference, p_size::VARCHAR AS platinum, (p_size || '.5') AS plus_flexible, p_size::VARCHAR AS plus_strict FROM part
""",
)
def numeric_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    hashed = F.concat(F.lit("steps 1 and 2\n#### "), n)
    boxed = F.concat(F.lit("We get \\boxed{"), n, F.lit("}."))
    return table(spark, sf_dir, "part").select(
        "p_partkey", numeric.reference_answer(hashed).alias("reference"), numeric.platinum_answer(boxed).alias("platinum"),
        numeric.plus_flexible(F.concat(F.lit("from 10 to "), n, F.lit(".5"))).alias("plus_flexible"), numeric.plus_strict(hashed).alias("plus_strict"),
    )


@query(
    "label_extract",
    """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN chr(65 + (p_partkey % 4)::INT) WHEN 1 THEN chr(65 + (p_partkey % 4)::INT) WHEN 2 THEN '[invalid]' ELSE 'B' END AS label FROM part
""",
)
def label_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter, case = F.char(65 + F.col("p_partkey") % 4), F.col("p_size") % 4
    said = (
        F.when(case == 0, F.concat(F.lit("First A, but the answer is ("), letter, F.lit(") for sure")))
        .when(case == 1, F.concat(F.lit("Not Z or E; so "), letter, F.lit(".")))
        .when(case == 2, F.lit("I don't know"))
        .otherwise(F.lit("small red wheel"))
    )
    options = F.array(F.lit("wheel"), F.lit("red wheel"), F.lit("axle"), F.lit("hub"))
    return table(spark, sf_dir, "part").select("p_partkey", labels.label_or_text(said, options).alias("label"))


@query(
    "set_f1",
    """
WITH s AS (SELECT conv_id, list_distinct(list(role)) AS p, ['user', 'assistant', 'tool'] AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, round(2.0::DOUBLE * len(list_intersect(p, r)) / (len(p) + len(r)), 9) AS f1 FROM s
""",
)
def set_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("walk\nFinal answer: ["), F.array_join(F.collect_set("role"), ", "), F.lit("]\n\n"))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("said"))
    gold = F.array(F.lit("user"), F.lit("assistant"), F.lit("tool"))
    return g.select("conv_id", F.round(labels.set_f1(labels.final_nodes(F.col("said")), gold), DIGITS).alias("f1"))


@query(
    "stop_truncation",
    """
SELECT doc_id, CASE WHEN strpos(t, '. ') > 0 AND (strpos(t, chr(10)) = 0 OR strpos(t, '. ') < strpos(t, chr(10))) THEN left(t, strpos(t, '. ') - 1)
                    WHEN strpos(t, chr(10)) > 0 THEN left(t, strpos(t, chr(10)) - 1) ELSE t END AS cut FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
""",
)
def stop_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    stops = F.array(F.lit("\n"), F.lit(". "), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate_at_stop(F.coalesce("text", F.lit("")), stops).alias("cut"))


@query("label_prompts", "SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'Answer:' AS prompt FROM part")
def label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gaugery.plans.spec import prompt_column

    rows = table(spark, sf_dir, "part").withColumn("options", F.array("p_brand", "p_type"))
    return rows.select("p_partkey", prompt_column("Question: {p_name}\n{lettered options}\nAnswer:").alias("prompt"))


@query("order_length_desc", "SELECT doc_id, row_number() OVER (ORDER BY length(coalesce(text, '')) DESC, doc_id) - 1 AS exec_pos FROM documents")
def order_length_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the length of the request; only ids and lengths are ranked."""
    d = table(spark, sf_dir, "documents").select("doc_id", requests.length(prompt=F.col("text")).alias("n"))
    return selection.order_rows(d, "length|desc", F.col("n"), row_idx="doc_id").select("doc_id", "exec_pos")


def _shuffled(rows: int, seed: int) -> str:
    """Rows in the order that Python's generator gives, as a list of SQL."""
    order = list(range(rows))
    random.Random(seed).shuffle(order)
    return f"{order}"


#: The SQL knows the order for tables of 200 and of 1,000 rows.
@query(
    "order_shuffle",
    f"WITH n AS (SELECT count(*) AS n FROM documents), o AS (SELECT CASE n WHEN 200 THEN {_shuffled(200, 7)} WHEN 1000 THEN {_shuffled(1000, 7)} END AS o FROM n) SELECT doc_id, list_position(o, doc_id::INT) - 1 AS exec_pos FROM documents, o",
)
def order_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python's seeded shuffle of the native order."""
    return selection.order_rows(table(spark, sf_dir, "documents").select("doc_id"), "shuffle|7", row_idx="doc_id").select("doc_id", "exec_pos")


@query("select_rows", "SELECT item_id, pos FROM benchmark JOIN (VALUES (5, 0), (2, 1), (5, 2), (9, 3)) v(item_id, pos) USING (item_id)")
def select_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a caller lists, in that order, repeats included."""
    return selection.select_rows(table(spark, sf_dir, "benchmark"), [5, 2, 5, 9], row_idx="item_id").select("item_id", F.col("pos").cast("int").alias("pos"))


@query("subset_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def subset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"goods": {"heavy": {"building": "building", "machinery": "machinery"}, "light": "household"}}
    return selection.subset_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("c_mktsegment"), selection.resolve_subsets(tree, "goods.heavy"))


@query(
    "interleave_sources",
    """
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS turn, (dense_rank() OVER (ORDER BY source NULLS LAST) - 1)::INT AS source_pos FROM documents
""",
)
def interleave_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources in turn, rows without one last; a table is named for each, so their number is small."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    named = [r["source"] for r in d.select("source").distinct().orderBy(F.col("source").asc_nulls_last()).collect()]
    return selection.interleave([d.filter(F.col("source").eqNullSafe(F.lit(x))) for x in named], order="doc_id").select("doc_id", "source", "turn", "source_pos")


@query("fixed_groups", "SELECT doc_id // 4 AS group_id, count(*) AS members, max(n_chars) AS longest FROM documents GROUP BY ALL")
def fixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("group_id", reshape.fixed_groups(F.col("doc_id"), 4))
    return d.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.max("n_chars").alias("longest"))


@query(
    "rolling_windows",
    """
WITH e AS (SELECT vec_id, unnest(range(0, len(embedding), 5)) AS place, len(embedding) AS n FROM embeddings)
SELECT vec_id, (place // 5)::INT AS window_idx, least(5, n - place)::INT AS tokens, (CASE WHEN place = 0 THEN 1 ELSE 6 - least(5, n - place) END)::INT AS context, (CASE WHEN place = 0 THEN -1 ELSE place - 1 END)::INT AS last_id FROM e
""",
)
def rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(0), F.size("embedding") - 1).alias("ids"))
    return reshape.rolling_windows(e, "ids", 5, -1).select("vec_id", "window_idx", F.size("window_ids").alias("tokens"), F.size("context_ids").alias("context"), F.element_at("context_ids", -1).alias("last_id"))


_LANES = """
l AS (SELECT 'docs_' || lang AS suite, avg((n_chars > 1500)::INT::DOUBLE) AS value FROM documents WHERE lang <> 'es' GROUP BY ALL),
r AS (SELECT 'docs_' || lang AS suite, avg((n_chars > 2000)::INT::DOUBLE) AS value FROM documents WHERE lang <> 'de' GROUP BY ALL)
"""


@query(
    "compare_lanes",
    f"""
WITH {_LANES} SELECT coalesce(l.suite, r.suite) AS suite, 'acc' AS metric, l.value AS left_value, r.value AS right_value, l.value - r.value AS delta,
  CASE WHEN l.value > r.value THEN 'short' WHEN l.value < r.value THEN 'long' END AS winner FROM l FULL JOIN r ON l.suite = r.suite
""",
)
def compare_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")

    def lane(most: int, without: str) -> DataFrame:
        got = d.filter(F.col("lang") != without).groupBy("lang").agg(F.avg((F.col("n_chars") > most).cast("double")).alias("value"))
        return got.select(F.concat(F.lit("docs_"), "lang").alias("suite"), F.lit("acc").alias("metric"), "value")

    return compare.compare(lane(1500, "es"), lane(2000, "de"), "short", "long")


@query(
    "mean_scores",
    """
SELECT lang AS suite, 'em,long' AS metric, avg((n_chars > 1000)::INT::DOUBLE) AS value, count(*) AS samples FROM documents GROUP BY lang
UNION ALL
SELECT lang, 'em,even', sum((doc_id % 2 = 0)::INT)::DOUBLE / count(*), count(*) FROM documents GROUP BY lang
""",
)
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score that only even rows have still counts over all rows."""
    even = F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("em,even"), F.lit(1.0))).otherwise(F.create_map().cast("map<string,double>"))
    scores = F.map_concat(F.create_map(F.lit("em,long"), (F.col("n_chars") > 1000).cast("double")), even)
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("suite"), scores.alias("scores"))
    return metrics.mean_scores(d, ["suite"])


@query(
    "micro_average",
    "SELECT sum(n)::BIGINT AS instructions, round(sum(ok)::DOUBLE / sum(n), 9) AS inst_level, round(avg((ok = n)::INT::DOUBLE), 9) AS prompt_level FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (length(text) > 200) AS ok FROM conversations GROUP BY conv_id)",
)
def micro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") > 200).alias("ok"))
    return g.agg(F.sum("n").alias("instructions"), F.round(metrics.micro(F.col("ok"), F.col("n")), DIGITS).alias("inst_level"), F.round(F.avg((F.col("ok") == F.col("n")).cast("double")), DIGITS).alias("prompt_level"))


@query(
    "output_join",
    "SELECT doc_id, length(coalesce(text, '')) AS prompt_chars, 'out ' || doc_id AS output FROM documents",
)
def output_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs in another order than requests, by key, each exactly once."""
    d = table(spark, sf_dir, "documents").select("doc_id", requests.length(prompt=F.coalesce("text", F.lit(""))).cast("bigint").alias("prompt_chars"))
    outputs = d.select("doc_id", F.concat(F.lit("out "), F.col("doc_id").cast("string")).alias("output")).orderBy(F.col("doc_id").desc())
    return joins.join_outputs(d, outputs, ["doc_id"]).select("doc_id", "prompt_chars", "output")


@query(
    "self_exclusion",
    "SELECT a.s_suppkey, count(b.s_suppkey) AS shots FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND NOT (a.s_name IS NOT DISTINCT FROM b.s_name) GROUP BY ALL",
)
def self_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return joins.count_others(s, s, "s_nationkey", ["s_name"], "shots").filter("shots > 0").select("s_suppkey", "shots")


@query(
    "token_stats",
    r"SELECT min(n) AS min, round(avg(n), 9) AS avg, max(n) AS max FROM (SELECT len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x1c-\x1f\x{85}\p{Z}]+'), lambda x: x <> '')) AS n FROM documents)",
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").select(text.token_count(F.coalesce("text", F.lit(""))).alias("n"))
    s = n.agg(metrics.token_stats(F.col("n")).alias("s"))
    return s.select("s.min", F.round("s.avg", DIGITS).alias("avg"), "s.max")


@query("low_metrics", "SELECT 'docs_' || lang AS suite, 'acc' AS metric, avg((n_chars > 4000)::INT::DOUBLE) AS value FROM documents WHERE lang <> 'fr' GROUP BY lang HAVING avg((n_chars > 4000)::INT::DOUBLE) <= 0.5")
def low_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg((F.col("n_chars") > 4000).cast("double")).alias("value"))
    results = d.select(F.concat(F.lit("docs_"), "lang").alias("suite"), F.lit("acc").alias("metric"), "value")
    known = spark.createDataFrame([("docs_fr", "acc")], "suite string, metric string")
    return metrics.low_metrics(results, 0.5, known).select("suite", "metric", "value")


@query("bleu4_corpus")
def bleu4_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as predictions of the next passage; statistics by row, one sum, one row out."""
    b = table(spark, sf_dir, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("reference")), "item_id")
    stats = pairs.select(
        bleu.bleu4_stats("text", F.array("reference")).alias("s4"), bleu.bleu_stats("text", F.array("reference")).alias("s13"),
        bleu.chrf_stats("text", "reference").alias("c"), bleu.ter_stats("text", "reference").alias("t"),
    )
    return stats.agg(bleu.bleu4(F.col("s4")).alias("bleu4"), bleu.bleu(F.col("s13")).alias("bleu"), bleu.chrf(F.col("c")).alias("chrf"), bleu.ter(F.col("t")).alias("ter"))


@query("rouge_means")
def rouge_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("reference")), "item_id")
    kinds = ("rouge1", "rouge2", "rougeL", "rougeLsum")
    scored = pairs.select(rouge.rouge_column(F.col("text"), F.col("reference"), kinds).alias("r"))
    return scored.agg(*[F.avg(f"r.{k}").alias(k) for k in kinds])


@query("instruction_checks")
def instruction_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every instruction on every turn of a conversation, strictly and loosely."""
    asked = spark.createDataFrame([(k, '{"keyword": "the", "keywords": ["the"], "letter": "e", "num_words": 50, "num_sentences": 3, "end_phrase": "."}') for k in sorted(ifeval.CHECKS)], "kind string, options string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    each = turns.withColumn("kind", F.explode(F.array(*map(F.lit, sorted(ifeval.CHECKS))))).join(F.broadcast(asked), "kind")
    return each.withColumn("x", ifeval.followed("kind", "text", "options")).groupBy("kind").agg(F.count(F.lit(1)).alias("turns"), F.count_if("x.strict").alias("strict"), F.count_if("x.loose").alias("loose"))


@query(
    "math_answers",
    """
SELECT p_partkey, (CASE p_partkey % 5 WHEN 3 THEN false WHEN 4 THEN p_size % 2 = 0 ELSE true END)::INT::DOUBLE AS em,
       CASE p_partkey % 5 WHEN 0 THEN '\\dfrac{' || p_size || '}{7}' WHEN 1 THEN p_size || ' \\text{ cm}' WHEN 2 THEN '\\left(' || p_size || ', 3\\right)' WHEN 3 THEN (p_size + 1)::VARCHAR ELSE '\\sqrt{' || p_size || '}' END AS answer
FROM part
""",
)
def math_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, units, pairs and roots in boxes and phrases; some answers are wrong."""
    n, kind = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    of = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    pick = lambda *cases: F.coalesce(*[F.when(kind == i, c) for i, c in enumerate(cases)])
    other = F.when(F.col("p_size") % 2 == 0, n).otherwise(F.lit("0"))
    said = pick(
        of("Thus $x$ gives \\boxed{\\dfrac{", n, "}{7}}."), of("It is \\boxed{", n, " \\text{ cm}}"), of("So the final answer is $\\left(", n, ", 3\\right)$."),
        of("\\boxed{1} no, \\boxed{", (F.col("p_size") + 1).cast("string"), "}"), of("we find \\boxed{\\sqrt{", n, "}}"),
    )
    gold = pick(of("\\frac{", n, "}{7}"), n, of("(", n, ",3)"), n, of("\\sqrt", "{", other, "}"))
    return table(spark, sf_dir, "part").select("p_partkey", math_text.math_match(said, gold).alias("em"), math_text.extract_answer(said).alias("answer"))
