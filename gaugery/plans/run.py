"""A suite from rows to metrics: samples -> requests -> outputs -> scores -> metrics, one plan per suite.

The model is a scorer: a function from requests to outputs, both DataFrames. Likelihood requests have row_idx, choice_idx,
context and continuation, their outputs logprob, is_greedy and token_count; generation requests have row_idx, prompt and
stops, their outputs text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugery.functions import bleu, classification, ifeval, labels, longbench, math_text, mlqa, numeric, qa_text, rouge, text
from gaugery.functions import multiple_choice as mc
from gaugery.operators import joins, metrics, reshape, selection
from gaugery.plans.rows import ROWS, prepared
from gaugery.plans.spec import prompt_column, sql
from gaugery.plans.suites import Suite
from gaugery.ship import ship, tidy

Scorer = Callable[[DataFrame], DataFrame]


def hash_scorer(requests: DataFrame) -> DataFrame:
    """A stand-in for a model whose outputs depend on the request's text alone, in SQL functions."""
    n = F.crc32(F.concat("context", "continuation").cast("binary"))
    return requests.select("row_idx", "choice_idx", (-(n % 10_000) / 1000.0).alias("logprob"), (n % 2 == 0).alias("is_greedy"), F.greatest(F.size(F.split(F.btrim("continuation"), " ")), F.lit(1)).alias("token_count"))


def recorded(outputs: DataFrame) -> Scorer:
    """Outputs that were recorded before, by request key."""

    def run(requests: DataFrame) -> DataFrame:
        keys = [c for c in ("row_idx", "choice_idx") if c in requests.columns]
        return joins.join_outputs(requests.select(*keys), outputs, keys)

    return run


def python_scorer(score: Callable[[list[dict]], list[dict]], schema: str, batch: int = 64) -> Scorer:
    """A model in Python: requests of an Arrow batch come as dicts, longest first, `batch` at a time; outputs go back in any order."""

    def run(requests: DataFrame) -> DataFrame:
        ship(requests.sparkSession)
        size = [F.length(c) for c in requests.columns if dict(requests.dtypes)[c] == "string"]
        ordered = requests.sortWithinPartitions(sum(size[1:], size[0]).desc())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = b.to_pylist()
                for i in range(0, len(rows), batch):
                    yield pa.RecordBatch.from_pylist(score(rows[i : i + batch]))

        return ordered.mapInArrow(tidy(work), schema)

    return run


@dataclass
class Result:
    suite: str
    samples: DataFrame
    metrics: DataFrame  # suite, metric, value


def build(rows: DataFrame, suite: Suite) -> DataFrame:
    """rows with prompt, and choices and gold, or targets, as the suite says; what it doesn't say must be there."""
    given = suite.name in ROWS and "prompt" in rows.columns
    rows = prepared(suite.name, rows)
    made = {"__p": prompt_column(suite.prompt)} if suite.prompt is not None and not given else {}
    made |= {f"__{k}": sql(getattr(suite, k)) for k in ("choices", "gold", "targets", "suffix") if getattr(suite, k) is not None}
    out = rows.withColumns(made) if made else rows
    for short, name in (("__p", "prompt"), ("__choices", "choices"), ("__gold", "gold"), ("__targets", "targets"), ("__suffix", "suffix")):
        if short in made:
            out = out.drop(name).withColumnRenamed(short, name)
    return out


def with_shots(rows: DataFrame, pool: DataFrame, suite: Suite, k: int, group: str | None = None) -> DataFrame:
    """rows with `prefix`: the suite's description and the first k exemplars of the pool, of the row's group if one is named."""
    key = group or "__all"
    keyed = rows if group else rows.withColumn(key, F.lit(0))
    shots = selection.fewshot(pool if group else pool.withColumn(key, F.lit(0)), key, prompt_column(suite.shot), k)
    sections = F.concat(F.array(prompt_column(suite.description)), F.coalesce("shots", F.array().cast("array<string>")))
    said = F.filter(sections, lambda x: x != "")
    joined = keyed.join(shots.select(key, "shots"), key, "left")
    return joined.withColumn("prefix", F.when(F.size(said) > 0, F.concat(F.array_join(said, "\n\n"), F.lit("\n\n"))).otherwise("")).drop("shots", "__all")


def _named(scores: dict[str, Column]) -> Column:
    return F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), v.cast("double"))])


def likelihood_requests(samples: DataFrame, suite: Suite) -> DataFrame:
    if suite.suffix is not None:
        return reshape.explode_choices(samples.select("row_idx", "suffix", "choices")).select("row_idx", "choice_idx", F.col("choice").alias("context"), F.col("suffix").alias("continuation"))
    exploded = reshape.explode_choices(samples.select("row_idx", "prompt", "choices"))
    said = F.col("choice") if suite.bare else text.continuation(F.col("choice"))
    return exploded.select("row_idx", "choice_idx", F.col("prompt").alias("context"), said.alias("continuation"))


def multiple_choice(rows: DataFrame, suite: Suite, scorer: Scorer = hash_scorer) -> Result:
    samples = build(rows, suite)
    outputs = scorer(likelihood_requests(samples, suite))
    scored = reshape.gather_choices(outputs, ["row_idx"]).withColumnRenamed("choices", "scored")
    joined = joins.join_outputs(samples, scored, ["row_idx"])
    x = mc.outcome(F.col("scored"), F.col("gold"))
    if suite.kind == "exam":
        out = joined.withColumn("scores", _named({"acc,exam": mc.exam_score(F.col("scored"), F.col("gold"))})).withColumn("norm_best", x["norm_best"]).withColumn("raw_best", x["raw_best"])
    else:
        out = joined.withColumn("x", x).withColumn("scores", _named({"acc,ll": F.col("x.raw_acc"), "acc,ll_avg": F.col("x.norm_acc")})).select("*", "x.raw_best", "x.norm_best").drop("x")
    out = out.withColumn("prediction", F.get("choices", F.col("norm_best"))).withColumn("target", F.get("choices", F.col("gold")))
    found = metrics.mean_scores(out).select(F.lit(suite.name).alias("suite"), "metric", "value")
    extra: dict[str, Column] = {}
    for key, best in (("ll", "raw_best"), ("ll_avg", "norm_best")):
        if suite.scorer == "mcc":
            extra[f"mcc,{key}"] = classification.matthews(F.col(best), F.col("gold"))
        if suite.scorer == "f1":
            extra[f"f1,{key}_boolean"] = classification.f1_for_label(F.col(best), F.col("gold"), 1)
        if suite.labels:
            name = "f1,ll_macro" if key == "ll" else "f1,ll_avg_macro"
            extra[name] = classification.macro_f1(F.col(best), F.col("gold"), [int(v) for v in suite.labels])
    if extra:
        more = out.agg(_named(extra).alias("m")).select(F.lit(suite.name).alias("suite"), F.explode("m").alias("metric", "value"))
        found = found.unionByName(more)
    return Result(suite.name, out, found)


def own(rows: DataFrame, suite: Suite, scorer: Scorer = hash_scorer) -> Result:
    """Likelihoods of choices with another score than the share of right ones."""
    samples = build(rows, suite)
    outputs = scorer(likelihood_requests(samples, suite)).withColumn("lp", F.col("logprob").cast("double"))
    listed = F.array_sort(F.collect_list(F.struct("choice_idx", "lp", "is_greedy")))
    joined = joins.join_outputs(samples, outputs.groupBy("row_idx").agg(listed.alias("scored")), ["row_idx"])
    lps = F.transform("scored", lambda c: c["lp"])
    best = mc.argmax(lps)
    match suite.scorer:
        case "preference":
            scores = {"pct_stereotype": F.get(lps, F.lit(0)) > F.get(lps, F.lit(1)), "ll_diff": F.abs(F.get(lps, F.lit(0)) - F.get(lps, F.lit(1)))}
        case "cooccurrence":
            at = lambda i: F.get(lps, F.lit(i))
            scores = {"likelihood_diff": mc.logsumexp(at(0), at(1)) - mc.logsumexp(at(2), at(3)), "pct_male_preferred": best >= 2}
        case "truth_first":
            scores = {"acc": F.get("gold", best) == 1}
        case "truth_mass":
            mass = F.zip_with(mc.softmax(lps), F.col("gold"), lambda p, g: F.when(g == 1, p).otherwise(0.0))
            scores = {"acc": F.aggregate(mass, F.lit(0.0), lambda s, x: s + x)}
        case "greedy":
            greedy = F.array_position(F.transform("scored", lambda c: F.coalesce(c["is_greedy"], F.lit(False))), True)
            scores, best = {"em": greedy > 0}, F.when(greedy > 0, (greedy - 1).cast("int")).otherwise(best)
        case other:
            raise NotImplementedError(f"{suite.name} needs {other or 'an evaluator'} outside this engine")
    out = joined.withColumn("prediction", F.get("choices", best)).withColumn("scores", _named(scores))
    return Result(suite.name, out, metrics.mean_scores(out).select(F.lit(suite.name).alias("suite"), "metric", "value"))


def single(rows: DataFrame, suite: Suite, scorer: Scorer = hash_scorer) -> Result:
    samples = build(rows, suite)
    asked = samples.select("row_idx", F.lit(0).alias("choice_idx"), F.col("prompt").alias("context"), F.get("targets", F.lit(0)).alias("continuation"))
    out = joins.join_outputs(samples, scorer(asked).drop("choice_idx"), ["row_idx"]).withColumn("scores", _named({"acc,ll": F.col("is_greedy")}))
    found = out.agg(_named({"acc,ll": metrics.greedy_accuracy(F.col("is_greedy")), "ppl,ll": metrics.perplexity(F.col("logprob"))}).alias("m"))
    return Result(suite.name, out, found.select(F.lit(suite.name).alias("suite"), F.explode("m").alias("metric", "value")))


@dataclass(frozen=True)
class Windows:
    """How a text is scored that is longer than a model's input: a function from a text column to its token ids, the
    input's width, and the id that stands before a first token."""

    tokenise: Callable[[Column], Column]
    width: int
    start_id: int


def _windowed(samples: DataFrame, scorer: Scorer, windows: Windows) -> DataFrame:
    """row_idx, logprob and token_count of texts that are scored window by window: disjoint windows, each after what fits
    before it. A request has the ids beside their texts, numbers parted by spaces; its choice_idx is the window's number."""
    told = reshape.rolling_windows(samples.select("row_idx", windows.tokenise(F.col("scored_text")).alias("ids")), "ids", windows.width, windows.start_id)
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    asked = told.select("row_idx", F.col("window_idx").alias("choice_idx"), text_of("context_ids").alias("context"), text_of("window_ids").alias("continuation"), "context_ids", F.col("window_ids").alias("continuation_ids"))
    sums = scorer(asked).groupBy("row_idx").agg(F.sum("logprob").alias("logprob"), F.sum("token_count").alias("token_count"))
    # A text without tokens has no window, and nothing to score.
    return samples.select("row_idx").join(sums, "row_idx", "left").fillna({"logprob": 0.0, "token_count": 0})


def rolling(rows: DataFrame, suite: Suite, scorer: Scorer = hash_scorer, windows: Windows | None = None) -> Result:
    samples = build(rows, suite)
    wiki = suite.name == "wikitext"
    samples = samples.withColumn("scored_text", text.wikitext(F.col("prompt")) if wiki else F.col("prompt"))
    samples = samples.withColumn("words", text.split_word_count(F.col("prompt")) if wiki else text.token_count(F.col("prompt"))).withColumn("bytes", text.byte_count(F.col("prompt")))
    if windows is None:
        asked = samples.select("row_idx", F.lit(0).alias("choice_idx"), F.lit("").alias("context"), F.col("scored_text").alias("continuation"))
        scored = scorer(asked).select("row_idx", "logprob", "token_count")
    else:
        scored = _windowed(samples, scorer, windows)
    out = joins.join_outputs(samples, scored, ["row_idx"])
    p = out.agg(metrics.perplexities(F.col("logprob"), F.col("words"), F.col("bytes")).alias("p"))
    found = p.select(F.lit(suite.name).alias("suite"), F.explode(_named({k: F.col(f"p.{k}") for k in ("word_perplexity", "byte_perplexity", "bits_per_byte")})).alias("metric", "value"))
    return Result(suite.name, out, found)


def _answers(kind: str, p: Column, ts: Column) -> tuple[dict[str, Column], Column]:
    """Scores of a generated text, and what was extracted from it."""
    first = F.get(ts, F.lit(0))
    if kind.startswith("longbench "):
        task = kind.removeprefix("longbench ")
        scored = longbench.longbench_score(F.lit(task), p, ts, F.col("classes"))
        return {"score": scored, f"{longbench.METRIC_OF[task.removesuffix('_e')]}_score": scored}, longbench.scored_part(task, p)
    match kind:
        case "em":
            return {"em": text.strip(p) == first}, text.strip(p)
        case "em_raw":
            return {"em": p == first}, p
        case "bbh":
            return {"em": labels.bbh_answer(p, first) == first}, labels.bbh_answer(p, first)
        case "contains":
            return {"contains": qa_text.contains(p, first)}, p
        case "qa":
            best = qa_text.best(p, qa_text.aliases(ts))
            return {"em": best["em"], "f1": best["f1"]}, qa_text.canonical(p)
        case "mlqa":
            best = mlqa.mlqa_best(p, ts, F.lit("en"))
            return {"em": best["em"], "f1": best["f1"]}, p
        case "qasper":
            return {"f1,abstractive": qa_text.qasper_f1(p, first)}, qa_text.normalise(p)
        case "numeric" | "numeric_hash":
            gold = numeric.reference_answer(first) if kind == "numeric_hash" else first
            return {"acc,num": numeric.numbers_equal(numeric.numeric_answer(p), gold)}, numeric.numeric_answer(p)
        case "plus":
            gold = numeric.plus_normal(first)
            return {"em,strict": numeric.plus_normal(numeric.plus_strict(p)) == gold, "em,flex": numeric.plus_normal(numeric.plus_flexible(p)) == gold}, numeric.plus_flexible(p)
        case "math":
            return {"em": math_text.math_match(p, first)}, math_text.extract_answer(p)
        case "math_solution":
            return {"em": math_text.math_match(p, math_text.extract_answer(first))}, math_text.extract_answer(p)
        case "short":
            return {"em": math_text.short_match(p, first)}, p
        case "label_pro":
            found = labels.label_or_text(p, F.col("options"))
            return {"em,choice_label": found == first}, found
        case "label_gpqa":
            found = labels.label_or_text(p, F.col("options"), labels.GPQA_PHRASES, "A-D")
            return {"em,choice_label": found == first}, found
        case "summary":
            r = rouge.rouge(("rouge1", "rouge2", "rougeLsum"))(p, ts)
            return {k: r[k] for k in ("rouge1", "rouge2", "rougeLsum")}, p
        case "indices":
            said, gold = labels.indices(p, F.size("answers")), F.transform(ts, lambda x: x.cast("bigint"))
            none = F.size(said) == 0
            f1 = F.when(none & (F.size(gold) == 0), 1.0).when(none, 0.0).otherwise(labels.set_f1(said, gold))
            return {"em": F.array_sort(said) == F.array_sort(F.array_distinct(gold)), "f1a": f1}, F.array_join(F.transform(said, lambda x: x.cast("string")), ",")
        case "contains_all":
            return {"contains": qa_text.contains_fraction(qa_text.control_to_lines(p), ts)}, qa_text.control_to_lines(p)
        case "bleu_rouge":
            r = rouge.rouge(("rouge1", "rouge2", "rougeL"))(p, ts)
            return {"bleu": bleu.sentence_bleu(p, ts), **{k: r[k] for k in ("rouge1", "rouge2", "rougeL")}}, p
        case "headline":
            clean = qa_text.headline_clean(p)
            r = rouge.rouge(("rouge1",), stemmed=False)(clean, F.array(qa_text.headline_clean(first)))
            return {"rouge1": r["rouge1"], "average_len": F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))}, clean
        case "nodes":
            strict, flexible = labels.final_nodes(p), labels.final_nodes(p, True)
            none = F.array().cast("array<string>")
            return {"f1": labels.set_f1(F.coalesce(strict, none), ts), "f1,flexible": labels.set_f1(F.coalesce(flexible, none), ts)}, F.array_join(F.coalesce(strict, none), ", ")
    raise KeyError(f"no such scorer: {kind}")


def generate(rows: DataFrame, suite: Suite, scorer: Scorer) -> Result:
    samples = build(rows, suite)
    if (suite.scorer or "").startswith("longbench ") and "classes" not in samples.columns:
        samples = samples.withColumn("classes", F.array().cast("array<string>"))
    stops = F.array(*map(F.lit, suite.stops)) if suite.stops else F.array().cast("array<string>")
    asked = samples.select("row_idx", "prompt", stops.alias("stops"), F.lit(suite.max_new_tokens).alias("max_new_tokens"))
    said = scorer(asked).select("row_idx", F.col("text").alias("__text"))
    out = joins.join_outputs(samples, said, ["row_idx"]).withColumn("prediction", text.truncate_at_stop(F.coalesce("__text", F.lit("")), stops)).drop("__text")
    suite_col = F.lit(suite.name).alias("suite")
    if suite.scorer in ("translation", "bleu4"):
        one = F.get("targets", F.lit(0))
        p = text.strip(F.col("prediction"))
        if suite.scorer == "bleu4":
            found = out.select(bleu.bleu4_stats(p, F.array(one)).alias("s")).agg(_named({"bleu4": bleu.bleu4(F.col("s"))}).alias("m"))
        else:
            stats = out.select(bleu.bleu_stats(p, F.array(one)).alias("s"), bleu.chrf_stats(p, one).alias("c"), bleu.ter_stats(p, one).alias("t"))
            found = stats.agg(_named({"bleu": bleu.bleu(F.col("s")), "chrf": bleu.chrf(F.col("c")), "ter": bleu.ter(F.col("t"))}).alias("m"))
        return Result(suite.name, out, found.select(suite_col, F.explode("m").alias("metric", "value")))
    if suite.scorer == "ifeval":
        each = out.select("row_idx", "prediction", F.posexplode(F.arrays_zip("instruction_id_list", "kwargs")).alias("i", "z")).withColumn("x", ifeval.followed("z.instruction_id_list", "prediction", "z.kwargs"))
        per = each.groupBy("row_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.strict").alias("s"), F.count_if("x.loose").alias("l"))
        out = out.join(per, "row_idx", "left").fillna(0, ["n", "s", "l"])
        names = {}
        for k, c in (("strict", "s"), ("loose", "l")):
            names |= {f"prompt_level_{k}_acc": F.avg((F.col(c) == F.col("n")).cast("double")), f"inst_level_{k}_acc": metrics.micro(F.col(c), F.col("n"))}
        return Result(suite.name, out, out.agg(_named(names).alias("m")).select(suite_col, F.explode("m").alias("metric", "value")))
    scores, extracted = _answers(suite.scorer, F.col("prediction"), F.col("targets"))
    out = out.withColumn("extracted", extracted).withColumn("scores", _named(scores))
    return Result(suite.name, out, metrics.mean_scores(out).select(suite_col, "metric", "value"))


#: Suites whose rows take exemplars in a form of their own.
WITH_POOL = ("mmlu_pro", "mmlu_pro_plus")
RUNNERS = {"mc": multiple_choice, "exam": multiple_choice, "single": single, "rolling": rolling, "generate": generate, "own": own}


def evaluate(
    rows: DataFrame, suite: Suite, scorer: Scorer | None = None, *, pool: DataFrame | None = None, shots: int = 5, group: str | None = None, order: str | None = None, windows: Windows | None = None
) -> Result:
    """rows have row_idx. Suites that run generated code aren't evaluated, as there is no sandbox.

    pool: rows from which the first `shots` exemplars are taken, of each row's `group` if a column is named. order: the
    order of submission, by which samples get exec_pos; it changes no result. windows: for perplexity of long texts.
    """
    if suite.kind == "own" and suite.scorer is None:
        raise NotImplementedError(f"{suite.name} runs generated code")
    if suite.kind == "generate" and scorer is None:
        raise ValueError("generated answers need a scorer")
    if pool is not None:
        rows = prepared(suite.name, rows, pool=pool, shots=shots) if suite.name in WITH_POOL else with_shots(rows, pool, suite, shots, group)
    more = {"windows": windows} if suite.kind == "rolling" else {}
    result = RUNNERS[suite.kind](rows, suite, *([scorer] if scorer else []), **more)
    if order is not None:
        result.samples = selection.order_rows(result.samples, order, F.length("prompt"))
    return result
