"""Reshaping of nested rows: choices, turns and their history, problems, question sets, windows of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_choices(df: DataFrame, choices: str = "choices") -> DataFrame:
    """One row per choice: choice_idx from 0 and choice."""
    return df.select("*", F.posexplode(choices).alias("choice_idx", "choice"))


def gather_choices(scored: DataFrame, keys: Sequence[str], first: Sequence[str] = ()) -> DataFrame:
    """The scored choices of each sample as an array ordered by choice_idx; `first` columns are the same on all its rows."""
    parts = F.array_sort(F.collect_list(F.struct("choice_idx", F.col("logprob").cast("double").alias("logprob"), F.col("token_count").cast("int").alias("token_count"))))
    return scored.groupBy(*keys).agg(parts.alias("choices"), *[F.first(c).alias(c) for c in first])


def history(df: DataFrame, group: str, order: str, fields: Sequence[str], name: str = "history") -> DataFrame:
    """Each row with the array of the rows before it in its group.

    What comes out is in proportion to the square of a group's rows, and a group is one task: for conversations of up to
    some thousand turns.
    """
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.collect_list(F.struct(*fields)).over(before))


def group_lists(df: DataFrame, group: str, order: str, value: str, carry: Sequence[str] = (), name: str = "values") -> DataFrame:
    """One row per group: trimmed, non-empty, distinct values in first-seen order; other columns from the first row."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.btrim(value).alias("v")))), lambda s: s["v"])
    first = F.min(F.struct(F.col(order).alias("o"), *carry)).alias("__first")
    out = df.groupBy(group).agg(F.array_distinct(F.filter(seen, lambda v: v != "")).alias(name), first)
    return out.select(group, name, *[F.col(f"__first.{c}").alias(c) for c in carry])


def group_structs(df: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str], name: str) -> DataFrame:
    """One row per keys: the structs of a group in order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct(*fields).alias("__s"))))
    return df.groupBy(*keys).agg(F.transform(listed, lambda s: s["__s"]).alias(name))


def fixed_groups(row_idx: Column, size: int) -> Column:
    """Number of the group of `size` rows in turn to which a row belongs."""
    return F.floor(row_idx / size).cast("bigint")


def columns_to_rows(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """Parallel arrays as rows, with `item_idx`."""
    rest = [c for c in df.columns if c not in arrays]
    zipped = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("item_idx", "__z"))
    return zipped.select(*rest, "item_idx", *[F.col(f"__z.{a}").alias(a) for a in arrays])


def flatten_squad(df: DataFrame, data: str = "data") -> DataFrame:
    """data -> paragraphs -> qas as one row per question: title, context, id, question, answers."""
    a = df.select(F.explode(data).alias("d")).select(F.col("d.title").alias("title"), F.explode("d.paragraphs").alias("p"))
    b = a.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return b.select("title", "context", F.col("q.id").alias("id"), F.col("q.question").alias("question"), F.transform("q.answers", lambda x: x["text"]).alias("answers"))


def flatten_problems(df: DataFrame, problems: str = "problems") -> DataFrame:
    """One row per problem of an article, with those before it."""
    rest = [c for c in df.columns if c != problems]
    out = df.select(*rest, problems, F.posexplode(problems).alias("problem_idx", "problem"))
    return out.withColumn("previous_problems", F.slice(problems, F.lit(1), F.col("problem_idx"))).drop(problems)


def flatten_turns(df: DataFrame, questions: str = "questions", answers: str = "answers") -> DataFrame:
    """One row per turn of a conversation, with the questions and answers before it and the number of turns."""
    rest = [c for c in df.columns if c not in (questions, answers)]
    out = df.select(*rest, questions, answers, F.posexplode(F.arrays_zip(F.col(questions).alias("q"), F.col(answers).alias("a"))).alias("turn", "__t"))
    return out.select(
        *rest, "turn", F.col("__t.q").alias("question"), F.col("__t.a").alias("answer"), F.size(questions).alias("turns"),
        F.slice(questions, F.lit(1), F.col("turn")).alias("history_questions"), F.slice(answers, F.lit(1), F.col("turn")).alias("history_answers"),
    )


def paper_answers(df: DataFrame, qas: str = "qas") -> DataFrame:
    """Questions about papers as one row per answer, with its kind: unanswerable, then bool_yes, free_form, extractive, bool_no."""
    rest = [c for c in df.columns if c != qas]
    a = df.select(*rest, F.explode(qas).alias("q")).select(*rest, F.col("q.question").alias("question"), F.explode("q.answers").alias("a"))
    free = F.coalesce(F.col("a.free_form_answer"), F.lit(""))
    spans = F.coalesce("a.extractive_spans", F.array().cast("array<string>"))
    kind = F.when(F.col("a.unanswerable"), "unanswerable").when(F.col("a.yes_no"), "bool").when(free != "", "free_form").when(F.size(spans) > 0, "extractive").when(~F.col("a.yes_no"), "bool")
    said = F.when(F.col("a.unanswerable"), "unanswerable").when(F.col("a.yes_no"), "yes").when(free != "", free).when(F.size(spans) > 0, F.array_join(spans, ", ")).when(~F.col("a.yes_no"), "no")
    return a.select(*rest, "question", said.alias("answer"), kind.alias("answer_type"))


def lettered_options(text: Column) -> Column:
    """Options of `a ) x , b ) y` in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[abcde] \) (.*?)(?: , (?=[abcde] \))|$)"), F.lit(1)), lambda x: F.btrim(x))


def blank_parts(sentence: Column, options: Column) -> tuple[Column, Column]:
    """Contexts with each option in the place of `_`, and what follows it."""
    head, tail = F.substring_index(sentence, "_", 1), F.substr(sentence, F.instr(sentence, "_") + 1)
    return F.transform(options, lambda o: F.concat(head, o)), tail


def replace_span(text: Column, start: Column, old: Column, new: Column) -> Column:
    """text with `old` at a place (from 0) replaced."""
    return F.concat(F.left(text, start), new, F.substr(text, start + F.length(old) + 1))


def rolling_windows(df: DataFrame, ids: str, width: int, start_id: int) -> DataFrame:
    """Disjoint windows of at most `width` tokens to be scored, each with `context_ids` before it: the start token for the
    first, else the token before, and for a last window that is short as many more as keep the input at its full width."""
    cut = df.select("*", F.posexplode(F.sequence(F.lit(0), F.greatest(F.size(ids) - 1, F.lit(0)), F.lit(width))).alias("window_idx", "at")).filter(F.size(ids) > 0)
    count = F.least(F.lit(width), F.size(ids) - F.col("at"))
    before = F.when(F.col("at") == 0, F.array(F.lit(start_id))).otherwise(F.slice(ids, F.greatest(F.col("at") + count - width, F.lit(1)), width - count + 1))
    return cut.withColumn("context_ids", before).withColumn("window_ids", F.slice(ids, F.col("at") + 1, F.lit(width))).drop("at")


def continuation_chunks(df: DataFrame, prefix: str, target: str, width: int, start_id: int) -> DataFrame:
    """A continuation longer than the model's input, in chunks of at most `width` tokens, each with as much of what stands
    before it as fits: the input holds one token more than the width, as the last one is only predicted."""
    history = F.concat(F.when(F.size(prefix) > 0, F.col(prefix)).otherwise(F.array(F.lit(start_id))), F.col(target))
    cut = df.withColumn("__all", history).filter(F.size(target) > 0)
    cut = cut.select("*", F.posexplode(F.sequence(F.lit(0), F.size(target) - 1, F.lit(width))).alias("chunk_idx", "__at"))
    ends = F.size("__all") - F.size(target) + F.col("__at")  # tokens before the chunk
    count = F.least(F.lit(width), F.size(target) - F.col("__at"))
    context = F.least(ends, width + 1 - count)
    out = cut.withColumn("context_ids", F.slice("__all", ends - context + 1, context)).withColumn("chunk_ids", F.slice(target, F.col("__at") + 1, F.lit(width)))
    return out.drop("__all", "__at")
