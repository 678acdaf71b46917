"""Question answering: normalised text, exact match, token F1, best of several references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugery.functions.text import collapse, let, tokens, without_punctuation

#: What counts as declining to answer; the last but one can't arise once punctuation is gone.
NO_ANSWER = ("", "unanswerable", "no answer", "cannot be answered", "can't be answered", "not answerable")
UNANSWERABLE = "unanswerable"


def normalise(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces."""
    return collapse(F.regexp_replace(without_punctuation(F.lower(c)), r"\b(a|an|the)\b", " "))


def canonical(c: Column) -> Column:
    return let(normalise(c), lambda n: F.when(n.isin(*NO_ANSWER), UNANSWERABLE).otherwise(n))


def counts(a: Column) -> Column:
    """The distinct elements t of an array in order, each with its number n: starts of runs in the sorted array."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.transform(s, lambda x, i: F.struct(x.alias("t"), i.alias("at"), ((i == 0) | (x != F.get(s, i - 1))).alias("head"))), lambda r: r["head"])
        return let(heads, lambda h: F.transform(h, lambda r, j: F.struct(r["t"].alias("t"), (F.coalesce(F.get(h, j + 1)["at"], F.size(s)) - r["at"]).alias("n"))))

    return let(F.sort_array(a), runs)


#: Shared elements up to which each is counted by itself; more are counted by sorting.
FEW = 64


def common_count(left: Column, right: Column) -> Column:
    """Size of the intersection of two arrays as multisets.

    A few shared elements are counted one by one, by what taking them out leaves. Of many the counts of both sides are
    sorted together: of neighbours with one element the first has the lesser number.
    """
    times = lambda a, t: F.size(a) - F.size(F.array_remove(a, t))
    one_by_one = lambda few: F.aggregate(few, F.lit(0), lambda s, t: s + F.least(times(left, t), times(right, t)))
    shared = lambda z: F.transform(z, lambda x, k: F.when(x["t"] == F.get(z, k + 1)["t"], x["n"]).otherwise(0))
    by_sorting = let(F.sort_array(F.concat(counts(left), counts(right))), lambda z: F.aggregate(shared(z), F.lit(0), lambda s, x: s + x))
    return let(F.array_intersect(left, right), lambda few: F.when(F.size(few) <= FEW, one_by_one(few)).otherwise(by_sorting))


def f1_of(common: Column, left: Column, right: Column, both_empty: float | None = 1.0) -> Column:
    """F1 of the sizes of two sides and of what they share. With both_empty None, nothing shared scores 0; else equality of the
    sizes decides where a side is empty."""
    f1 = F.when(common == 0, 0.0).otherwise(2.0 * common / (left + right))
    if both_empty is None:
        return f1
    return F.when((left == 0) | (right == 0), (left == right).cast("double") * both_empty).otherwise(f1)


def multiset_f1(left: Column, right: Column, both_empty: float | None = 1.0) -> Column:
    """F1 of token arrays. With both_empty None, empty sides score 0; else equality decides where a side is empty."""

    score = lambda p, r: let(common_count(p, r), lambda n: f1_of(n, F.size(p), F.size(r), both_empty))
    return let(left, lambda p: let(right, lambda r: score(p, r)))


def exact_match(prediction: Column, target: Column) -> Column:
    return (canonical(prediction) == canonical(target)).cast("double")


def f1(prediction: Column, target: Column) -> Column:
    return multiset_f1(tokens(canonical(prediction)), tokens(canonical(target)))


def best(prediction: Column, targets: Column) -> Column:
    """em, f1 and place of the best target by (em, f1), the first of equals; an empty array is an error."""
    scored = F.transform(targets, lambda t, i: F.struct(exact_match(prediction, t).alias("em"), f1(prediction, t).alias("f1"), (-i).alias("minus")))
    top = F.array_max(scored)
    found = F.struct(top["em"].alias("em"), top["f1"].alias("f1"), (-top["minus"]).alias("place"))
    return F.when(F.size(targets) == 0, F.raise_error(F.lit("a question needs at least one target")).cast("struct<em:double,f1:double,place:int>")).otherwise(found)


def qasper_f1(prediction: Column, answer: Column) -> Column:
    """As f1, but without the aliases, and 0 where nothing is shared even if both are empty."""
    return multiset_f1(tokens(normalise(prediction)), tokens(normalise(answer)), None)


def contains(prediction: Column, target: Column) -> Column:
    """Literal containment without regard to case."""
    return (F.instr(F.lower(prediction), F.lower(target)) > 0).cast("double")


def contains_fraction(prediction: Column, outputs: Column) -> Column:
    """Share of the outputs that a prediction contains; 0 without outputs."""
    hits = F.size(F.filter(outputs, lambda o: F.instr(F.lower(prediction), F.lower(o)) > 0))
    return F.when(F.size(outputs) == 0, 0.0).otherwise(hits / F.size(outputs))


def control_to_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f]+", "\n"), r"(?U)^\s+|\s+$", "")


def headline_clean(c: Column) -> Column:
    """No ASCII punctuation, single spaces, lower case."""
    return F.lower(collapse(without_punctuation(c)))


def aliases(c: Column) -> Column:
    """Trimmed, non-empty, distinct in first-seen order."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))
