"""Multiple choice by log-likelihood, as expressions over `choices`, an array of (choice_idx, logprob, token_count).

The first of equal maxima wins, so argmax is the position of the maximum; `max_by` would take the last. Scores are
doubles throughout, as ties are exact.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from decimal import Decimal, InvalidOperation
from itertools import permutations
from math import ceil, factorial

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = string.ascii_uppercase
MOST_PERMUTED = 8


def labels(n: int) -> list[str]:
    if not 1 <= n <= len(LABELS):
        raise ValueError(f"a question has 1 to {len(LABELS)} labelled choices, not {n}")
    return list(LABELS[:n])


def label_column(n: Column) -> Column:
    return F.slice(F.array(*map(F.lit, LABELS)), F.lit(1), n)


def ordered(choices: Column) -> Column:
    return F.array_sort(choices)


def logprobs(choices: Column) -> Column:
    return F.transform(choices, lambda c: c["logprob"])


def normalised(logprob: Column, tokens: Column) -> Column:
    """Log-probability by token, a choice without tokens counting as one."""
    return logprob / F.greatest(tokens, F.lit(1))


def normalised_logprobs(choices: Column) -> Column:
    return F.transform(choices, lambda c: normalised(c["logprob"], c["token_count"]))


def argmax(values: Column) -> Column:
    """Place, from 0, of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def outcome(choices: Column, gold: Column) -> Column:
    """raw_best, norm_best, raw_acc, norm_acc of ordered choices."""
    raw, norm = argmax(logprobs(choices)), argmax(normalised_logprobs(choices))
    return F.struct(raw.alias("raw_best"), norm.alias("norm_best"), (raw == gold).cast("double").alias("raw_acc"), (norm == gold).cast("double").alias("norm_acc"))


def exam_score(choices: Column, gold: Column) -> Column:
    """1/k if gold is among the k choices that share the maximum, else 0."""
    values = logprobs(choices)
    tied = F.filter(values, lambda v: v == F.array_max(values))
    return F.when(F.get(values, gold) == F.array_max(values), 1.0 / F.size(tied)).otherwise(0.0)


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    return F.transform(values, lambda v: F.exp(v - top) / F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def logsumexp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.log(F.exp(a - top) + F.exp(b - top))


def permutation_share(value: float | int | str | None) -> float:
    """A share of label permutations: a number from 0 to 1; none or a blank is 0."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return 0.0
    try:
        share = float(Decimal(str(value).strip()))
    except (InvalidOperation, ValueError):
        share = -1.0
    if not 0.0 <= share <= 1.0:
        raise ValueError("label_permutations must be a float in [0.0, 1.0]")
    return share


def permutation_metric(value: float | int | str | None) -> str:
    share = permutation_share(value)
    if share == 0.0:
        raise ValueError("a share of 0 has no metric")
    text = format(Decimal(str(share)).normalize(), "f")
    return f"acc,label_perm:{text if '.' in text else text + '.0'}"


def label_permutations(n: int, value: float | int | str | None) -> list[tuple[int, ...]]:
    """The permutations that a share stands for: all of them at 1, else a subset as even as can be.

    A subset is grown one by one. The next is that which keeps the counts of (choice, label) nearest, in squares, to
    what a perfectly even subset of that size would have; the first of equals in lexicographic order.
    """
    share = permutation_share(value)
    if share == 0.0:
        return []
    if n > MOST_PERMUTED:
        raise ValueError(f"{n} choices have {factorial(n)} permutations; at most {MOST_PERMUTED} choices are permuted")
    everything = list(permutations(range(n)))
    size = min(len(everything), max(n, ceil(len(everything) * share)))
    if share == 1.0 or size == len(everything):
        return everything
    seen = {(c, p): 0 for c in range(n) for p in range(n)}
    chosen: list[tuple[int, ...]] = []
    left = dict.fromkeys(everything)
    while len(chosen) < size:
        even = (len(chosen) + 1) / n
        # Only the n pairs that a permutation adds change their square.
        best = min(left, key=lambda p: sum((seen[c, at] + 1 - even) ** 2 - (seen[c, at] - even) ** 2 for at, c in enumerate(p)))
        del left[best]
        chosen.append(best)
        for at, c in enumerate(best):
            seen[c, at] += 1
    return chosen


def permuted_average(n: int, perms: Sequence[tuple[int, ...]], label_logprobs: Column) -> Column:
    """Mean log-probability of each choice: label j of permutation p stands for choice p[j]; label_logprobs is an array of arrays."""
    if not perms or any(len(p) != n for p in perms):
        raise ValueError("at least one permutation is needed, all of the same length")
    total = [F.lit(0.0)] * n
    for k, p in enumerate(perms):
        for at, choice in enumerate(p):
            total[choice] = total[choice] + F.get(F.get(label_logprobs, F.lit(k)), F.lit(at))
    return F.array(*[t / len(perms) for t in total])
