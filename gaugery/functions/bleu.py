"""BLEU, chrF and TER over a corpus, from statistics of each row that are summed.

Statistics of a row are counted on Arrow batches; sums and the last step are Column aggregates, so a corpus of any size
meets in one row of numbers. BLEU, chrF and TER follow the published definitions with the usual parameters: 13a tokens,
exponential smoothing, chrF2 on character 6-grams without blanks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugery.functions.arrow import arrow_udf

#: Fixed value: added to counts before their logarithm is taken.
TINY = 2.2250738585072014e-308


def _counts(tokens: Sequence[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n)), strict=False))


def punct_tokens(text: str) -> list[str]:
    """Words and single signs, in lower case."""
    return re.findall(r"\w+|[^\s\w]", text.strip().lower())


def tokens_13a(text: str) -> list[str]:
    """Tokens of the standard scheme for machine translation."""
    t = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = t.replace(entity, sign)
    t = f" {t} "
    for find, put in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = re.sub(find, put, t)
    return t.split()


def row_stats(prediction: str, references: Sequence[str], tokenise: Callable[[str], list[str]] = punct_tokens) -> tuple[int, int, list[int], list[int]]:
    """Tokens of the shortest reference and of the prediction; by order 1 to 4 the predicted n-grams, and those of them that
    a reference has, each at most as often as in the reference that has it most."""
    p, rs = tokenise(prediction), [tokenise(r) for r in references]
    correct = []
    for n in range(1, 5):
        most: Counter = Counter()
        for r in rs:
            most |= _counts(r, n)
        correct.append((_counts(p, n) & most).total())
    return min(map(len, rs)), len(p), [max(len(p) - n + 1, 0) for n in range(1, 5)], correct


_STATS = "ref_len long, pred_len long, guess array<long>, correct array<long>"


def _table(predictions: pd.Series, references: pd.Series, tokenise: Callable[[str], list[str]]) -> pd.DataFrame:
    rows = [row_stats(p or "", [str(r) for r in rs], tokenise) for p, rs in zip(predictions, references, strict=True)]
    return pd.DataFrame(rows, columns=["ref_len", "pred_len", "guess", "correct"])


@arrow_udf(_STATS)
def bleu4_stats(prediction: pd.Series, references: pd.Series) -> pd.DataFrame:
    """Statistics for `bleu4`, by words and signs in lower case; at least one reference."""
    return _table(prediction, references, punct_tokens)


@arrow_udf(_STATS)
def bleu_stats(prediction: pd.Series, references: pd.Series) -> pd.DataFrame:
    """Statistics for `bleu`, by 13a tokens."""
    return _table(prediction, references, tokens_13a)


def bleu4(stats: Column) -> Column:
    """Smoothed corpus BLEU-4 from 0 to 100 of a column of bleu4_stats: orders 2 to 4 have one added to both counts."""
    part = []
    for n in range(4):
        more = 1.0 if n else 0.0
        guess, correct = (F.sum(stats[k][n]).cast("double") for k in ("guess", "correct"))
        part.append(F.log(correct + more + TINY) - F.log(guess + more + TINY))
    ref, pred = (F.sum(stats[k]).cast("double") for k in ("ref_len", "pred_len"))
    brevity = F.least(F.lit(0.0), 1.0 - (ref + 1.0) / (pred + 1.0))
    return F.exp(sum(part[1:], part[0]) / 4.0 + brevity) * 100.0


@arrow_udf("double")
def sentence_bleu(prediction: pd.Series, references: pd.Series) -> pd.Series:
    """BLEU of a single text from 0 to 1, with orders up to its length and exponential smoothing."""

    def one(p: str, rs: Sequence[str]) -> float:
        ref, size, guess, correct = row_stats(p, rs, tokens_13a)
        orders, halvings, logs = [n for n in range(4) if guess[n] > 0], 0, 0.0
        if not orders or not correct[0]:
            return 0.0
        for n in orders:
            halvings += correct[n] == 0
            logs += math.log((correct[n] or 0.5**halvings) / guess[n])
        return math.exp(logs / len(orders) + min(0.0, 1 - ref / size))

    return pd.Series([one(p or "", [str(r) for r in rs]) for p, rs in zip(prediction, references, strict=True)], dtype=float)


def bleu(stats: Column) -> Column:
    """Corpus BLEU from 0 to 100 of a column of bleu4_stats with tokens_13a; orders without a match are halved in turn."""
    logs, halvings = F.lit(0.0), F.lit(0.0)
    for n in range(4):
        guess, correct = (F.sum(stats[k][n]).cast("double") for k in ("guess", "correct"))
        halvings = halvings + F.when(correct == 0, 1.0).otherwise(0.0)
        logs = logs + F.when(guess == 0, 0.0).when(correct == 0, F.log(F.lit(100.0) / F.pow(F.lit(2.0), halvings) / F.greatest(guess, F.lit(1.0)))).otherwise(F.log(F.greatest(correct, F.lit(TINY)) * 100.0 / F.greatest(guess, F.lit(1.0))))
    ref, pred = (F.sum(stats[k]).cast("double") for k in ("ref_len", "pred_len"))
    brevity = F.when(pred >= ref, 1.0).when(pred > 0, F.exp(1.0 - ref / F.greatest(pred, F.lit(1.0)))).otherwise(0.0)
    missing = F.sum(stats["guess"][3]) == 0
    return F.when(missing | (F.sum(stats["correct"][0]) == 0), 0.0).otherwise(brevity * F.exp(logs / 4.0))


@arrow_udf("pred array<long>, ref array<long>, both array<long>")
def chrf_stats(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    """By order 1 to 6, runs of characters without blanks: in the prediction, in the reference, in both."""
    rows = []
    for p, r in zip(prediction, reference, strict=True):
        p, r = ("".join((x or "").split()) for x in (p, r))
        span = range(1, 7)
        rows.append(([max(len(p) - n + 1, 0) for n in span], [max(len(r) - n + 1, 0) for n in span], [(_counts(p, n) & _counts(r, n)).total() for n in span]))
    return pd.DataFrame(rows, columns=["pred", "ref", "both"])


def chrf(stats: Column, orders: int = 6, beta: float = 2.0) -> Column:
    """Corpus chrF from 0 to 100: F-beta of precision and recall averaged over the orders that occur on both sides."""
    precision, recall, used = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for n in range(orders):
        p, r, b = (F.sum(stats[k][n]).cast("double") for k in ("pred", "ref", "both"))
        there = (p > 0) & (r > 0)
        precision = precision + F.when(there, b / F.greatest(p, F.lit(1.0))).otherwise(0.0)
        recall = recall + F.when(there, b / F.greatest(r, F.lit(1.0))).otherwise(0.0)
        used = used + there.cast("double")
    precision, recall = (x / F.greatest(used, F.lit(1.0)) for x in (precision, recall))
    below = beta**2 * precision + recall
    return F.when(below > 0, 100.0 * (1 + beta**2) * precision * recall / below).otherwise(0.0)


def _edit_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def ter_edits(prediction: str, reference: str, longest: int = 10, farthest: int = 50) -> tuple[int, int]:
    """Edits from prediction to reference, a move of a run of words counting as one, and the words of the reference.

    Moves are chosen greedily: the one that lowers the edit distance most, of words that the reference has as a run.
    """
    h, r = (re.sub(r"\s+", " ", x.strip().lower()).split(" ") if x.strip() else [] for x in (prediction, reference))
    runs = {tuple(r[i : i + n]) for n in range(1, longest + 1) for i in range(len(r) - n + 1)}
    moves, now = 0, _edit_distance(h, r)
    while now:
        best = None
        for n in range(min(longest, len(h)), 0, -1):
            for i in range(len(h) - n + 1):
                run = h[i : i + n]
                if tuple(run) not in runs or run == r[i : i + n]:
                    continue
                rest = h[:i] + h[i + n :]
                for j in range(max(0, i - farthest), min(len(rest), i + farthest) + 1):
                    if j != i and r[j : j + n] == run:
                        moved = rest[:j] + run + rest[j:]
                        d = _edit_distance(moved, r)
                        if now - d > 1 and (best is None or d < best[0]):
                            best = d, moved
        if best is None:
            break
        now, h, moves = best[0], best[1], moves + 1
    return moves + now, len(r)


@arrow_udf("edits long, words long")
def ter_stats(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([ter_edits(p or "", r or "") for p, r in zip(prediction, reference, strict=True)], columns=["edits", "words"])


def ter(stats: Column) -> Column:
    edits, words = F.sum(stats["edits"]).cast("double"), F.sum(stats["words"]).cast("double")
    return F.when(words > 0, 100.0 * edits / F.greatest(words, F.lit(1.0))).when(edits > 0, 100.0).otherwise(0.0)
