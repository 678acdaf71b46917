"""Scores of long-context tasks, chosen by the task's name."""

from __future__ import annotations

import difflib
import re
import string
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugery.functions.arrow import arrow_udf
from gaugery.functions.rouge import rouge_l, tokenise

#: The score of each task, and the tasks of which only the first line counts.
METRICS = {
    "qa_f1": "narrativeqa qasper multifieldqa_en hotpotqa 2wikimqa musique triviaqa",
    "qa_f1_zh": "multifieldqa_zh",
    "rouge": "gov_report qmsum multi_news samsum",
    "rouge_zh": "dureader vcsum",
    "classification": "trec lsht",
    "count": "passage_count",
    "retrieval": "passage_retrieval_en",
    "retrieval_zh": "passage_retrieval_zh",
    "code_sim": "lcc repobench-p",
}
FIRST_LINE = frozenset("triviaqa samsum trec lsht".split())
METRIC_OF = {task: m for m, tasks in METRICS.items() for task in tasks.split()}


def _is_sign(c: str) -> bool:
    return c in string.punctuation or unicodedata.category(c)[0] == "P"


def _english(text: str) -> list[str]:
    return re.sub(r"\b(a|an|the)\b", " ", "".join(c for c in text.lower() if not _is_sign(c))).split()


def chinese(text: str) -> list[str]:
    """CJK characters one by one, other runs whole, signs and blanks apart."""
    spaced = "".join(" " if c.isspace() or _is_sign(c) else f" {c} " if "一" <= c <= "鿿" else c for c in text.lower())
    return [t for t in spaced.split(" ") if t]


def token_f1(p: list[str], r: list[str]) -> float:
    if not p or not r:
        return float(p == r)
    both = (Counter(p) & Counter(r)).total()
    return 2 * both / (len(p) + len(r))


def _numbers(text: str, wanted: str | None) -> float:
    found = re.findall(r"\d+", text)
    return sum(x == wanted for x in found) / len(found) if found and wanted is not None else 0.0


def _classes(p: str, r: str, classes: list[str]) -> float:
    hits = [c for c in classes if c and c in p and (c == r or c not in r)]
    return 1 / len(hits) if r in hits else 0.0


def _code(p: str, r: str) -> float:
    rows = p.lstrip("\n").split("\n")
    line = next((x for x in rows if not any(s in x for s in "`#") and "//" not in x), "")
    return difflib.SequenceMatcher(None, line, r).ratio()


def score(task: str, prediction: str, reference: str, classes: list[str] = ()) -> float:
    """A task's name may end in _e."""
    root = task.removesuffix("_e")
    p = prediction.lstrip("\n").split("\n")[0] if root in FIRST_LINE else prediction
    match METRIC_OF[root]:
        case "qa_f1":
            return token_f1(_english(p), _english(reference))
        case "qa_f1_zh":
            return token_f1(chinese(p), chinese(reference))
        case "rouge":
            return rouge_l(tokenise(reference), tokenise(p))[2]
        case "rouge_zh":
            return rouge_l(tokenise(" ".join(chinese(reference))), tokenise(" ".join(chinese(p))))[2]
        case "classification":
            return _classes(p, reference, classes)
        case "count":
            return _numbers(p, str(reference).strip())
        case "code_sim":
            return _code(p, reference)
        case retrieval:
            m = re.search(r"段落(\d+)" if retrieval == "retrieval_zh" else r"Paragraph (\d+)", reference)
            return _numbers(p, m[1] if m else None)


def scored_part(task: str, prediction: Column) -> Column:
    """What of a prediction counts: of some tasks the first line."""
    if task.removesuffix("_e") not in FIRST_LINE:
        return prediction
    return F.substring_index(F.ltrim(prediction, F.lit("\n")), "\n", 1)


@arrow_udf("double")
def longbench_score(task: pd.Series, prediction: pd.Series, references: pd.Series, classes: pd.Series) -> pd.Series:
    """The best score over the references; classes may be null."""
    rows = zip(task, prediction, references, classes, strict=True)
    return pd.Series([max((score(t, p or "", str(r), [] if c is None else list(c)) for r in rs), default=0.0) for t, p, rs, c in rows], dtype=float)
