"""Answers in several languages: punctuation of any script and a language's articles go; Chinese counts by character."""

from __future__ import annotations

import re
import string
import unicodedata
from collections import Counter

import pandas as pd
from gaugery.functions.arrow import arrow_udf

#: A language's articles; None has none.
ARTICLES = {
    "en": r"\b(a|an|the)\b",
    "es": r"\b(un|una|unos|unas|el|la|los|las)\b",
    "vi": r"\b(của|là|cái|chiếc|những)\b",
    "de": r"\b(ein|eine|einen|einem|eines|einer|der|die|das|den|dem|des)\b",
    "ar": r"(?:^|\s)ال",
    "hi": None,
    "zh": None,
}


def normalise(text: str, language: str) -> str:
    if language not in ARTICLES:
        raise ValueError(f"no normalisation for language {language!r}")
    t = "".join(c for c in text.lower() if c not in string.punctuation and unicodedata.category(c)[0] != "P")
    if ARTICLES[language]:
        t = re.sub(ARTICLES[language], " ", t)
    if language == "zh":
        t = re.sub("([一-鿿])", r" \1 ", t)
    return " ".join(t.split())


def scores(prediction: str, answer: str, language: str) -> tuple[float, float]:
    """Exact match and F1; F1 is 0 where nothing is shared."""
    p, a = normalise(prediction, language), normalise(answer, language)
    both = (Counter(p.split()) & Counter(a.split())).total()
    return float(p == a), 2 * both / (len(p.split()) + len(a.split())) if both else 0.0


@arrow_udf("em double, f1 double, place int")
def mlqa_best(prediction: pd.Series, answers: pd.Series, language: pd.Series) -> pd.DataFrame:
    """The best answer by (em, f1), the first of equals."""
    rows = []
    for p, many, lang in zip(prediction, answers, language, strict=True):
        got = [scores(p or "", a, lang) for a in many]
        place = max(range(len(got)), key=lambda i: (got[i], -i))
        rows.append((*got[place], place))
    return pd.DataFrame(rows, columns=["em", "f1", "place"])
