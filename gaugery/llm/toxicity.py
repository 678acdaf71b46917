"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding lower-cases, maps homoglyphs of Latin letters and, inside words, digits and signs that stand for letters, and
turns all else into gaps, so that every word stands between two spaces. The automaton holds whole words (" word ") and
stems (" stem"); of matches that begin at a place the longest counts, so an exception, a phrase or a word of weight 0
that contains a term, silences it. A text's evidence is the sum of the weights of its matches over a power of its length
in words, and its score is the logistic function of that, both fitted to the sample.

Fitting: a bounded sample of labelled rows. The lexicon is the words and stems whose share of toxic texts could arise
by chance with probability under `chance`, counted by text; a longer term goes where a stem in it does as well, and
words over a stem that occur mainly in clean texts become exceptions. Scoring reads whole texts in Arrow batches.

Defined cases: a null or empty text scores as one without matches, and so does every text if there are no labelled
rows. Rows that repeat are scored each by itself. Other columns are carried, none is read but the text; one named like a
result column gets `_in` at the end of its name. Empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from math import exp, lgamma, log
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import carried, labelled_sample
from gaugery.ship import ship, tidy

MOST_TOXIC = 2000
MOST_CLEAN = 8000
CHANCE = 1e-6
#: Terms of the sample, the most frequent in toxic texts, from which a lexicon is chosen.
MOST_TERMS = 100_000
STEMS = (3, 4, 5, 7)
ONE_WORD = 0.7
POWERS = (0.25, 0.5, 0.75, 1.0)
#: Phrases in which a term is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser")
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "υ": "u", "ι": "i", "κ": "k", "τ": "t", "ε": "e", "η": "n", "χ": "x", "γ": "y", "ı": "i", "ɡ": "g", "ɑ": "a", "ℓ": "l",
}
#: Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_homoglyphs = str.maketrans(HOMOGLYPHS)
_signs = re.compile(r"[0-9@$!]+")
_substitutes = str.maketrans(SUBSTITUTES)
#: Letters that may stand for others: beyond Latin with its accents, and the dotless i.
_foreign = re.compile("[^\\x00-\u0130\u0132-\u024f]")
_gaps = re.compile(r"[\W\d_]+")


def unmix(t: str) -> str:
    """Digits and signs next to a letter as the letters that they stand for, in words of two letters or more; signs that end
    a word are left out, and exclamation marks count between letters only."""
    out, last = [], 0
    for m in _signs.finditer(t):
        a, b = m.span()
        if a < last:
            continue
        before, after = a > 0 and t[a - 1].isalpha(), b < len(t) and t[b].isalpha()
        if not (before and after) and (m.group().strip("!") == "" or not (before or after)):
            continue
        while a > last and (t[a - 1].isalnum() or t[a - 1] in "@$"):
            a -= 1
        while b < len(t) and (t[b].isalnum() or t[b] in "@$!"):
            b += 1
        word = t[a:b].rstrip("@$!")
        out += [t[last:a], word.translate(_substitutes) if sum(map(str.isalpha, word)) >= 2 else word]
        last = b
    return "".join([*out, t[last:]]) if out else t


def fold(text: str | None) -> str:
    """Words in folded letters, each between two spaces of its own."""
    t = (text or "").lower()
    if not t.isascii() and _foreign.search(t):
        t = unicodedata.normalize("NFKC", t).translate(_homoglyphs)
    t = unmix(t)
    return f" {_gaps.sub('  ', t)} "


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # " word ", " stem", and exceptions with weight 0
    power: float = 0.0
    slope: float = 1.0
    bias: float = -4.0


@lru_cache(2)
def _automaton(terms: tuple[tuple[str, float], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in terms:
        a.add_word(term, weight)
    a.make_automaton()
    return a


def evidence(texts: list[str | None], weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each text's matches, and its words."""
    total, length = np.zeros(len(texts)), np.zeros(len(texts))
    a = _automaton(tuple(sorted(weights.items()))) if weights else None
    for i, text in enumerate(texts):
        if text:
            t = fold(text)
            length[i] = t.count("  ") + 1
            if a is not None:
                total[i] = sum(w for _, w in a.iter_long(t))
    return total, length


def score(total: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    x = model.slope * total / (1 + length / 50) ** model.power + model.bias
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _terms(text: str) -> set[str]:
    found = set()
    for w in set(fold(text).split()):
        if len(w) >= 3:
            found.add(f" {w} ")
            found.update(f" {w[:n]}" for n in STEMS if len(w) > n)
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by = Counter(), Counter()
        labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i in range(0, len(texts), 500):
            for label, text in zip(labels[i : i + 500], texts[i : i + 500], strict=True):
                by[bool(label)].update(_terms(text))
            terms = sorted(by[0].keys() | by[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([by[k][t] for t in terms], pa.int64()) for k in (1, 0))], names=["term", "toxic", "clean"])
            by = Counter(), Counter()


def _log_tail(t: int, n: int, p: float) -> float:
    """log P(Binomial(n, p) >= t), by its first terms."""
    first = lgamma(n + 1) - lgamma(t + 1) - lgamma(n - t + 1) + t * log(p) + (n - t) * log(1 - p)
    ratio, total, part = p / (1 - p), 1.0, 1.0
    for k in range(t, min(n, t + 200)):
        part *= (n - k) / (k + 1) * ratio
        total += part
    return first + log(total)


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, chance: float = CHANCE) -> dict[str, float]:
    """The lexicon from (term, toxic texts, clean texts) and the number of texts of either kind."""
    weight = lambda t, c: log((t + 0.5) / (toxic - t + 0.5)) - log((c + 0.5) / (clean - c + 0.5))
    share = toxic / (toxic + clean)
    good = {x: weight(t, c) for x, t, c in counts if t >= 3 and weight(t, c) >= 2 and _log_tail(t, t + c, share) < log(chance)}
    # A stem that stands for little more than one word gives way to that word.
    often = {x: t for x, t, _ in counts}
    most: dict[str, int] = {}
    for x, t in often.items():
        if x.endswith(" "):
            for n in STEMS:
                most[x[: n + 1]] = max(most.get(x[: n + 1], 0), t)
    good = {x: w for x, w in good.items() if x.endswith(" ") or most.get(x, 0) < ONE_WORD * often[x]}
    kept: dict[str, float] = {}
    for x in sorted(good, key=lambda x: (len(x), x)):
        stems = [x[:n] for n in range(2, len(x)) if x[:n] in kept]
        if not any(kept[s] >= good[x] - 1.0 for s in stems):
            kept[x] = good[x]
    words = [x for x in kept if not x.endswith(" ")]
    for x, t, c in counts:
        if x.endswith(" ") and c >= 3 and weight(t, c) < 0.5 and any(x.startswith(s) for s in words):
            kept[x] = 0.0
    return kept


def fit(labels: DataFrame, docs: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, chance: float = CHANCE, exceptions: tuple[str, ...] = EXCEPTIONS, most_terms: int = MOST_TERMS) -> Model:
    """labels: id, label (1 toxic, 0 not); docs: id, text. At most most_toxic + most_clean rows are read for the fit, and at
    most `most_terms` of their terms, and as many possible exceptions, come to the driver."""
    ship(docs.sparkSession)
    rows = labelled_sample(labels, docs, {1: most_toxic, 0: most_clean})
    # Several parts, as the work is on words and the sample is small in bytes.
    spread = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model()
    counted = spread.mapInArrow(tidy(_counted), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # A term needs three toxic texts and a weight of 2, an exception three clean ones over a stem: only such are collected.
    odds = F.log((F.col("toxic") + 0.5) / (F.lit(toxic + 0.5) - F.col("toxic"))) - F.log((F.col("clean") + 0.5) / (F.lit(clean + 0.5) - F.col("clean")))
    likely = counted.filter((F.col("toxic") >= 3) & (odds >= 2)).orderBy(F.col("toxic").desc(), "term").limit(most_terms)
    counts = likely.toPandas()
    lexicon = choose(list(counts.itertuples(index=False, name=None)), toxic, clean, chance)
    stems = [x for x in lexicon if not x.endswith(" ")]
    if stems:
        of = {n: [x for x in stems if len(x) == n] for n in {len(x) for x in stems}}  # as many lengths as STEMS has
        over = reduce(or_, [F.substring("term", 1, n).isin(some) for n, some in sorted(of.items())])
        tame = counted.filter((F.col("clean") >= 3) & F.col("term").endswith(" ") & (odds < 0.5) & over).orderBy(F.col("clean").desc(), "term").limit(most_terms).toPandas()
        lexicon |= dict.fromkeys(tame["term"], 0.0)
    for phrase in exceptions:
        if any(f" {w} " in lexicon for w in phrase.split()):
            lexicon["  ".join(f" {w} ".strip() for w in phrase.split()).join("  ")] = 0.0

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, length = evidence(batch.column(1).to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), pa.array(length)], names=["label", "total", "length"])

    kind = rows.schema["label"].dataType.simpleString()
    seen = spread.mapInArrow(tidy(measured), f"label {kind}, total double, length double").toPandas()
    y = (seen["label"].to_numpy() == 1).astype(float)
    best = None
    for power in POWERS:
        x = seen["total"].to_numpy() / (1 + seen["length"].to_numpy() / 50) ** power
        slope, bias = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-(slope * x + bias))), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-6:
            best = loss, power, slope, bias
    return Model(lexicon, *map(float, best[1:]))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and bias by Newton's steps with a light penalty."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z, w = np.stack([x / scale, np.ones(len(x))], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        gradient = z.T @ (p - y) / len(y) + ridge * np.array([w[0] * 0.01, 0])
        hessian = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag([ridge * 0.01, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, with score (0 to 1), predicted (1 if score >= 0.5), evidence and n_words."""
    ship(docs.sparkSession)
    named = carried([c for c in docs.columns if c != text_col], ["score", "predicted", "evidence", "n_words"])
    rest = list(named.values())
    ordered = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in named.items()], F.col(f"`{text_col}`").alias("__g_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, length = evidence(batch.column(len(rest)).to_pylist(), model.weights)
            p = score(total, length, model)
            columns = pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(total), pa.array(length.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *columns], names=[*rest, "score", "predicted", "evidence", "n_words"])

    types = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ordered.schema.fields[:-1])
    return ordered.mapInArrow(tidy(run), f"{types}score double, predicted int, evidence double, n_words long")
