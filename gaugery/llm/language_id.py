"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier on hashed character n-grams (orders 1 to 3
over lower-cased letters, other characters being gaps) tells the languages with +1 from those with -1: the log-odds of
an n-gram under the mean of either side, averaged over a text, short texts being drawn to 0. Decoding takes the
codeword of least loss, log(1 + exp(-code * margin)) weighted by each bit's accuracy on the sample, and flags a text as
ambiguous where the runner-up is near. Up to seven languages have the exhaustive code, more a random dense code of distinct
columns chosen for the distance of its words.

Fitting: n-gram counts of at most `per_language` labelled rows of each language, drawn by a hash of their ids in 64
cells, so that no language's rows meet in one task; the model is a table of n-grams by bits, of fixed size. Prediction
reads whole texts in Arrow batches and needs no shuffle.

Defined cases: a null text, or one without letters, is `und` with score 0 and not ambiguous; so is every text if no
labelled row has letters. With one language every other text is that, with score 1. A null id is held out. Rows that
repeat are predicted each by itself. Other columns are carried and not read; one named like a result column gets `_in` at
the end of its name. Empty tables give empty results. More than `most_languages` labels are an error, as the model's size
is in proportion to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import carried, row_sample
from gaugery.ship import ship, tidy

PER_LANGUAGE = 1500
DIMENSIONS = 1 << 16
SMOOTHING = 0.5
AMBIGUOUS = 0.2
#: A margin is SCALE times the mean log-odds of a text with many n-grams; SHRINK n-grams without opinion are added.
SCALE = 3.0
SHRINK = 12
CHUNK = 400_000
#: Characters beyond which a text is read piece by piece.
LONG = 2_000_000
MOST_LANGUAGES = 200


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngrams(texts: list[str], dimensions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashed n-grams of all texts in turn, and each text's first place. Every text has at least one."""
    codes = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    c = np.concatenate(codes)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in codes])
    c = np.where(_letters()[c], c, np.uint32(32))
    same = np.empty(len(c), bool)
    same[0] = False
    same[1:] = (c[1:] == 32) & (c[:-1] == 32) & (own[1:] == own[:-1])
    c, own = c[~same].astype(np.uint64), own[~same]
    x, shift = np.zeros(len(c), np.uint64), np.uint64(64 - (dimensions.bit_length() - 1))
    for order in (1, 2, 3):
        if order > 1:
            c, own, x = c[1:], own[1:], x[:-1]
        x = (x + c) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        # x[i] belongs to the text of its last character; windows that begin in the text before don't count.
        inside = np.ones(len(own), bool) if order == 1 else own == own_before[: len(own)]
        if order == 1:
            own_before = own
            starts_own, at = own, x
        else:
            starts_own, at = own[inside], x[inside]
        bins = ((at * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)
        yield bins, np.searchsorted(starts_own, np.arange(len(texts)))


def pieces(text: str, size: int) -> Iterator[str]:
    """A text in pieces of about `size` characters, cut before a blank where there is one."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        cut = cut if cut > 0 else at + size
        yield text[at:cut]
        at = cut
    yield text[at:]


def long_ngrams(text: str, dimensions: int, size: int = CHUNK) -> Iterator[np.ndarray]:
    """Hashed n-grams of one text, piece by piece and order by order, each once: two characters are carried over a cut."""
    shift, carry = np.uint64(64 - (dimensions.bit_length() - 1)), np.zeros(0, np.uint64)
    every = pieces(text, size)
    piece, first = next(every), " "
    while piece is not None:
        following = next(every, None)
        codes = np.frombuffer(f"{first}{piece.lower()}{' ' if following is None else ''}".encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(32))
        same = np.empty(len(codes), bool)
        same[0] = len(carry) > 0 and carry[-1] == 32 and codes[0] == 32
        same[1:] = (codes[1:] == 32) & (codes[:-1] == 32)
        c = np.concatenate((carry, codes[~same].astype(np.uint64)))
        x = np.zeros(len(c), np.uint64)
        for order in (1, 2, 3):
            # x[i] is of the window that begins at i; those that end in the carry were counted before.
            x = x[: len(c) - order + 1]
            x = (x + c[order - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            own = x[max(0, len(carry) - order + 1) :]
            yield ((own * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)
        carry, piece, first = c[-2:], following, ""


def chunks(texts: list[str], size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `size` characters; a text beyond LONG is a run of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if len(t) > LONG and start < i:
            yield start, i
            start, held = i, 0
        held += len(t)
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1, no column constant or the same as another or its opposite."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        columns = [[1 if i in ones else -1 for i in range(n)] for k in range(1, n) for ones in combinations(range(n), k) if 0 in ones]
        return np.array(columns, np.int8).T
    r, best = np.random.default_rng(seed), None
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(200):
        columns: dict[bytes, np.ndarray] = {}
        while len(columns) < bits:
            c = r.choice(np.array([-1, 1], np.int8), n)
            c *= c[0]  # the opposite column is the same classifier
            if abs(int(c.sum())) < n:
                columns.setdefault(c.tobytes(), c)
        code = np.stack(list(columns.values()), axis=1)
        alike = code.astype(np.int32) @ code.T.astype(np.int32)
        distance = int((bits - alike[~np.eye(n, dtype=bool)]).min()) // 2
        if best is None or distance > best[0]:
            best = distance, code
    return best[1]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    table: np.ndarray  # n-grams x bits
    weights: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        total, counts = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        if len(texts) == 1 and len(texts[0]) > LONG:
            # Numbers of n-grams take the place of the n-grams, so memory doesn't grow with the text.
            found = np.zeros(len(self.table), np.int64)
            for bins in long_ngrams(texts[0], len(self.table)):
                found += np.bincount(bins, minlength=len(found))
            return SCALE * (found @ self.table.astype(np.float64))[None] / (found.sum() + SHRINK)
        for bins, first in ngrams(texts, len(self.table)):
            ends = np.append(first[1:], len(bins))
            some = ends > first
            total[some] += np.add.reduceat(self.table[bins], first[some], axis=0, dtype=np.float64)
            counts += ends - first
        return SCALE * total / (counts + SHRINK)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """texts x languages"""
        return np.logaddexp(0, -margins[:, None, :] * self.codes[None]) @ self.weights

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best and of the next language, score of the best, and whether the two are near."""
        best, second, score, near = (np.zeros(len(texts), t) for t in (np.int64, np.int64, float, bool))
        for a, b in chunks(texts):
            loss = self.losses(self.margins(texts[a:b]))
            order = np.argsort(loss, axis=1, kind="stable")
            rows = np.arange(b - a)
            p = np.exp(loss.min(axis=1)[:, None] - loss)
            p /= p.sum(axis=1)[:, None]
            best[a:b], score[a:b] = order[:, 0], p[rows, order[:, 0]]
            if loss.shape[1] > 1:
                second[a:b] = order[:, 1]
                near[a:b] = p[rows, order[:, 0]] - p[rows, order[:, 1]] < AMBIGUOUS
        return best, second, score, near


def _counter(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if has_letters(text):
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                total = found.setdefault(lang, np.zeros(dimensions, np.int64))
                for a, b in chunks(texts):
                    long = b - a == 1 and len(texts[a]) > LONG
                    for bins in long_ngrams(texts[a], dimensions) if long else (x for x, _ in ngrams(texts[a:b], dimensions)):
                        total += np.bincount(bins, minlength=dimensions)
        for lang, total in found.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bin", "n"])

    return run


def fit(
    docs: DataFrame,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    learnable: Column | None = None,
    per_language: int = PER_LANGUAGE,
    dimensions: int = DIMENSIONS,
    most_languages: int = MOST_LANGUAGES,
) -> Model:
    """The model, of a size that depends on the number of languages alone."""
    ship(docs.sparkSession)
    own = docs if learnable is None else docs.filter(learnable)
    own = own.select(F.col(id_col).alias("id"), F.col(lang_col).alias("label"), F.col(text_col).alias("text"))
    several = [r[0] for r in own.select("label").filter("label is not null").distinct().limit(most_languages + 1).collect()]
    if len(several) > most_languages:
        raise ValueError(f"more than {most_languages} languages; the model holds {dimensions} numbers for each: raise most_languages")
    rows = row_sample(own, per_language)
    counted = rows.mapInArrow(tidy(_counter(dimensions)), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    names, bins, numbers = got.column("lang").combine_chunks().dictionary_encode(), got.column("bin").to_numpy(), got.column("n").to_numpy()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    seen = names.dictionary.to_pylist()
    languages = sorted(seen)
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.zeros((dimensions, 1), np.float32), np.ones(1))
    counts = np.full((len(languages), dimensions), SMOOTHING)
    place = np.array([languages.index(x) for x in seen])
    counts[place[names.indices.to_numpy()], bins] += numbers  # one row for each language and bin
    p = counts / counts.sum(axis=1, keepdims=True)
    side = lambda s: (codes == s).T.astype(float) @ p / (codes == s).sum(axis=0)[:, None]
    model = Model(languages, codes, np.log(side(1) / side(-1)).T.astype(np.float32, order="C"), np.ones(codes.shape[1]))

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(codes.shape[1], np.int64), 0
        for batch in batches:
            pairs = [(x, t) for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letters(t)]
            for a, b in chunks([t for _, t in pairs]):
                truth = codes[[languages.index(x) for x, _ in pairs[a:b]]]
                right += (truth * model.margins([t for _, t in pairs[a:b]]) > 0).sum(axis=0)
                seen += b - a
        yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([right.tolist()])], names=["seen", "right"])

    got = rows.mapInArrow(tidy(tested), "seen long, right array<long>").agg(F.sum("seen").alias("seen"), *[F.sum(F.col("right")[i]).alias(f"r{i}") for i in range(codes.shape[1])]).first()
    accuracy = np.clip([(got[f"r{i}"] + 1) / (got["seen"] + 2) for i in range(codes.shape[1])], 0.51, 0.999)
    weights = np.log(accuracy / (1 - accuracy))
    model.weights = weights / weights.mean()
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' columns, the text only if asked for, with lang_pred, score (0 to 1), second, ambiguous."""
    ship(docs.sparkSession)
    named = carried(docs.columns, ["lang_pred", "score", "second", "ambiguous"])
    kept = list(named.values())
    at = docs.columns.index(text_col)
    sent = [i for i in range(len(kept)) if keep_text or i != at]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            good = [i for i, t in enumerate(texts) if m.languages and has_letters(t)]
            best, second, score, near = ["und"] * len(texts), [None] * len(texts), [0.0] * len(texts), [False] * len(texts)
            for i, b, s, p, n in zip(good, *m.predict([texts[i] for i in good]), strict=True):
                best[i], score[i], near[i] = m.languages[b], float(p), bool(n)
                second[i] = m.languages[s] if len(m.languages) > 1 else None
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in sent), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(near, pa.bool_())],
                names=[*(kept[i] for i in sent), "lang_pred", "score", "second", "ambiguous"],
            )

    ordered = docs.select(*[F.col(f"`{c}`").alias(name) for c, name in named.items()])
    types = "".join(f"`{ordered.schema[i].name}` {ordered.schema[i].dataType.simpleString()}, " for i in sent)
    return ordered.mapInArrow(tidy(run), f"{types}lang_pred string, score double, second string, ambiguous boolean")
