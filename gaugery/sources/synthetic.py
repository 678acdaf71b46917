"""Long-context rows made to a length: needles in haystacks, variable chains, common and frequent words, questions over documents.

A row depends on its number and the seed alone, so any task can make it again. How much filler fits is found once by
bisection on row 0, with a token counter that the caller gives; every row is then made with that much.
"""

from __future__ import annotations

import random
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugery.ship import ship, tidy

SEED = 42
NOISE = ("The grass is green.", "The sky is blue.", "The sun is yellow.", "Here we go.", "There and back again.")


@dataclass(frozen=True)
class Task:
    """kind: niah, chain, common or frequent; the numbers of keys, values and queries are those of needles."""

    kind: str
    keys: int = 1
    values: int = 1
    queries: int = 1
    token: str = "numbers"
    filler: str = "noise"  # or needles
    new_tokens: int = 128


#: The tasks by name.
TASKS = {
    "niah_single_1": Task("niah"),
    "niah_single_2": Task("niah"),
    "niah_single_3": Task("niah", token="uuids"),
    "niah_multikey_1": Task("niah", keys=4),
    "niah_multikey_2": Task("niah", filler="needles"),
    "niah_multikey_3": Task("niah", token="uuids", filler="needles"),
    "niah_multiquery": Task("niah", keys=4, queries=4),
    "niah_multivalue": Task("niah", values=4),
    "ruler_vt": Task("chain", new_tokens=30),
    "ruler_cwe": Task("common", new_tokens=120),
    "ruler_fwe": Task("frequent", new_tokens=50),
}


def word(r: random.Random, syllables: int = 3) -> str:
    return "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(syllables))


def _token(r: random.Random, kind: str) -> str:
    return str(r.randrange(10**6, 10**7)) if kind == "numbers" else str(uuid.UUID(int=r.getrandbits(128), version=4))


def _distinct(make: Callable[[], str], n: int) -> list[str]:
    found: dict[str, None] = {}
    while len(found) < n:
        found[make()] = None
    return list(found)


def _spread(r: random.Random, filler: list[str], needles: list[str]) -> list[str]:
    """The needles in order at random places among the filler."""
    at = sorted(r.randrange(len(filler) + 1) for _ in needles)
    out, last = [], 0
    for place, needle in zip(at, needles, strict=True):
        out += [*filler[last:place], needle]
        last = place
    return out + filler[last:]


def make(name: str, index: int, units: int, seed: int = SEED) -> tuple[str, list[str], str]:
    """Prompt, expected outputs and the beginning of the answer of a row with so many units of filler."""
    task, r = TASKS[name], random.Random(seed * 1_000_003 + index)
    noise = [NOISE[i % len(NOISE)] for i in range(units)]
    if task.kind == "niah":
        keys = _distinct(lambda: word(r), task.keys)
        held = {k: _distinct(lambda: _token(r, task.token), task.values) for k in keys}
        say = lambda k, v: f"One of the special magic {task.token} for {k} is: {v}."
        needles = [say(k, v) for k, vs in held.items() for v in vs]
        r.shuffle(needles)
        filler = [say(word(r), _token(r, task.token)) for _ in range(units)] if task.filler == "needles" else noise
        asked = r.sample(keys, task.queries)
        what = ", ".join(asked)
        text = "\n".join(_spread(r, filler, needles))
        prompt = f"Some special magic {task.token} are hidden within the following text. Memorize them, as a question about them follows.\n{text}\nWhat are all the special magic {task.token} for {what} mentioned in the provided text?"
        return prompt, [v for k in asked for v in held[k]], f"The special magic {task.token} for {what} mentioned in the provided text are"
    if task.kind == "chain":
        names, value = _distinct(lambda: word(r, 2).upper(), 5), str(r.randrange(10_000, 100_000))
        steps = [f"VAR {names[0]} = {value}", *(f"VAR {b} = VAR {a}" for a, b in zip(names, names[1:], strict=False))]
        prompt = f"Memorize and track the chains of variable assignment hidden in the following text.\n{' '.join(_spread(r, noise, steps))}\nQuestion: Find all variables that are assigned the value {value} in the text above."
        return prompt, names, f"Answer: the {len(names)} variables that are assigned the value {value} are"
    if task.kind == "common":
        words = _distinct(lambda: word(r), 10 + units)
        listed = words[:10] * 30 + words[10:] * 3
        r.shuffle(listed)
        prompt = "Below is a numbered list of words. Memorize the ones that appear most often.\n" + " ".join(f"{i}. {w}" for i, w in enumerate(listed, 1)) + "\nQuestion: What are the 10 most common words in the above list?"
        return prompt, words[:10], "Answer: The top 10 words that appear most often in the list are:"
    top, rare = _distinct(lambda: word(r), 3), _distinct(lambda: word(r, 4), 10 + units)
    listed = [w for k, w in enumerate(top) for _ in range((units + 10) // (3 + k) + 3 - k)] + rare * 2 + ["..."] * (units // 20)
    r.shuffle(listed)
    prompt = "Read the following coded text and track the frequency of each coded word. Find the three most frequently appeared coded words.\n" + " ".join(listed) + "\nQuestion: Do not provide any explanation. Ignore the dots. What are the three most frequently appeared words?"
    return prompt, top, "Answer: According to the coded text above, the three most frequently appeared words are:"


def fit_units(name: str, max_tokens: int, count: Callable[[str], int], seed: int = SEED) -> int:
    """The most filler with which row 0, its outputs and the answer to come fit into so many tokens; at least 1."""
    size = lambda n: count(" ".join([(m := make(name, 0, n, seed))[0], m[2], *m[1]])) + TASKS[name].new_tokens
    low, high = 1, 2
    while size(high) <= max_tokens:
        low, high = high, high * 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if size(mid) <= max_tokens else (low, mid)
    return low


def synthetic_rows(spark: SparkSession, name: str, rows: int, units: int, seed: int = SEED) -> DataFrame:
    """row_idx, prompt (with the beginning of the answer), targets."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i in range(0, len(ids), 64):
                made = [make(name, j, units, seed) for j in ids[i : i + 64]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 64], pa.int64()), pa.array([f"{p} {a}" for p, _, a in made]), pa.array([t for _, t, _ in made], pa.list_(pa.string()))], names=["row_idx", "prompt", "targets"])

    return spark.range(rows).mapInArrow(tidy(run), "row_idx long, prompt string, targets array<string>")


def documents_question(questions: DataFrame, documents: DataFrame, count: int) -> DataFrame:
    """Each question (row_idx, question, doc_id of its source) with its source among `count` documents (doc_id, text), the
    others being those next to it in a fixed pseudo-random order; numbered in that order."""
    ranked = documents.select("doc_id", "text", F.xxhash64("doc_id", F.lit(SEED)).alias("h"))
    near = F.expr(f"explode(sequence(0, {count} - 1))")
    from gaugery.operators.selection import with_row_idx

    placed = with_row_idx(ranked.orderBy("h", "doc_id"), "place").drop("h")
    total = placed.count()
    asked = questions.join(placed.select("doc_id", F.col("place").alias("own")), "doc_id").withColumn("step", near).withColumn("place", F.pmod(F.col("own") + F.col("step"), F.lit(total)))
    listed = asked.join(placed.select("place", "text"), "place").groupBy("row_idx", "question").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("place", "row_idx").alias("o"), "text"))).alias("d"))
    shown = F.array_join(F.transform("d", lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), x["text"])), "\n\n")
    return listed.select("row_idx", F.concat(F.lit("Answer the question based on the given documents.\n"), shown, F.lit("\n\nQuestion: "), "question", F.lit("\nAnswer:")).alias("prompt"))
