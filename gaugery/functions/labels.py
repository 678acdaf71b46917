"""Choice labels and short answers in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugery.functions.multiple_choice import label_column
from gaugery.functions.text import lines, strip

INVALID = "[invalid]"
#: Phrases that announce a label, in the order in which they are tried.
PRO_PHRASES = (r"(?iU)\bthe answer is\s*\(?([A-Z])\)?", r"(?iU)\banswer is\s*\(?([A-Z])\)?", r"(?iU)\banswer\s*[:\-]\s*\(?([A-Z])\)?")
GPQA_PHRASES = (r"(?iU)\bthe correct answer is\s*\(?([A-D])\)?", r"(?iU)\bthe answer is\s*\(?([A-D])\)?", r"(?iU)\banswer\s*[:\-]\s*\(?([A-D])\)?")
HLE_PHRASES = (
    r"(?iU)\bthe correct answer is\s*\(?([A-J])\)?",
    r"(?iU)\bthe answer is\s*\(?([A-J])\)?",
    r"(?iU)\bfinal answer\s*[:\-]\s*\(?([A-J])\)?",
    r"(?iU)\banswer\s*[:\-]\s*\(?([A-J])\)?",
)


#: What stands before a short answer, answers of yes or no, a letter in brackets, a list of names.
ANSWER_PREFIX = r"(?iU)^\s*(?:A:|Answer:|The answer is)\s*"
YES_NO = r"(?U)\b(True|False|Yes|No)\b"
IN_BRACKETS = r"\(([A-Z])\)"
FINAL_ANSWER = r"(?iU)final answer:\s*\[([^\n]*)\]"


def _found(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(1)), F.upper)


def label(c: Column, valid: Column, phrases: tuple[str, ...] = PRO_PHRASES, bare: str = "A-Z") -> Column:
    """First valid label of the first phrase that has one, else the last valid letter that stands alone."""
    good = lambda xs: F.filter(xs, lambda x: F.array_contains(valid, x))
    said = [F.get(good(_found(c, p)), F.lit(0)) for p in phrases]
    return F.coalesce(*said, F.try_element_at(good(_found(c, rf"(?U)\b([{bare}])\b")), F.lit(-1)), F.lit(INVALID))


def hle_label(c: Column) -> Column:
    """Last label of the first phrase that occurs, else the last letter that stands alone, else empty."""
    said = [F.try_element_at(_found(c, p), F.lit(-1)) for p in HLE_PHRASES]
    return F.coalesce(*said, F.try_element_at(_found(c, r"(?U)\b([A-J])\b"), F.lit(-1)), F.lit(""))


def plain(c: Column) -> Column:
    """Lower case, all but a-z and 0-9 as single spaces."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def label_of_text(c: Column, options: Column) -> Column:
    """Label of the one option that a response equals, else of the longest that it contains, unless two are as long."""
    said, letters = plain(F.coalesce(c, F.lit(""))), label_column(F.size(options))
    pairs = F.transform(options, lambda o, i: F.struct(F.length(plain(o)).alias("size"), F.get(letters, i).alias("label"), plain(o).alias("text")))
    equal = F.filter(pairs, lambda p: p["text"] == said)
    inside = F.filter(pairs, lambda p: (p["size"] > 0) & (F.instr(said, p["text"]) > 0))
    top = F.array_max(F.transform(inside, lambda p: p["size"]))
    longest = F.filter(inside, lambda p: p["size"] == top)
    one = F.when(F.size(longest) == 1, F.get(longest, F.lit(0))["label"]).otherwise(INVALID)
    return F.when(said == "", INVALID).when(F.size(equal) == 1, F.get(equal, F.lit(0))["label"]).otherwise(one)


def label_or_text(c: Column, options: Column, phrases: tuple[str, ...] = PRO_PHRASES, bare: str = "A-Z") -> Column:
    found = label(c, label_column(F.size(options)), phrases, bare)
    return F.when(found == INVALID, label_of_text(c, options)).otherwise(found)


def bbh_answer(c: Column, target: Column) -> Column:
    """First line without an answer prefix, in the shape of the target where that is a yes or no or a letter in brackets."""
    t = F.regexp_replace(F.get(lines(strip(c)), F.lit(0)), ANSWER_PREFIX, "")
    t = strip(t)
    yes_no = F.get(F.regexp_extract_all(t, F.lit(YES_NO), F.lit(1)), F.lit(0))
    letter = F.get(F.regexp_extract_all(t, F.lit(IN_BRACKETS), F.lit(1)), F.lit(0))
    boxed = F.concat(F.lit("("), F.coalesce(letter, F.when(F.rlike(t, F.lit("^[A-Z]$")), t)), F.lit(")"))
    ended = F.when(t.endswith(".") & ~target.endswith("."), F.regexp_replace(t, r"(?U)\.$", "")).otherwise(t)
    ended = F.regexp_replace(ended, r"(?U)\s+$", "")
    return F.coalesce(F.when(target.isin("True", "False", "Yes", "No"), yes_no), F.when(F.rlike(target, F.lit(r"^\([A-Z]\)$")), boxed), ended)


def final_nodes(c: Column, flexible: bool = False) -> Column:
    """Names in `final answer: [...]` on the last line that isn't blank, or with flexible on the last line that has it; null if none."""
    text = F.coalesce(c, F.lit(""))
    rows = F.filter(lines(text), lambda x: strip(x) != "")
    said = F.transform(rows, lambda x: F.get(F.regexp_extract_all(x, F.lit(FINAL_ANSWER), F.lit(1)), F.lit(0)))
    kept = F.filter(said, lambda x: x.isNotNull()) if flexible else said
    inside = F.try_element_at(kept, F.lit(-1))
    names = F.filter(F.split(inside, ",", -1), lambda x: strip(x) != "")
    return F.when(inside.isNull(), None).otherwise(F.transform(names, lambda x: F.btrim(strip(x), F.lit("'\""))))


def set_f1(predicted: Column, reference: Column) -> Column:
    """F1 of two arrays as sets: 1 if both are empty, 0 if one is."""
    p, r = F.array_distinct(predicted), F.array_distinct(reference)
    both = F.size(F.array_intersect(p, r))
    return F.when((F.size(p) == 0) & (F.size(r) == 0), 1.0).otherwise(2.0 * both / (F.size(p) + F.size(r)))


def indices(c: Column, n: Column) -> Column:
    """Integers from 0 below n in a text, none where it says none."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"(\d{1,18})"), F.lit(1)), lambda x: x.cast("bigint"))
    kept = F.array_sort(F.array_distinct(F.filter(found, lambda x: x < n)))
    return F.when(F.instr(F.lower(c), "none") > 0, F.array().cast("array<bigint>")).otherwise(kept)
