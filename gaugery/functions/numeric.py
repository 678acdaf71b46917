"""Numeric answers: finding them in free text, their canonical form, equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugery.functions.text import filled_lines, strip

INVALID = "[invalid]"
NUMBER = r"-?(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+)"
#: Patterns that lead to an answer.
HASH_NUMBER = r"(?U)####\s*(-?(?:[0-9][0-9,]*(?:\.[0-9]+)?|\.[0-9]+))"
ANSWER_LINE = r"(?iU)(?:the\s+final\s+answer\s+is|final\s+answer\s*:|the\s+answer\s+is|answer\s*:)\s*([^\n]+)"
BOXED = r"\\boxed\{(?:\\text\{)?([^\\{}]+)\}"
STRICT = r"#### (\-?[0-9\.\,]+)"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(group))


def _first(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match or null; no pattern here matches the empty text."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def _last(c: Column, pattern: str, group: int = 0) -> Column:
    return F.try_element_at(_all(c, pattern, group), F.lit(-1))


def canonical(token: Column) -> Column:
    """Plain decimal notation without grouping, needless zeros or a minus before zero; [invalid] for what is no number.

    A chain of replacements: no plus, no zeros before a digit, a zero before a leading point, no zeros after the last digit
    of a fraction, no point at the end, no minus before zero.
    """
    t = number = F.replace(strip(token), F.lit(","), F.lit(""))
    for find, put in ((r"^\+", ""), (r"^(-?)0+(?=[0-9])", "$1"), (r"^(-?)\.", "$10."), (r"(\.[0-9]*?)0+$", "$1"), (r"\.$", ""), (r"^-0$", "0")):
        number = F.regexp_replace(number, find, put)
    return F.when(F.rlike(t, F.lit(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$")), number).otherwise(INVALID)


def numbers_equal(left: Column, right: Column) -> Column:
    return (left != INVALID) & (right != INVALID) & (canonical(left) == canonical(right))


def reference_answer(c: Column) -> Column:
    """The number after the first `#### `."""
    return F.coalesce(F.replace(_first(c, STRICT, 1), F.lit(","), F.lit("")), F.lit(INVALID))


def platinum_answer(c: Column) -> Column:
    """A boxed number, or the number of the answer section or of the last line."""
    text = F.coalesce(c, F.lit(""))
    low = F.lower(text)
    said = F.instr(F.replace(low, F.lit("*"), F.lit("")), "answer:") > 0
    section = lambda x: F.substring_index(x, "answer: ", -1)
    boxed = F.when(said, _first(section(low), BOXED, 1)).otherwise(_first(text, BOXED, 1))
    last = F.lower(F.element_at(F.split(F.btrim(text, F.lit("\n")), "\n", -1), -1))
    shown = F.when(boxed.isNotNull(), boxed).when(said, text).otherwise(last)
    clean = F.replace(section(F.lower(F.translate(shown, "*#", ""))), F.lit(","), F.lit(""))
    return F.coalesce(F.regexp_replace(_first(clean, r"-?[0-9.]*[0-9]"), r"\.0+$", ""), F.lit(INVALID))


def numeric_answer(c: Column) -> Column:
    """The first of: number after ####; first number of the last answer phrase; first number of the first box; last number
    of the last line that isn't blank; last number of all."""
    phrase = _first(_last(c, ANSWER_LINE, 1), NUMBER)
    box = _first(_first(c, BOXED, 1), NUMBER)
    line = _last(F.try_element_at(filled_lines(F.coalesce(c, F.lit(""))), F.lit(-1)), NUMBER)
    found = F.coalesce(_first(c, HASH_NUMBER, 1), phrase, box, line, _last(c, NUMBER))
    return canonical(found)


def target_after_hashes(c: Column) -> Column:
    """Gold number after ####; a row without it is an error."""
    found = reference_answer(c)
    return F.when(found == INVALID, F.raise_error(F.lit("the gold answer has no #### marker")).cast("string")).otherwise(found)


def plus_normal(c: Column) -> Column:
    """Lower case without commas and dollars, what stands before the last `#### `, and a final period."""
    t = F.translate(F.lower(strip(c)), ",$", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r"(?s)^.*#### ", ""), r"\.\n?\z", ""))


def plus_strict(c: Column) -> Column:
    return F.coalesce(_first(c, STRICT, 1), F.lit(INVALID))


def plus_flexible(c: Column) -> Column:
    return F.coalesce(_last(c, r"-?[$0-9.,]{2,}|-?[0-9]+"), F.lit(INVALID))
