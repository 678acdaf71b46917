"""Column functions on strings: trimming, lines, tokens, continuations, truncation, counts, code extraction.

Patterns use Java's `(?U)` where letters and blanks of all scripts are meant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32 punctuation characters of ASCII.
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
_BLANK = r"[\s\x1c-\x1f]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it; a plain expression would be repeated at each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without blanks of any kind at either end; Spark's trim knows the space only."""
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){_BLANK}+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end starts no further line."""
    return F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END, -1)


def filled_lines(c: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def tokens(c: Column) -> Column:
    """What stands between blanks."""
    return F.array_remove(F.split(c, f"(?U){_BLANK}+"), "")


def collapse(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.array_join(tokens(c), " ")


def without_punctuation(c: Column) -> Column:
    return F.translate(c, ASCII_PUNCTUATION, "")


def continuation(choice: Column) -> Column:
    """A space before it, unless it begins with a blank."""
    return F.when(F.rlike(choice, F.lit(f"(?U)^{_BLANK}")), choice).otherwise(F.concat(F.lit(" "), choice))


def truncate_at_stop(c: Column, stops: Column) -> Column:
    """Up to the first place where any of the stop strings begins; empty stop strings don't count."""
    places = F.filter(F.transform(F.filter(stops, lambda s: s != ""), lambda s: F.instr(c, s)), lambda p: p > 0)
    first = F.array_min(places)
    return F.when(first.isNull(), c).otherwise(F.left(c, first - 1))


def preview(c: Column, limit: int = 160) -> Column:
    """One line of at most `limit` characters, line ends written out."""
    flat = F.replace(c, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def byte_count(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


def split_word_count(c: Column) -> Column:
    """Parts between runs of blanks, empty ones at the ends included."""
    return F.size(F.split(c, f"(?U){_BLANK}+", -1)).cast("bigint")


def token_count(c: Column) -> Column:
    return F.size(tokens(c)).cast("bigint")


#: The replacements, in order, that undo the tokenisation of WikiText pages; patterns have True.
WIKITEXT_STEPS = (
    ("s '", "s'", False),
    (r"/' [0-9]/", "/'[0-9]/", True),
    (" @-@ ", "-", False),
    (" @,@ ", ",", False),
    (" @.@ ", ".", False),
    (" : ", ": ", False),
    (" ; ", "; ", False),
    (" . ", ". ", False),
    (" ! ", "! ", False),
    (" ? ", "? ", False),
    (" , ", ", ", False),
    (r"(?U)\(\s*([^\)]*?)\s*\)", "($1)", True),
    (r"(?U)\[\s*([^\]]*?)\s*\]", "[$1]", True),
    (r"(?U)\{\s*([^}]*?)\s*\}", "{$1}", True),
    (r'(?U)"\s*([^"]*?)\s*"', '"$1"', True),
    (r"(?U)'\s*([^']*?)\s*'", "'$1'", True),
    ("= = = =", "====", False),
    ("= = =", "===", False),
    ("= =", "==", False),
    (" \u00b0 ", "\u00b0", False),
    (" \n", "\n", False),
    ("\n ", "\n", False),
    (" N ", " 1 ", False),
    (" 's", "'s", False),
)


def wikitext(c: Column) -> Column:
    for find, put, pattern in WIKITEXT_STEPS:
        c = F.regexp_replace(c, find, put) if pattern else F.replace(c, F.lit(find), F.lit(put))
    return c


def fenced_code(c: Column, fence: str, preamble: str) -> Column:
    """The first fenced block, else the text without the preamble pattern; trimmed."""
    found = F.regexp_extract_all(c, F.lit(fence), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.get(found, F.lit(0)))).otherwise(strip(F.regexp_replace(c, preamble, "")))


def humaneval_code(c: Column) -> Column:
    opened = F.concat(F.lit("```"), c)
    found = F.regexp_extract_all(opened, F.lit(r"(?s)```(?:python)?\n?(.*?)\n?```"), F.lit(1))
    return F.when(F.size(found) > 0, strip(F.get(found, F.lit(0)))).otherwise(strip(F.regexp_replace(c, r"(?mU)^(?:Here is .*?:\s*)", "")))


def livecodebench_code(c: Column) -> Column:
    return fenced_code(c, r"(?isU)```(?:python)?\s*(.*?)\s*```", r"(?imU)^(?:here is .*?:\s*)")
