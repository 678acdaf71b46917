"""Templates of prompts as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugery.functions.multiple_choice import LABELS
from gaugery.functions.text import strip

_slot = re.compile(r"\{([^{}]+)\}")


def sql(text: str) -> Column:
    """strip(x) becomes a regular expression that trims."""
    return F.expr(re.sub(r"strip\((\w+|`[^`]+`)\)", r"regexp_replace(CAST(\1 AS STRING), '(?U)^[\\\\s]+|[\\\\s]+$', '')", text))


def lettered(options: Column, mark: str = "{0}. {1}", glue: str = "\n") -> Column:
    """Options as lines that begin with their labels."""
    head, tail = mark.split("{0}")[0], mark.split("{0}")[1].split("{1}")
    letters = F.array(*map(F.lit, LABELS))
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.lit(head), F.get(letters, i), F.lit(tail[0]), strip(o), F.lit(tail[1]))), glue)


def prompt_column(template: str) -> Column:
    """`{field}` is a field trimmed, `{raw field}` as it is, `{lettered array}` lines of labelled options, `{sql expression}`
    any expression; all else is text."""
    parts, last = [], 0
    for m in _slot.finditer(template):
        parts.append(F.lit(template[last : m.start()]))
        kind, _, name = m[1].partition(" ")
        if kind == "raw" and name:
            parts.append(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")))
        elif kind == "lettered" and name:
            parts.append(lettered(sql(name)))
        elif kind == "sql" and name:
            parts.append(sql(name).cast("string"))
        else:
            parts.append(strip(F.col(m[1]).cast("string")))
        last = m.end()
    return F.concat(*parts, F.lit(template[last:]))
