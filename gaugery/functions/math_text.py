"""Mathematical answers in LaTeX: finding them, a canonical form, equality. Braces nest, so this is Python on Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from gaugery.functions.arrow import arrow_udf

#: Phrases that announce an answer, in the order in which they are tried on a line.
PHRASES = tuple(re.compile(p, re.I) for p in (r"\bfinal answer(?:\s+is)?\s*[:=\-]?\s*(.+)", r"\bthe answer(?:\s+is)?\s*[:=\-]?\s*(.+)", r"\banswer\s*[:=\-]\s*(.+)"))
#: What the canonical form replaces, in this order; None marks where text after a unit goes.
STEPS = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("\\(", ""), ("\\)", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""),
    None, ("\\%", ""), (" .", " 0."), ("{.", "{0."),
)
_end_signs = re.compile(r"[\.,;:!]+$")
_end_quotes = re.compile(r"[\s`\"']+$")


def last_box(text: str) -> str | None:
    """Content of the last \\boxed or \\fbox; null if there is none or its braces don't close."""
    if "\\boxed " in text:
        return text.rpartition("\\boxed ")[2].partition("$")[0]
    at = text.rfind("\\boxed")
    if at < 0:
        at = text.rfind("\\fbox")
    if at < 0:
        return None
    depth = 0
    for end in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[end], 0)
        if text[end] == "}" and depth == 0:
            whole = text[at : end + 1]
            # Only \boxed{...} has its content taken out; any other shape is no answer.
            return whole[7:-1] if whole.startswith("\\boxed{") else None
    return None


def _inline(text: str) -> str:
    found = re.findall(r"(?s)\$([^$]+)\$", text) or re.findall(r"(?s)\\\((.+?)\\\)", text)
    return found[-1].strip() if found else ""


def _tidy(text: str) -> str:
    t = text.strip().strip("`\"'")
    box = last_box(t)
    if box is not None:
        t = box.strip()
    elif not ("\\boxed" in t or "\\fbox" in t):
        t = _inline(t) or t
    return _end_signs.sub("", _end_quotes.sub("", t)).strip()


def extract(text: str | None) -> str:
    """The last box, else the last line with an answer phrase, else the last inline formula, else the last line."""
    text = text or ""
    box = last_box(text)
    if box is not None:
        return _tidy(box)
    rows = [x.strip() for x in text.splitlines() if x.strip()]
    for row in reversed(rows):
        said = next((m[1].strip() for p in PHRASES if (m := p.search(row))), None)
        if said is not None:
            if said:
                return _tidy(said)
            break
    return _tidy(_inline(text) or (rows[-1] if rows else text))


def _arguments(text: str, command: str, count: int) -> str:
    """Braces around the bare one-letter arguments of a command; ValueError where one is missing."""
    head, *parts = text.split(command)
    out = [head]
    for part in parts:
        if not part:
            raise ValueError(f"{command} without an argument")
        if part[0] != "{":
            bare, rest = part[:count], part[count:]
            if len(bare) < count:
                raise LookupError
            second = "".join(c if c == "{" else "{" + c + "}" for c in bare[1:])
            part = "{" + bare[0] + "}" + second + rest
        out.append(part)
    return command.join(out)


def canonical(text: str) -> str:
    """A form in which answers that are written differently are the same text."""
    t = text.strip()
    for step in STEPS:
        t = t.partition("\\text{ ")[0] if step is None else t.replace(*step)
    if not t:
        return t
    if t[0] == ".":
        t = "0" + t
    sides = t.split("=")
    if len(sides) == 2 and len(sides[0]) <= 2:
        t = sides[1]
    t = _arguments(t, "\\sqrt", 1).replace(" ", "")
    try:
        t = _arguments(t, "\\frac", 2)
    except LookupError:
        pass
    if t == "0.5":
        t = "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?\d+)/(-?\d+)", t, re.A):
        plain = [str(int(x)) for x in m.groups()]
        if "/".join(plain) == t:
            t = "\\frac{%s}{%s}" % tuple(plain)
    return _end_signs.sub("", t)


def equivalent(left: str | None, right: str | None) -> bool:
    if left is None or right is None:
        return left is right
    try:
        return canonical(left) == canonical(right)
    except ValueError:
        return left == right


@arrow_udf("string")
def extract_answer(text: pd.Series) -> pd.Series:
    return text.map(extract)


@arrow_udf("string")
def canonical_answer(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else canonical(x))


@arrow_udf("double")
def math_match(prediction: pd.Series, target: pd.Series) -> pd.Series:
    """1 if the answer found in a prediction is equivalent to the target."""
    return pd.Series([float(equivalent(extract(p), t)) for p, t in zip(prediction, target, strict=True)], dtype=float)


#: Prefixes of a short answer.
_SHORT = tuple(re.compile(p, re.I | re.S) for p in (r"\bfinal answer\s*[:\-]\s*(.+)$", r"\bthe answer is\s*(.+)$", r"\banswer\s*[:\-]\s*(.+)$"))
_fence = re.compile(r"(?is)```(?:text|markdown)?\s*(.*?)\s*```")


def short_answer(text: str | None) -> str:
    """Inside a fence if there is one: the last box, else the last line of what follows a prefix."""
    t = (text or "").strip()
    if m := _fence.search(t):
        t = m[1].strip()
    box = last_box(t)
    if box is not None:
        return box.strip()
    t = next((m[1].strip() for p in _SHORT if (m := p.search(t))), t)
    rows = [x.strip() for x in t.splitlines() if x.strip()]
    return (rows[-1] if rows else t).strip().strip("`\"'")


def _folded(t: str) -> str:
    return " ".join(t.strip().strip("`\"'").lower().split())


@arrow_udf("double")
def short_match(prediction: pd.Series, target: pd.Series) -> pd.Series:
    """1 if a short answer is equivalent as mathematics or the same but for case and blanks."""
    pairs = ((short_answer(p), t or "") for p, t in zip(prediction, target, strict=True))
    return pd.Series([float(equivalent(a, t) or _folded(a) == _folded(t)) for a, t in pairs], dtype=float)
