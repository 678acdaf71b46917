"""URL filters: pattern rules indexed by their rarest literal token.

A rule is compiled to a regular expression over host and path, and has literal tokens (runs of ASCII letters and digits
bounded by other characters) that any URL it matches must contain whole. Token frequencies are counted over all URLs,
and each rule is filed under its rarest token. A URL's tokens fetch the rules filed under them, and only those run.

Up to `inline` filed tokens the index is a map in the plan, and judging needs no shuffle; a larger index, whose size is
that of the given rule list, is joined to the tokens of distinct URLs, and hot URLs are joined back by `join_groups`.
All of it is SQL functions.

Defined cases: a null URL or one without `://` has empty host and path, and gets the default verdict unless a pattern
matches the empty text. A rule without a usable token is tried on every URL. Of the host rules that fit the longest
wins, then the greater text. Repeated rows are judged alike. Other columns are carried, one named like a result column
with `_in` at the end of its name; names starting with `__g_` are reserved. Empty tables give empty results, and no rules
give the default everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugery.llm.common import carried, join_groups

ALLOW, BLOCK = "allow", "block"
INLINE = 256
#: Filed rules up to which the index is broadcast.
BROADCAST = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict for the URLs that a text fits: host and path (`host/path`), or with glob=True a pattern with `*`."""

    verdict: str
    text: str
    glob: bool = False

    @property
    def regex(self) -> str:
        quoted = ".*".join("".join(c if c.isalnum() or c in "/_" else f"\\{c}" if ord(c) < 128 else c for c in part) for part in self.text.split("*"))
        if self.glob:
            return f"(?s)^{quoted}$"
        host, slash, _ = self.text.partition("/")
        return f"^(?:[^/]*\\.)?{quoted}" + ("" if slash else "(?:/|$)")

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that no longer run of letters and digits of a URL can hide."""
        found, t = [], self.text
        for m in re.finditer(r"[A-Za-z0-9]+", t):
            before = m.start() == 0 or t[m.start() - 1] != "*"
            after = t[m.end()] != "*" if m.end() < len(t) else self.glob or "/" not in t
            if before and after:
                found.append(m.group())
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(url, r"[^A-Za-z0-9]+"), lambda t: t != ""))


def index(urls: DataFrame, rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by their rarest token; '' files those without one. urls has host and path; all of it is counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {"": rules} if rules else {}
    tokens = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    seen = urls.select(F.explode(_tokens(F.concat("host", "path"))).alias("token")).join(F.broadcast(tokens), "token").groupBy("token").count()
    often = {r["token"]: r["count"] for r in seen.collect()}  # as many rows as the rules have tokens, at most
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (often.get(t, 0), t), default=""), []).append(r)
    return filed


_FIELDS = "struct<long:int,rule:string,verdict:string,glob:boolean,regex:string>"


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(len(r.text)).alias("long"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.glob).alias("glob"), F.lit(r.regex).alias("regex"))


def _best(fits: Column, glob: bool) -> Column:
    return F.array_max(F.filter(fits, lambda c: c["glob"] == F.lit(glob)))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = ALLOW, inline: int = INLINE) -> DataFrame:
    """pages with host, path, rule (text of the host rule that won, else null), pattern (of the glob that won), verdict.

    A host rule's verdict comes first, then a pattern's, then the default.
    """
    host, path = host_and_path(F.col(url_col))
    named = carried(pages.columns, ["host", "path", "rule", "pattern", "verdict"])
    kept = list(named.values())
    seen = pages.select(*[F.col(f"`{c}`").alias(name) for c, name in named.items()], host.alias("host"), path.alias("path"))
    filed = index(seen.select("host", "path"), rules)
    url = F.concat("host", "path")
    if sum(map(len, filed.values())) <= inline:
        if filed:
            ways = F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(_struct, rs)))])
            asked = F.concat(_tokens(url), F.array(F.lit("")))
            fetched = F.flatten(F.filter(F.transform(asked, lambda t: F.try_element_at(ways, t)), lambda c: c.isNotNull()))
        else:
            fetched = F.array().cast(f"array<{_FIELDS}>")
        fits = seen.withColumn("__g_fits", F.filter(fetched, lambda c: F.rlike(url, c["regex"])))
        found = fits.withColumns({"__g_rule": _best(F.col("__g_fits"), False), "__g_glob": _best(F.col("__g_fits"), True)})
    else:
        rows = [(t, len(r.text), r.text, r.verdict, r.glob, r.regex) for t, rs in filed.items() for r in rs]
        ways = seen.sparkSession.createDataFrame(rows, "token string, long int, rule string, verdict string, glob boolean, regex string")
        urls = seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("__g_n"))
        asked = urls.withColumn("token", F.explode(F.concat(_tokens(url), F.array(F.lit("")))))
        one = F.struct("long", "rule", "verdict", "glob", "regex")
        ways = F.broadcast(ways) if len(rows) <= BROADCAST else ways
        fit = asked.join(ways, "token").filter(F.rlike(url, F.col("regex")))
        best = fit.groupBy("host", "path").agg(F.first("__g_n").alias("__g_n"), F.max(F.when(~F.col("glob"), one)).alias("__g_rule"), F.max(F.when(F.col("glob"), one)).alias("__g_glob"))
        found = join_groups(seen, best, ["host", "path"], "__g_n", F.monotonically_increasing_id())
    verdict = F.coalesce(F.col("__g_rule.verdict"), F.col("__g_glob.verdict"), F.lit(default))
    return found.select(*[f"`{c}`" for c in kept], "host", "path", F.col("__g_rule.rule").alias("rule"), F.col("__g_glob.rule").alias("pattern"), verdict.alias("verdict"))
