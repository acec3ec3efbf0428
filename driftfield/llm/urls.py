"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression with the literal tokens that every matching URL contains whole. The index holds each rule under the one
of its tokens that is rarest among the URLs at hand; a URL's tokens fetch candidate rules, and only those run their expressions.
Everything is DataFrame expressions; the rules themselves are one literal of the plan.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Allow and block rules of op9 as (verdict, host and path): fixed values.
BASE_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Further patterns, matched anywhere in what follows ``://``, query and fragment included: words of link farms and of pages that only sell.
PATTERN_RULES = ("spam-farm", "cheap-pills", "casino-bonus", "free-money", "click-here", "payday-loan", "adult-cam")
RULES_BROADCAST = 100_000
_TOKEN = "[a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A rule of one of four kinds; A-Z count as a-z except in the path of a host rule.

    ``host``: host, subdomains and path prefix. ``pattern``: a literal delimited by other than letters or digits. ``wildcard``: the same, in
    which each ``*`` stands for any characters. ``regex``: an expression that is found anywhere in the lower-cased URL after ``://``, with
    ``literals``, the whole tokens that every match contains (none: the rule runs on every URL).
    """

    verdict: str
    text: str
    kind: str = "host"
    literals: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.kind not in ("host", "pattern", "wildcard", "regex"):
            raise ValueError(f"unknown kind {self.kind}")

    @property
    def pattern(self) -> str:
        if self.kind == "regex":
            return self.text
        text = self.text if self.kind == "host" else self.text.translate(str.maketrans(_UPPER, _LOWER))
        quoted = re.sub(r"([^A-Za-z0-9/_\-])", r"\\\1", text)
        if self.kind == "host":
            return f"^([^/]*\\.)?{quoted}"
        if self.kind == "wildcard":
            quoted = quoted.replace("\\*", "(?s:.*)")
        return f"(^|[^a-z0-9]){quoted}([^a-z0-9]|$)"

    @property
    def tokens(self) -> list[str]:
        """Tokens that end inside the rule; the last of a path prefix may go on in the URL, and so may one beside a ``*``."""
        if self.kind == "regex":
            return sorted({t.translate(str.maketrans(_UPPER, _LOWER)) for t in self.literals})
        text = self.text.translate(str.maketrans(_UPPER, _LOWER))
        whole = lambda m: "*" not in (text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1])
        found = re.finditer(_TOKEN, text)
        return sorted({m.group() for m in found if (m.end() < len(text) if self.kind == "host" else self.kind == "pattern" or whole(m))})


def default_rules() -> list[Rule]:
    return [Rule(v, t) for v, t in BASE_RULES] + [Rule("block", t, "pattern") for t in PATTERN_RULES]


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty for a null URL or one without it."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#`` or the end."""
    rest = after_scheme(url)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return _lower(host), path


def _tokens(subject: Column) -> Column:
    """Distinct tokens; the empty one, under which rules without a whole token are indexed, is always there."""
    return F.array_union(F.array(F.lit("")), F.regexp_extract_all(_lower(subject), F.lit(f"({_TOKEN})"), 1))


def _literal_table(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table as one literal of the plan: no Python worker, as rows handed over by ``createDataFrame`` would need."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def rule_index(subjects: DataFrame, rules: list[Rule]) -> DataFrame:
    """(token, verdict, rule, kind, pattern): every rule once, under its token that the fewest subjects contain (ties: first by name)."""
    spark = subjects.sparkSession
    keyed = [{"rule_no": i, "token": t} for i, r in enumerate(rules) for t in (r.tokens or [""])]
    ours = _literal_table(spark, keyed, "rule_no: int, token: string")
    seen = subjects.select(F.explode(_tokens(F.col("whole"))).alias("token")).join(F.broadcast(ours.select("token").distinct()), "token").groupBy("token").count()
    best = ours.join(seen, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
    listed = [{"rule_no": i, "verdict": r.verdict, "rule": r.text, "kind": r.kind, "pattern": r.pattern} for i, r in enumerate(rules)]
    texts = _literal_table(spark, listed, "rule_no: int, verdict: string, rule: string, kind: string, pattern: string")
    return best.join(texts, "rule_no").drop("rule_no")


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) for every row of ``pages(page_id, url)``.

    Among host rules that fit, the longest decides (ties: block first, then by name). Without one, any rule of another kind decides (block
    first); these see the query string and fragment too. Else ``default`` holds. A null URL or one without ``://`` has an empty host and path and gets the default. Repeated rows are
    judged alike; an empty table or rule list is fine.
    """
    rules = default_rules() if rules is None else rules
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), _lower(after_scheme(F.col("url"))).alias("whole"))
    subjects = split.select(F.concat("host", "path").alias("subject"), "whole").distinct()
    if rules:
        index = rule_index(subjects, rules)
        index = F.broadcast(index) if len(rules) <= RULES_BROADCAST else index  # one row per rule
        fetched = subjects.withColumn("token", F.explode(_tokens(F.col("whole")))).join(index, "token")
        run = F.when(F.col("kind") == "host", F.col("subject")).otherwise(F.col("whole"))
        hits = fetched.withColumn("_run", run).where(F.expr("regexp_like(_run, pattern)"))
        rank = F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")
        pattern_rank = F.struct((F.col("verdict") == "block").alias("b"), "rule", "verdict")
        best = hits.groupBy("subject", "whole").agg(
            F.max(F.when(F.col("kind") == "host", rank)).alias("_host"), F.max(F.when(F.col("kind") != "host", pattern_rank)).alias("_pattern")
        )
    else:
        best = subjects.select("subject", "whole", *[F.lit(None).cast("struct<n:int,b:boolean,rule:string,verdict:string>").alias(c) for c in ("_host", "_pattern")])
    judged = split.withColumn("subject", F.concat("host", "path")).join(best, ["subject", "whole"], "left")
    return judged.select(
        "page_id", "host", "path", F.col("_host.rule").alias("rule"),
        F.coalesce(F.col("_host.verdict"), F.col("_pattern.verdict"), F.lit(default)).alias("verdict"),
        F.col("_pattern.rule").alias("pattern_rule"),
    )


def _sql() -> str:
    base = ", ".join(f"('{v}', '{t}', '^([^/]*\\.)?{t.replace('.', chr(92) + '.')}')" for v, t in BASE_RULES)
    spam = ", ".join(f"('{t}', '(^|[^a-z0-9]){t}([^a-z0-9]|$)')" for t in PATTERN_RULES)
    return rf"""
WITH base(verdict, rule, pattern) AS (VALUES {base}), spam(rule, pattern) AS (VALUES {spam}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path, translate(coalesce(rest, ''), '{_UPPER}', '{_LOWER}') AS whole FROM cut),
subjects AS (SELECT DISTINCT host || path AS subject FROM split), wholes AS (SELECT DISTINCT whole FROM split),
hosts AS (
  SELECT subject, max({{'n': length(rule), 'b': verdict = 'block', 'rule': rule, 'verdict': verdict}}) AS best
  FROM subjects JOIN base ON regexp_matches(subject, pattern) GROUP BY subject
), spams AS (SELECT whole, max(rule) AS rule FROM wholes JOIN spam ON regexp_matches(whole, pattern) GROUP BY whole)
SELECT page_id, host, path, hosts.best.rule AS rule, coalesce(hosts.best.verdict, CASE WHEN spams.rule IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       spams.rule AS pattern_rule
FROM split LEFT JOIN hosts ON hosts.subject = host || path LEFT JOIN spams ON spams.whole = split.whole
"""


SQL = _sql()
