"""URL filters: pattern rules indexed by their rarest literal token.

A rule is an anchored pattern: ``||`` stands for the start of the host or of one
of its subdomain labels, ``*`` for any run of characters, ``^`` for a separator
(anything but a letter, digit, ``-``, ``_``, ``.`` or ``%``, or the end). Each rule
is filed under that of its whole literal tokens that fewest URLs hold (counted over
the input); the tokens of a URL fetch the rules filed under them, and only those
run their regular expression. A rule without a whole literal token is tried on
every URL.

Cases: a null URL or one without ``://`` has empty host and path and meets no rule;
repeated rows are each judged; an empty table gives an empty result; other columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.common import read

#: Up to so many rules the index is a literal map in the plan; a larger one is joined by token as a table.
MAX_LITERAL_RULES = 500


@dataclass(frozen=True)
class UrlRule:
    name: str
    pattern: str
    action: str
    base: bool = False

    def regex(self) -> str:
        body, out = self.pattern, ""
        if body.startswith("||"):
            body, out = body[2:], r"^(?:[^/]*\.)?"
        for c in body:
            out += ".*" if c == "*" else r"(?:[^A-Za-z0-9_.%-]|$)" if c == "^" else re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", c)
        return "(?s)" + out

    def tokens(self) -> list[str]:
        """Literal runs that are whole tokens of every URL that fits."""
        anchored = self.pattern.startswith("||")
        body = self.pattern[2:] if anchored else self.pattern
        found = []
        for m in re.finditer(r"[A-Za-z0-9]+", body):
            left = anchored if m.start() == 0 else body[m.start() - 1] != "*"
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m.group().lower())
        return found


#: Fixed values of the task: the base rules (host and path); the longest that fits decides.
BASE_RULES = [
    UrlRule("com/", "||com/", "allow", True),
    UrlRule("example.com/en/", "||example.com/en/", "block", True),
    UrlRule("www.example.com/en/", "||www.example.com/en/", "allow", True),
    UrlRule("net/es/", "||net/es/", "block", True),
    UrlRule("net/fr/", "||net/fr/", "block", True),
]

#: What the filter adds for URLs that no base rule fits; where several fit, a block goes before an allow.
METHOD_RULES = [
    UrlRule("spam-farm", "||spam-farm.", "block"),
    UrlRule("cheap-pills", "||cheap-pills.", "block"),
    UrlRule("casino", "||casino.", "block"),
    UrlRule("adserver", "||adserver.*^", "block"),
    UrlRule("tracker-pixel", "/pixel.gif", "block"),
    UrlRule("docs", "||docs.*/", "allow"),
]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (without query and fragment); empty where there is none."""
    part = lambda group: F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", group), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def url_tokens(target: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(target), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(targets: DataFrame, rules: list[UrlRule]) -> dict[str, int]:
    """How many URLs hold each token of the rules: one row per rule token at most comes to the driver."""
    wanted = sorted({t for r in rules for t in r.tokens()})
    rows = (
        targets.select(F.explode(F.array_intersect(url_tokens(F.col("target")), F.array(*map(F.lit, wanted)))).alias("token"))
        .groupBy("token").count().collect()
    )
    return {r["token"]: r["count"] for r in rows}


def rule_index(rules: list[UrlRule], counts: dict[str, int]) -> dict[str, list[UrlRule]]:
    """Rules by their rarest token; those without a token under the empty one."""
    index: dict[str, list[UrlRule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens(), key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


def _rule(r: UrlRule) -> Column:
    """Ordered so that the largest of several wins: base first, then length; block before allow for the others."""
    return F.struct(
        F.lit(r.base).alias("base"), F.lit(0 if r.base else int(r.action == "block")).alias("blocks"), F.lit(len(r.name)).alias("size"),
        F.lit(r.name).alias("name"), F.lit(r.action).alias("action"), F.lit(r.regex()).alias("regex"),
    )


def filter_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, best (struct of the winning rule, or null)."""
    host, path = url_parts(F.col(url_col))
    targets = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("target", F.concat("host", "path"))
    index = rule_index(rules, token_counts(targets, rules) if any(r.tokens() for r in rules) else {})
    untokened = index.pop("", [])
    always = F.array(*map(_rule, untokened)) if untokened else None
    best = lambda fetched: F.array_max(F.filter(fetched, lambda r: F.rlike(F.col("target"), r["regex"])))
    if len(rules) <= MAX_LITERAL_RULES:
        if not index:
            return targets.select(id_col, "host", "path", best(always).alias("best"))
        table = F.create_map(*[x for token, held in index.items() for x in (F.lit(token), F.array(*map(_rule, held)))])
        fetched = F.flatten(F.filter(F.transform(url_tokens(F.col("target")), lambda t: F.element_at(table, t)), lambda x: x.isNotNull()))
        return targets.select(id_col, "host", "path", best(F.concat(fetched, always) if untokened else fetched).alias("best"))
    spark = pages.sparkSession
    schema = "token string, base boolean, blocks int, size int, name string, action string, regex string"
    rows = [(t, r.base, 0 if r.base else int(r.action == "block"), len(r.name), r.name, r.action, r.regex()) for t, held in index.items() for r in held]
    filed = spark.createDataFrame(rows, schema)
    winners = (
        targets.select("target").distinct().withColumn("token", F.explode(url_tokens(F.col("target"))))
        .join(filed, "token").where(F.rlike("target", "regex"))
        .groupBy("target").agg(F.max(F.struct("base", "blocks", "size", "name", "action", "regex")).alias("fetched"))
    )
    found = F.array(F.col("fetched"), best(always)) if untokened else F.array("fetched")
    return targets.join(winners, "target", "left").select(id_col, "host", "path", F.array_max(found).alias("best"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL. rule is the base rule that decides, else null; method_rule the added one."""
    judged = filter_urls(read(spark, sf_dir, "pages"), BASE_RULES + METHOD_RULES)
    return judged.select(
        "page_id", "host", "path",
        F.when(F.col("best.base"), F.col("best.name")).alias("rule"),
        F.coalesce(F.col("best.action"), F.lit("allow")).alias("verdict"),
        F.when(~F.col("best.base"), F.col("best.name")).alias("method_rule"),
    )


def _oracle() -> str:
    fits = lambda host, path: f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"
    base = [("net/es/", "net", "/es/", "block"), ("net/fr/", "net", "/fr/", "block"), ("com/", "com", "/", "allow"), ("example.com/en/", "example.com", "/en/", "block"), ("www.example.com/en/", "www.example.com", "/en/", "allow")]
    base.sort(key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{n}'" for n, h, p, _ in base) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{n}' THEN '{a}'" for n, _, _, a in base) + " WHEN method_rule = 'docs' THEN 'allow' WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END"
    label = lambda name: f"regexp_matches(host || path, '^([^/]*\\.)?{name}\\.')"
    extra = [
        ("tracker-pixel", "contains(host || path, '/pixel.gif')"), ("cheap-pills", label("cheap-pills")), ("spam-farm", label("spam-farm")),
        ("adserver", "regexp_matches(host || path, '(?s)^([^/]*\\.)?adserver\\.')"), ("casino", label("casino")), ("docs", "regexp_matches(host || path, '(?s)^([^/]*\\.)?docs\\..*/')"),
    ]
    method = "CASE WHEN rule IS NOT NULL THEN NULL " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in extra) + " END"
    return f"""
    WITH parts AS (
      SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    ruled AS (SELECT *, {rule} AS rule FROM parts),
    added AS (SELECT *, {method} AS method_rule FROM ruled)
    SELECT page_id, host, path, rule, {verdict} AS verdict, method_rule FROM added"""


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLES = {"op1_url_filters": _oracle()}
