"""Secret scans: a trigram inverted index decides which rules run on which text.

From each rule's regular expression a Boolean query over trigrams is derived: a
text that matches the rule must satisfy it. The inverted index lists, for every
trigram that some query asks for, the ids of the texts that hold it (letters in
lower case). The postings of a query are intersected and united by id as it says,
which gives each rule's candidates; only these are verified with the regular
expression. Rules without a mandatory trigram scan every text.

Only ids and trigrams are shuffled. The candidates, ids with the rules to run, meet
the texts by a broadcast while they are few (counted first), else by a shuffled join.

Cases: a null text counts as empty and has no spans; whole texts are scanned,
however long (offsets take time with the power 1.5 of a text's matches); repeated
rows and rows of one id, null ones too, are each scanned, by the candidates of their
id taken together, which changes no result; spans that begin together are told in
the order of the rules; an empty table gives an empty result; other columns of the
input are ignored by scan_secrets and kept by with_secrets, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as K
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.common import read, staged, text_of
from landloom.llm.spans import counted, listed, located, no_spans

#: Alternatives that are multiplied out for one stretch of literal text.
MAX_STRINGS = 32
#: Candidates (an id and rule numbers each) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000


@dataclass(frozen=True)
class SecretRule:
    """regex: for Java and Python alike. keep: what a match must fulfil, else it is dropped after it was consumed."""

    kind: str
    regex: str
    keep: Callable[[Column], Column] | None = None


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""

#: Fixed values of the task. Where a run is maximal, its least length stands in the expression: that drops the same matches.
BASE_RULES = [
    SecretRule("assign", _ASSIGN, lambda hit: F.length(F.regexp_extract(hit, _ASSIGN, 2)) >= 6),
    SecretRule("access", r"AKIA[A-Z0-9]{16,}+"),
    SecretRule("hex", r"[0-9a-f]{24,}+"),
]

#: Spans that the method adds.
METHOD_RULES = [
    SecretRule("github", r"gh[opsu]_[A-Za-z0-9]{36,}+"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("live_key", r"[rs]k_live_[0-9A-Za-z]{20,}+"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+"),
    SecretRule("upper_hex", r"(?<![0-9A-Za-z])[0-9A-F]{32,}+(?![0-9A-Za-z])"),
]

RULES = BASE_RULES + METHOD_RULES


def _trigrams(strings: set[str]):
    """Query that holds for any text with one of the strings; True if some string has no trigram."""
    parts = []
    for s in sorted(strings):
        grams = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        if not grams:
            return True
        parts.append(("and", [("has", g) for g in grams]))
    return ("or", parts)


def _all(parts: list):
    parts = [p for p in parts if p is not True]
    return ("and", parts) if parts else True


def _walk(items) -> tuple[set[str] | None, object]:
    """Of a parsed expression: the strings it can match, if few, else None; and a query that each match satisfies."""
    exact: set[str] | None = {""}
    run, held = {""}, []
    for op, arg in items:
        found: set[str] | None = None
        query: object = True
        if op is K.LITERAL:
            found = {chr(arg).lower()}
        elif op is K.IN and all(k is K.LITERAL for k, _ in arg) and len(arg) <= 8:
            found = {chr(v).lower() for _, v in arg}
        elif op is K.SUBPATTERN:
            found, query = _walk(arg[3])
        elif op is K.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            if all(s is not None for s, _ in branches):
                found = set().union(*(s for s, _ in branches))
            elif all(q is not True for _, q in branches):
                query = ("or", [q for _, q in branches])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            least, most, inner = arg
            strings, inside = _walk(inner)
            if (least, most) == (0, 1) and strings is not None:
                found = strings | {""}
            elif (least, most) == (1, 1):
                found, query = strings, inside
            elif least:
                query = inside if strings is None else _trigrams(strings)
        elif op in (K.AT, K.ASSERT, K.ASSERT_NOT):
            found = {""}
        joined = {a + b for a in run for b in found} if found is not None and len(run) * len(found) <= MAX_STRINGS else None
        if joined is None:
            held += [_trigrams(run), query if found is None else _trigrams(found)]
            run, exact = {""}, None
        else:
            run = joined
    return (run if exact is not None else None), _all([*held, _trigrams(run)])


def trigram_query(regex: str):
    """('and'|'or', parts), ('has', trigram) or True (nothing is mandatory); trigrams in lower case."""
    return _walk(_parser.parse(regex))[1]


def query_trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "has" else set().union(*(query_trigrams(q) for q in query[1]))


def candidate(query, has: Callable[[str], Column]) -> Column:
    """The postings of the query's trigrams intersected and united as it says."""
    if query is True:
        return F.lit(True)
    if query[0] == "has":
        return has(query[1])
    out = None
    for q in query[1]:
        c = candidate(q, has)
        out = c if out is None else out & c if query[0] == "and" else out | c
    return out


def trigram_postings(docs: DataFrame, rules: list[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, id), of the trigrams that the rules ask for, one row for each text that holds one."""
    wanted = sorted(set().union(*(query_trigrams(trigram_query(r.regex)) for r in rules)))
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted])) if wanted else F.array().cast("array<string>")
    return texts.select(F.explode(held).alias("trigram"), "id")


def rule_candidates(postings: DataFrame, rules: list[SecretRule] = RULES) -> DataFrame:
    """id, run (numbers of the rules whose query the id's postings satisfy), of ids with such a rule."""
    queries = {i: trigram_query(r.regex) for i, r in enumerate(rules)}
    held = postings.groupBy("id").agg(F.collect_set("trigram").alias("held"))  # as many as the rules have trigrams at most
    fits = [F.when(candidate(q, lambda t: F.array_contains("held", F.lit(t))), F.lit(i)) for i, q in queries.items() if q is not True]
    return held.select("id", (F.array_compact(F.array(*fits)) if fits else F.array().cast("array<int>")).alias("run")).where(F.size("run") > 0)


def with_secrets(docs: DataFrame, rules: list[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with secrets, the spans with their text (a column of this name is replaced)."""
    found = staged(rule_candidates(trigram_postings(docs, rules, id_col, text_col), rules))
    few = found.limit(BROADCAST_CANDIDATES + 1).count() <= BROADCAST_CANDIDATES
    rest = docs.drop("secrets").select(F.struct("*").alias("row"), F.col(id_col).alias("row_id"))
    met = rest.join(found.hint("broadcast" if few else "merge"), F.col("row_id").eqNullSafe(F.col("id")), "left")
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    spans = []
    for rank, r in enumerate(rules):
        own = located(text, r.regex, r.kind, rank, r.keep)
        spans.append(own if trigram_query(r.regex) is True else F.when(F.array_contains("run", F.lit(rank)), own).otherwise(no_spans()))
    return met.select("row.*", F.concat(*spans).alias("secrets"))


def scan_secrets(docs: DataFrame, rules: list[SecretRule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id and secrets (spans with their text)."""
    return with_secrets(docs.select(id_col, text_col), rules, id_col, text_col).select(id_col, "secrets")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the secrets of every document."""
    base = [r.kind for r in BASE_RULES]
    found = scan_secrets(read(spark, sf_dir, "documents")).withColumn("base", F.filter("secrets", lambda s: s["kind"].isin(base)))
    return found.select(
        "doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in base],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


def _oracle() -> str:
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = {
        "assign": assign, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "github": "gh[opsu]_[A-Za-z0-9]{36,}", "slack": "xox[abprs]-[A-Za-z0-9-]{10,}",
        "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "live_key": "[rs]k_live_[0-9A-Za-z]{20,}", "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}", "upper_hex": "[0-9A-F]{32,}",
    }
    keep = {"assign": f"length(regexp_extract(hit, '{assign}', 1)) >= 6", "upper_hex": "NOT regexp_matches(substr(t, s::BIGINT, 1), '[0-9A-Za-z]') AND NOT regexp_matches(substr(t, e::BIGINT + 1, 1), '[0-9A-Za-z]')"}
    parts = " UNION ALL ".join(
        f"""SELECT rid, '{kind}' AS kind, {rank} AS rank, s, e FROM (
              SELECT rid, t, hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS s, s + length(hit) AS e
              FROM (SELECT rid, t, gaps, hits, unnest(range(1, len(hits) + 1)) AS i, hits[i] AS hit
                    FROM (SELECT rid, t, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM d))) WHERE {keep.get(kind, "true")}"""
        for rank, (kind, p) in enumerate(patterns.items())
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS ({parts}),
    told AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || s::INT || ':' || e::INT, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s::INT || ':' || e::INT, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (rid)"""


QUERIES = {"op2_secret_scans": op2_secret_scans}
ORACLES = {"op2_secret_scans": _oracle()}
