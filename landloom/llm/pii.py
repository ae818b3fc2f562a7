"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans: loose mail addresses, dotted
numbers and runs of digits with separators. Each candidate has format features
(digits, groups, separators, checks that hold) and context features (neighbouring
characters, words before it), all small whole numbers. Boosted trees of depth two
score it; a threshold for each generator, calibrated to PRECISION on documents that
the trees did not learn from, selects the spans to redact. The four base kinds are
always found; the trees add spans that no base span overlaps.

The tables have no labels for personal data, and the base kinds can't teach what they
themselves miss. So the trees learn from planted cases: into words of each document of
a bounded sample one value of every family in FAMILIES is put, personal ones (telephone
numbers without a country code, social security numbers, masked mail addresses) and
decoys (dates, versions, order numbers, handles), often behind a cue word. A candidate
that touches a planted value has the label of its family; the other candidates of these
words, as they stand in the corpus, count as not personal; candidates that a base span
overlaps are left out, since they are found anyway.

The trees are learned from the table of feature vectors and their counts, which
Spark aggregates and whose rows the features' ranges bound; they are scored as plain
column expressions.

Cases: a null text counts as empty; whole texts are searched, however long (offsets
take time with the power 1.5 of a text's matches); repeated rows are each searched;
spans that begin together are told in the order of the kinds; an empty table gives an
empty result; without a document to plant in nothing is added; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.llm.common import bounded_sample, read, text_of
from landloom.llm.spans import counted, free_of, listed, located, no_spans

#: Documents that cases are planted in, at most (chosen by a hash of doc_id), and their words around a planted value.
LEARN_ROWS, LEARN_WORDS = 3_000, 10
#: Of so many documents one calibrates the thresholds instead of teaching the trees.
HELD_OUT = 3
TREES, RATE, PRECISION = 30, 0.3, 0.95
#: Characters before a candidate that are searched for cue words.
CUE_CHARS = 24


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    digits = F.reverse(_digits(hit))
    values = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(hit: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(4)).try_cast("int"), F.lit(0)) <= 255))


def _digit_count(low: int, high: int):
    return lambda hit: F.length(_digits(hit)).between(low, high)


#: Fixed values of the task. Possessive repeats and look-behinds match the same and take linear time;
#: where a match is maximal, its least digits stand in the expression.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

BASE = {
    "email": (EMAIL, None),
    "ip": (IP, small_parts),
    "card": (CARD, lambda hit: F.length(_digits(hit)).between(12, 19) & luhn(hit)),
    "phone": (PHONE, _digit_count(9, 15)),
}

#: Generators: kind of the added span, and what proposes it.
GENERATORS = {
    "email_like": r"(?<![^\s<>\"'(),;])[^\s<>\"'(),;@]++(?:@|\(at\)|\[at\])[^\s<>\"'(),;@]++",
    "dotted": r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){2,7}+",
    "digits": r"(?<![0-9A-Za-z+])\+?+\(?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+(?![A-Za-z])",
}

#: What is planted: whether it is personal, its form ({n}: n digits, {w}: letters), and words that often stand before it.
FAMILIES = {
    "phone_dashes": (1, "{3}-{3}-{4}", ("call", "phone", "tel", "fax")),
    "phone_brackets": (1, "({3}) {3}-{4}", ("call", "phone", "mobile", "contact")),
    "phone_dots": (1, "{3}.{3}.{4}", ("call", "phone", "tel", "mobile")),
    "phone_blanks": (1, "{3} {3} {4}", ("phone", "tel", "fax", "contact")),
    "security_number": (1, "{3}-{2}-{4}", ("ssn", "account")),
    "masked_mail": (1, "{w}{2}(at){w}.com", ("mail", "contact")),
    "bracketed_mail": (1, "{w}[at]{w}.org", ("mail", "contact")),
    "date": (0, "20{2}-{2}-{2}", ("on",)),
    "dotted_date": (0, "{2}.{2}.20{2}", ("am",)),
    "version": (0, "{1}.{2}.{1}", ("version",)),
    "build": (0, "{1}.{1}.{4}.{3}.{2}", ("build",)),
    "order": (0, "{4}-{4}", ("order",)),
    "number": (0, "{7}", ("item",)),
    "long_number": (0, "{16}", ("id",)),
    "ratio": (0, "{4}/{4}", ("of",)),
    "handle": (0, "{w}@{w}", ("by",)),
}

#: Features in order, with the highest value of each; the least is 0.
FEATURES = {"generator": 2, "digits": 20, "groups": 8, "last": 8, "marks": 8, "plus": 1, "bracket": 1, "luhn": 1, "parts": 1, "dot_end": 1, "before": 3, "after": 3, "cue": 2}


def base_spans(text: Column) -> Column:
    """Spans of the base kinds. Kinds whose tell-tale character is absent are skipped."""
    held = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    found = []
    for rank, (kind, (regex, keep)) in enumerate(BASE.items()):
        spans = located(text, regex, kind, rank, keep)
        found.append(F.when(held[kind], spans).otherwise(no_spans()) if kind in held else spans)
    return F.concat(*found)


def candidate_spans(text: Column) -> Column:
    found = []
    for rank, (kind, regex) in enumerate(GENERATORS.items()):
        spans = located(text, regex, kind, len(BASE) + rank)
        found.append(F.when(F.rlike(text, F.lit(r"@|\(at\)|\[at\]")), spans).otherwise(no_spans()) if kind == "email_like" else spans)
    return F.concat(*found)


def _class(char: Column) -> Column:
    """0 nothing or white space, 1 letter, 2 digit, 3 other."""
    return F.when(F.coalesce(F.trim(char), F.lit("")) == "", 0).when(F.rlike(char, F.lit(r"\p{L}")), 1).when(F.rlike(char, F.lit("[0-9]")), 2).otherwise(3)


def features(text: Column, span: Column) -> Column:
    """The feature vector of a candidate as array<int>."""
    value, start = span["value"], span["start"]
    n = F.length(_digits(value))
    lead = F.lower(F.substring(text, F.greatest(start + 1 - CUE_CHARS, F.lit(1)), F.least(start, F.lit(CUE_CHARS))))
    before = F.when(start > 0, F.substring(text, start, F.lit(1)))
    columns = [
        span["rank"] - len(BASE),
        F.least(n, F.lit(FEATURES["digits"])),
        F.least(F.regexp_count(value, F.lit("[0-9]+")), F.lit(FEATURES["groups"])),
        F.least(F.length(F.regexp_extract(value, "([0-9]+)[^0-9]*$", 1)), F.lit(FEATURES["last"])),
        F.least(F.length(F.regexp_replace(value, r"[0-9\p{L}]", "")), F.lit(FEATURES["marks"])),
        F.contains(value, F.lit("+")).cast("int"),
        F.contains(value, F.lit("(")).cast("int"),
        F.when(n.between(12, 19), luhn(value).cast("int")).otherwise(0),
        F.when(F.rlike(value, F.lit(r"^[0-9]+(\.[0-9]+){3}$")), small_parts(value).cast("int")).otherwise(0),
        F.rlike(value, F.lit(r"\.[A-Za-z]{2,}$")).cast("int"),
        _class(before),
        _class(F.substring(text, span["end"] + 1, F.lit(1))),
        F.when(F.rlike(lead, F.lit("tel|phone|call|fax|mobile|mail|contact")), 1).when(F.rlike(lead, F.lit("card|visa|iban|account|ssn")), 2).otherwise(0),
    ]
    return F.array(*[c.cast("int") for c in columns])


def _value(form: str, salt: int) -> Column:
    """A value of this form, drawn from the columns draw and family."""
    parts = []
    for i, piece in enumerate(re.split(r"(\{\w\})|(\{\d+\})", form)):
        drawn = F.xxhash64("draw", F.lit(f"{salt}:{i}"))
        if piece == "{w}":
            parts.append(F.translate(F.substring(F.hex(drawn), 1, 7), "0123456789ABCDEF", "anostrkeildmubhv"))
        elif piece and re.fullmatch(r"\{\d+\}", piece):
            n = int(piece[1:-1])
            parts.append(F.lpad(F.pmod(drawn, F.lit(10**n)).cast("string"), n, "0"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def planted(docs: DataFrame) -> DataFrame:
    """text, start, end (of a planted value), personal and held (whether it calibrates): a row for each document (column text) and family."""
    words = docs.select(F.xxhash64("text").alias("draw"), F.split("text", " ").alias("words"))
    at = F.pmod("draw", F.size("words")).cast("int")
    near = words.select("draw", F.array_join(F.slice("words", F.greatest(at - LEARN_WORDS + 1, F.lit(1)), LEARN_WORDS), " ").alias("left"), F.array_join(F.slice("words", at + 1, LEARN_WORDS), " ").alias("right"))
    cases = []
    for salt, (personal, form, cues) in enumerate(FAMILIES.values()):
        luck = F.pmod(F.xxhash64("draw", F.lit(f"{salt}:cue")), F.lit(6))
        own, any_ = F.array(*map(F.lit, cues)), F.array(*[F.lit(c) for _, _, held in FAMILIES.values() for c in held])
        of = lambda held: F.get(held, F.pmod(F.xxhash64("draw", F.lit(f"{salt}:word")), F.size(held)).cast("int"))  # noqa: E731, B023
        cue = F.when(luck < 3, F.concat(of(own), F.lit(" "))).when(luck == 3, F.concat(of(any_), F.lit(" "))).otherwise("")
        cases.append(F.struct(cue.alias("cue"), _value(form, salt).alias("value"), F.lit(personal).alias("personal")))
    rows = near.select("draw", "left", "right", F.explode(F.array(*cases)).alias("c"))
    lead = F.concat("left", F.lit(" "), "c.cue")
    return rows.select(
        F.concat(lead, F.col("c.value"), F.lit(" "), F.col("right")).alias("text"), F.length(lead).alias("start"), (F.length(lead) + F.length("c.value")).alias("end"),
        F.col("c.personal").alias("personal"), (F.pmod(F.xxhash64("draw", F.lit("held")), F.lit(HELD_OUT)) == 0).alias("held"),
    )


def learning_table(docs: DataFrame) -> tuple[list, list]:
    """(features, share that is personal, count) of the candidates of planted cases in docs (column text), to learn from and to calibrate with."""
    cases = planted(docs).withColumn("candidates", free_of(candidate_spans(F.col("text")), base_spans(F.col("text"))))
    inside = lambda c: (c["start"] < F.col("end")) & (F.col("start") < c["end"])
    told = lambda c: F.struct(features(F.col("text"), c).alias("x"), F.when(inside(c), F.col("personal")).otherwise(0).alias("y"))
    rows = cases.select("held", F.explode(F.transform("candidates", told)).alias("r"))
    table = rows.groupBy("held", "r.x").agg(F.avg("r.y").alias("y"), F.count("*").alias("n")).collect()
    return tuple([(r["x"], r["y"], r["n"]) for r in table if r["held"] is held] for held in (False, True))


class BoostedTrees:
    """Trees of depth two as (feature, limit, (feature, limit, value, value) on either side), and each generator's threshold."""

    def __init__(self, table: list[tuple[list[int], float, int]], held: list[tuple[list[int], float, int]] = ()) -> None:
        """table to learn from, held to calibrate with: (features, share that is personal, count)."""
        self.trees: list[tuple] = []
        self.thresholds: dict[int, float] = {}
        self.start = 0.0
        if not table:
            return
        table = sorted(table, key=lambda r: r[0])
        x, y, n = np.array([r[0] for r in table]), np.array([r[1] for r in table]), np.array([r[2] for r in table], float)
        mean = min(0.999, max(0.001, float(y @ n / n.sum())))
        self.start = round(float(np.log(mean / (1 - mean))), 6)
        score = np.full(len(x), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(x, n * (y - p), n * np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += self._apply(tree, x)
        held = sorted(held, key=lambda r: r[0])
        if not held:
            return
        x, y, n = np.array([r[0] for r in held]), np.array([r[1] for r in held]), np.array([r[2] for r in held], float)
        p = 1 / (1 + np.exp(-(self.start + sum(self._apply(tree, x) for tree in self.trees))))
        for g in range(len(GENERATORS)):
            own = x[:, 0] == g
            for t in np.unique(p[own]):
                above = own & (p >= t)
                if y[above] @ n[above] >= PRECISION * n[above].sum():
                    self.thresholds[g] = float(t) - 1e-9
                    break

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int, float]:
        """The feature and limit (left: at most) with the highest gain."""
        best = (0, int(x[:, 0].max(initial=0)), -1.0)
        whole = g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            for limit in np.unique(x[:, f])[:-1].tolist():
                left = x[:, f] <= limit
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - whole
                if gain > best[2] + 1e-9:
                    best = (f, limit, gain)
        return best

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        leaf = lambda m: round(RATE * float(g[m].sum() / (h[m].sum() + 1)), 6)
        f, limit, _ = self._split(x, g, h)
        left = x[:, f] <= limit
        sides = []
        for m in (left, ~left):
            f2, limit2, _ = self._split(x[m], g[m], h[m]) if m.any() else (0, 0, 0)
            low = x[:, f2] <= limit2
            sides.append((f2, limit2, leaf(m & low), leaf(m & ~low)))
        return f, limit, *sides

    @staticmethod
    def _apply(tree: tuple, x: np.ndarray) -> np.ndarray:
        f, limit, left, right = tree
        side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        return np.where(x[:, f] <= limit, side(left), side(right))

    def probability(self, x: Column) -> Column:
        """The same as a column; x: array<int>."""
        side = lambda s: F.when(x[s[0]] <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
        total = F.lit(self.start)
        for f, limit, left, right in self.trees:
            total = total + F.when(x[f] <= limit, side(left)).otherwise(side(right))
        return 1 / (1 + F.exp(-total))

    def selected(self, x: Column) -> Column:
        """Whether the candidate reaches its generator's threshold."""
        limits = F.array(*[F.lit(float(self.thresholds.get(g, 2))) for g in range(len(GENERATORS))])  # no candidate reaches 2
        return self.probability(x) >= F.get(limits, x[0])


def find_pii(docs: DataFrame, model: BoostedTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, text, base (spans) and added (spans of the trees that overlap no base span)."""
    texts = docs.select(id_col, text_of(text_col).alias("text"))
    found = texts.select(id_col, "text", base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("candidates"))
    if not model.thresholds:
        return found.select(id_col, "text", "base", no_spans().alias("added"))
    chosen = F.filter(free_of(F.col("candidates"), F.col("base")), lambda c: model.selected(features(F.col("text"), c)))
    return found.select(id_col, "text", "base", F.when(F.size("candidates") > 0, chosen).otherwise(no_spans()).alias("added"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the personal data of every document."""
    docs = read(spark, sf_dir, "documents")
    sample = bounded_sample(docs.select("doc_id", text_of().alias("text")), "doc_id", LEARN_ROWS, 9)
    found = find_pii(docs, BoostedTrees(*learning_table(sample)))
    return found.select(
        "doc_id", *[counted(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"),
    )


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
