import hashlib
import random
import re

from pyspark.sql import functions as F

from landloom.llm import pii as P

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def keep(kind, hit):
    n = sum(c.isdigit() for c in hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= n <= 19 and luhn(hit)
    return kind == "email" or 9 <= n <= 15


def brute(text):
    text = text or ""
    out = [(m.start(), rank, kind, m.end()) for rank, (kind, r) in enumerate(KINDS.items()) for m in re.finditer(r, text) if keep(kind, m.group())]
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def texts():
    rng = random.Random(2)
    pieces = ["a@b.c_d@e.f", "x@y", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (983) 555-7102", "+1234+56789012", "é", "ß ", "999", "12.", "@", "+", "\n", "  ", "00255.1.1.1", "5500005555555559x", "a.b@c-d.ef."]
    made = ["".join(rng.choice(pieces) + rng.choice(["", " ", ",", "."]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    return [None, "", "a@b.c 12345678 " * 4000, "1" * 5000, "a" * 20000, "1 " * 3000 + "x", "a@" * 500, *made]


def test_base_spans_against_re(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", P.F.lit("clash"))
    sample = df.select("doc_id", P.text_of().alias("text"))
    found = P.find_pii(df, P.BoostedTrees(*P.learning_table(sample))).select("doc_id", P.listed(P.F.col("base")).alias("b"), P.F.size("added").alias("n")).collect()
    for r in found:
        assert r["b"] == ",".join(brute(rows[r["doc_id"]][1])), rows[r["doc_id"]]
    assert hashlib.sha256(b"").hexdigest()


def test_trees_as_columns_score_like_numpy(spark):
    rng = random.Random(4)
    table = [([rng.randint(0, m) for m in P.FEATURES.values()], rng.choice([0.0, 1.0]), rng.randint(1, 9)) for _ in range(200)]
    model = P.BoostedTrees(table)
    x = P.np.array([t[0] for t in table])
    score = P.np.full(len(x), model.start)
    for t in model.trees:
        score += model._apply(t, x)
    df = spark.createDataFrame([(t[0],) for t in table], "x array<int>")
    got = [r[0] for r in df.select(model.probability(P.F.col("x"))).collect()]
    assert P.np.allclose(got, 1 / (1 + P.np.exp(-score)))


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.find_pii(df, P.BoostedTrees(*P.learning_table(df))).count() == 0


def test_added_spans_on_planted_data(spark):
    """Values, words and places that the trees have not seen: precision and recall of what they add; base kinds and decoys apart."""
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioustrnlmd") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    corpus = [(i, prose(rng.randint(0, 80)) + (f" {digits(16)} {word()}" if i % 9 == 0 else "")) for i in range(600)]
    personal = [lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{word()}xx(at){word()}yy.com"]
    decoys = [lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}", lambda: f"{digits(1)}.{digits(2)}.{digits(1)}", lambda: digits(7), lambda: f"{digits(4)}-{digits(4)}"]
    rows = [(i, f"{prose(20)} {rng.choice(personal if i % 2 else decoys)()} {prose(5)}") for i in range(400)]
    schema = "doc_id long, text string"
    model = P.BoostedTrees(*P.learning_table(spark.createDataFrame(corpus, schema)))
    found = P.find_pii(spark.createDataFrame(rows, schema), model).select("doc_id", P.F.size("base").alias("base"), P.F.size("added").alias("added")).collect()
    right = sum(r["added"] > 0 for r in found if r["doc_id"] % 2)
    wrong = sum(r["added"] > 0 for r in found if r["doc_id"] % 2 == 0)
    assert right >= 0.9 * 200 and right >= 0.9 * (right + wrong)
    assert sum(r["added"] > 0 for r in P.find_pii(spark.createDataFrame(corpus, schema), model).select(P.F.size("added").alias("added")).collect()) <= 3


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "mail a@b.cc now", "x"), (1, "mail a@b.cc now", "x"), (None, "+1 234 567 8901", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, candidates string")
    found = P.find_pii(df, P.BoostedTrees([])).select("doc_id", P.listed(P.F.col("base"))).collect()
    assert sorted(map(tuple, found), key=repr) == [(1, "email:5:11"), (1, "email:5:11"), (None, "phone:0:15")]


def test_digits_within_letters_are_no_candidates(spark):
    texts = ["token = 1eb9c654e721b4f812088970e66a", "part AB1234567890", "1234567890XY", "call 555 123 4567 now", "(404) 555-0199"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [s["value"] for s in r["c"] if s["kind"] == "digits"] for r in df.select("doc_id", P.candidate_spans(F.col("text")).alias("c")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["555 123 4567"], 4: ["(404) 555-0199"]}
