import random

import duckdb
import numpy as np

from landloom.llm import languages as L

SCHEMA = "doc_id long, text string, lang string, score string"
LETTERS = {"aa": "etaoin shrdlu", "bb": "éèàùç oueitr", "ru": "абвгдежз ик", "zh": "的一是不了人我在有他"}


def text(rng, lang, n=200):
    return "".join(rng.choice(LETTERS[lang]) for _ in range(n))


def cosine_brute(texts, learned):
    """The same sums letter by letter, without tables of trigrams."""
    e = L.Encoder()

    def vector(t):
        letters = [ord(c) if c.isalpha() else 0 for c in t.lower()]
        letters = [0, *(c for i, c in enumerate(letters) if c or not i or letters[i - 1]), 0]
        total = np.zeros(L.DIMENSIONS)
        gap = e.letter(0)
        for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
            total += np.roll(e.letter(a) if a else gap, 2) * np.roll(e.letter(b) if b else gap, 1) * (e.letter(c) if c else gap)
        return total

    sums = {}
    for t, lang in learned:
        v = vector(t)
        sums[lang] = sums.get(lang, 0) + v / np.linalg.norm(v)
    out = []
    for t in texts:
        v = vector(t)
        cos = {lang: s @ v / np.linalg.norm(s) / np.linalg.norm(v) for lang, s in sums.items()}
        best = max(sorted(cos), key=lambda x: cos[x])
        out.append((best, cos[best]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, text(rng, lang), lang, "x") for i, lang in enumerate([*LETTERS] * 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, prototypes = L.learn_prototypes(docs.where("doc_id < 24"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.predict_languages(docs, langs, prototypes).collect()}
    want = cosine_brute([r[1] for r in rows], [(r[1], r[2]) for r in rows[:24]])
    assert all(got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-3 for i, w in enumerate(want))
    assert sum(got[r[0]][0] == r[2] for r in rows) >= 0.8 * len(rows)


def test_cases(spark):
    rng = random.Random(4)
    rows = [(1, text(rng, "aa"), "aa", "x")] * 3 + [(2, None, "aa", "x"), (3, "", None, "x"), (4, "123 !?", "bb", "x"), (None, text(rng, "bb"), "bb", "x"), (5, text(rng, "zh", 300_000), None, "x"), (6, "Ξένη γλώσσα και άλλα", None, "x"), (7, "日本語の文", None, "x"), (8, "русский текст", None, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, prototypes = L.learn_prototypes(docs)
    assert langs == ["aa", "bb"]
    got = sorted(((r["doc_id"] or 0, r["lang_pred"], r["lang"]) for r in L.predict_languages(docs, langs, prototypes).where("doc_id is null or doc_id < 5").collect()), key=str)
    assert got == sorted([(1, "aa", "aa")] * 3 + [(2, "und", "aa"), (3, "und", None), (4, "und", "bb"), (0, "bb", "bb")], key=str)
    assert [r[0] for r in L.predict_languages(docs, [], np.zeros((0, L.DIMENSIONS), np.float32)).select("lang_pred").distinct().collect()] == ["und"]
    assert L.predict_languages(docs.limit(0), langs, prototypes).count() == 0
    twins = np.stack([prototypes[0], prototypes[0]])
    assert L.predict_languages(docs.where("doc_id = 1"), ["m", "n"], twins).first()["lang_pred"] == "m"
    foreign = L.predict_languages(docs, langs, prototypes).where("doc_id > 5").collect()
    assert len(foreign) == 3 and all(r["lang_pred"] in ("aa", "bb") and 0 <= r["score"] <= 1 for r in foreign)


def test_every_language_is_learned(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, "aa") + f" q{i}", f"l{i:04}", "x") for i in range(1001)]
    assert L.learn_prototypes(spark.createDataFrame(rows, SCHEMA))[0] == [f"l{i:04}" for i in range(1001)]


def test_held_out_accuracy(spark):
    """op8 on sf0.01: documents whose crc32 of the id leaves 2 were not learned from."""
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in L.op8_language_id(spark, folder).collect()}
    truth = dict(duckdb.sql(f"select doc_id, lang from '{folder}/documents.parquet' where lang is not null and regexp_matches(text, '[a-z]')").fetchall())
    held = [i for i, r in got.items() if r["held_out"] and i in truth]
    assert len(held) > 150 and sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (__import__("zlib").crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
