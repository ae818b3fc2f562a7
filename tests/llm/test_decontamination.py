import random

from landloom.llm import decontamination as D

DOCS, ITEMS = "doc_id long, text string, similarity string", "item_id long, text string, doc_id string"


def similarity(a, b):
    """Sum of least over sum of greatest counts of five-word shingles."""
    count = lambda w: {g: sum(h == g for h in w) for g in w}
    x, y = count(a), count(b)
    least = sum(min(x[g], y.get(g, 0)) for g in x)
    return least / (len(a) + len(b) - least)


def grams(text):
    w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    k = min(5, len(w))
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if w else [], k


def brute(docs, items):
    found = set()
    for d, text in docs:
        for i, item in items:
            b, k = grams(item)
            w = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
            a = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if k else []
            n = min(len(b), len(a))
            if b and a and any(similarity(a[s : s + n], b) >= 0.8 for s in range(len(a) - n + 1)):
                found.add((d, i))
    return found


def made(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(rng.choice([3, 8, 20, 40, 60])))) for i in range(25)]
    docs = []
    for d in range(160):
        w = items[rng.randrange(25)][1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):  # edits, some past the threshold
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w[: len(w) // 2]
        docs.append((d, " ".join(prose(rng.randint(0, 40)) + w + prose(rng.randint(0, 40)))))
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    docs, items = made(random.Random(7))
    want = brute(docs, items)
    assert len(want) > 50
    for block in (D.ITEM_BLOCK, 6):
        monkeypatch.setattr(D, "ITEM_BLOCK", block)
        rows = D.find_leaks(spark.createDataFrame([(*r, "x") for r in docs], DOCS), spark.createDataFrame([(*r, "x") for r in items], ITEMS)).collect()
        got = {(r["doc_id"], r["item_id"]) for r in rows}
        assert len(rows) == len(got) and got <= want and len(got) >= 0.97 * len(want)


def test_repeats_nulls_long_texts_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = " ".join(f"w{i % 977}" for i in range(150_000)) + " " + item
    docs = spark.createDataFrame([(1, item, "x"), (1, item, "x"), (None, item, "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, "clean " * 40, "x")], DOCS)
    items = spark.createDataFrame([(8, item, "x"), (8, item, "x"), (8, "an other text of the same id", "x"), (9, None, "x"), (None, item, "x"), (10, "", "x")], ITEMS)
    got = sorted(((r["doc_id"] or 0, r["item_id"], round(r["similarity"], 3)) for r in D.find_leaks(docs, items).collect()))
    assert got == [(0, 8, 1.0), (1, 8, 1.0), (1, 8, 1.0), (4, 8, 1.0)]
    assert sorted(r["doc_id"] for r in D.without_leaks(docs, items).collect()) == [2, 3, 5]
    assert D.find_leaks(docs.limit(0), items).count() == 0 and D.find_leaks(docs, items.limit(0)).count() == 0
    assert D.without_leaks(docs, items.limit(0)).count() == 7
