import hashlib
import random

import pytest

from landloom.llm import suffix_dedup as S


def brute(rows):
    """What remove_repeats says of (doc_id, text) rows with different ids."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - 99):
            s = data[i : i + 100]
            if s in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(s)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def made(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abéc") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(40)) for _ in range(4)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passage) if rng.random() < 0.4 else " ".join(word() for _ in range(30)) for _ in range(rng.randint(1, 5))]
        texts.append(" ".join(parts))
    texts += rng.sample(texts, 8)
    texts += [t[:50] + "X" + t[51:] for t in rng.sample(texts, 8)]
    texts += [None, "", "short", "a" * 400, "a" * 250 + "b" * 150, "ab" * 300, "ab" * 300, "é" * 120]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("hot", [2000, 3])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_CONTEXTS", hot)
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df).collect()}
    assert got == brute(rows)


def test_suffix_array_is_sorted():
    rng = random.Random(3)
    contexts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 60))) for _ in range(40)] + [b"aaaa", b"aaaa", b"\xff\xff\x00"]
    array, _, left = S.two_stage_suffix_array(contexts)
    text, ends = [], []
    for i, c in enumerate(contexts):
        text += [x + len(contexts) for x in c] + [i]
        ends.append(len(text) - 1)
    assert array.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert left[array[0]] == 0


def test_repeated_rows_and_nulls(spark):
    t = "xyz " * 60
    rows = [(1, t, "z"), (1, t, "z"), (2, t, "z"), (None, "q" * 99, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in S.remove_repeats(df).collect())
    own = brute([(1, t)])[1][1]
    assert got == [(-1, 0), (1, own), (1, own), (2, 240)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_lines_shared_by_hundreds_of_different_documents(spark, monkeypatch):
    """A licence of 240 bytes, a line of 70 and one of 99 in 300 documents each: their anchors are split, in several rounds."""
    monkeypatch.setattr(S, "HOT_CONTEXTS", 20)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    shared = ["".join(rng.choice("lmnop qrs") for _ in range(n)) for n in (240, 70, 99)]
    rows = [(i, " ".join([*(word() for _ in range(25)), rng.choice(shared), *(word() for _ in range(25))])) for i in range(900)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_halves_hold_every_string_once():
    ctx = bytes(range(150))
    for at, size in ((20, 32), (0, 32), (68, 50), (51, 60), (50, 99), (30, 100)):
        starts = [i for i in range(len(ctx) - S.LENGTH + 1) if i <= at and i + S.LENGTH >= at + size]
        part = ctx[starts[0] : starts[-1] + S.LENGTH]
        parts = S.halves(part, at - starts[0], size) if size < 100 else [(0, len(part), 0, 100)]
        assert sorted(i for a, b, *_ in parts for i in range(a, b - S.LENGTH + 1)) == list(range(len(starts)))
        assert all(a <= c and c + d <= b and b - S.LENGTH <= c and a + S.LENGTH >= c + d for a, b, c, d in parts)


def test_very_long_text_and_texts_of_one_doc_id(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long[:200_000] + long), (2, long[1000:1150] + "tail"), (3, "y" + long[5000:5120])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.remove_repeats(df).collect()}
    assert got == brute(rows)
    x, y = "x" + long[:150], "y" + long[:150]
    two = S.remove_repeats(spark.createDataFrame([(7, x), (7, y)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in two) == [0, 150]
