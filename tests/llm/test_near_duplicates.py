import random

from landloom.llm import near_duplicates as N

SCHEMA = "doc_id long, text string, key string"


def words(rng, n):
    return [f"w{rng.randint(0, 50_000)}" for _ in range(n)]


def shingle_similarity(a, b):
    """Jaccard similarity of five-word shingles."""
    x, y = ({tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_classes_against_brute_force(spark):
    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, 200)) for _ in range(30)]
    for t in texts[:10]:
        for _ in range(4):
            w = t.split()
            w[rng.randint(0, len(w) - 1)] = "edited"
            texts.append(" ".join(w))
    texts += [" ".join([*passage, *words(rng, 40)]) for _ in range(40)]  # half alike, in one bucket: no duplicates
    texts += [texts[0], texts[0].upper(), "", None, "", "one two", "One, two!", "..."]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i] or "", texts[j] or ""
            plain = lambda t: "".join(c for c in t.lower() if c.isalnum() or c == " ")
            if a == b or (plain(a).strip() and shingle_similarity(plain(a), plain(b)) >= 0.8):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label))


def test_repeated_null_and_empty(spark):
    rows = [(1, "a b c d e f", "z"), (1, "a b c d e f", "z"), (None, "x", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in N.near_duplicates(df).collect()] == [(1, 1), (1, 1)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_alignment_keeps_order():
    a = N.np.arange(100, dtype=N.np.uint64)
    assert N.aligned_similarity(a, a) == 1
    assert N.aligned_similarity(a, N.np.concatenate([a[50:], a[:50]])) == 0
    assert N.aligned_similarity(a, a[:85]) == 0.85


def test_large_group_of_near_copies_against_brute_force(spark):
    rng = random.Random(5)
    base, texts = words(rng, 150), []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randint(0, len(w) - 1)] = f"edit{rng.randint(0, 50_000)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if shingle_similarity(texts[i], texts[j]) >= 0.8 and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label))


def test_group_of_several_classes_over_many_blocks_against_brute_force(spark, monkeypatch):
    """Copies with 1 to 8 edits: many are alike to some, but not to the pivot, others to none. Recall against all pairs is whole."""
    monkeypatch.setattr(N, "BLOCK_TEXTS", 32)
    rng = random.Random(6)
    texts = []
    for base in (words(rng, 150), words(rng, 90)):
        for _ in range(180):
            w = list(base)
            for _ in range(rng.randint(1, 8)):
                w[rng.randint(0, len(w) - 1)] = f"edit{rng.randint(0, 50_000)}"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label, links = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += 1
                if label[i] != label[j]:
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
    assert links > 1000 and len(set(label)) > 20
    assert got == dict(enumerate(label))


def test_shared_counts():
    rng = N.np.random.default_rng(1)
    xs, ys = ([N.np.unique(rng.integers(0, 9000, n).astype(N.np.uint64)) for n in (0, 40, 9000)] for _ in range(2))
    assert N.shared_counts(xs, ys).tolist() == [[len(N.np.intersect1d(x, y)) for y in ys] for x in xs]


def test_very_long_text_and_its_copy(spark):
    rng = random.Random(2)
    w = words(rng, 60_000)
    texts = [" ".join(w), " ".join(w[:100] + ["x"] + w[101:]), " ".join(words(rng, 20_000))]
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_two_texts_under_one_doc_id_keep_their_own_classes(spark):
    rng = random.Random(3)
    x, y = (" ".join(words(rng, 120)) for _ in range(2))
    rows = [(5, x, ""), (5, y, ""), (2, x + " more", ""), (3, y + " more", "")]
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(2, 2), (3, 3), (5, 2), (5, 3)]


def bands(text):
    return N.order_sketches(N.occurrence_labelled(N.shingles(N.Words()(text))))


def test_large_buckets_lose_no_partner(spark):
    """120 texts share most of one passage and are no duplicates; two more are, and agree on two sketches only, both of the passage."""
    rng = random.Random(11)
    passage = words(rng, 120)
    crowd = [" ".join([*passage, *words(rng, 30)]) for _ in range(120)]
    common = bands(" ".join(passage))
    while True:
        w = [*passage, *words(rng, 30)]
        x, v = bands(" ".join(w)), list(w)
        for place in (rng.randint(10, 40), rng.randint(50, 80), rng.randint(90, 140)):
            v[place] = f"edit{rng.randint(0, 50_000)}"
        same = x == bands(" ".join(v))
        if same.sum() == 2 and (x == common)[same].all():
            break
    assert sum((bands(t) == common)[same].all() for t in crowd) > N.SMALL_BUCKET
    texts = [*crowd, " ".join(w), " ".join(v)]
    assert shingle_similarity(*texts[-2:]) >= 0.8 and all(shingle_similarity(t, u) < 0.8 for t in crowd for u in texts[-2:])
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], SCHEMA)).collect()}
    assert got == dict(enumerate([*range(121), 120]))
