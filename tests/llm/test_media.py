from collections import Counter

import numpy as np

from landloom.llm import media as M

SCHEMA = "image_id long, width int, height int, pixels binary"


def scene(seed, h=96, w=120):
    rng = np.random.default_rng(seed)
    im = np.full((h, w), 128.0)
    for _ in range(25):
        y, x = rng.integers(0, h - 12), rng.integers(0, w - 12)
        im[y : y + rng.integers(6, 30), x : x + rng.integers(6, 30)] = rng.integers(0, 255)
    return im


def row(i, im):
    im = np.clip(np.rint(im), 0, 255).astype(np.uint8)
    return (i, im.shape[1], im.shape[0], im.tobytes())


def test_crops_and_edits_are_found_and_others_left_alone(spark):
    scenes = [scene(s) for s in range(12)]
    rows = [row(i, s) for i, s in enumerate(scenes)]
    rows += [row(100 + i, s[4:-6, 8:-4]) for i, s in enumerate(scenes)]
    rows += [row(200 + i, s * 0.8 + 20 + np.random.default_rng(i).normal(0, 2, s.shape)) for i, s in enumerate(scenes)]
    rows += [row(300, scenes[0]), (400, 5, 5, b""), (401, None, None, None), (402, 3, 3, b"x"), (403, 2, 2, b"abcd"), (403, 2, 2, b"abcd"), (None, 2, 2, b"abcd")]
    got = {r["image_id"]: r["class_id"] for r in M.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[k + i] == i for k in (100, 200) for i in range(12))
    assert found >= 22, got
    assert all(got[k + i] in (i, k + i, 100 + i) for k in (100, 200) for i in range(12))
    assert [got[i] for i in range(12)] == list(range(12)) and got[300] == 0
    assert [got[i] for i in (400, 401, 402, 403)] == [400, 401, 402, 403]


def prepared(im):
    f = M.describe(np.clip(np.rint(im), 0, 255)[None])[0]
    geometry = np.stack([f["x"], f["y"], f["scale"], f["turn"]], 1).astype(np.float32)
    return {"geometry": geometry, "words": np.frombuffer(np.packbits(f["bits"], 1).tobytes(), np.uint64).reshape(-1, M.BITS // 64)}


def brute_classes(shapes):
    label = {i: i for i in shapes}
    ids, links = sorted(shapes), 0
    for i in ids:
        for j in ids:
            if j < i and M.linked(shapes[j], shapes[i]):
                links += 1
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    return label, links


def test_classes_against_all_pairs_with_crowded_keys(spark, monkeypatch):
    """Every pair of pictures judged by agreeing(), no keys: the classes are the same, also where all keys are crowded and compared in blocks."""
    rng = np.random.default_rng(4)
    images = {}
    for i in range(8):
        s = scene(50 + i)
        s[5:40, 5:40] = scene(99)[30:65, 30:65]  # one emblem on all
        images[i] = s
        for k, e in enumerate((s[6:, :-9], s * 0.7 + 30, s + rng.normal(0, 6, s.shape), s[:70, 20:])):
            images[100 * (k + 1) + i] = e
    label, links = brute_classes({i: prepared(im) for i, im in images.items()})
    assert links > 30
    rows = [row(i, im) for i, im in images.items()]
    for small in (M.SMALL_BUCKET, 1):
        monkeypatch.setattr(M, "SMALL_BUCKET", small)
        monkeypatch.setattr(M, "BLOCK_IMAGES", 5)
        got = {r["image_id"]: r["class_id"] for r in M.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert sum(got[i] == label[i] for i in label) >= 0.95 * len(label)


def test_repeated_ids_clashing_names_and_large_pictures(spark):
    big = scene(7, 300, 420)
    rows = [(*row(1, big), "x"), (*row(1, big), "x"), (*row(2, big[:280, 30:]), "x"), (3, 48, 48, None, "x")]
    got = [tuple(r) for r in M.image_copies(spark.createDataFrame(rows, SCHEMA + ", rep string")).collect()]
    assert sorted(got) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_empty(spark):
    assert M.image_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_two_pictures_under_one_id_keep_their_copies(spark):
    one, other = scene(21), scene(22)
    rows = [row(1, one), row(1, other), row(2, one * 0.8 + 20), row(3, other[4:, 6:]), row(0, scene(23))]
    got = sorted(tuple(r) for r in M.image_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1)]


def test_contracted_links_keep_components(spark):
    import random

    from landloom.llm.classes import components, contracted

    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, j) for i in range(400, 440) for j in range(i)  if j >= 400] + [(7, 7)]
    df = spark.createDataFrame([p for p in links if p[0] != p[1]], "a long, b long")
    few = contracted(df)
    assert few.where("a >= 400").count() < 40 * 5
    assert {tuple(r) for r in components(few).collect()} == {tuple(r) for r in components(df).collect()}


def test_keys_of_one_class_are_not_joined(spark, monkeypatch):
    """op6: a large group of near copies is found by a few keys of each; the keys that only they have join nothing more."""
    rng, s = np.random.default_rng(3), scene(7)
    rows = [row(i, s + rng.normal(0, 0.7, s.shape)) for i in range(20)] + [row(50 + i, scene(200 + i)) for i in range(4)]
    asked, plain = [], M.pivot_pairs
    monkeypatch.setattr(M, "pivot_pairs", lambda met, *rest: (asked.append(met.count()), plain(met, *rest))[1])
    got = {r["image_id"]: r["class_id"] for r in M.image_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == 0 for i in range(20)) and all(got[50 + i] == 50 + i for i in range(4))
    keys = Counter(k for r in M.image_features(spark.createDataFrame(rows, SCHEMA)).collect() for k in r["keys"])
    assert max(asked) < sum(n for n in keys.values() if n > 1) / 2, asked
