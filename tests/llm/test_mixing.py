import random

from landloom.llm import mixing as M

SCHEMA = "doc_id long, source string, size long"


def expected_targets(sizes, share=1.5):
    """By the words of the task, source by source."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        whole = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / whole > 2 * sizes[s]]
        if not full:
            return out | {s: left * weights[s] / whole for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets_against_the_rule(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 40, 1000, 90_000]) for s in rng.sample("abcdefghijklmé", rng.randint(1, 9))} | ({None: 77} if rng.random() < 0.5 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in M.source_targets(df, M.WEIGHTS, 1.5).collect()}
        want = expected_targets(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want), sizes


def test_every_source_meets_its_target_whatever_its_size(spark, monkeypatch):
    """A source of five short documents among 20,000, a null one, one of size 0; null and repeated ids."""
    rng = random.Random(2)
    rows = [(i, "abc"[i % 3], 40 + i % 7) for i in range(20_000)] + [(30_000 + i, "small", 11) for i in range(5)] + [(None, None, rng.randint(0, 9)) for _ in range(50)] + [(7, "zero", 0)] * 3 + [(9, "same", 13)] * 40
    for broadcast in (M.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(M, "BROADCAST_SOURCES", broadcast)
        got = M.mix_sources(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
        assert len(got) == len(rows)
        sizes = {s: sum(r[2] for r in rows if r[1] == s) for s in {r[1] for r in rows}}
        target = expected_targets(sizes)
        for s in sizes:
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - target[s]) <= 1, s
            assert all(0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[s] for r in own)
    again = M.mix_sources(spark.createDataFrame(random.Random(3).sample(rows, len(rows)), SCHEMA)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def highest_quotients(votes, seats):
    """Seats handed out one by one to the highest votes / (2 won + 1), ties to the first."""
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_apportionment_against_handing_out_seats(spark):
    """Groups of many sizes: no seats, fewer seats than places, votes of 0, ties, one competitor with nearly all votes, fractions."""
    rng = random.Random(4)
    groups = [([0], 0), ([5], 7), ([1, 1, 1], 2), ([10**9, 1, 1, 1], 500), ([0, 3, 0], 4), ([2.5, 7.25, 0.1], 40)]
    groups += [([rng.choice([0, 1, 3, 50, 50, 997, 10**6]) + (rng.random() if rng.random() < 0.3 else 0) for _ in range(rng.randint(1, 60))], rng.randint(1, 900)) for _ in range(40)]
    groups = [(v, n) for v, n in groups if sum(v) or not n]
    rows = [(g, i, float(x), float(sum(v)), len(v), n) for g, (v, n) in enumerate(groups) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "g long, shard long, votes double, total double, places long, seats long")
    got = {(r.g, r.shard): r.won for r in M.apportioned(df, ["g"], ["shard"]).collect()}
    for g, (votes, seats) in enumerate(groups):
        assert [got[g, i] for i in range(len(votes))] == highest_quotients(votes, seats), (votes, seats)


def test_taken_against_brute_force(spark, monkeypatch):
    """Every document's words recomputed: sources compete for blocks, shards for their source's blocks, the seeded order fills the quotas."""
    monkeypatch.setattr(M, "DOCS_PER_SHARD", 50)
    monkeypatch.setattr(M, "BLOCKS_PER_SHARD", 16)
    rng = random.Random(6)
    rows = [(i, ["a", "a", "a", "b", None][i % 5], rng.choice([0, 3, 40, 41, 200])) for i in range(1500)] + [(5000 + i, "tiny", 900) for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.taken for r in M.mix_sources(df.repartition(5)).collect()}
    draw = {r.doc_id: (r.d, r.s) for r in df.select("doc_id", M.F.xxhash64("doc_id", M.F.lit(42)).alias("d")).withColumn("s", M.F.xxhash64("d")).collect()}
    names = [None, "a", "b", "tiny"]
    own = {s: [r for r in rows if r[1] == s] for s in names}
    target = expected_targets({s: sum(r[2] for r in own[s]) for s in names})
    shards = {s: -(-len(own[s]) // 50) for s in names}
    block = max(1, min(256, int(min(target[s] / shards[s] for s in names) / 16)))
    assert block > 1
    blocks = dict(zip(names, highest_quotients([target[s] for s in names], round(sum(target.values()) / block)), strict=True))
    want = {}
    for s in names:
        cells = [sorted((r for r in own[s] if draw[r[0]][1] % shards[s] == k), key=lambda r: draw[r[0]][0]) for k in range(shards[s])]
        sizes = [sum(r[2] for r in c) for c in cells]
        for cell, size, won in zip(cells, sizes, highest_quotients(sizes, blocks[s]), strict=True):
            left = min(won * block, 2 * size)
            want |= {r[0]: 0 for r in cell}
            for r in cell * 2:
                want[r[0]] += min(r[2], left)
                left -= min(r[2], left)
        assert abs(sum(want[r[0]] for r in own[s]) - target[s]) <= block * (1 + shards[s] / 2)
    assert got == want


def test_empty_and_clashing_names(spark):
    assert M.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, "one two", "s", "x"), (2, None, "s", "x"), (3, "", None, "x")], "doc_id long, text string, source string, target string")
    assert sorted(tuple(r)[:3] for r in M.mix_sources(M.sized_documents(df)).select("doc_id", "size", "taken").collect()) == [(1, 2, 3), (2, 0, 0), (3, 0, 0)]
