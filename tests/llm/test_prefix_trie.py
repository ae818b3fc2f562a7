"""The prefix trie against nested dicts, and tree contraction against plain sums."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from landloom.llm.prefix_trie import numbered_turns, prefix_trie, rebuilt
from landloom.llm.tree_contraction import subtree_totals

EMPTY = hashlib.sha256().hexdigest()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - int(c / 5) * 5
        made[c] = own.get(c - first, [])[:h] + turns[h:]
        for d in range(len(made[c]) + 1):
            nodes[tuple(made[c][:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    out = set()

    def below(p):
        saved = (len(nodes[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        told = [below(k) for k in kids[p]]
        leaves, saved = sum(x[0] for x in told) or 1, saved + sum(x[1] for x in told)
        ends = ",".join(map(str, sorted(c for c in nodes[p] if len(made[c]) == len(p))))
        out.add((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        below(())
    return out


@pytest.mark.parametrize("seed", range(2))
def test_against_dicts(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 60), 40):
        for t in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é", "", None, "user"])))
    rows += rows[:5] + [(None, 1, "user", "x")]
    unique = [(c, i, r, t) for i, (c, _, r, t) in enumerate(rows)]  # without turns of one number, whose order is by digest
    df = spark.createDataFrame(unique, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie(*rebuilt(numbered_turns(df))).collect()} == brute(unique)


def test_one_conversation_of_many_turns_and_long_texts(spark):
    rows = [(5, i, "user", "x" * (100_000 if i == 3 else i % 3)) for i in range(24)] + [(6, i, "user", "y") for i in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie(*rebuilt(numbered_turns(df))).collect()} == brute(rows)


def test_no_conversations_and_further_columns(spark):
    ties = [(c, None, "user", "a") for c in (0, 1, 2, 3, 4) for _ in range(c + 2)]  # repeated rows all count
    assert {tuple(r) for r in prefix_trie(*rebuilt(numbered_turns(spark.createDataFrame(ties, "conv_id long, turn long, role string, text string")))).collect()} == brute(ties)
    df = spark.createDataFrame([(1, 0, "user", "a", "k", 3)], "conv_id long, turn long, role string, text string, key string, depth int")
    assert prefix_trie(*rebuilt(numbered_turns(df.where("conv_id > 1")))).collect() == []
    assert {tuple(r) for r in prefix_trie(*rebuilt(numbered_turns(df))).collect()} == brute([(1, 0, "user", "a")])


@pytest.mark.parametrize("shape", ["chain", "random", "forest"])
def test_contraction(spark, shape):
    rng, n = random.Random(7), 40
    parent = {"chain": lambda i: i - 1, "random": lambda i: rng.randrange(i), "forest": lambda i: None if i % 9 == 0 else i - 1 - rng.randrange(min(i, 3))}[shape]
    rows = [(i, parent(i) if i else None, rng.randrange(100)) for i in range(n)]
    want = {i: v for i, _, v in rows}
    for i, p, _ in reversed(rows):
        if p is not None:
            want[p] += want[i]
    got = subtree_totals(spark.createDataFrame(rows, "id long, parent long, v long"), ["v"])
    assert {r.id: r.v for r in got.collect()} == want
    assert got.count() == n
