"""Repair of conversations against all edits by brute force."""

import hashlib
import random
import re
import zlib
from itertools import groupby

import pytest

from landloom.llm import conversation_repair
from landloom.llm.conversation_repair import Edits, Repair, damaged, less, repaired_conversations

PATTERN, OPEN = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")


def brute_edits(rows):
    """rows: (role, text, must_go, truncated). Every list of edits, with two insertions in a row at most, that costs no more than deleting all."""
    best = None

    def go(i, cost, audit, out, put):
        nonlocal best
        if cost > (best[0] if best else 3 * len(rows)) or not OPEN.fullmatch("".join(r[:1] or "?" for r, _ in out)):
            return
        if i == len(rows) and PATTERN.fullmatch("".join(r[:1] for r, _ in out)):
            best = min(best or (cost, audit, out), (cost, audit, out), key=lambda b: b[:2])
        if put < 2:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*out, (role, "")], put + 1)
        if i < len(rows):
            role, text, must_go, cut = rows[i]
            go(i + 1, cost + 3, audit + "D", out, 0)
            if not must_go:
                go(i + 1, cost + cut, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    go(i + 1, cost + cut + 2, audit + "R", [*out, (new, text)], 0)

    go(0, 0, "", [], 0)
    return best[0], best[1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()


def brute(rows):
    out = []
    for conv, of in groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0]):
        held = []
        for _, turn, role, text in sorted(of, key=lambda r: (r[1] is not None, r[1] or 0)):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        seen, told, counts = set(), [], [0, 0, 0]
        for _, role, text in held:
            blank = not text.strip(" \t\n\v\f\r")
            fault = 0 if blank else 1 if (role, text) in seen else 2 if text.strip(" \t\n\v\f\r")[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            told.append((role, text, fault < 2, fault == 2))
        turns = {t for t, _, _ in held if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, *brute_edits(told)))
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def spark_rows(spark, rows):
    return sorted(map(tuple, repaired_conversations(damaged(spark.createDataFrame(rows, SCHEMA))).collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_against_all_edits(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(-3, 120)]:
        turns = sorted(rng.sample(range(-2, 9), rng.randrange(1, 6)))
        if rng.random() < 0.2:
            turns[0] = None
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["a.", "b!", "c? ", "d", "e.", "f. ", " \t", "", None, "g..h."])) for t in turns]
    assert spark_rows(spark, rows) == brute(rows)


def test_edges(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([(1, 0, "user", "a.")], SCHEMA)
    assert repaired_conversations(damaged(df.where("conv_id > 1"))).collect() == []
    assert spark_rows(spark, [(1, 0, "user", "a."), (1, 1, "assistant", "x" * 300_000 + ".")]) == brute([(1, 0, "user", "a."), (1, 1, "assistant", "x" * 300_000 + ".")])
    wide = df.select("*", F.lit(1).alias("kind"), F.lit("k").alias("digest"), F.lit(True).alias("blank"))
    assert [tuple(r) for r in repaired_conversations(damaged(wide.select("conv_id", "turn", "role", "text", "kind"))).collect()] == brute([(1, 0, "user", "a.")])
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert spark_rows(spark, [(gone, 0, "user", "a.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    again = [(c, 1, "user", "a.") for c in range(20) for _ in range(3)]  # repeated rows are duplicates
    assert spark_rows(spark, again) == brute(again) and sum(r[3] for r in brute(again)) > 20


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 5])
def test_long_conversations_settle_and_collisions_are_seen_through(monkeypatch, modulus):
    rng = random.Random(5)
    rows = [(rng.choice(["user", "assistant", "system"]), f"t{i}.", rng.random() < 0.1, rng.random() < 0.1) for i in range(600)]
    got = []
    for settle in (7, 10_000):
        monkeypatch.setattr(conversation_repair, "SETTLE", settle)
        repair = Repair(modulus)
        for row in rows:
            repair.add(*row)
        got.append(repair.result())
    # the plain form: whole strings compared
    ways = {0: (0, "")}
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(of):
        for _ in range(4):
            for place, (cost, audit) in list(of.items()):
                for initial, then in steps[place].items():
                    if initial != "s":
                        of[then] = min(of.get(then, (1 << 60, "")), (cost + 2, audit + "I"))
        return of

    ways = inserted(ways)
    for role, _, must_go, cut in rows:
        after = {}
        for place, (cost, audit) in ways.items():
            options = [(place, cost + 3, "D")]
            if not must_go:
                options += [(then, cost + cut + (0 if role[:1] == i else 2), "K" if role[:1] == i else "R") for i, then in steps[place].items() if role[:1] == i or i != "s"]
            for then, total, letter in options:
                after[then] = min(after.get(then, (1 << 60, "")), (total, audit + letter))
        ways = inserted(after)
    want = min(ways[0], ways[3])
    assert [g[:2] for g in got] == [want, want] and got[0][2] == got[1][2]


def test_comparisons_agree_with_strings():
    rng = random.Random(1)
    for modulus in (3, (1 << 61) - 1):
        nodes = [(Edits(None, ""), "")]
        for _ in range(300):
            node, said = rng.choice(nodes[-40:])
            letter = rng.choice("DIK")
            nodes.append((Edits(node, letter, modulus), said + letter))
        for _ in range(3000):
            (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
            assert less(a, b) == (x < y)
