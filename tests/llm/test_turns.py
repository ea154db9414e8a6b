"""Repaired conversations against a search over single edits, turn by turn."""

import functools
import hashlib
import itertools
import random
import re
import sys
import zlib

import pytest

from penstock.llm import turns

SPACE = " \t\n\x0b\x0c\r"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role or (role if role == "" else " "), " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def plain(conv, rows):
    """The contract's row of one conversation, from its damaged rows."""
    rows = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
    seen, fault = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(SPACE)
        fault.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def least(i, state, inserted):
        """(cost, audit, lines) from row i on, the last role being `state`."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserted < 2:
            c, a, x = least(i, NEXT[state], inserted + 1)
            found.append((c + 2, "I" + a, ({"u": "user", "a": "assistant"}[NEXT[state]] + ":", *x)))
        if i < len(rows):
            c, a, x = least(i + 1, state, 0)
            found.append((c + 3, "D" + a, x))
            if fault[i] in ("", "truncated"):
                cut = fault[i] == "truncated"
                role, text = rows[i][2:]
                if role[:1] == NEXT[state] or (role[:1] == "s" and state == ""):
                    c, a, x = least(i + 1, role[:1], 0)
                    found.append((c + cut, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = least(i + 1, NEXT[state], 0)
                found.append((c + cut + 2, "R" + a, ({"u": "user", "a": "assistant"}[NEXT[state]] + ":" + text, *x)))
        return min(found, key=lambda f: f[:2], default=(10**6, "", ()))

    cost, audit, lines = least(0, "", 0)
    told = [r[1] for r in rows if r[1] is not None]
    gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv, gaps, *(fault.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, n):
    rng = random.Random(seed)
    said = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Long. tail ", "é?"]
    out = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""])
            row = (conv, rng.choice([turn, turn, turn + 1, None]), role, rng.choice(said) if rng.random() < 0.6 else f"turn {turn}.")
            out += [row] * rng.choice([1, 1, 1, 2])
    return out


def results(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


@pytest.mark.parametrize("parts", [None, 13])
def test_repair_by_brute_force(spark, parts):
    """Nulls, ties, repeats, odd roles; with many parts, conversations cross their borders."""
    rows = made(3, 60)
    df = spark.createDataFrame([(*r, "c", 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, c string, part int, audit string").repartition(3)
    out = turns.repair(turns.damaged(df), df.select("conv_id").distinct(), parts)
    hurt = damage(rows)
    assert results(out) == sorted((plain(c, hurt) for c in {r[0] for r in rows}), key=str)


def test_one_long_conversation_in_many_segments(spark):
    """Every segment starts from the state in which the one before it ends, whatever the ties."""
    rng = random.Random(11)
    rows = [(5, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["Yes.", "said %d." % t, "cut %d" % t, ""])) for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    ids = df.select("conv_id").distinct()
    a, b = results(turns.repair(turns.damaged(df), ids, 1)), results(turns.repair(turns.damaged(df), ids, 40))
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    assert a == b == [plain(5, damage(rows))]
    sys.setrecursionlimit(limit)


@pytest.mark.parametrize("seed", range(300))
def test_program(seed):
    """Cost and audit of random turns without Spark."""
    rng = random.Random(seed)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", f"{t}.", f"{t}", " "])) for t in range(rng.randint(0, 9))]
    want = plain(1, rows)
    if not rows:
        return
    light, seen = {}, set()
    for name in ("c", "part", "at", "told", "turn", "key", "initial", "blank", "cut", "again", "n"):
        light[name] = []
    for t, (_, _, role, text) in enumerate(rows):
        for name, v in zip(light, (1, 0, t, True, t, b"", role[0], not text.strip(), text.strip()[-1:] != ".", (role, text) in seen, 1), strict=True):
            light[name].append(v)
        seen.add((role, text))
    got, _ = turns._solved(light, turns.START, turns.AT_END, True)
    assert (got[3], got[2], *got[4:8]) == (want[6], want[7], *want[2:6])


def test_often_said_turns(spark):
    """More copies of one text than the bound for a single task."""
    rows = [(1, t, "user", "Ok.") for t in range(12_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    marked = turns.light(turns.prepared(df.selectExpr("*", "1 as n")))
    assert marked.where("again").count() == 11_999 and not marked.where("turn = 0").first().again


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert turns.repair(turns.damaged(df), df.select("conv_id").distinct()).count() == 0
    lost = spark.createDataFrame([(c,) for c in range(3)], "conv_id bigint")
    assert results(turns.repair(turns.damaged(df), lost)) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in range(3)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hurt = damage(rows)
    assert results(turns.query(spark, sf)) == sorted((plain(c, hurt) for c in {r[0] for r in rows}), key=str)
