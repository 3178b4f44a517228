"""Repairs against a search through all edits, and whole queries against plain Python."""

import hashlib
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sondage.llm import conversations
from sondage.llm.conversations import EDGES, END, NOTHING, Repair, crossings, damaged, solved, summary
from sondage.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, letters, roles) of rows (initial, fault), by trying all edits; ``written`` is
    what matters of the roles before: none, a system turn, or the last one."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def best(i, written, inserts):
        found = [(0, "", ())] if i == len(rows) and written in ("", "a") else []

        def offer(cost, letter, role, rest):
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], ((role,) if role is not None else ()) + rest[2]))

        if inserts < 3:
            for role in ("user", "assistant"):
                if (written, role[0]) in step:
                    offer(5, "I", role, best(i, step[written, role[0]], inserts + 1))
        if i < len(rows):
            initial, fault = rows[i]
            extra = 5 if fault == "truncated" else 0
            offer(2, "D", None, best(i + 1, written, 0))
            if fault not in ("blank", "duplicate"):
                for role in ("user", "assistant"):
                    if (written, role[0]) in step:
                        offer(1 + extra, "R", role, best(i + 1, step[written, role[0]], 0))
                if (written, initial) in step:
                    offer(extra, "K", initial, best(i + 1, step[written, initial], 0))
        return min(found) if found else None

    for i in range(len(rows), -1, -1):  # from behind, so that calls stay shallow
        for written in ("", "s", "u", "a"):
            best(i, written, 0)
    return best(0, "", 0)


def expected(turns):
    """The contract's row of every conversation, turns given as (conv_id, turn, role, text)."""
    held = defaultdict(list)
    for conv, turn, role, text in turns:
        named, role, text = " " if conv is None else conv, " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{named}:{' ' if turn is None else turn}".encode()) % 20
        held[conv]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        held[conv] += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    found = []
    for conv, rows in held.items():
        digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))
        faults, seen = [], set()
        for _, role, text in rows:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
            faults.append(fault)
            seen.add((role, text))
        cost, audit, _ = cheapest(tuple((r[1][:1], f) for r, f in zip(rows, faults, strict=True)))
        repaired, state, at = [], "", 0
        for letter in audit:
            given = "assistant" if state == "u" else "user"
            if letter == "I":
                role, text = given, ""
            else:
                _, role, text = rows[at]
                at += 1
                if letter == "D":
                    continue
                role = given if letter == "R" else role
            state = role[0]
            repaired.append(f"{role}:{text}")
        assert LEGAL.fullmatch("".join(x[0] for x in repaired))
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
        found.append((
            conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        ))
    return sorted(found, key=repr)


ALPHABET = "suaoSUAO0123"


def plain(letter):
    if letter in "0123":
        return "suao"[int(letter)], "blank"
    return letter.lower(), "truncated" if letter.isupper() else ""


def repaired_in_stretches(rows, size):
    """Cost and letters by way of stretches of ``size`` rows."""
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    far = conversations.FAR
    steps = []
    for part in parts:
        costs, ranks = summary(part)
        steps.append([[(q, costs[4 * p + q], ranks[4 * p + q]) for q in range(4) if costs[4 * p + q] < far] for p in range(4)])
    behind = crossings([*steps, [[(q, c, 0) for q, c, _ in e] for e in EDGES[END]]], NOTHING, NOTHING)
    before = [NOTHING, *behind[:-1]]
    tail = EDGES[END][before[-1]][0]
    letters = "".join(solved(r, p, q) for r, p, q in zip(parts, before, behind, strict=False)) + tail[2]
    cost = tail[1] + sum(next(c for s, c, _ in e[p] if s == q) for e, p, q in zip(steps, before, behind, strict=False))
    return cost, letters


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, min_size=1, max_size=12), st.integers(1, 12))
def test_cheapest_and_least_edits(rows, size):
    cost, letters, _ = cheapest(tuple(map(plain, rows)))
    assert repaired_in_stretches(rows, size) == (cost, letters)


@settings(max_examples=20, deadline=None)
@given(st.text("suaUAo1", min_size=100, max_size=300), st.sampled_from([1, 7, 64, 300]))
def test_long_conversations_do_not_depend_on_stretches(rows, size):
    cost, letters, _ = cheapest(tuple(map(plain, rows)))
    assert repaired_in_stretches(rows, size) == (cost, letters)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_query_over_whole_table(spark, scale):
    folder = f"/root/testdata/{scale}"
    turns = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op11_hirschberg_repair"](spark, folder).collect()), key=repr)
    assert got == expected(turns)


def odd_turns():
    roles = ["user", "assistant", "system", "tool", "", None, "User", "sys", "ux", "é"]
    texts = ["Yes.", "no", None, "", " \n\t", "What?!  \n", "a.b", "x" * 40_000 + ".", ".", "Ünïcode 😀", "end\x0b!\x0c"]
    rows = [(c, t, roles[(7 * c + 3 * t) % 10], texts[(5 * c + t * t) % 11]) for c in range(40) for t in range(c % 9)]
    rows += [(c, None if t % 3 == 0 else t // 2, roles[t % 3], texts[(c + t) % 11]) for c in range(40, 60) for t in range(12)]
    rows += [(None, t, roles[t % 2], "Fine.") for t in range(5)]  # null id
    rows += [(70, 3, "user", "Again.")] * 30 + [(70, t, "assistant", "Again.") for t in range(9)]
    rows += [(71, None, "user", "Only nulls.")] * 2 + [(72, 5, None, None)]
    return rows + [(80 + c, c, "user", "Dropped or not.") for c in range(60)]


def test_nulls_ties_repeats_and_odd_roles(spark):
    import tempfile

    rows = odd_turns()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    folder = tempfile.mkdtemp(dir=spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    df.selectExpr("*", "1 AS key", "2 AS digest", "3 AS n", "4 AS piece", "5 AS audit").write.parquet(f"{folder}/conversations.parquet")
    got = [tuple(r) for r in QUERIES["op11_hirschberg_repair"](spark, folder).collect()]
    assert sorted(got, key=repr) == expected(rows)


def test_one_conversation_over_many_tasks_and_stretches(spark):
    """Half of all rows are one conversation, a third of these one and the same row."""
    rows = [(1, t, ("user", "assistant", "user", "system", "tool")[t * t % 5], f"Turn {t % 400}{'.!x'[t % 3]}") for t in range(800)]
    rows += [(1, 90, "user", "The same.")] * 400 + [(c, t, "user", f"Hm {t}.") for c in range(2, 302) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    repair = Repair(damaged(df), most=37)
    digests = {r["key"]: r["repaired_sha256"] for r in repair.digests().collect()}
    got = [(int(r["key"]), *r[1:], digests[r["key"]]) for r in repair.report.collect()]
    wanted = [r for r in expected(rows) if r[7] or r[6]]
    assert sorted(got, key=repr) == wanted
    turns = repair.turns().where("key = '1'").orderBy("position").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns)
    assert hashlib.sha256(text.encode()).hexdigest() == digests["1"]
    assert [r["position"] for r in turns] == list(range(len(turns)))


def test_empty_table(spark):
    repair = Repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert repair.report.count() == repair.digests().count() == repair.turns().count() == 0
