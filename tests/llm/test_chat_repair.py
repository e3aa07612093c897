"""Operator 11 against enumeration of all edits, and the query against a sequential reading of the contract."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import Row

from tagloom.llm import chat_repair, queries
from tests.conftest import SF001, SF01

LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def enumerate_edits(takes):
    """(cost, letters) of the best of all edits whose initials are legal, inserts up to two at a place."""
    found = []

    def go(i, cost, letters, initials, room):
        if cost > 3 * len(takes) + 4:
            return
        if i == len(takes) and LEGAL.fullmatch(initials):
            found.append((cost, letters))
        if room:
            for r in "ua":
                go(i, cost + 2, letters + "I", initials + r, room - 1)
        if i == len(takes):
            return
        initial, must, cut = takes[i]
        go(i + 1, cost + 3, letters + "D", initials, 2)
        if not must:
            if initial:
                go(i + 1, cost + cut, letters + "K", initials + initial, 2)
            for r in "ua":
                go(i + 1, cost + 2 + cut, letters + "R", initials + r, 2)

    go(0, 0, "", "", 2)
    return min(found)


def plain_best(takes):
    """The same by whole strings for every state; checked against the enumeration, used for long runs."""
    best = {"": (0, "")}
    relax = lambda b: [b.__setitem__(t, c) for _ in range(2) for s, v in list(b.items()) for t, c in [({"": "u", "s": "u", "u": "a", "a": "u"}[s], (v[0] + 2, v[1] + "I"))] if t not in b or c < b[t]]
    relax(best)
    for initial, must, cut in takes:
        new = {}
        for s, (cost, letters) in best.items():
            options = [(s, cost + 3, "D")]
            if not must:
                options += [(t, cost + 2 + cut, "R") for t in "ua" if s + t in ("u", "su", "ua", "au")]
                if s + initial in ("s", "u", "su", "ua", "au") and initial:
                    options.append((initial, cost + cut, "K"))
            for t, c, x in options:
                if t not in new or (c, letters + x) < new[t]:
                    new[t] = (c, letters + x)
        best = new
        relax(best)
    return min(best[s] for s in ("", "a") if s in best)


def random_takes(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def solved(takes, entry=None):
    run = chat_repair.Repairer(entry)
    return "".join([run.push(*t) for t in takes]) + run.finish()


def test_against_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        takes = random_takes(rng, rng.randint(0, 4))
        cost, letters = enumerate_edits(takes)
        assert plain_best(takes) == (cost, letters)
        assert solved(takes) == letters


def test_long_runs_hold_unresolved_rows_only():
    rng = random.Random(2)
    takes = random_takes(rng, 4000)
    run, most, out = chat_repair.Repairer(), 0, ""
    for t in takes:
        out += run.push(*t)
        most = max(most, run.alive)
    assert out + run.finish() == plain_best(takes)[1]
    assert most < 120  # nodes of the back-pointer tree, of 4,000 rows with up to four survivors each


def test_runs_cut_into_pieces():
    rng = random.Random(3)
    for _ in range(120):
        takes = random_takes(rng, rng.randint(2, 14))
        cuts = sorted({0, len(takes), *[rng.randint(1, len(takes) - 1) for _ in range(rng.randint(1, 4))]})
        pieces = [takes[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        states = chat_repair._join_runs([chat_repair._summary(p) for p in pieces])
        letters = ""
        for piece, (entry, leave) in zip(pieces, states):
            run = chat_repair.Repairer(entry)
            letters += "".join([run.push(*t) for t in piece]) + run.finish(leave)
        assert letters == plain_best(takes)[1]


def by_contract(rows):
    """The contract's result of one conversation's rows (turn, role, text), read row by row."""
    out = []
    for turn, role, text in rows:
        fate = zlib.crc32(f"{by_contract.conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, takes, faults = set(), [], []
    for _, role, text in out:
        trimmed = text.rstrip(SPACE)
        fault = "blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
        takes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, letters = plain_best(takes)
    lines, state, waiting = [], "", list(out)
    for x in letters:
        wanted = "assistant" if state == "u" else "user"
        role, text = (None, "") if x == "I" else waiting.pop(0)[1:]
        if x != "D":
            role = role if x == "K" else wanted
            state = role[:1]
            lines.append(f"{role}:{text}")
    turns = [t for t, _, _ in out if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(out, out[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in chat_repair.FAULTS], sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def contract(rows):
    chats = {}
    for r in rows:
        chats.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    out = {}
    for conv, turns in chats.items():
        by_contract.conv = " " if conv is None else conv
        out[conv] = by_contract(turns)
    return out


def result(df):
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r)[1:9] for r in rows}


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_query_follows_the_contract(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    assert result(queries.op11_chat_repair(spark, folder)) == contract(rows)


def test_odd_rows_and_a_hot_conversation(spark):
    rng = random.Random(4)
    texts = ["Hi.", "So?", "no end", "", " \n", "Ünï!", "again.", "x" * 3000]
    schema = "conv_id long, turn long, role string, text string, part string, cost string, c string"
    rows = [Row(conv_id=rng.choice([None, *range(12)]), turn=rng.choice([None, *range(9)]), role=rng.choice([None, "user", "assistant", "system", "tool", ""]), text=rng.choice([None, *texts]), part="p", cost="c", c="c") for _ in range(250)]
    rows += [Row(conv_id=99, turn=rng.choice([None, 5, *range(400)]), role=rng.choice(["user", "assistant", "user", "x"]), text=rng.choice([*texts, f"say {i}.", f"say {i}"]), part="p", cost="c", c="c") for i in range(1500)]
    rows += [rows[-1]] * 300  # equal rows are one with a count
    chats = spark.createDataFrame(rows, schema)
    out = chat_repair.report(chats, chat_repair.repair(chat_repair.damage(chats)))
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in out.collect()}
    assert got == contract(rows)


def test_empty_tables_and_conversations_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert chat_repair.report(none, chat_repair.repair(none)).collect() == []
    chats = spark.createDataFrame([(1, 0, "user", "Hi.")], schema)
    row = chat_repair.report(chats, chat_repair.repair(chats.limit(0))).first()
    assert (row["gaps"], row["cost"], row["audit"], row["repaired_sha256"]) == (0, 0, "", hashlib.sha256(b"").hexdigest())
