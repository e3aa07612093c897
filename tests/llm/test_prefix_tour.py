"""Operator 12 against a trie built in memory."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import Row

from tagloom.llm import prefix_tour, queries
from tests.conftest import SF001, SF01


def by_contract(rows):
    chats = {}
    for r in rows:
        if r["conv_id"] is not None:
            chats.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    for c, turns in chats.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest()))
        chats[c] = [t[1:] for t in turns]
    rebuilt = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(chats.get(c - c % 5, [])[:h] + own[h:])
    members = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    out = []

    def below(seq):
        found = [below(k) for k in children.get(seq, [])]
        leaves = sum(f[0] for f in found) or 1
        saved = sum(f[1] for f in found) + ((len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[seq] if len(rebuilt[c]) == len(seq)))
        out.append((min(members[seq]), len(seq), min(members[seq[:-1]]) if seq else None, len(members[seq]), len(found), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return sorted(out)


def result(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("folder", [SF001, SF01])
def test_query_equals_a_trie_in_memory(spark, folder):
    assert result(queries.op12_prefix_tour(spark, folder)) == by_contract(spark.read.parquet(f"{folder}/conversations.parquet").collect())


def as_result(spark, rows, schema, tmp_path):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    return result(queries.op12_prefix_tour(spark, str(tmp_path)))


SCHEMA = "conv_id long, turn long, role string, text string, owner string, depth string, pos string"


def test_nulls_ties_copies_and_a_long_conversation(spark, tmp_path):
    rng = random.Random(7)
    extra = {"owner": "o", "depth": "d", "pos": "p"}
    rows = [Row(conv_id=rng.choice([None, *range(-3, 40)]), turn=rng.choice([None, *range(6)]), role=rng.choice([None, "user", "assistant"]), text=rng.choice([None, "", "a", "ä", "b"]), **extra) for _ in range(300)]
    rows += [Row(conv_id=100 + c, turn=t, role="user", text=f"common {t}", **extra) for c in range(60) for t in range(rng.choice([3, 12]))]
    rows += [Row(conv_id=500, turn=t, role="user", text=f"long {t % 7}", **extra) for t in range(900)]  # deeper than any chunk of the layout here
    assert as_result(spark, rows, SCHEMA, tmp_path) == by_contract(rows)


def test_turnless_conversations_and_empty_table(spark, tmp_path):
    # 7 and 8 take what conversation 5 lacks, and drop their own
    rows = [Row(conv_id=c, turn=0, role="user", text="hi", owner=None, depth=None, pos=None) for c in (7, 8, 12)]
    assert as_result(spark, rows, SCHEMA, tmp_path / "a") == by_contract(rows)
    assert as_result(spark, [], SCHEMA, tmp_path / "b") == []


def test_list_ranking_of_scattered_lists(spark):
    """Nothing local: every arc's successor lies elsewhere, so that all ranking is done by the joins."""
    n, rng = 400, random.Random(8)
    order = [(o, s) for o in range(n // 2) for s in range(2)]
    rng.shuffle(order)
    rows = [(*a, *(b or (None, None)), 1, i) for i, (a, b) in enumerate(zip(order, [*order[1:], None]))]
    df = spark.createDataFrame(rows, "owner long, slot long, to_owner long, to_slot long, leaf long, saving long")
    assert all(r["pos"] == r["saving"] for r in prefix_tour.rank(df).collect())
