"""Vector operators against brute force, chat formatting against one Viterbi pass, and the pipeline."""

from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tagloom.llm import chat_hmm, cosine_cells, queries, rotated_codes
from tests.conftest import SF001, SF01

ODD = [None, [], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], [1.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, -1.0], [1.0, 0.1], [1.0, 0.0, 0.0], [1e300, 1e300], [-0.0, 1e-300]]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rows = [Row(vec_id=i, embedding=v, label=1, node="n", key="k", id="i") for i, v in enumerate(ODD)]
    rows.append(rows[6])
    rows.append(Row(**(rows[6].asDict() | {"vec_id": None})))
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, key string, id string")


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_links(vectors, ids, threshold=0.9):
    n = len(vectors)
    good = [usable(v) and i is not None for v, i in zip(vectors, ids)]
    unit = [np.array(v) / np.abs(v).max() if g else None for v, g in zip(vectors, good)]
    links = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) >= threshold - 1e-12:
                links[i].append(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((ids[i], len(links[i]), min((ids[j] for j in seen if ids[j] is not None), default=None)))
    return out


def test_cells_on_odd_rows(odd_vectors):
    rows = odd_vectors.collect()
    want = Counter(brute_links([r.embedding for r in rows], [r.vec_id for r in rows]))
    got = cosine_cells.near_duplicates(odd_vectors).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert cosine_cells.near_duplicates(odd_vectors.limit(0)).count() == 0


def clustered(rng, n, dims):
    centres = rng.standard_normal((n // 20, dims))
    rows = centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, dims)) * rng.choice([0.05, 0.25, 1.0], (n, 1))
    rows[: n // 10] = rows[0] + rng.standard_normal((n // 10, dims)) * 0.1
    rows[n // 10 : n // 8] = rows[1]
    return rows


def test_cells_equal_brute_force_with_many_cells_and_blocks(spark):
    rng = np.random.default_rng(2)
    vectors = clustered(rng, 900, 24)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = {i: (n, c) for i, n, c in brute_links(vectors.tolist(), list(range(len(vectors))))}
    got = {r.vec_id: (r.n_links, r.component_id) for r in cosine_cells.near_duplicates(rows, cell_rows=40, block_rows=16).collect()}
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    exact = {r.vec_id: (r.n_links, r.component_id) for r in cosine_cells.near_duplicates(rows, cell_rows=40, block_rows=16, spread=1e9).collect()}
    assert exact == want


def brute_nearest(vectors, ids, is_query, k):
    out = {}
    for q, i in enumerate(ids):
        if i is not None and is_query(i) and usable(vectors[q]) and i not in out:
            scored = []
            for v, j in zip(vectors, ids):
                if j is not None and j != i and usable(v) and len(v) == len(vectors[q]):
                    total = 0.0
                    for x, y in zip(vectors[q], v):
                        total += x * y
                    scored.append((-total, j))
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_search_on_odd_rows(odd_vectors):
    rows = odd_vectors.collect()
    want = brute_nearest([r.embedding for r in rows], [r.vec_id for r in rows], lambda i: True, 3)
    got = {}
    for r in rotated_codes.search(odd_vectors, F.lit(True), k=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: n for q, n in want.items() if n}
    assert rotated_codes.search(odd_vectors.limit(0), F.lit(True)).count() == 0


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(clustered(rng, 1500, 16), 2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = brute_nearest(vectors.tolist(), list(range(len(vectors))), lambda i: i % 20 == 0, 20)
    found = rotated_codes.search(rows, F.col("id") % 20 == 0, block_rows=200).orderBy("query_id", "rank").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.999 * 20 * len(want) and sum(got[q] == want[q] for q in want) >= 0.98 * len(want)


def test_errors_stay_within_the_bounds():
    rng = np.random.default_rng(4)
    vectors, asked = rng.standard_normal((2000, 64)), rng.standard_normal((50, 64))
    codes = rotated_codes.Codes(vectors, vectors.mean(axis=0), [rotated_codes.rotation(64, i) for i in range(rotated_codes.ROTATIONS)])
    guess, by_query, by_vector = codes.estimate(asked)
    off = np.abs(guess - asked @ vectors.T) / (by_query[:, None] * by_vector)
    assert (off <= rotated_codes.ERROR_SPREAD).mean() > 0.99 and codes.bits[0].shape == (2000, 8)


# --- chats -----------------------------------------------------------------------


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, moves, entry = rng.standard_normal((6, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)

    def value(path):
        return entry[path[0]] + sum(scores[t, s] for t, s in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))

    assert tuple(chat_hmm.viterbi(scores, entry, moves)) == max(product(range(3), repeat=6), key=value)
    fixed = max((p for p in product(range(3), repeat=6) if p[-1] == 1), key=value)
    assert tuple(chat_hmm.viterbi(scores, entry, moves, 1)) == fixed


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_markers_give_the_roles_and_are_dropped(spark):
    raw = "User: hello there\nhow are you?\n\n### Assistant: fine.\n1. one\n- two\nHuman: and now\n[AI] bye"
    model = chat_hmm.ChatModel(["assistant", "system", "user"], np.zeros((0, 0)), [])
    out = chat_hmm.format_chats(chats(spark, [(1, 0, None, raw)]), model=model).first()
    assert out.roles == ["user", "assistant", "user", "assistant"] and out.role_pred == "user"
    assert out.rendered == "<|im_start|>user\nhello there\nhow are you?\n\n<|im_end|>\n<|im_start|>assistant\nfine.\n1. one\n- two\n<|im_end|>\n<|im_start|>user\nand now\n<|im_end|>\n<|im_start|>assistant\nbye\n<|im_end|>\n"


def test_held_out_roles_of_the_table(spark):
    table = spark.read.parquet(f"{SF01}/conversations.parquet")
    rows = queries.op4_chat_hmm(spark, SF01).join(table.select("conv_id", "turn", "role"), ["conv_id", "turn"]).collect()
    assert len(rows) == table.count()
    tested = [r for r in rows if r.held_out]
    assert len(tested) > 100 and np.mean([r.role == r.role_pred for r in tested]) >= 0.9


def one_pass(rows, model):
    """The whole conversation by one Viterbi pass."""
    features, split = chat_hmm._lines([r[3] or "" for r in rows], True)
    path = chat_hmm.viterbi(model.scores(features), model.start, model.moves)
    firsts = np.cumsum([0] + [len(s) for s in split])[:-1]
    return [model.roles[path[i] // 2] for i in firsts]


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_a_hot_conversation_over_many_partitions(spark, partitions):
    table = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn").collect()]
    hot = [(10_000, i, None, (r[3] or "") + ("\nAssistant: yes" if i % 5 == 0 else "")) for i, r in enumerate(table * 3)]
    rows = table + hot + [(20_000, 0, None, "end")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        laid = chat_hmm.lay_out(chats(spark, rows), conv_col="conv_id", order_col="turn", text_col="text", role_col="role", trusted=None)
        model = chat_hmm.learn(laid, chat_hmm._first_keys(laid))
        out = chat_hmm.format_chats(chats(spark, rows), model=model).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = [r.role_pred for r in sorted((r for r in out if r.conv_id == 10_000), key=lambda r: r.turn)]
    assert got == one_pass(hot, model) and len(out) == len(rows)
    text = "".join(r.rendered for r in sorted((r for r in out if r.conv_id == 10_000), key=lambda r: r.turn))
    assert text.startswith("<|im_start|>") and text.endswith("<|im_end|>\n") and text.count("<|im_start|>") == text.count("<|im_end|>")


def test_chats_on_odd_rows(spark):
    rows = [(None, 0, "user", "hi"), (None, None, None, None), (1, 1, "user", ""), (1, 1, "user", ""), (1, 1, "assistant", "a"), (2, 0, "tool", "x" * 100_000 + "\n" * 2000)]
    table = chats(spark, rows).withColumn("rendered", F.lit(1)).withColumn("label", F.lit("q"))
    out = chat_hmm.format_chats(table).collect()
    assert Counter((r.conv_id, r.turn) for r in out) == Counter(r[:2] for r in rows)
    assert {r.role_pred for r in chat_hmm.format_chats(table, role_col=None).collect()} == {"user"}
    assert chat_hmm.format_chats(table.limit(0)).count() == 0
