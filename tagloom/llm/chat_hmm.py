"""Chat formatting: a hidden Markov model recovers the roles of a raw transcript, which is then rendered in canonical turns.

A transcript is the pieces of a conversation in order; a piece has one or more
lines. A hidden state is a role and whether the line begins a turn of that role
or continues it. What is seen of a line: its opening (whether it starts a piece,
and which speaker its marker names, if it has one), its length, how it ends, what
kind of line it is, and whether the conversation starts there. Transition and
emission tables are counted over all labelled pieces that learning may use and
mixed with fixed priors, so that markers count even where the labelled text has
none. Viterbi decoding gives the roles; markers are dropped and every turn is
written as ``<|im_start|>role``, its text, ``<|im_end|>``.

Scale: pieces are range-partitioned by conversation and order, so a conversation
of any length is spread over tasks, and the layout is checkpointed in the shared
folder. A first pass gives, for the first and last conversation of each
partition, the best score from every state to every state; these few numbers a
partition are joined up on the driver, which fixes the states at partition
borders; a second pass decodes every partition between its borders. The path is
the one a single Viterbi pass would take (but for ties).

Defined results: a null or empty text is one empty line; pieces of a null
conversation id form one conversation; a null order comes first; equal orders
are ordered by the digest of their text; repeated pieces are turns of their own.
Without labelled pieces every piece is of the role ``user``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import ref
from tagloom.session import ensure_checkpoint_dir

# Names that speakers go by in transcripts.
SPEAKERS = {
    "user": ("user", "human", "you", "customer", "q", "question", "prompter"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "gpt", "a", "answer", "response"),
    "system": ("system", "sys", "instruction", "instructions", "context"),
}
DEFAULT_ROLE = "user"
#: share of the priors in every table
PRIOR = 0.05

_MARKER = re.compile(r"^\s*(?:[#>*\[(<|]{1,4}\s*)?([A-Za-z]{1,12})(?:\s*[\])>*|]{1,4}\s*:?|\s*:)\s*(?:\*\*)?")
_NAMED = {name: role for role, names in SPEAKERS.items() for name in names}
_LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s")

#: features of a line and how many values each has; the opening comes first
OPENINGS = ["none", *SPEAKERS]
SIZES = (2 * len(OPENINGS), 12, 5, 5, 2)


def marker_of(line: str) -> tuple[str, int]:
    """The role that a speaker marker at the start of the line names ("none" without one), and where the text after it begins."""
    found = _MARKER.match(line)
    role = _NAMED.get(found[1].lower(), "none") if found else "none"
    return role, found.end() if role != "none" else 0


def line_features(line: str, starts_piece: bool, starts_conversation: bool) -> tuple[int, ...]:
    role, at = marker_of(line)
    text = line[at:].strip()
    end = 0 if not text else 1 if text[-1] in "?¿" else 2 if text[-1] in ".!…" else 3 if text[-1] in ":;," else 4
    kind = 0 if not text else 1 if text.startswith("```") else 2 if _LIST.match(line) else 3 if text[0].isupper() else 4
    return len(OPENINGS) * starts_piece + OPENINGS.index(role), min(11, len(text).bit_length()), end, kind, int(starts_conversation)


class ChatModel:
    """Roles and the logarithms of the tables; state 2r begins a turn of role r, state 2r + 1 continues it."""

    def __init__(self, roles: list[str], moves: np.ndarray, seen: list[np.ndarray]):
        self.roles = roles or [DEFAULT_ROLE]
        n = 2 * len(self.roles)
        moves = moves if len(moves) else np.zeros((n + 1, n))
        seen = seen or [np.zeros((n, k)) for k in SIZES]
        begin = np.arange(n) % 2 == 0
        # priors: a conversation opens with the beginning of a turn; only the same role's turn can be continued
        first = np.where(begin, 1.0, 1e-9)
        move = np.where(begin, 1.0, 0.0)[None, :] + np.eye(n) * ~begin + np.eye(n, k=1) * begin[:, None]
        allowed = move > 0
        self.start = self._mixed(moves[:1], first[None])[0]
        self.moves = np.where(allowed, self._mixed(moves[1:], move), -1e9)
        openings = np.zeros((n, SIZES[0]))
        for state in range(n):
            named = OPENINGS.index(self.roles[state // 2]) if self.roles[state // 2] in OPENINGS else 0
            if state % 2:
                openings[state, 0], openings[state, 1:] = 1.0, 1e-4
            else:
                openings[state] = 1e-3
                openings[state, [named, len(OPENINGS) + named]] += 1.0
                openings[state, len(OPENINGS)] += 1.0
        priors = [openings] + [np.ones((n, k)) for k in SIZES[1:]]
        self.emit = [self._mixed(c, p) for c, p in zip(seen, priors)]

    @staticmethod
    def _mixed(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
        prior = prior / prior.sum(axis=1, keepdims=True)
        total = counts.sum(axis=1, keepdims=True)
        learned = np.where(total > 0, counts / np.maximum(total, 1), prior)
        return np.log(np.maximum((1 - PRIOR) * learned + PRIOR * prior, 1e-300))

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Log emission scores, lines x states."""
        return sum(table[:, features[:, i]].T for i, table in enumerate(self.emit))


def viterbi(scores: np.ndarray, entry: np.ndarray, moves: np.ndarray, last: int | None = None) -> np.ndarray:
    """Best states; ``entry`` scores the first line's states, ``last`` fixes the last line's state."""
    back = np.zeros(scores.shape, np.int64)
    best = entry + scores[0]
    for t in range(1, len(scores)):
        options = best[:, None] + moves
        back[t] = options.argmax(axis=0)
        best = options[back[t], np.arange(len(best))] + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = int(best.argmax()) if last is None else last
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def _transfer(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best score from each state of the line before to each state of the last line."""
    best = moves + scores[0][None, :]
    for row in scores[1:]:
        best = (best[:, :, None] + moves[None]).max(axis=1) + row[None, :]
    return best


def lay_out(df: DataFrame, *, conv_col: str, order_col: str, text_col: str, role_col: str | None, trusted: Column | None) -> DataFrame:
    """Pieces in order, spread over partitions whatever a conversation's length, checkpointed in the shared folder."""
    label = F.lit(None).cast("string") if role_col is None else ref(role_col)
    label = label if trusted is None else F.when(trusted, label)
    rows = df.select(ref(conv_col).alias("conv"), ref(order_col).alias("order"), F.coalesce(ref(text_col), F.lit("")).alias("text"), label.alias("label"))
    rows = rows.withColumn("tie", F.xxhash64("text", "label"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "order", "tie")]
    ensure_checkpoint_dir(df.sparkSession)
    # a number of partitions of its own, so that pieces stay spread when AQE would join small ones
    return rows.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys).sortWithinPartitions(*keys).checkpoint()


def _conversations(batches):
    """Runs of pieces of one conversation in one partition: id and lists of orders, texts and labels."""
    held, at = None, None
    for batch in batches:
        convs, orders, texts, labels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "order", "text", "label"))
        for row in zip(convs, orders, texts, labels):
            if held is None or row[0] != at:
                if held is not None:
                    yield at, held
                at, held = row[0], ([], [], [])
            for values, value in zip(held, row[1:]):
                values.append(value)
    if held is not None:
        yield at, held


def _lines(texts: list[str], opens: bool) -> tuple[np.ndarray, list[list[str]]]:
    split = [t.split("\n") for t in texts]
    features = [line_features(line, j == 0, opens and i == 0 and j == 0) for i, lines in enumerate(split) for j, line in enumerate(lines)]
    return np.array(features, np.int64).reshape(-1, len(SIZES)), split


def _first_keys(laid: DataFrame) -> dict[int, tuple]:
    """For each partition with pieces whether it opens in the conversation that the one before ends in."""

    def ends(batches):
        first = last = None
        for batch in batches:
            if batch.num_rows:
                convs = batch.column(0)
                first = convs[0] if first is None else first
                last = convs[batch.num_rows - 1]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first.as_py()], first.type), pa.array([last.as_py()], last.type)], names=["part", "first", "last"])

    kind = laid.schema["conv"].dataType
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("first", kind), T.StructField("last", kind)])
    rows = sorted(laid.select("conv").mapInArrow(ends, schema).collect(), key=lambda r: r["part"])  # two ids a partition
    out, before = {}, None
    for i, r in enumerate(rows):
        after = rows[i + 1] if i + 1 < len(rows) else None
        out[r["part"]] = (before is not None and before["last"] == r["first"], after is not None and after["first"] == r["last"])
        before = r
    return out


def learn(laid: DataFrame, edges: dict[int, tuple]) -> ChatModel:
    """Tables counted over all labelled pieces; the partitions' counts are added in Spark and only the tables reach the driver.

    The first line of a partition that continues a conversation is counted as
    continuing one, without the move that leads into it.
    """
    roles = [r[0] for r in laid.where("label is not null").groupBy("label").count().orderBy("label").select("label").collect()]
    if not roles:
        return ChatModel([], np.zeros((0, 0)), [])
    number = {r: i for i, r in enumerate(roles)}

    def count(batches):
        tables: dict[tuple, int] = {}
        opens = not edges.get(TaskContext.get().partitionId(), (False, False))[0]
        for _, (_, texts, labels) in _conversations(batches):
            features, split = _lines(texts, opens)
            at, before = 0, -1 if opens else None
            for label, lines in zip(labels, split):
                for j in range(len(lines)):
                    if label is None:
                        before = None
                    else:
                        state = 2 * number[label] + (j > 0)
                        if before is not None:
                            tables[("m", before + 1, state)] = tables.get(("m", before + 1, state), 0) + 1
                        for i, value in enumerate(features[at]):
                            key = (str(i), state, int(value))
                            tables[key] = tables.get(key, 0) + 1
                        before = state
                    at += 1
            opens = True
        rows = list(tables.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0][0] for r in rows], pa.string()), *(pa.array([r[0][i] for r in rows], pa.int64()) for i in (1, 2)), pa.array([r[1] for r in rows], pa.int64())], names=["name", "i", "j", "n"])

    n = 2 * len(roles)
    moves, seen = np.zeros((n + 1, n)), [np.zeros((n, k)) for k in SIZES]
    for r in laid.mapInArrow(count, "name string, i long, j long, n long").groupBy("name", "i", "j").agg(F.sum("n").alias("n")).collect():
        table = moves if r["name"] == "m" else seen[int(r["name"])]
        table[r["i"], r["j"]] = r["n"]
    return ChatModel(roles, moves, seen)


def _borders(laid: DataFrame, edges: dict[int, tuple], model: ChatModel) -> dict[int, tuple]:
    """State before the first and at the last line of each partition, where its conversation goes on beyond."""
    crossing = {p for p, (a, b) in edges.items() if a or b}
    if not crossing:
        return {}

    def transfers(batches):
        part = TaskContext.get().partitionId()
        if part not in crossing:
            return
        into, beyond = edges[part]
        rows, final = [], None
        for i, (_, (_, texts, _)) in enumerate(_conversations(batches)):
            if i == 0 and into:
                rows.append(_transfer(model.scores(_lines(texts, False)[0]), model.moves))
            final = texts if i or not into else None
        if beyond and final:
            scores = model.scores(_lines(final, True)[0])
            first = np.full(model.moves.shape, -1e18)
            first[:, :] = model.start + scores[0]  # whatever the line before
            rows.append(first if len(scores) == 1 else (first[:, :, None] + _transfer(scores[1:], model.moves)[None]).max(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([x.ravel().tolist() for x in rows], pa.list_(pa.float64()))], names=["part", "run", "best"])

    n = 2 * len(model.roles)
    got: dict[int, list] = {}
    for r in sorted(laid.mapInArrow(transfers, "part long, run long, best array<double>").collect(), key=lambda r: (r["part"], r["run"])):
        got.setdefault(r["part"], []).append(np.array(r["best"]).reshape(n, n))
    borders: dict[int, tuple] = {}
    chain: list[int] = []
    for part in sorted(edges):
        if part not in crossing:
            continue
        into, beyond = edges[part]
        if into:
            chain.append(part)
            if not (beyond and len(got[part]) == 1):  # the conversation ends here
                _settle(chain, got, borders)
                chain = [part] if beyond else []
        else:
            chain = [part]
    return borders


def _settle(chain: list[int], got: dict[int, list], borders: dict[int, tuple]) -> None:
    """Viterbi over the partitions that one conversation runs through: its last run in the first, its first run in the others."""
    score, steps = got[chain[0]][-1][0], []
    for part in chain[1:]:
        options = score[:, None] + got[part][0]
        steps.append(options.argmax(axis=0))
        score = options.max(axis=0)
    state = int(score.argmax())
    for part, step in zip(chain[:0:-1], steps[::-1]):
        before = int(step[state])
        borders[part] = (before, state, *borders.get(part, (None,) * 3)[2:]) if part in borders else (before, state, None)
        state = before
    old = borders.get(chain[0], (None, None, None))
    borders[chain[0]] = (old[0], old[1], state)


def format_chats(df: DataFrame, *, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text", role_col: str | None = "role", trusted: Column | None = None, model: ChatModel | None = None) -> DataFrame:
    """One row a piece: conversation, order, role of its first line, roles of the turns that begin in it, and its rendered text.

    Rendered texts joined in the order of conversation, order and text digest are
    the canonical transcript. ``role_col`` of ``trusted`` rows is read for
    learning only, and not at all if a ``model`` is given.
    """
    laid = lay_out(df, conv_col=conv_col, order_col=order_col, text_col=text_col, role_col=None if model else role_col, trusted=trusted)
    edges = _first_keys(laid)
    model = model or learn(laid, edges)
    borders = _borders(laid, edges, model)
    new = [("role_pred", T.StringType()), ("roles", T.ArrayType(T.StringType())), ("rendered", T.StringType())]
    schema = T.StructType([T.StructField(conv_col, laid.schema["conv"].dataType), T.StructField(order_col, laid.schema["order"].dataType)] + [T.StructField(*f) for f in new])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def written(conv, pieces, opens, closes, entry, end):
        orders, texts, _ = pieces
        features, split = _lines(texts, opens)
        path = viterbi(model.scores(features), entry, model.moves, end).tolist()
        rows, at, begun = [], 0, not opens
        for order, lines in zip(orders, split):
            out, roles, states = [], [], path[at : at + len(lines)]
            for line, state in zip(lines, states):
                if state % 2:
                    out.append(line)
                    continue
                roles.append(model.roles[state // 2])
                out.append(("<|im_end|>\n" if begun else "") + f"<|im_start|>{roles[-1]}\n" + line[marker_of(line)[1] :])
                begun = True
            rows.append((conv, order, model.roles[states[0] // 2], roles, "\n".join(out) + "\n"))
            at += len(lines)
        if closes:
            rows[-1] = (*rows[-1][:4], rows[-1][4] + "<|im_end|>\n")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[f.name for f in schema.fields])

    def run(batches):
        part = TaskContext.get().partitionId()
        into, beyond = edges.get(part, (False, False))
        before, first_end, last_end = borders.get(part, (None, None, None))
        held, first = None, True
        for found in _conversations(batches):
            if held is not None:
                yield written(*held, not (first and into), True, model.moves[before] if first and into else model.start, first_end if first and into else None)
                first = False
            held = found
        if held is not None and first and into:
            yield written(*held, False, not beyond, model.moves[before], first_end)
        elif held is not None:
            yield written(*held, True, not beyond, model.start, last_end if beyond else None)

    return laid.mapInArrow(run, schema)
