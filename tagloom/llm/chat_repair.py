"""Conversation structure repair by a survivor-coalescence Viterbi.

A conversation is legal if the initials of its roles are ``(s?(ua)+)?``. Edits:
keep a row (``K``, 0), give it the role user or assistant (``R``, 2), delete it
(``D``, 3; a blank or duplicate row must go), insert an empty turn (``I``, 2); a
truncated row that stays adds 1. The cheapest edits are found, of equally cheap
ones those whose letters, in order, are least in ASCII.

``Repairer`` takes the rows one by one. It keeps, for each of four states of the
grammar, the best edits so far as a node of a tree of back pointers. A node counts
what hangs on it and goes when nothing does, and as soon as all survivors share an
ancestor the letters above it are final and leave, so memory holds the unresolved
rows only. Ties compare the survivors' complete unresolved letters, back to where
they part. (Two equally cheap survivors of one state are never a prefix of each
other: they have consumed the same rows, so one would end in further inserts, which
cost.)

Rows are spread over range partitions in order, whatever a conversation's length.
For the runs that touch an edge of their partition a first pass sends the cheapest
cost and the order of the letters for every state before and after the run: a few
numbers a partition, from which the states at the edges follow. Then all
partitions repair their runs at once.

Results: nulls of role and text count as one space; a null conversation id is a
conversation; rows go by turn, nulls first, ties by role, then by the MD5 of the
text, so that equal rows are one row with a count until the last pass; a
conversation without rows has no edits; an empty table gives an empty one; other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import ref
from tagloom.session import ensure_checkpoint_dir

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: states of the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: the state that a role's initial leads to
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the initial of a turn that may be inserted, or a row's new role, in each state
WANTED = {EMPTY: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
FINAL = (EMPTY, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")


class _Node:
    __slots__ = ("parent", "letter", "depth", "below")

    def __init__(self, parent: _Node | None, letter: str):
        self.parent, self.letter, self.below = parent, letter, 0
        self.depth = parent.depth + 1 if parent else 0


class Repairer:
    """Cheapest edits of one run of rows; ``entry`` is the state before it, None at the start of a conversation."""

    def __init__(self, entry: int | None = None):
        self.root = _Node(None, "")
        self.best: dict[int, tuple[int, _Node]] = {EMPTY if entry is None else entry: (0, self.root)}
        self.root.below = 1
        self.alive = 1
        if entry is None:
            self._insert()

    # a node's count is that of its children and of the states whose survivor it is

    def _child(self, parent: _Node, letter: str) -> _Node:
        parent.below += 1
        self.alive += 1
        return _Node(parent, letter)

    def _release(self, node: _Node | None) -> None:
        node.below -= 1
        while node.below == 0 and node is not self.root:
            self.alive -= 1
            node = node.parent
            node.below -= 1

    @staticmethod
    def _letters(a: _Node, b: _Node) -> tuple[str, str]:
        """The letters of both since they parted."""
        la, lb = [], []
        while a is not b:
            deeper = a.depth - b.depth
            if deeper >= 0:
                la.append(a.letter)
                a = a.parent
            if deeper <= 0:
                lb.append(b.letter)
                b = b.parent
        return "".join(reversed(la)), "".join(reversed(lb))

    def _less(self, cost: int, parent: _Node, letter: str, held: tuple[int, _Node, str]) -> bool:
        if cost != held[0]:
            return cost < held[0]
        mine, other = self._letters(parent, held[1])
        return mine + letter < other + held[2]

    def _insert(self) -> None:
        """Turns may be inserted here: at most two, as a third comes back to a state for a price."""
        for _ in range(2):
            for state in list(self.best):
                target = NEXT[state, WANTED[state]]
                (cost, node), held = self.best[state], self.best.get(target)
                if held is None or self._less(cost + INSERT, node, "I", (*held, "")):
                    child = self._child(node, "I")
                    child.below = 1
                    self.best[target] = (cost + INSERT, child)
                    if held:
                        self._release(held[1])

    def push(self, initial: str, must_go: bool, truncated: bool) -> str:
        """Take one row; the letters that became final with it."""
        found: dict[int, tuple[int, _Node, str]] = {}

        def offer(target: int, cost: int, node: _Node, letter: str) -> None:
            if target not in found or self._less(cost, node, letter, found[target]):
                found[target] = (cost, node, letter)

        for state, (cost, node) in self.best.items():
            offer(state, cost + DELETE, node, "D")
            if must_go:
                continue
            if (state, initial) in NEXT:
                offer(NEXT[state, initial], cost + KEEP + TRUNCATED * truncated, node, "K")
            if initial != WANTED[state]:
                offer(NEXT[state, WANTED[state]], cost + REROLE + TRUNCATED * truncated, node, "R")
        old = [node for _, node in self.best.values()]
        self.best = {}
        for state, (cost, node, letter) in found.items():
            child = self._child(node, letter)
            child.below = 1
            self.best[state] = (cost, child)
        for node in old:
            self._release(node)
        self._insert()
        self._prune()
        return self._settled()

    def _prune(self) -> None:
        """Drop survivors that can only lose: what follows the states without a user turn can as well follow an assistant
        turn, where at most one system turn more has to go. Without this the edits that delete all would never part with."""
        if ASSISTANT in self.best:
            least = self.best[ASSISTANT][0]
            for state, more in ((EMPTY, DELETE), (SYSTEM, 0)):
                if state in self.best and self.best[state][0] > least + more:
                    self._release(self.best.pop(state)[1])

    def _settled(self) -> str:
        """Letters above the point where the survivors part; the root moves there."""
        if self.root.below != 1:
            return ""
        path = [min(self.best.values(), key=lambda s: s[1].depth)[1]]
        while path[-1].parent is not self.root:
            path.append(path[-1].parent)
        letters = []
        # the root has one child; go on while a node has one child and is no survivor
        survivors = {id(node) for _, node in self.best.values()}
        while path and self.root.below == 1 and id(self.root) not in survivors:
            self.root = path.pop()
            self.root.parent = None
            letters.append(self.root.letter)
            self.alive -= 1
        return "".join(letters)

    def ends(self) -> dict[int, tuple[int, str]]:
        """Cost and unresolved letters of every state's survivor."""
        return {state: (cost, self._letters(node, self.root)[0]) for state, (cost, node) in self.best.items()}

    def finish(self, exit_state: int | None = None) -> str:
        """The rest of the letters, to ``exit_state`` or to the better of the final states."""
        ends = self.ends()
        return ends[exit_state][1] if exit_state is not None else min(ends[s] for s in FINAL if s in ends)[1]


# --- rows ---------------------------------------------------------------------------

def damage(df: DataFrame) -> DataFrame:
    """The conversations with the faults that the contract plants by ``crc32(conv_id:turn) % 20``."""
    text = lambda c: F.coalesce(ref(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = df.select(ref("conv_id").alias("conv_id"), ref("turn").alias("turn"), text("role").alias("role"), text("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    new_text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), new_text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def lay_out(df: DataFrame) -> DataFrame:
    """Distinct rows in order with their count and fault, spread over partitions, checkpointed in the shared folder."""
    spark = df.sparkSession
    text = lambda c: F.coalesce(ref(c).cast("string"), F.lit(" "))
    rows = df.select(ref("conv_id").alias("conv"), ref("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    again = rows.groupBy("conv", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("nulls")).where("n > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first", "nulls")
    rows = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(F.col("turn").isNotNull() & (F.col("nulls") | (F.col("turn") > F.col("first"))), F.lit(False))
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(trimmed == "", FAULTS[0]).when(later, FAULTS[1]).when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), FAULTS[2])
    rows = rows.select("conv", "turn", "role", "text", "copies", "digest", fault.alias("fault"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "digest")]
    ensure_checkpoint_dir(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).checkpoint()


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names])


def _takes(role: str, fault: str | None, copies: int) -> Iterator[tuple[str, bool, bool]]:
    """What ``Repairer.push`` takes for a row and its repetitions, which are duplicates if it is not blank."""
    yield role[:1], fault in FAULTS[:2], fault == FAULTS[2]
    for _ in range(copies - 1):
        yield role[:1], True, False


def _summary(takes: list[tuple[str, bool, bool]]) -> list[list]:
    """[entry, inserts before, exit, cost, order of the letters without the inserts at their end, number of these]."""
    found = []
    for entry in (None, EMPTY, SYSTEM, USER, ASSISTANT):
        run = Repairer(entry)
        settled = "".join([run.push(*t) for t in takes])
        for state, (cost, rest) in run.ends().items():
            for inserts in range(3):
                letters = "I" * inserts + settled + rest
                base = letters.rstrip("I")
                found.append([-1 if entry is None else entry, inserts, state, cost, base, len(letters) - len(base)])
    order = {base: i for i, base in enumerate(sorted({f[4] for f in found}))}
    return [[*f[:4], order[f[4]], f[5]] for f in found]


def _edges(laid: DataFrame) -> list[dict]:
    """For each partition with rows its first and last conversation, last initial, and the summaries of both runs."""
    kind = laid.schema["conv"].dataType
    schema = T.StructType([
        T.StructField("part", T.LongType()), T.StructField("first", kind), T.StructField("last", kind), T.StructField("runs", T.LongType()), T.StructField("initial", T.StringType()),
        *[T.StructField(c, T.ArrayType(T.ArrayType(T.LongType()))) for c in ("opening", "closing")],
    ])

    def run(batches):
        held, first, at, runs, role = [], None, None, 0, ""
        for conv, role, fault, copies in _rows(batches, ["conv", "role", "fault", "copies"]):
            if not runs or conv != at:
                if runs == 1:
                    first = (at, held)
                at, held, runs = conv, [], runs + 1
            held.extend(_takes(role, fault, copies))
        if not runs:
            return
        first = first or (at, held)
        opening, closing = _summary(first[1]), _summary(held) if runs > 1 else None
        values = [TaskContext.get().partitionId(), first[0], at, runs, role[:1], opening, closing]
        yield pa.RecordBatch.from_arrays([pa.array([v], to_arrow_type(f.dataType)) for v, f in zip(values, schema.fields)], names=schema.names)

    return sorted((r.asDict() for r in laid.select("conv", "role", "fault", "copies").mapInArrow(run, schema).collect()), key=lambda r: r["part"])


def _join_runs(pieces: list[list[list]]) -> list[tuple[int | None, int | None]]:
    """State before and after each piece of one conversation on its cheapest, then least, edits.

    Survivors are compared by what the pieces before decided (``grade``, equal if
    they differ in inserts at the end only) and by the order within the piece.
    """
    # by state: cost, grade, inserts at the end, the states passed
    best = {-1: (0, 0, 0, [])}
    for piece in pieces:
        found: dict[int, tuple] = {}
        for entry, inserts, state, cost, order, tail in piece:
            if entry not in best or best[entry][2] != inserts:
                continue
            before, grade, _, path = best[entry]
            mine = (before + cost, (grade, order), tail, [*path, (entry, state)])
            if state not in found or mine[:3] < found[state][:3]:
                found[state] = mine
        grades = {g: i for i, g in enumerate(sorted({f[1] for f in found.values()}))}
        best = {state: (cost, grades[g], tail, path) for state, (cost, g, tail, path) in found.items()}
    path = min(best[s] for s in FINAL if s in best)[3]
    return [(None if e < 0 else e, s) for e, s in path[:-1]] + [(None if path[-1][0] < 0 else path[-1][0], None)]


def _edge_states(edges: list[dict]) -> dict[int, dict]:
    """For each partition: states before its first run, after its last, and the initial before it, where conversations go on."""
    out = {e["part"]: {} for e in edges}
    i = 0
    while i < len(edges):
        # the partitions over which the conversation that ends partition i goes on
        j = i
        while j + 1 < len(edges) and edges[j + 1]["first"] == edges[i]["last"] and (j == i or edges[j]["runs"] == 1):
            j += 1
        if j > i:
            pieces = [edges[i]["closing"] or edges[i]["opening"], *[edges[k]["opening"] for k in range(i + 1, j + 1)]]
            for k, (entry, leave) in zip(range(i, j + 1), _join_runs(pieces)):
                if k > i:
                    out[edges[k]["part"]] |= {"entry": entry, "before": edges[k - 1]["initial"]}
                if k < j:
                    out[edges[k]["part"]]["exit"] = leave
        i = max(j, i + 1)
    return out


def repair(df: DataFrame) -> DataFrame:
    """One row an edit of ``conv_id, turn, role, text``, ordered by (``part``, ``seq``) within a conversation.

    ``edit`` K, R, D or I; ``role`` and ``text`` after the edit (null if deleted);
    ``cost``; ``fault`` of the row; ``illegal``: the row's initial may not follow
    that of the row before it. Runs its first pass while the plan is built.
    """
    laid = lay_out(df)
    states = _edge_states(_edges(laid))
    kind = laid.schema["conv"].dataType
    schema = T.StructType([
        T.StructField("conv_id", kind), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("edit", T.StringType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("fault", T.StringType()), T.StructField("illegal", T.BooleanType()),
    ])
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches):
        part = TaskContext.get().partitionId()
        edge = states.get(part, {})
        out: list[tuple] = []
        seq = 0

        def apply(letters: str, waiting: deque, state: int) -> int:
            """Edits of final letters on the rows that wait for them."""
            nonlocal seq
            for letter in letters:
                turn = fault = None
                role, text, cost, illegal = ROLES[WANTED[state]], "", INSERT, False
                if letter != "I":
                    turn, old, text, fault, illegal = waiting.popleft()
                    cost = {"K": KEEP, "R": REROLE, "D": DELETE}[letter] + (TRUNCATED if fault == FAULTS[2] and letter != "D" else 0)
                    role = old if letter == "K" else role
                if letter == "D":
                    role = text = None
                else:
                    state = NEXT[state, role[:1]]
                out.append((at, part, seq, turn, letter, role, text, cost, fault, illegal))
                seq += 1
            return state

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=schema.names)
            out.clear()
            return batch

        held, at, state, waiting, before = None, None, EMPTY, deque(), None
        for conv, turn, role, text, fault, copies in _rows(batches, ["conv", "turn", "role", "text", "fault", "copies"]):
            if held is None or conv != at:
                opening = held is None
                if held is not None:
                    apply(held.finish(), waiting, state)
                entry = edge.get("entry") if opening else None
                at, held, waiting, state = conv, Repairer(entry), deque(), EMPTY if entry is None else entry
                before = edge.get("before") if opening else None
            for i, take in enumerate(_takes(role, fault, copies)):
                kind_of = fault if not i else FAULTS[0] if fault == FAULTS[0] else FAULTS[1]
                waiting.append((turn, role, text, kind_of, before is not None and before + role[:1] not in ("su", "ua", "au")))
                before = role[:1]
                state = apply(held.push(*take), waiting, state)
            if len(out) >= 2000:
                yield flushed()
        if held is not None:
            apply(held.finish(edge.get("exit")), waiting, state)
        if out:
            yield flushed()

    return laid.select("conv", "turn", "role", "text", "fault", "copies").mapInArrow(run, schema)


def digests(edits: DataFrame) -> DataFrame:
    """SHA-256 of every conversation's repaired ``role:text`` lines, streamed in order: no conversation is gathered."""
    kind = edits.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("repaired_sha256", T.StringType())])
    rows = edits.where("edit <> 'D'").select("conv_id", "part", "seq", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches):
        ids, found, at, state = [], [], None, None
        for conv, line in _rows(batches, ["conv_id", "line"]):
            if state is None or conv != at:
                if state is not None:
                    ids.append(at)
                    found.append(state.hexdigest())
                at, state = conv, hashlib.sha256(line.encode())
            else:
                state.update(b"\n" + line.encode())
        if state is not None:
            ids.append(at)
            found.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, to_arrow_type(kind)), pa.array(found, pa.string())], names=schema.names)

    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq").select("conv_id", "line").mapInArrow(run, schema)


def report(conversations: DataFrame, edits: DataFrame) -> DataFrame:
    """One row a conversation of ``conversations``: faults, cost, letters and digest of its edits."""
    kept = edits.where("edit <> 'I'")
    pieces = edits.groupBy("conv_id", "part").agg(
        F.sum("cost").alias("cost"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS],
        F.count_if("illegal").alias("illegal"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "edit"))), lambda x: x["edit"]), "").alias("audit"),
    )
    sums = ["cost", *FAULTS, "illegal"]
    found = pieces.groupBy(F.col("conv_id").alias("c")).agg(*[F.sum(c).alias(c) for c in sums], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    turns = kept.groupBy(F.col("conv_id").alias("g")).agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ids = conversations.select(ref("conv_id").alias("conv_id")).distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left").join(turns, F.col("conv_id").eqNullSafe(F.col("g")), "left")
    hashes = digests(edits).select(F.col("conv_id").alias("h"), "repaired_sha256")
    out = out.join(hashes, F.col("conv_id").eqNullSafe(F.col("h")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", zero("gaps"), *[zero(f) for f in FAULTS], zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
