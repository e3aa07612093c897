"""Prefix trie of conversations by the Euler-tour technique.

1. **Turns.** Rows are laid out by (conversation, turn) in chunks cut by the data;
   a turn's place is its place in the chunk plus the rows of the chunks before.
   A conversation takes the first ``h`` turns of the first one of its family and
   then its own after the ``h``-th; both lengths are grouped counts.
2. **Names.** The name of a prefix of d turns is d and two exact sums over its
   turns of 64-bit hashes of (place, SHA-256 of the turn): prefix sums over the
   chunks, so a conversation of any length is spread. Equal names are one node;
   a node is known by its smallest member and its depth, as a conversation passes
   one node at a depth.
3. **Tour.** Every node has an enter and an exit arc. After an enter arc comes that
   of the first child or the own exit arc; after an exit arc the enter arc of the
   next sibling or the parent's exit arc. Children go by smallest member, and the
   next one comes from a lead within chunks of (parent, member) and from the chunk
   after.
4. **List ranking.** Arcs are dealt over parts by member. Inside a part chains are
   followed, so that only the arcs which a chain enters a part by remain; these are
   ranked by pointer doubling with Spark joins, in as many rounds as the logarithm
   of their number; then each part numbers its chains. Where nothing is local this
   is pointer doubling over all arcs, and still right.
5. **Sums.** With arcs numbered, leaves and savings are prefix sums over the tour in
   chunks of positions; a subtree's are those between its two arcs.

Results: a null role or text counts as empty; a row without a conversation id
belongs to none; turns go by turn (null first), ties by role, then by the SHA-256
of the turn; repeated rows are turns of their own; a family is five consecutive ids
from a multiple of five, below zero as well; an empty table has no root; other
columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import materialize, ref
from tagloom.operators.series import lay_out, series_spec

#: positions of the tour in a chunk of the prefix sums
CHUNK = 1 << 18
#: most turns a conversation takes from the first of its family, and the size of a family
MOST_SHARED, FAMILY = 8, 5


def shared_turns(conv: Column) -> Column:
    """Turns a conversation takes from the first of its family, by the contract's rule."""
    return (F.crc32(conv.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def _lane(place: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), place, F.col("digest")).cast("decimal(38,0)")


def turns(df: DataFrame) -> DataFrame:
    """``conv``, chunk, ``pos`` (from 1), digest and byte length of the text of every turn."""
    text = lambda c: F.coalesce(ref(c).cast("string"), F.lit(""))
    rows = df.where(ref("conv_id").isNotNull()).select(ref("conv_id").cast("long").alias("conv"), ref("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    # nulls in front: below every BIGINT
    rows = rows.select("conv", F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit("-10000000000000000000").cast("decimal(20,0)")).alias("turn"), "role", digest.alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    rows = materialize(rows, "tour-turns")
    spec = series_spec(rows, ["conv"], ["turn", "role", "digest"])
    laid = lay_out(rows, spec)
    inside = Window.partitionBy("conv", "_chunk").orderBy("turn", "role", "digest")
    before = Window.partitionBy("conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy("conv", "_chunk").agg(F.count(F.lit(1)).alias("n"))
    carry = counts.select("conv", "_chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))
    out = laid.withColumn("row", F.row_number().over(inside)).join(carry, ["conv", "_chunk"])
    return out.select("conv", "_chunk", (F.col("row") + F.col("carry")).alias("pos"), "digest", "bytes")


def _prefixes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row a prefix of every rebuilt conversation: conv, depth, sums of both lanes, last turn's lanes and bytes, and whether it is the whole; and all lengths."""
    own = materialize(turns(df), "tour-places")
    sizes = own.groupBy("conv").agg(F.max("pos").alias("size"))
    first = F.col("conv") - F.pmod("conv", F.lit(FAMILY))
    convs = sizes.withColumns({"h": shared_turns(F.col("conv")), "donor": first})
    donors = sizes.select(F.col("conv").alias("donor"), F.col("size").alias("given"))
    convs = convs.join(donors, "donor", "left").withColumn("taken", F.least("h", F.coalesce("given", F.lit(0))))
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0)))
    # a family's first turns: at most MOST_SHARED rows a donor, for at most FAMILY conversations
    heads = own.where((F.col("pos") <= MOST_SHARED) & (F.col("conv") % FAMILY == 0))
    upto = Window.partitionBy("conv").orderBy("pos")
    lanes = {f"lane{i}": _lane(F.col("pos"), i) for i in (1, 2)}
    heads = heads.withColumns(lanes).withColumns({f"sum{i}": F.sum(f"lane{i}").over(upto) for i in (1, 2)}).withColumnRenamed("conv", "donor")
    head_rows = convs.select("conv", "donor", "taken", "length").join(heads, "donor").where("pos <= taken")
    columns = ["conv", F.col("depth").cast("long").alias("depth"), "sum1", "sum2", "lane1", "lane2", "bytes", (F.col("depth") == F.col("length")).alias("whole")]
    head_rows = head_rows.withColumnRenamed("pos", "depth").select(*columns)
    # the own turns behind them
    ends = head_rows.groupBy("conv").agg(F.max_by("sum1", "depth").alias("head1"), F.max_by("sum2", "depth").alias("head2"))
    zero = F.lit(0).cast("decimal(38,0)")
    info = convs.select("conv", "h", "taken", "length").join(ends, "conv", "left").na.fill(0, ["taken"])
    info = info.withColumns({f"head{i}": F.coalesce(f"head{i}", zero) for i in (1, 2)})
    tail = own.join(info, "conv").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    tail = tail.withColumns({f"lane{i}": _lane(F.col("depth"), i) for i in (1, 2)})
    inside = Window.partitionBy("conv", "_chunk").orderBy("depth")
    before = Window.partitionBy("conv").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = tail.groupBy("conv", "_chunk").agg(*[F.sum(f"lane{i}").alias(f"s{i}") for i in (1, 2)])
    carry = sums.select("conv", "_chunk", *[F.coalesce(F.sum(f"s{i}").over(before), zero).alias(f"carry{i}") for i in (1, 2)])
    tail = tail.withColumns({f"in{i}": F.sum(f"lane{i}").over(inside) for i in (1, 2)}).join(carry, ["conv", "_chunk"])
    tail = tail.withColumns({f"sum{i}": (F.col(f"in{i}") + F.col(f"carry{i}") + F.col(f"head{i}")).cast("decimal(38,0)") for i in (1, 2)})
    return head_rows.unionByName(tail.select(*columns)), convs.select("conv", "length")


def nodes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (owner, depth, parent's owner, members, own saving), and the node that each conversation ends in."""
    prefixes, lengths = _prefixes(df)
    prefixes, lengths = materialize(prefixes, "tour-prefixes"), materialize(lengths, "tour-lengths")
    key = ["depth", "sum1", "sum2"]
    named = prefixes.groupBy(*key).agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"), F.min("lane1").alias("lane1"), F.min("lane2").alias("lane2"))
    named = materialize(named, "tour-named")
    all_convs = lengths.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n")).first()
    first = F.lit(all_convs["owner"]).cast("long")
    above = named.select(*[F.col(k).alias(f"up_{k}") for k in key], F.col("owner").alias("parent"))
    is_parent = (F.col("depth") - 1 == F.col("up_depth")) & (F.col("sum1") - F.col("lane1") == F.col("up_sum1")) & (F.col("sum2") - F.col("lane2") == F.col("up_sum2"))
    deep = named.where("depth > 1").join(above, is_parent)
    columns = ["owner", "depth", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).cast("long").alias("saving")]
    below = deep.select(*columns).unionByName(named.where("depth = 1").withColumn("parent", first).select(*columns))
    root = lengths.sparkSession.createDataFrame([(all_convs["owner"], 0, None, all_convs["n"], 0)] if all_convs["n"] else [], below.schema)
    last = prefixes.where("whole").select("conv", *key)
    ends = last.join(named.select(*key, "owner"), key).select("owner", "depth", "conv")
    bare = lengths.where("length = 0").select(first.alias("owner"), F.lit(0).cast("long").alias("depth"), "conv")
    return materialize(root.unionByName(below), "tour-nodes"), ends.unionByName(bare)


# --- tour ---------------------------------------------------------------------------

#: an arc is known by its node's owner and its slot: twice the depth, and one more if it leaves the node
_ARC = T.StructType([T.StructField(c, T.LongType()) for c in ("owner", "slot", "to_owner", "to_slot", "leaf", "saving", "_chunk")])


def arcs(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with ``n_children``, and all arcs with the one that comes after (null after the last)."""
    children = tree.where("parent IS NOT NULL").select("parent", "depth", "owner")
    laid = lay_out(children, series_spec(children, ["parent", "depth"], ["owner"]))
    inside = Window.partitionBy("parent", "depth", "_chunk").orderBy("owner")
    after = Window.partitionBy("parent", "depth").orderBy("_chunk")
    firsts = laid.groupBy("parent", "depth", "_chunk").agg(F.min("owner").alias("first"))
    firsts = firsts.select("parent", "depth", "_chunk", F.lead("first").over(after).alias("later"))
    siblings = laid.withColumn("next", F.lead("owner").over(inside)).join(firsts, ["parent", "depth", "_chunk"])
    siblings = siblings.select("owner", "depth", F.coalesce("next", "later").alias("next"))
    eldest = children.groupBy(F.col("parent").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.min("owner").alias("child"), F.count(F.lit(1)).alias("n_children"))
    found = tree.join(siblings, ["owner", "depth"], "left").join(eldest, ["owner", "depth"], "left")
    found = materialize(found.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "tour-family")
    enter, leave = F.col("depth") * 2, F.col("depth") * 2 + 1
    arc = lambda owner, slot: F.struct(owner.alias("owner"), slot.alias("slot"))
    entered = F.when(F.col("child").isNull(), arc(F.col("owner"), leave)).otherwise(arc(F.col("child"), enter + 2))
    left = F.when(F.col("next").isNotNull(), arc(F.col("next"), enter)).when(F.col("parent").isNotNull(), arc(F.col("parent"), leave - 2))
    zero = F.lit(0).cast("long")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    both = F.array(
        F.struct(enter.alias("slot"), entered.alias("to"), leaf.alias("leaf"), F.col("saving").alias("saving")),
        F.struct(leave.alias("slot"), left.alias("to"), zero.alias("leaf"), zero.alias("saving")),
    )
    rows = found.select("owner", F.explode(both).alias("arc"))
    rows = rows.select("owner", "arc.slot", F.col("arc.to.owner").alias("to_owner"), F.col("arc.to.slot").alias("to_slot"), "arc.leaf", "arc.saving")
    return found, rows


def _follow(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the arcs of a part: the index of the last arc of each one's chain, the way to it, which arcs a chain enters by, and all codes."""
    owner, slot = table["owner"].to_numpy(), table["slot"].to_numpy()
    to_owner = table["to_owner"].fill_null(0).to_numpy()
    to_slot = table["to_slot"].fill_null(-1).to_numpy()
    owners, home = np.unique(owner, return_inverse=True)
    code = home.astype(np.int64) << 40 | slot
    order = np.argsort(code)
    to_home = np.minimum(np.searchsorted(owners, to_owner), len(owners) - 1)
    wanted = np.where((owners[to_home] == to_owner) & (to_slot >= 0), to_home.astype(np.int64) << 40 | to_slot, -1)
    at = np.minimum(np.searchsorted(code[order], wanted), len(order) - 1)
    here = np.arange(len(code))
    last = np.where((wanted >= 0) & (code[order][at] == wanted), order[at], here)
    entered = np.ones(len(code), bool)
    entered[last[last != here]] = False
    way = (last != here).astype(np.int64)
    while True:  # pointer doubling inside the part
        way, jump = way + way[last], last[last]
        if np.array_equal(jump, last):
            return last, way, entered, code
        last = jump


def rank(rows: DataFrame) -> DataFrame:
    """``pos`` (from 0) of every arc along the list; runs its rounds while the plan is built."""
    laid = materialize(lay_out(rows, series_spec(rows, ["owner"], ["slot"])).select(*_ARC.names), "tour-arcs")
    entry = T.StructType([*_ARC.fields[:4], T.StructField("_chunk", T.LongType()), T.StructField("arcs", T.LongType())])

    def contract(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        last, way, entered, _ = _follow(table)
        ends = table.take(pa.array(last[entered]))
        starts = table.filter(pa.array(entered))
        return pa.table([starts["owner"], starts["slot"], ends["to_owner"], ends["to_slot"], starts["_chunk"], pa.array(way[entered] + 1)], names=entry.names)

    entries = materialize(laid.groupBy("_chunk").applyInArrow(contract, entry), "tour-entries")
    # arcs from an entry to the end of the list, by doubling its jumps
    open_, done, total, turn = entries, [], None, 0
    while True:
        done.append(open_.where("to_owner IS NULL").select("owner", "slot", "_chunk", "arcs"))
        open_ = open_.where("to_owner IS NOT NULL")
        ahead = entries if not turn else reached
        ahead = ahead.select(F.col("owner").alias("to_owner"), F.col("slot").alias("to_slot"), F.col("to_owner").alias("far_owner"), F.col("to_slot").alias("far_slot"), F.col("arcs").alias("further"))
        step = open_.join(ahead, ["to_owner", "to_slot"])
        step = step.select("owner", "slot", F.col("far_owner").alias("to_owner"), F.col("far_slot").alias("to_slot"), "_chunk", (F.col("arcs") + F.col("further")).alias("arcs"))
        open_ = materialize(step, f"tour-jump{turn}")
        turn += 1
        if open_.isEmpty():
            break
        ended = done[0]
        for d in done[1:]:
            ended = ended.unionByName(d)
        none = F.lit(None).cast("long")
        reached = open_.unionByName(ended.select("owner", "slot", none.alias("to_owner"), none.alias("to_slot"), "_chunk", "arcs"))
    ranked = done[0]
    for d in done[1:]:
        ranked = ranked.unionByName(d)
    ranked = materialize(ranked, "tour-ranked")
    total = laid.count()
    ranked = ranked.select("owner", "slot", "_chunk", (F.lit(total) - F.col("arcs")).alias("pos"))
    placed = T.StructType([*[f for f in _ARC.fields if f.name in ("owner", "slot", "leaf", "saving")], T.StructField("pos", T.LongType())])

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        last, way, entered, code = _follow(left)
        starts = np.flatnonzero(entered)
        starts = starts[np.lexsort((left["slot"].to_numpy()[starts], left["owner"].to_numpy()[starts]))]
        known = right.sort_by([("owner", "ascending"), ("slot", "ascending")])["pos"].to_numpy()
        end_pos = np.zeros(len(code), np.int64)
        end_pos[last[starts]] = known + way[starts]
        return left.select(placed.names[:4]).append_column("pos", pa.array(end_pos[last] - way))

    return laid.groupBy("_chunk").cogroup(ranked.groupBy("_chunk")).applyInArrow(place, placed)


def trie(df: DataFrame) -> DataFrame:
    """One row a node: owner (its smallest member), depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    tree, ends = nodes(df)
    family, rows = arcs(tree)
    placed = materialize(rank(rows), "tour-placed")
    total = placed.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK))
    width = max(1, -(-total // parts))
    placed = placed.withColumn("part", F.floor(F.col("pos") / F.lit(width)).cast("long"))
    inside = Window.partitionBy("part").orderBy("pos")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a part
    sums = placed.groupBy("part").agg(F.sum("leaf").alias("l"), F.sum("saving").alias("s"))
    carry = sums.select("part", F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s"))
    run = placed.withColumns({"lsum": F.sum("leaf").over(inside), "ssum": F.sum("saving").over(inside)}).join(carry, "part")
    leaves, saved = F.col("lsum") + F.col("l"), F.col("ssum") + F.col("s")
    leaving = F.col("slot") % 2 == 1
    subtree = run.groupBy("owner", F.floor(F.col("slot") / 2).cast("long").alias("depth")).agg(
        F.sum(F.when(leaving, leaves).otherwise(F.col("leaf") - leaves)).alias("n_leaves"),
        F.sum(F.when(leaving, saved).otherwise(F.col("saving") - saved)).alias("saved_tokens"),
    )
    # written apart: in one stage the windows, joins and digests would hold all their sort buffers at once
    subtree, digests = materialize(subtree, "tour-subtrees"), materialize(_end_digests(ends), "tour-digests")
    out = family.join(subtree, ["owner", "depth"]).join(digests, ["owner", "depth"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("owner", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def _end_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ids of the conversations that end in each node: joined within chunks, then streamed."""
    ends = materialize(ends, "tour-ends")
    laid = lay_out(ends, series_spec(ends, ["owner", "depth"], ["conv"]))
    pieces = laid.groupBy("owner", "depth", "_chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    schema = T.StructType([T.StructField("owner", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("ends_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at, state = [], None, None
        for batch in batches:
            for owner, depth, ids in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if (owner, depth) == at:
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    found.append((*at, state.hexdigest()))
                at, state = (owner, depth), hashlib.sha256(ids.encode())
        if at is not None:
            found.append((*at, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=schema.names)

    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "_chunk").select("owner", "depth", "ids").mapInArrow(run, schema)
