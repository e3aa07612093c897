"""SimHash near-duplicates through pivot distance tables.

Every document gets a 64-bit fingerprint of its word shingles. Equal
fingerprints are one node. A node is put into one bucket for each choice of
three of six bit blocks: two fingerprints that differ in at most three bits
agree on three blocks at least, so every linked pair meets in some bucket.
Inside the buckets of a task a table holds the Hamming distance of every
fingerprint to many fixed reference fingerprints; a pair is discarded when any
two coordinates differ by more than the link distance (triangle inequality), and
the survivors are verified on the fingerprints themselves. Pairs are looked at in
strides over the sorted bucket and never stored; only a spanning forest leaves
the task. A bucket of more than ``BUCKET_ROWS`` fingerprints is salted, and each
pair of its salts is a bucket of its own. Components are then found by joins.

Defined results: a null text, or one without words, has fingerprint zero and is
linked like any other; equal rows have equal fingerprints; a component is named
by its smallest document id (null ids are ignored unless a component has no
other).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import kept_columns, materialize, ref, row_digest, schema_of, text_slices, with_arrays
from tagloom.llm.graph import Forest, components

SHINGLE_WORDS, MAX_BITS, HASH_SEED = 3, 3, 42
BLOCKS, PIVOTS, BUCKET_ROWS, DEAL = 6, 12, 4096, 32
#: rows of whole buckets that are compared at a time in a task
TABLE_ROWS = 1 << 18


def fingerprint_of(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Bitwise majority of the XXH64 values of all shingles; ``bytes.lower`` and ``bytes.split`` are the ASCII rules wanted."""
    from xxhash import xxh64_digest

    parts = text.lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = [e - 1 for e in accumulate(len(p) + 1 for p in parts)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    count = max(1, len(parts) - words + 1)
    ends = ends[words - 1 :] or [len(joined)]
    bits = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):
        digests = b"".join([xxh64_digest(joined[s:e], HASH_SEED) for s, e in zip(starts[at : min(count, at + (1 << 16))], ends[at : at + (1 << 16)])])
        bits += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > count).view(">u8")[0])


def fingerprints(df: DataFrame, *, text_col: str = "text", keep=("doc_id",), out_col: str = "fingerprint", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and the fingerprint as a long (the bits of the unsigned value)."""
    keep = kept_columns(df, keep, [out_col])
    schema = schema_of(df, keep, [(out_col, T.LongType())])
    columns = [ref(c) for c in keep] + [ref(text_col).cast("binary").alias("_tl_text")]

    def run(batches):
        for batch, texts in text_slices(batches, "_tl_text"):
            values = np.array([fingerprint_of(t, shingle_words) for t in texts], np.uint64).view(np.int64)
            yield with_arrays(batch, keep, schema, [pa.array(values, pa.int64())])

    return df.select(*columns).mapInArrow(run, schema)


def references(count: int = PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: the SplitMix64 sequence."""
    out = []
    for i in range(1, count + 1):
        z = (i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
        out.append(z ^ (z >> 31))
    return np.array(out, np.uint64)


def _masks(max_bits: int) -> list[int]:
    """For each choice of blocks that a linked pair may leave alone: the mask of those blocks (as a signed long)."""
    blocks = max(BLOCKS, max_bits + 1)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ones = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:])]
    values = [sum(c) for c in combinations(ones, blocks - max_bits)]
    return [v - (1 << 64) if v >= 1 << 63 else v for v in values]


def _forest_of(table: pa.Table, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the fingerprints of one task, whose rows are sorted by bucket and value: a tree's root is its smallest value."""
    bucket = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
    prints = table.column(3).to_numpy()
    n = len(prints)
    fresh = np.concatenate([[True], (bucket[1:] != bucket[:-1]).any(axis=1)]) if n else np.zeros(0, bool)
    firsts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(firsts, n))
    several = np.repeat(sizes > 1, sizes)
    prints, sizes = prints[several], sizes[sizes > 1]
    values = prints.view(np.uint64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    forest = Forest(len(values))
    if not len(values):
        return prints, prints
    pivots = np.stack([np.bitwise_count(values ^ p) for p in references()], axis=0).astype(np.int8)
    index, stride = np.arange(len(values)), 1
    while len(index := index[index + stride < ends[index]]):
        left, right = index, index + stride
        for row in pivots:  # a pair goes at the first coordinate that separates it
            near = np.abs(row[left] - row[right]) <= max_bits
            left, right = left[near], right[near]
        close = np.bitwise_count(values[left] ^ values[right]) <= max_bits
        if close.any():
            forest.link(left[close], right[close])
        stride += 1
    linked = forest.root != np.arange(len(values))
    return prints[linked], prints[forest.root[linked]]


def links(prints: DataFrame, *, print_col: str = "fingerprint", max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints that differ in ``max_bits`` bits or fewer."""
    masks = _masks(max_bits)
    keys = F.array(*[F.struct(F.lit(i).cast("long").alias("m"), ref(print_col).bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    # a bucket's rows are dealt over DEAL parts for the look-up of its size, so a hot bucket does not meet in one task
    deal = F.pmod(F.xxhash64("f"), F.lit(DEAL))
    rows = prints.select(ref(print_col).alias("f"), F.explode(keys).alias("_b")).select("_b.m", "_b.k", "f").withColumn("d", deal)
    hot = rows.groupBy("m", "k").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    hot = hot.select("m", "k", (F.ceil(F.col("n") / bucket_rows) + 1).alias("salts"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(DEAL - 1).cast("long"))).alias("d"))
    own = F.pmod(F.xxhash64("f", F.lit(1)), F.col("salts"))
    pair = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1), lambda s: s != own), lambda s: F.least(s, own) * F.col("salts") + F.greatest(s, own))
    rows = rows.join(hot, ["m", "k", "d"], "left")
    rows = rows.withColumn("s", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pair)))
    rows = rows.select("m", "k", "s", "f").repartition("m", "k", "s").sortWithinPartitions("m", "k", "s", "f")

    def run(batches):
        for table in _whole_buckets(batches):
            a, b = _forest_of(table, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _whole_buckets(batches: Iterator[pa.RecordBatch], rows: int = TABLE_ROWS) -> Iterator[pa.Table]:
    """Tables of whole buckets of about ``rows`` rows, so a task's memory does not follow its partition."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(i).to_numpy() for i in range(3)], axis=1)
        others = np.flatnonzero((keys != keys[-1]).any(axis=1))  # the last bucket may go on in the next batch
        if len(others):
            last = int(others[-1]) + 1
            yield table.slice(0, last)
            held, size = table.slice(last).to_batches(), table.num_rows - last
    if size:
        yield pa.Table.from_batches(held)


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row a document: id, ``fingerprint`` (long) and ``component_id`` (smallest id that links reach)."""
    prints = fingerprints(df.select(ref(id_col).alias("_tl_id"), ref(text_col).alias("text")), keep=["_tl_id"], shingle_words=shingle_words)
    prints = materialize(prints, "simhash")
    nodes = prints.groupBy("fingerprint").agg(F.min("_tl_id").alias("first"))
    roots = materialize(components(links(nodes, max_bits=max_bits), "simhash"), "simhash-roots")
    # written before they are joined, so that AQE can split a component or a fingerprint that holds many rows
    smallest = roots.join(nodes, roots.node == nodes.fingerprint).groupBy("root").agg(F.min("first").alias("component_id"))
    linked = roots.join(materialize(smallest, "simhash-components"), "root").select(F.col("node").alias("fingerprint"), "component_id")
    classes = nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(materialize(classes, "simhash-classes"), "fingerprint").select(F.col("_tl_id").alias(id_col), "fingerprint", "component_id")


def hex_of(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def one_of_each(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the one with the smallest id (rows without an id come last), fingerprint and digest of the row.

    A component is known by its root fingerprint, so null ids and ids that are repeated with other texts are documents of their own.
    """
    rows = df.withColumn("_tl_row", row_digest(df, text_col))
    prints = rows.select(ref(id_col).alias("_tl_id"), "_tl_row", ref(text_col).alias("text"))
    prints = materialize(fingerprints(prints, keep=["_tl_id", "_tl_row"], shingle_words=shingle_words), "simhash")
    least = F.min(F.struct(F.col("_tl_id").isNull().alias("unnamed"), "_tl_id", "fingerprint", "_tl_row"))
    nodes = prints.groupBy("fingerprint").agg(least.alias("first"))
    roots = materialize(components(links(nodes, max_bits=max_bits), "simhash"), "simhash-roots")
    rooted = nodes.join(roots, nodes.fingerprint == roots.node, "left").select(F.coalesce("root", "fingerprint").alias("root"), "first")
    chosen = rooted.groupBy("root").agg(F.min("first").alias("first")).select("first._tl_row")
    # equal rows first become one on the map side, then the texts lie where the join wants them
    return rows.dropDuplicates(["_tl_row"]).join(chosen, "_tl_row", "left_semi").select(*[ref(c) for c in df.columns])
