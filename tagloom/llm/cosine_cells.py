"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside them.

Equal vectors are one node with a count. Centroids come from a bounded sample by
spherical k-means; every vector belongs to the cell of its nearest centroid and
visits each further cell whose centroid is nearly as near. How near follows from
the threshold t: a partner y = t x + sqrt(1 - t^2) z with z of random direction
leaves x's cell for one whose centroid is further by a gap g only if z spans
t g / (sqrt(1 - t^2) |c - c'|), and random directions in d dimensions spread by
1 / sqrt(d); ``SPREAD`` of these spreads are allowed for. Recall is therefore
measured against brute force (see tests and README), not assumed.

A cell of more than ``BLOCK_ROWS`` vectors is cut into blocks by hash, and the
cell's visitors meet each block in a task of their own. Products are blocked
matrix products in double precision; a task emits link counts and a spanning
forest, never the pairs. A pair is linked if either side visits the other.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component, and rows without an id, link with nothing; vectors of different
length are never compared; copies count as other vectors, so n copies alone have
n - 1 links each; rows of one id with different vectors are different vectors, and
each row has the links of its own.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import materialize, ref
from tagloom.llm.graph import Forest, components
from tagloom.llm.vectors import blocks, doubles, parse

THRESHOLD, SPREAD = 0.9, 2.5
SAMPLE_ROWS, CELL_ROWS, MAX_CELLS, BLOCK_ROWS, QUERY_ROWS, ROUNDS = 16_384, 1024, 1024, 2048, 512, 8


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Unit centroids; an empty cell takes the vector that fits its own cell worst."""
    rng = np.random.default_rng(seed)
    centroids = units[rng.choice(len(units), k, replace=False)]
    for _ in range(rounds):
        nearest, best = _nearest(units, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        empty = np.flatnonzero(np.bincount(nearest, minlength=k) == 0)
        sums[empty] = units[np.argsort(best)[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-300), centroids)
    return centroids


def _nearest(units: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nearest, best = np.empty(len(units), np.int64), np.empty(len(units))
    for a in range(0, len(units), 4096):
        scores = units[a : a + 4096] @ centroids.T
        nearest[a : a + 4096], best[a : a + 4096] = scores.argmax(axis=1), scores.max(axis=1)
    return nearest, best


def margin(threshold: float, dims: int, spread: float = SPREAD) -> float:
    """How much further a centroid may be for its cell to be visited."""
    return spread * math.sqrt(max(0.0, 1 - threshold**2)) * math.sqrt(2 / dims) / max(threshold, 1e-9)


def _parsed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, key, dims, unit): key is a digest of the usable vector, null for others; unit its direction as bytes of doubles."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("key", T.BinaryType()), T.StructField("dims", T.IntegerType()), T.StructField("unit", T.BinaryType())])

    def run(batches):
        for batch in batches:
            vectors, good = parse(batch.column(1))
            ids = batch.column(0)
            usable = [v if g and ids[i].is_valid else None for i, (v, g) in enumerate(zip(vectors, good))]
            keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() if v is not None else None for v in usable]
            units = []
            for v in usable:
                if v is not None:
                    v = v / np.abs(v).max()  # no overflow or underflow in the norm
                    v = (v / np.sqrt((v * v).sum())).tobytes()
                units.append(v)
            dims = [len(u) // 8 if u is not None else None for u in units]
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["id", "key", "dims", "unit"])

    return df.select(ref(id_col).alias("id"), ref(vector_col)).mapInArrow(run, schema)


def _fit(nodes: DataFrame, count: int, cell_rows: int, sample_rows: int) -> dict[int, np.ndarray]:
    """Centroids by number of dimensions, from a sample by hash; only sampled vectors reach the driver."""
    share = min(1.0, sample_rows / max(1, count))
    sample = nodes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("dims", "key", "unit").collect()
    found: dict[int, list] = {}
    for r in sorted(sample, key=lambda r: bytes(r["key"])):
        found.setdefault(r["dims"], []).append(np.frombuffer(r["unit"]))
    out = {}
    for dims, rows in found.items():
        k = min(MAX_CELLS, len(rows), max(1, round(len(rows) / max(share, 1e-9) / cell_rows)))
        out[dims] = spherical_kmeans(np.stack(rows), k)
    return out


def _assigned(nodes: DataFrame, centroids: dict[int, np.ndarray], threshold: float, spread: float) -> DataFrame:
    """Own cell and visited cells (own one included) of every node."""
    schema = T.StructType([nodes.schema["node"], T.StructField("copies", T.LongType()), T.StructField("dims", T.IntegerType()), T.StructField("unit", T.BinaryType()), T.StructField("own", T.IntegerType()), T.StructField("visits", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                cells = centroids.get(int(d))
                if cells is None:  # a length that the sample missed is one cell
                    own, near = np.zeros(part.num_rows, np.int64), np.ones((part.num_rows, 1), bool)
                else:
                    scores = doubles(part.column(3)) @ cells.T
                    own = scores.argmax(axis=1)
                    near = scores >= scores.max(axis=1, keepdims=True) - margin(threshold, int(d), spread)
                offsets = np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)
                visits = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(near)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), visits], names=[f.name for f in schema.fields])

    return nodes.select("node", "copies", "dims", "unit").mapInArrow(run, schema)


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root): partial link counts, and for each node met the node it hangs on."""
    node = rows.schema["node"].dataType
    schema = T.StructType([T.StructField("node", node), T.StructField("links", T.LongType()), T.StructField("root", node)])
    arrow = pa.int64() if isinstance(node, T.LongType) else pa.int32() if isinstance(node, T.IntegerType) else pa.string()

    def met(key, targets, queries):
        cell = key[1]
        units, nodes = doubles(targets.column(targets.schema.get_field_index("unit"))), targets.column(targets.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
        copies = targets.column(targets.schema.get_field_index("copies")).to_numpy()
        lists = targets.column(targets.schema.get_field_index("visits"))
        width = max([cell, *(x for x in lists.flatten().to_numpy())]) + 1
        visited = np.zeros((len(nodes), width), bool)
        lengths = np.diff(lists.offsets.to_numpy())
        visited[np.repeat(np.arange(len(nodes)), lengths), lists.flatten().to_numpy()] = True
        forest, gained = Forest(len(nodes)), np.zeros(len(nodes), np.int64)
        for part in queries:
            theirs = part.column(part.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
            own = part.column(part.schema.get_field_index("own")).to_numpy()
            weight = part.column(part.schema.get_field_index("copies")).to_numpy()
            q, t = np.nonzero(doubles(part.column(part.schema.get_field_index("unit"))) @ units.T >= threshold)
            other = theirs[q] != nodes[t]
            q, t = q[other], t[other]
            if not len(q):
                continue
            # a pair met in only one of its two directions counts for both sides here
            both = (own[q] < width) & visited[t, np.minimum(own[q], width - 1)]
            links = np.bincount(q, copies[t], len(theirs)).astype(np.int64)
            gained += np.bincount(t[~both], weight[q[~both]], len(nodes)).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            anchor = np.repeat(t[heads], np.diff(np.append(heads, len(q))))
            forest.link(anchor, t)
            with_links = q[heads]
            yield pa.RecordBatch.from_arrays([pa.array(theirs[with_links], arrow), pa.array(links[with_links], pa.int64()), pa.array(nodes[t[heads]], arrow)], names=["node", "links", "root"])
        moved = np.flatnonzero((forest.root != np.arange(len(nodes))) | (gained > 0))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved], arrow), pa.array(gained[moved], pa.int64()), pa.array(nodes[forest.root[moved]], arrow)], names=["node", "links", "root"])

    def run(batches):
        yield from blocks(batches, ["dims", "cell", "block"], "kind", QUERY_ROWS, met)

    return rows.mapInArrow(run, schema)


def near_duplicates(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, spread: float = SPREAD, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a vector: id, n_links, component_id (smallest id reachable) and kept (id = component_id)."""
    rows = materialize(_parsed(df, id_col, vector_col), "cells-vectors")
    usable = rows.where("key is not null")
    nodes = usable.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("unit").alias("unit"))
    # a number a vector, not an id: one id may have several vectors. Written, so the numbers stay
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "cells-nodes")
    centroids = _fit(nodes, nodes.count(), cell_rows, sample_rows)
    assigned = materialize(_assigned(nodes, centroids, threshold, spread), "cells-assigned")
    # one number a cell, and cells are bounded: at most MAX_CELLS for each length of vectors
    parts = assigned.groupBy("dims", F.col("own").alias("cell")).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    parts = materialize(parts, "cells-parts")
    base = assigned.select("node", "copies", "dims", "unit", "own", "visits")
    targets = base.withColumn("cell", F.col("own")).join(F.broadcast(parts), ["dims", "cell"])
    targets = targets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("kind", F.lit(0))
    queries = base.withColumn("cell", F.explode("visits")).join(F.broadcast(parts), ["dims", "cell"])
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(1)).withColumn("visits", F.array().cast("array<int>"))
    names = ["node", "copies", "dims", "unit", "own", "visits", "cell", "block", "kind"]
    meeting = targets.select(names).unionByName(queries.select(names)).repartition("dims", "cell", "block").sortWithinPartitions("dims", "cell", "block", "kind")
    found = materialize(_compare(meeting, threshold), "cells-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), "cells")
    classes = nodes.join(counts, "node", "left").join(roots, "node", "left")
    classes = materialize(classes.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "cells-rooted")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(smallest, "root").select("key", "n_links", "component_id")
    out = rows.select("id", "key").join(materialize(classes, "cells-classes"), "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
