"""Nearest neighbours by inner product with randomly rotated one-bit codes.

Every vector is coded around the mean of all vectors, once for each of
``ROTATIONS`` random rotations: the signs of its rotated residual as packed bits,
with two correction scalars, the residual's length and the cosine between the
residual and its code. The codes give an unbiased estimate of the inner product
with any query and a bound on its error that holds with high probability
(``ERROR_SPREAD`` standard deviations).

Queries are not broadcast and vectors not paired: vectors are dealt by hash into
blocks of about ``BLOCK_ROWS``, the queries visit every block in batches, and a
block emits at most k rows a query. In a block the k best estimates are ranked
exactly first; then each vector whose estimate plus error bound reaches the k-th
exact product is ranked exactly as well, so the answer is the exact one unless a
bound fails. All products that decide are in double precision on the original
vectors, summed in order of the components.

Defined results: vectors that are null, empty, zero or hold a null or non-finite
component, and rows without an id, take no part; a query's candidates are the
vectors of its length with another id; rows that repeat a query's id are one
query (with the vector whose digest is smallest); ties go to the smaller id, and
a query with fewer than k candidates gets all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tagloom.llm.common import materialize, ref
from tagloom.llm.vectors import blocks, doubles, parse

NEIGHBOURS, ROTATIONS, ERROR_SPREAD, BLOCK_ROWS, QUERY_ROWS = 20, 4, 3.0, 4096, 256


def rotation(dims: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng((17, seed)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of a block of vectors around a centre, one for each of several random rotations."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, turns: list[np.ndarray]):
        rest = vectors - centre
        self.length = np.linalg.norm(rest, axis=1)
        self.dims, self.turns, self.centre = vectors.shape[1], turns, centre
        rest /= np.maximum(self.length, 1e-300)[:, None]
        turned = [rest @ turn for turn in turns]
        self.bits = [np.packbits(t >= 0, axis=1) for t in turned]
        self.cosine = [np.maximum(np.abs(t).sum(axis=1) / np.sqrt(self.dims), 1e-6) for t in turned]
        # what estimates are made of: the signs, scaled by the correction scalars, of all rotations side by side
        signs = [np.unpackbits(b, axis=1, count=self.dims).astype(np.float32) * 2 - 1 for b in self.bits]
        scales = [self.length / (c * np.sqrt(self.dims) * len(turns)) for c in self.cosine]
        self.scaled = np.concatenate([s * x[:, None].astype(np.float32) for s, x in zip(signs, scales)], axis=1)
        spread = np.mean([(1 - np.minimum(c, 1.0) ** 2) / c**2 for c in self.cosine], axis=0)
        self.loose = self.length * np.sqrt(spread / (len(turns) * max(1, self.dims - 1)))

    def estimate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Estimated inner products (queries x vectors), and the two factors of their standard errors: of queries and of vectors."""
        turned = np.concatenate([queries @ turn for turn in self.turns], axis=1).astype(np.float32)
        guess = turned @ self.scaled.T + (queries @ self.centre).astype(np.float32)[:, None]
        return guess, np.linalg.norm(queries, axis=1), self.loose


def _exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row-wise inner products, components added in order."""
    total = np.zeros(len(queries))
    for j in range(queries.shape[1]):
        total += queries[:, j] * vectors[:, j]
    return total


def block_search(codes: Codes, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block the best k of every query: query number, vector number, product.

    ``codes`` and all that chooses work on the vectors and queries divided by
    their largest component, so no magnitude overflows; the products that come
    out are those of the originals.
    """
    small = vectors / np.abs(vectors).max()
    asked = queries / np.abs(queries).max(axis=1, keepdims=True)
    guess, by_query, by_vector = codes.estimate(asked)
    own_query, own_vector = np.nonzero(query_ids[:, None] == ids[None, :])
    guess[own_query, own_vector] = -np.inf
    first = min(k, len(ids))
    top = np.argpartition(guess, len(ids) - first, axis=1)[:, len(ids) - first :]
    reach = guess + (spread * by_query).astype(np.float32)[:, None] * by_vector.astype(np.float32)
    found_query, found_vector, found_score = [], [], []
    for i, query in enumerate(queries):
        sure = top[i][guess[i, top[i]] > -np.inf]
        floor = (small[sure] @ asked[i]).min() if len(sure) == first == k else -np.inf  # the k-th exact product so far
        slack = 1e-6 * (1 + abs(floor)) if floor > -np.inf else 0.0  # estimates are single precision
        chosen = np.flatnonzero((reach[i] >= floor - slack) & (guess[i] > -np.inf))
        rough = small[chosen] @ asked[i]
        if len(chosen) > k:
            kth = np.partition(rough, len(rough) - k)[len(rough) - k]
            chosen = chosen[rough >= kth - 1e-12 * (1 + np.abs(rough).max())]
        score = _exact(np.broadcast_to(query, (len(chosen), len(query))), vectors[chosen])
        best = np.lexsort((ids[chosen], -score))[:k]
        found_query.append(np.full(len(best), i))
        found_vector.append(chosen[best])
        found_score.append(score[best])
    return np.concatenate(found_query).astype(np.int64), np.concatenate(found_vector).astype(np.int64), np.concatenate(found_score)


def _parsed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("dims", T.IntegerType()), T.StructField("vector", T.BinaryType())])

    def run(batches):
        for batch in batches:
            vectors, good = parse(batch.column(1))
            rows = [i for i in np.flatnonzero(good).tolist() if batch.column(0)[i].is_valid]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array([len(vectors[i]) for i in rows], pa.int32()), pa.array([vectors[i].tobytes() for i in rows], pa.binary())], names=["id", "dims", "vector"])

    return df.select(ref(id_col).alias("id"), ref(vector_col)).mapInArrow(run, schema)


def _centres(rows: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, int]]:
    """Mean and number of the vectors of each length: one partial sum a task and length, added in Spark."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = doubles(batch.column(2).filter(pa.array(dims == d)))
                total = sums.setdefault(int(d), [0, np.zeros(d)])
                total[0] += len(part)
                total[1] = total[1] + part.sum(axis=0)
        out = [(d, i, float(x), n) for d, (n, s) in sums.items() for i, x in enumerate(s)]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64()))], names=["dims", "i", "x", "n"])

    summed = rows.mapInArrow(run, "dims int, i int, x double, n long").groupBy("dims", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    centres: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for r in summed.collect():  # as many rows as a vector has components
        centres.setdefault(r["dims"], np.zeros(r["dims"]))[r["i"]] = r["x"] / r["n"]
        counts[r["dims"]] = r["n"]
    return centres, counts


def search(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, spread: float = ERROR_SPREAD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest of every row for which ``is_query`` holds (a column over ``id``)."""
    rows = materialize(_parsed(df, id_col, vector_col), "codes-vectors")
    centres, counts = _centres(rows)
    parts = {d: max(1, -(-n // block_rows)) for d, n in counts.items()}
    number = F.element_at(F.create_map(*[x for d, n in sorted(parts.items()) for x in (F.lit(d), F.lit(n))]), F.col("dims")) if parts else F.lit(1)
    id_type = rows.schema["id"].dataType
    vectors = rows.withColumn("block", F.pmod(F.xxhash64("id", "vector"), number).cast("int")).withColumn("kind", F.lit(0))
    queries = rows.where(is_query).groupBy("id").agg(F.min(F.struct(F.xxhash64("vector").alias("h"), "dims", "vector")).alias("q")).select("id", "q.dims", "q.vector")
    queries = queries.withColumn("block", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("kind", F.lit(1))
    names = ["id", "dims", "vector", "block", "kind"]
    meeting = vectors.select(names).unionByName(queries.select(names)).repartition("dims", "block").sortWithinPartitions("dims", "block", "kind", "id")
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType())])

    def met(key, targets, asked):
        d = key[0]
        vectors, ids = doubles(targets.column(2)), targets.column(0).to_numpy(zero_copy_only=False)
        largest = np.abs(vectors).max()
        codes = Codes(vectors / largest, np.nan_to_num(centres[d] / largest), [rotation(d, seed) for seed in range(ROTATIONS)])
        for part in asked:
            query_ids = part.column(0).to_numpy(zero_copy_only=False)
            q, v, score = block_search(codes, vectors, ids, doubles(part.column(2)), query_ids, k, spread)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), targets.column(0).take(pa.array(v)), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    def run(batches):
        yield from blocks(batches, ["dims", "block"], "kind", QUERY_ROWS, met)

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    found = meeting.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")
