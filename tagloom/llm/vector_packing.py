"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Documents with equal texts are a group. A group that holds more than a
``1 / (shards x FINE)`` part of the bytes, tokens or rows is dealt into pieces by
the hash of the id, and rows of the group that share an id, or have none, by a
number of their own, so that no id gathers rows; all other groups are gathered whole, by hash, into ``ATOMS``
atoms. The pieces of a group are placed together, unless it holds more than a
``1 / (shards x WHOLE)`` part, half a shard: only then each goes its own way.
Groups, pieces and atoms, a number bounded by these parameters, are placed one
after the other, largest first, on the shard whose residual capacity has the
largest dot product with the item's (bytes, tokens, rows) vector. Rows then look
up their piece or atom; ranks within these and their offsets give gapless slots,
so neither a shard nor a large group is sorted in one task.

Defined results: which of several rows equal in id and text goes to which shard is
not defined, only how they spread; a null text has no bytes beside the one that every row counts,
no tokens and CRC 0; repeated rows are rows of their own and get slots of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.common import materialize, ref
from tagloom.llm.token_mix import word_count

SHARDS, ATOMS, FINE, WHOLE = 8, 8192, 64, 2


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item (rows of bytes, tokens, rows): largest first, by the dot product with what is left."""
    share = items * shards / np.maximum(items.sum(axis=0), 1)
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        out[i] = best = int(np.argmax(left @ share[i]))
        left[best] -= share[i]
    return out


def _units(keys: list[tuple[int, int]], loads: np.ndarray, most: list[float]) -> np.ndarray:
    """The number of the item that each piece or atom (sorted keys; an atom's second is -1) is placed with: a group's pieces are one up to ``most``."""
    group = np.cumsum([i > 0 and (k2 < 0 or keys[i - 1][1] < 0 or k1 != keys[i - 1][0]) for i, (k1, k2) in enumerate(keys)]).astype(np.int64)
    held = np.stack([np.bincount(group, loads[:, j]) for j in range(loads.shape[1])], axis=1)
    cut = (held > most).any(axis=1)[group] & np.array([k2 >= 0 for _, k2 in keys], bool)
    return np.unique(np.where(cut, len(keys) + np.arange(len(keys)), group), return_inverse=True)[1]


def pack(df: DataFrame, *, shards: int = SHARDS, atoms: int = ATOMS, fine: int = FINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, tokens, shard and slot (gapless from 0 in each shard)."""
    spark, text = df.sparkSession, ref(text_col)
    raw = text.cast("binary")
    rows = df.select(
        ref(id_col).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("crc"),
        word_count(text).alias("tokens"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("g"),
    )
    rows = materialize(rows.withColumn("own", F.monotonically_increasing_id()), "packing")  # written: the numbers stay
    groups = rows.groupBy("g", "size", "crc").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.sum("size").alias("b"))
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    most = [max(1.0, (x or 0) / (shards * fine)) for x in total]
    worst = F.greatest(F.col("b") / most[0], F.col("t") / most[1], F.col("n") / most[2])
    # at most 3 x shards x fine groups can be this large, whatever the input
    large = groups.where(worst > 1).select("g", "size", "crc", F.least(F.col("n"), F.ceil(worst)).cast("long").alias("pieces"))
    rows = rows.join(F.broadcast(large), ["g", "size", "crc"], "left")
    # ids that several rows of a large group have, or lack
    shared = rows.where("pieces is not null").groupBy("g", "size", "crc", "id").count().where("count > 1")
    shared = shared.select(F.col("g").alias("sg"), F.col("size").alias("ss"), F.col("crc").alias("sc"), F.col("id").alias("sid"), F.lit(True).alias("shared"))
    same = (F.col("g") == F.col("sg")) & (F.col("size") == F.col("ss")) & (F.col("crc") == F.col("sc")) & F.col("id").eqNullSafe(F.col("sid"))
    rows = rows.join(shared, same & F.col("pieces").isNotNull(), "left").drop("sg", "ss", "sc", "sid")
    piece = F.pmod(F.xxhash64("id", F.lit(5), F.when(F.col("shared"), F.col("own"))), F.col("pieces"))
    rows = rows.withColumn("k1", F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("g"), F.lit(atoms))).otherwise(F.col("g"))).withColumn("k2", F.coalesce(piece, F.lit(-1).cast("long")))
    sums = sorted(tuple(r) for r in rows.groupBy("k1", "k2").agg(F.sum("size"), F.sum("tokens"), F.count("*")).collect())
    loads = np.array([s[2:] for s in sums], np.float64).reshape(-1, 3)
    unit = _units([s[:2] for s in sums], loads, [max(1.0, (x or 0) / (shards * WHOLE)) for x in total])
    items = np.stack([np.bincount(unit, loads[:, j]) for j in range(3)], axis=1)
    shard = place(items, shards)[unit]
    filled, placed = [0] * shards, []
    for (k1, k2, _, _, n), s in zip(sums, shard.tolist()):
        placed.append((k1, k2, s, filled[s]))
        filled[s] += n
    table = spark.createDataFrame(placed, "k1 long, k2 long, shard int, base long")
    rank = F.row_number().over(W.partitionBy("k1", "k2").orderBy("id", "own")) - 1
    rows = rows.withColumn("rank", rank).join(F.broadcast(table), ["k1", "k2"])
    return rows.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "tokens", "shard", (F.col("base") + F.col("rank")).alias("slot"))
