"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources share ``budget`` times all words by weight; a target stops
at ``cap`` times its source's words and the excess is shared again. That is a
water level: target = min(cap x size, level x weight), and the level is the
largest quotient (budget left over) / (weight left over) in order of cap / weight.

Selection: every document has the exponential key -ln(u) / quality, u from the
digest of its id, so small keys are a weighted sample without replacement. Where
the id is null or repeated, u is from the id, the digest of the row and a rank
among equal rows, so these rows are drawn independently too. A
source first takes its complete epochs; the rest of its target is filled in key
order. Literal split points cut (source, key) into ranges of equal size, whatever
the scale of the weights; their word sums are prefix-summed per source, and only the
range in which the target is reached is sorted by key, so no source's documents meet
in one task. The outcome is one cut (range, key, id,
row, rank) a source, which every document is compared with.

Defined results: a null text has no words; a null source is a source, last in
order; quality weights that are null or not positive count as 1; rows that repeat
an id are documents of their own, and equal rows are interchangeable; a source
without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tagloom.llm.common import WORD, materialize, ref, row_digest
from tagloom.operators.splits import split_points

CYCLE, BUDGET, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix"
#: equal rows are ranked in parts of at most 2 ** PART_BITS rows
PART_BITS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from 52 bits of the digest of seed and id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame, *, cycle=CYCLE, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(no_source, source, source_size) with ``target``; one row a source, so the windows here are over sources only."""
    n = len(cycle)
    rank = F.row_number().over(W.orderBy("no_source", "source")) - 1
    shares = sizes.withColumn("share", F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (rank % n + 1).cast("int")))
    full = F.col("source_size") * F.lit(float(cap))
    order = W.orderBy(full / F.col("share"), "no_source", "source")
    before = F.coalesce(F.sum(full).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("share").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("no_source", "source")
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    level = F.max("level").over(everything)
    return shares.withColumn("level", (total - before) / still).withColumn("target", F.least(full, level * F.col("share"))).drop("level", "share")


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``, from 0 among rows of the same ``row``: within a part by a window, over the parts by their counts."""
    rank = F.row_number().over(W.partitionBy("row", "part").orderBy("part")) - 1
    sizes = rows.groupBy("row", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("row").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    before = sizes.withColumn("before", before).where("before > 0").select("row", "part", "before")
    rows = rows.withColumn("rank", rank).join(before, ["row", "part"], "left")
    return rows.withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0))).drop("part", "before")


def plan(df: DataFrame, *, weights: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle=CYCLE, budget: float = BUDGET, cap: float = CAP, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Slim rows (id, row digest and rank, size, source, key) written once, and per source its size, target, epochs and cut.

    ``weights`` has ``id_col`` and ``weight``, the quality weight of a document (1 where it has none).
    """
    rows = df.select(ref(id_col).alias("id"), ref(source_col).isNull().alias("no_source"), F.coalesce(ref(source_col), F.lit("")).alias("source"), word_count(ref(text_col)).alias("size"), row_digest(df, text_col).alias("row"), F.shiftright(F.monotonically_increasing_id(), PART_BITS).alias("part"))
    rows = materialize(rows, "mix-rows")
    repeated = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("repeated"))
    rows = _ranked(rows).join(repeated, "id", "left")
    weight = F.lit(1.0)
    if weights is not None:
        best = weights.groupBy(ref(id_col).alias("id")).agg(F.max("weight").alias("weight"))
        rows, weight = rows.join(best, "id", "left"), F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(1.0)
    own = F.concat_ws(":", F.col("id").cast("string"), "row", "rank")
    key = -F.log(uniform(F.when(F.col("id").isNull() | F.col("repeated"), own).otherwise(F.col("id").cast("string")), seed)) / weight
    rows = materialize(rows.withColumn("key", key).select("id", "row", "rank", "no_source", "source", "size", "key"), "mix")
    by = ["no_source", "source"]
    # ranges of equal size along the keys of each source, whatever the scale of the weights; none grows with the table
    rows = rows.withColumn("bucket", split_points(rows, [*by, "key"]).index())
    buckets = rows.groupBy(*by, "bucket").agg(F.sum("size").alias("words"))
    goal = targets(buckets.groupBy(*by).agg(F.sum("words").alias("source_size")), cycle=cycle, budget=budget, cap=cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = materialize(goal, "mix-goals")
    start = F.coalesce(F.sum("words").over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = buckets.withColumn("start", start).join(goal.where("rest > 0"), by).where("start < rest and start + words >= rest")
    reached = materialize(reached.select(*by, "bucket", "start", "rest"), "mix-reached")
    upto = F.col("start") + F.sum("size").over(W.partitionBy(*by, "bucket").orderBy("key", "id", "row", "rank").rowsBetween(W.unboundedPreceding, 0))
    # a document is taken if the middle of its words lies before the target
    inside = rows.join(reached, [*by, "bucket"]).withColumn("upto", upto).where("upto - size / 2 < rest")
    last = inside.groupBy(*by).agg(F.max(F.struct("key", "id", "row", "rank")).alias("cut"))
    cuts = reached.select(*by, F.col("bucket").alias("cut_bucket")).join(last, by, "left")
    return rows, materialize(goal.join(cuts, by, "left"), "mix-cuts")


def _copies(rows: DataFrame, goals: DataFrame) -> DataFrame:
    chosen = (F.col("bucket") < F.col("cut_bucket")) | ((F.col("bucket") == F.col("cut_bucket")) & (F.struct("key", "id", "row", "rank") <= F.col("cut")))
    return rows.join(goals, ["no_source", "source"]).withColumn("copies", F.col("epochs") + F.coalesce(chosen, F.lit(False)).cast("long"))


def mix(df: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, size, source_size, target (of its source), copies and taken (words times copies)."""
    rows, goals = plan(df, id_col=id_col, **options)
    return _copies(rows, goals).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mixed documents, all columns, each as often as the mix takes it."""
    rows, goals = plan(df, id_col=id_col, text_col=text_col, **options)
    # equal rows are one with the copies of all: which of them a copy comes from makes no difference
    taken = _copies(rows, goals).groupBy("row").agg(F.sum("copies").alias("_tl_copies")).where("_tl_copies > 0").withColumnRenamed("row", "_tl_row")
    out = df.withColumn("_tl_row", row_digest(df, text_col)).dropDuplicates(["_tl_row"]).join(taken, "_tl_row")
    return out.withColumn("_tl_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_tl_copies")))).select(*[ref(c) for c in df.columns])
