"""Operators on tables whose ids are null or repeated."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import cosine_cells, language_crf, token_mix, vector_packing
from tests.conftest import SF01


def loads(rows):
    sizes, counts = Counter(), Counter()
    for r in rows:
        sizes[r["shard"]] += r["size"]
        counts[r["shard"]] += 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    return sizes, counts


@pytest.mark.parametrize("ids", ["CAST(NULL AS BIGINT)", "7L", "id", "id % 3"])
def test_equal_texts_spread_whatever_their_ids(spark, ids):
    df = spark.range(4000).select(F.expr(ids).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    sizes, counts = loads(vector_packing.pack(df).collect())
    assert len(counts) == 8 and max(counts.values()) <= 1.1 * 500 and max(sizes.values()) <= 1.1 * sum(sizes.values()) / 8


def test_one_id_with_two_fifths_of_the_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).cast("long").alias("doc_id"), F.when(F.col("id") < 2000, F.lit("a text that many rows repeat")).otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"))
    sizes, _ = loads(vector_packing.pack(df).collect())
    assert max(sizes.values()) <= 1.05 * sum(sizes.values()) / 8 and min(sizes.values()) >= 0.95 * sum(sizes.values()) / 8


def test_placement_equals_the_dot_product_rule():
    rng = np.random.default_rng(1)
    for shards in (1, 3, 8):
        items = rng.integers(0, 1000, (60, 3)).astype(float)
        left = [[1.0, 1.0, 1.0] for _ in range(shards)]
        total = items.sum(axis=0)
        want = [None] * len(items)
        for i in sorted(range(len(items)), key=lambda i: -max(items[i] * shards / total)):
            share = items[i] * shards / total
            dots = [sum(a * b for a, b in zip(row, share)) for row in left]
            want[i] = dots.index(max(dots))
            left[want[i]] = [a - b for a, b in zip(left[want[i]], share)]
        assert vector_packing.place(items, shards).tolist() == want


def test_one_id_with_two_vectors(spark):
    a, b = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    near = lambda v, i: [x + 0.01 * (j == i) for j, x in enumerate(v)]
    rows = [(5, a), (5, b), (6, near(a, 1)), (7, near(b, 1)), (8, near(b, 2)), (9, near(b, 3)), (None, a), (10, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cosine_cells.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 1, 5, True), (5, 3, 5, True), (6, 1, 5, False), (7, 3, 5, False), (8, 3, 5, False), (9, 3, 5, False), (None, 0, None, False), (10, 0, 10, True)], key=str)


@pytest.mark.parametrize("ids", [None, 7])
def test_languages_are_learned_whatever_the_ids(spark, ids):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("lang IS NOT NULL")
    model = language_crf.learn(docs.withColumn("doc_id", F.lit(ids).cast("long")), sample_docs=50)
    assert set(model.labels) == {r.lang for r in docs.select("lang").distinct().collect()}
    found = language_crf.predict(docs, model, keep=["doc_id", "lang"]).where("n_words > 5")
    assert found.where("lang = lang_pred").count() >= 0.9 * found.count()
    few = docs.where("lang = 'en'").limit(1).select("text", "lang").join(spark.range(300)).unionByName(docs.where("lang <> 'en'").select("text", "lang"), allowMissingColumns=True)
    assert "en" in language_crf.learn(few, sample_docs=20).labels  # a language of one text, often repeated


def test_the_mix_does_not_depend_on_the_scale_of_the_weights(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    weights = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 2.0).otherwise(1.0).alias("weight"))
    taken = []
    for scale in (1.0, 1e-6, 1e4):
        scaled = weights.withColumn("weight", F.col("weight") * scale)
        taken.append({r.doc_id: r.taken for r in token_mix.mix(docs, weights=scaled).collect()})
        rows, _ = token_mix.plan(docs, weights=scaled)
        ranges = [r["count"] for r in rows.groupBy("bucket").count().collect()]
        assert len(ranges) >= 6 and max(ranges) <= 3 * 1000 / 8  # of equal size, about
    assert taken[0] == taken[1] == taken[2]
