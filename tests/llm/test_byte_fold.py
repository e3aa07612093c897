"""Operator 13 against the tiktoken library."""

import hashlib
import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from tagloom.llm import byte_fold, queries
from tests.conftest import SF001


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=byte_fold.default_pattern(), mergeable_ranks=byte_fold.load_ranks(byte_fold.default_ranks()), special_tokens={})


def encoded(df, **kw):
    return {(r["doc_id"], r["text"]): list(r["ids"]) for r in byte_fold.encode(df, keep=("doc_id", "text"), **kw).collect()}


def test_ids_and_bytes_equal_the_library(spark, odd_docs, library):
    out = byte_fold.encode(odd_docs, keep=("doc_id", "text", "score")).withColumn("back", byte_fold.decode(F.col("ids"))).collect()
    assert len(out) == odd_docs.count()
    for r in out:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or ""), r["doc_id"]
        assert bytes(r["back"]).decode() == (r["text"] or "")
        assert r["score"] == "y"


def test_random_texts_runs_and_new_letters(spark, library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("etao inshr'dlu\n\t  äé日本1290=-_!ſ") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += ["a" * 3001, "=" * 777, " " * 500 + "x", "ab" * 400 + "aba", "日本語" * 200, "".join(rng.choice("abc") for _ in range(900))]
    texts += ["abԘ՘࢏x 1\U00011de1yﷺ", "\u0085 　x", "\x00\x00a\U0010ffff", "퟿"]  # letters and numbers of several Unicode versions
    got = encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    for i, t in enumerate(texts):
        assert got[i, t] == library.encode_ordinary(t), repr(t[:40])


def test_small_vocabulary_with_lower_ranks_of_longer_pieces(spark):
    """Random vocabularies hold pieces that must be merged one at a time; one with 'aba' before 'ba' among them."""
    rng = random.Random(5)
    for trial in range(3):
        pieces = {bytes([b]) for b in range(256)}
        made = list({"".join(rng.choice("ab") for _ in range(rng.randint(2, 5))).encode() for _ in range(25)} | {b"aba", b"ba", b"ab"})
        rng.shuffle(made)
        ranks = {p: i for i, p in enumerate(sorted(pieces) + made)}
        assert byte_fold.stepwise_pieces(ranks)
        library = tiktoken.Encoding("own", pat_str=r"[ab]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 3, 7, 20, 90]))) for _ in range(150)]
        df = spark.createDataFrame([(w.encode(),) for w in words], "w binary")
        for r in df.select("w", byte_fold.fold_word(F.col("w"), ranks).alias("ids")).collect():
            assert list(r["ids"]) == library.encode_ordinary(bytes(r["w"]).decode())


def test_words_of_many_small_slices(spark, library, monkeypatch):
    texts = [f"word{i % 7} and {'x' * (i % 5)} again" for i in range(60)]
    monkeypatch.setattr(byte_fold, "SLICE_WORDS", 3)
    monkeypatch.setattr(byte_fold, "COMMON_DOCS", 20)
    monkeypatch.setattr(byte_fold, "SLICE_TOTAL", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = encoded(df)
    assert all(got[i, t] == library.encode_ordinary(t) for i, t in enumerate(texts))


def test_empty_table_and_null_ids(spark, no_docs):
    assert byte_fold.encode(no_docs).collect() == []
    row = spark.createDataFrame([(None,), ([],)], "ids array<int>").select(byte_fold.decode(F.col("ids")).alias("b"), byte_fold.little_endian(F.col("ids"), 10).alias("l")).collect()
    assert [bytes(r["b"]) for r in row] == [b"", b""] and [bytes(r["l"]) for r in row] == [b"", b""]


def test_query_digests(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = queries.op13_byte_fold(spark, SF001).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
