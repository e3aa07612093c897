"""Substring dedup by de Bruijn compaction.

Edges of the graph are windows of ``WINDOW`` consecutive words. Every window has
an anchor, the smallest hash of its ``ANCHOR_WORDS``-word k-mers; equal windows
have equal anchors, and neighbouring windows mostly share theirs. A maximal run
of windows of a document with one anchor is a local nonbranching path, kept as
one row: anchor, digest of its words, document, first word, number of windows.

Spark joins compact the paths that repeat. An anchor of one document is no
repeat and goes. Where all paths of an anchor have the same digest, the path is
nonbranching in the whole corpus: it is one span, whose source is the smallest
document. Only where paths of an anchor differ, so that the graph branches, are
single windows compared: a second scan emits their digests, narrowed by a bitmap
of fixed size (``BITMAP_BITS``) that lets through all branching anchors and some
others, which costs time but changes nothing.

All digests are 128 bits, two independent polynomial lanes, taken from the words
at the coordinates of both sides. ``repeated_spans(..., sources=True)`` adds the
source's coordinates and ``verify`` compares the words themselves there; that
moves both texts, so it is an audit beside the main path (see README).

Defined results: a null text has no words; a document with fewer words than a
window loses none; a window repeated only within its own document, or only in
documents with the same or a null id, is no repeat; rows that repeat an id are
told apart by their text; windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import materialize, ref, schema_of, text_slices

WINDOW, ANCHOR_WORDS, BITMAP_BITS = 50, 12, 1 << 26
#: hashing takes some dozens of bytes a character, so slices are short here
HASH_CHARS = 250_000
_MASK = (1 << 64) - 1
#: one page of Spark's bitmap functions
_PAGE_BITS = 32768


def _splitmix(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of an odd number modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            k = len(self.values)
            self.values = np.concatenate([self.values, self.values * np.uint64(pow(self.base, k, 1 << 64))])
        return self.values[:n]


class _Lane:
    """One hash function of words and of word sequences, read off prefix sums."""

    def __init__(self, seed: int):
        letters = _splitmix(seed, 258)
        self.letters, p, q = letters[:256], int(letters[256]) | 1, int(letters[257]) | 1
        self.p, self.p_inverse = _Powers(p), _Powers(pow(p, -1, 1 << 64))
        self.q, self.q_inverse = _Powers(q), _Powers(pow(q, -1, 1 << 64))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.p(len(data)), out=sums[1:])
        return _mix((sums[ends] - sums[starts]) * self.p_inverse(len(data) + 1)[starts] + (ends - starts).astype(np.uint64))

    def prefix(self, words: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.q(len(words)), out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, starts: np.ndarray, counts) -> np.ndarray:
        return _mix((prefix[starts + counts] - prefix[starts]) * self.q_inverse(len(prefix))[starts] + np.uint64(1) * np.asarray(counts).astype(np.uint64))


@lru_cache(maxsize=1)
def _lanes() -> tuple[_Lane, _Lane]:
    return _Lane(0x5DEECE66D), _Lane(0x2545F4914F6CDD1D)


def word_bounds(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, starts and ends of all words, and the number of the text each word is in."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    solid = np.ones(256, bool)
    solid[[32, 9, 10, 11, 12, 13]] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], solid[data].view(np.int8), [0]])))
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return data, edges[::2], edges[1::2], np.searchsorted(begins, edges[::2], "right") - 1


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, have = values, 1
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


class _Paths:
    """Local paths of some texts: owner, anchor, first word in the text, number of windows and digests."""

    def __init__(self, texts: list[bytes | None], window: int, anchor: int):
        lanes = _lanes()
        with np.errstate(over="ignore"):
            data, starts, ends, owner = word_bounds(texts)
            self.prefixes = [lane.prefix(lane.words(data, starts, ends)) for lane in lanes]
            valid = np.flatnonzero(owner[: len(owner) - window + 1] == owner[window - 1 :]) if len(owner) >= window else np.zeros(0, np.int64)
            if not len(valid):
                self.owner = self.first = self.count = self.at = np.zeros(0, np.int64)
                self.anchor = self.digest = np.zeros(0, np.uint64)
                self.digests = (self.digest, self.digest)
                return
            grams = lanes[0].spans(self.prefixes[0], np.arange(len(owner) - anchor + 1), anchor)
            smallest = _sliding_min(grams, window - anchor + 1)[valid]
            fresh = np.concatenate([[True], (np.diff(valid) != 1) | (owner[valid[1:]] != owner[valid[:-1]]) | (smallest[1:] != smallest[:-1])])
            heads = np.flatnonzero(fresh)
            self.at, self.count = valid[heads], np.diff(np.append(heads, len(valid)))
            self.anchor, self.owner = smallest[heads], owner[self.at]
            first_word = np.searchsorted(owner, np.arange(len(texts)), "left")
            self.first = self.at - first_word[self.owner]
            self.digests = tuple(lane.spans(p, self.at, self.count + window - 1) for lane, p in zip(lanes, self.prefixes))

    def windows(self, chosen: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen paths: path number, offset and both digests of every window."""
        count = self.count[chosen]
        path = np.repeat(chosen, count)
        offset = np.arange(len(path)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            return path, offset, *(lane.spans(p, self.at[path] + offset, window) for lane, p in zip(_lanes(), self.prefixes))


def _input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(ref(id_col).isNotNull() & ref(text_col).isNotNull()).select(ref(id_col).alias("doc"), F.hash(ref(text_col)).alias("tag"), ref(text_col).cast("binary").alias("_tl_text"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


def _paths(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    new = [("anchor", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("first", T.IntegerType()), ("count", T.IntegerType())]
    schema = schema_of(docs, ["doc", "tag"], new)

    def run(batches):
        for batch, texts in text_slices(batches, "_tl_text", HASH_CHARS):
            p = _Paths(texts, window, anchor)
            owner = pa.array(p.owner)
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), _signed(p.anchor), *map(_signed, p.digests), pa.array(p.first.astype(np.int32)), pa.array(p.count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _branch_windows(docs: DataFrame, bitmap, bits: int, window: int, anchor: int) -> DataFrame:
    """(doc, tag, first, h1, h2) of the windows whose anchor is in the bitmap."""
    new = [("first", T.IntegerType()), ("h1", T.LongType()), ("h2", T.LongType())]
    schema = schema_of(docs, ["doc", "tag"], new)

    def run(batches):
        marked = np.frombuffer(bitmap.value, np.uint8)
        for batch, texts in text_slices(batches, "_tl_text", HASH_CHARS):
            p = _Paths(texts, window, anchor)
            bit = (p.anchor % np.uint64(bits)).astype(np.int64)
            path, offset, h1, h2 = p.windows(np.flatnonzero(marked[bit >> 3] >> (bit & 7) & 1), window)
            for a in range(0, len(path), 1 << 18):
                cut = slice(a, a + (1 << 18))
                owner = pa.array(p.owner[path[cut]])
                columns = [batch.column(0).take(owner), batch.column(1).take(owner), pa.array((p.first[path[cut]] + offset[cut]).astype(np.int32)), _signed(h1[cut]), _signed(h2[cut])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)


def _bitmap(anchors: DataFrame, bits: int) -> bytes:
    """Bits of the anchors modulo ``bits``, built by Spark's bitmap aggregate: ``bits`` / 8 bytes whatever the input."""
    bit = F.col("anchor").bitwiseAND(F.lit(bits - 1).cast("long"))  # a power of two: the remainder of the unsigned value
    pages = anchors.select(bit.alias("bit")).groupBy(F.expr(f"bit div {_PAGE_BITS}").alias("page")).agg(F.expr(f"bitmap_construct_agg(bit % {_PAGE_BITS})").alias("marks"))
    out = bytearray(bits // 8)
    for page, marks in pages.collect():
        out[page * _PAGE_BITS // 8 : page * _PAGE_BITS // 8 + len(marks)] = marks
    return bytes(out)


def repeated_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor_words: int = ANCHOR_WORDS, bitmap_bits: int = BITMAP_BITS, sources: bool = False) -> DataFrame:
    """(doc, tag, start, end) of words covered by windows that also start in a smaller document.

    ``tag`` tells rows with the same id apart; ends are exclusive. Spans of a
    document may overlap and touch. With ``sources`` also (source, source_tag,
    source_start) of the same words in the smallest document. Two scans of the
    documents, jobs run while the plan is built.
    """
    docs = _input(df, id_col, text_col)
    paths = materialize(_paths(docs, window, anchor_words), "spans-paths")
    # the smallest document by (id, first word), and whether paths differ; grouped with partial sums on the map side
    anchors = paths.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), (F.min("h1") != F.max("h1")).alias("b1"), (F.min("h2") != F.max("h2")).alias("b2"))
    anchors = materialize(anchors.where("lo < hi").select("anchor", "lo", (F.col("b1") | F.col("b2")).alias("branches")), "spans-anchors")
    whole = paths.join(anchors.where("not branches").select("anchor", "lo"), "anchor").where("doc > lo")
    names = ["doc", "tag", F.col("first").alias("start"), (F.col("first") + F.col("count") + (window - 1)).alias("end")]
    if sources:
        whole = whole.join(_sources(paths, ["anchor"]), ["anchor", "lo"])
        names += [F.col("lo").alias("source"), F.col("at.tag").alias("source_tag"), F.col("at.first").alias("source_start")]
    whole = whole.select(*names)
    bitmap = df.sparkSession.sparkContext.broadcast(_bitmap(anchors.where("branches"), bitmap_bits))
    windows = materialize(_branch_windows(docs, bitmap, bitmap_bits, window, anchor_words), "spans-windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("h1", "h2", "lo")
    parts = windows.join(materialize(least, "spans-least"), ["h1", "h2"]).where("doc > lo")
    names[3] = (F.col("first") + window).alias("end")
    if sources:
        parts = parts.join(_sources(windows, ["h1", "h2"]), ["h1", "h2", "lo"])
    return whole.unionByName(parts.select(*names))


def _sources(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One place of each key in each document."""
    return rows.groupBy(*keys, F.col("doc").alias("lo")).agg(F.min(F.struct("first", "tag")).alias("at"))


def verify(spans: DataFrame, df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans (with sources) and ``equal``: whether the words at both coordinates are the same.

    Each side's words are cut out where its text is and only digests of them
    meet; a span without its document is not equal.
    """
    spans = materialize(spans.withColumn("span", F.monotonically_increasing_id()), "spans-verify")
    asked = spans.select(F.explode(F.array(F.struct("doc", "tag", "start", "end", "span"), F.struct(F.col("source").alias("doc"), F.col("source_tag").alias("tag"), F.col("source_start").alias("start"), (F.col("source_start") + F.col("end") - F.col("start")).alias("end"), "span"))).alias("a")).select("a.*")
    asked = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end", "span")).alias("cuts"))
    docs = _input(df, id_col, text_col).dropDuplicates(["doc", "tag"]).join(asked, ["doc", "tag"]).select("_tl_text", "cuts")

    def run(batches):
        for batch, texts in text_slices(batches, "_tl_text", HASH_CHARS):
            numbers, digests = [], []
            for text, cuts in zip(texts, batch.column(1).to_pylist()):
                words = text.split()
                for cut in cuts:
                    numbers.append(cut["span"])
                    digests.append(hashlib.sha256(b" ".join(words[cut["start"] : cut["end"]])).digest())
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(digests, pa.binary())], names=["span", "digest"])

    found = docs.mapInArrow(run, "span long, digest binary").groupBy("span").agg(F.count("*").alias("n"), (F.min("digest") == F.max("digest")).alias("same"))
    return spans.join(found, "span", "left").withColumn("equal", F.coalesce((F.col("n") == 2) & F.col("same"), F.lit(False))).drop("span", "n", "same")


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """Per row: id, n_words, n_removed, spans (start, end; merged) and kept_text, the other words joined by one space."""
    spans = repeated_spans(df, id_col=id_col, text_col=text_col, window=window, **options)
    # equal rows find equal spans: a set keeps one of each, on the map side already
    spans = spans.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    docs = df.select(ref(id_col).alias("id"), F.hash(ref(text_col)).alias("_tl_tag"), ref(text_col).cast("binary").alias("_tl_text"))
    docs = docs.join(spans, (docs.id == spans.doc) & (docs._tl_tag == spans.tag), "left").select("id", "_tl_text", F.array_sort("spans").alias("spans"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = schema_of(docs, ["id"], [("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", span), ("kept_text", T.StringType())])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for batch, texts in text_slices(batches, "_tl_text", HASH_CHARS):
            lists = batch.column(batch.schema.get_field_index("spans"))
            n_words, n_removed, merged, kept = [], [], [], []
            for i, text in enumerate(texts):
                words = text.split() if text else []
                joined = _merge(lists[i])
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in joined))
                merged.append([{"start": a, "end": b} for a, b in joined])
                cuts = [0, *(x for s in joined for x in s), len(words)]
                kept.append(b" ".join([w for a, b in zip(cuts[::2], cuts[1::2]) for w in words[a:b]]).decode("utf-8", "replace"))
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _merge(spans: pa.Scalar) -> list[tuple[int, int]]:
    if not spans.is_valid or not len(spans.values):
        return []
    starts, ends = (spans.values.field(i).to_numpy() for i in (0, 1))
    reach = np.maximum.accumulate(ends)
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[fresh].tolist(), reach[np.append(fresh[1:], len(starts)) - 1].tolist()))
