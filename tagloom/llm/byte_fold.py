"""Byte-level BPE encoding and decoding: ranked merges folded by Spark over the distinct words.

0. Words that many documents of a sample (``SAMPLE_DOCS``) share are encoded first; they need
   not travel. At most ``COMMON_WORDS`` of at most ``COMMON_BYTES`` bytes go to all
   tasks, and no result depends on which.
1. A pass over the texts cuts them into words (matches of the split pattern) and
   writes one row a document, with its words as numbers into the table of its
   *slice*, and one row a slice with that table. A slice is what one task met
   until its table held ``SLICE_WORDS`` words or ``SLICE_CHARS`` characters, so
   neither a task's memory nor a later group grows with the corpus. The rows are
   bucketed by slice, so they are not moved again.
2. The words of all slices meet by word. Each distinct word is encoded once: its
   bytes start as pieces, and a fold (``aggregate`` over as many steps as the word
   has bytes) merges the neighbouring pair of least rank until none is left. The
   ranks are a literal map: two arrays by slot, a piece in one of the two slots that
   its hash names.
3. (slice, number, ids) goes back to its slice and the documents look their ids up
   by number. Decoding concatenates the binary pieces of a literal table.

Bytes are handled as Latin-1 characters inside the fold, one character a byte.
In long words one step merges every occurrence of the least pair, left to right,
where that equals one merge at a time: merging makes pairs that hold the new piece only, so
the order can differ only if the piece followed or preceded by another makes a
piece of lower rank. Pieces with such a neighbour in the vocabulary are found
beforehand, and of those one occurrence is merged a step.

Results: a null or empty text has no ids and decodes to nothing; repeated rows
are encoded alike; columns that are not kept do not matter; a kept column named
like an output is replaced by it. A word of n bytes takes up to n steps over its
pieces, so one of a million different letters is slow, but right. The pattern's
classes follow the library that is matched (its Unicode version, not that of the
``regex`` module).
"""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.llm.common import kept_columns, ref, schema_of, text_slices
from tagloom.session import ensure_checkpoint_dir

#: bounds of a slice's table of distinct words, and of the words of its documents
SLICE_WORDS, SLICE_CHARS, SLICE_TOTAL = 400_000, 8_000_000, 16_000_000
#: common words: how many at most and of how many bytes, and the sample they are found in
COMMON_WORDS, COMMON_BYTES, COMMON_DOCS, SAMPLE_DOCS = 1 << 17, 64, 3, 1 << 14
#: slots of the literal rank map (a power of two)
SLOTS = 1 << 17
#: in words of more than ``LONG`` pieces, from so many equal pairs on, a step merges all of them
LONG, MANY = 64, 16
_NONE = 2**31 - 1


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary has no piece for the bytes {missing[:5]}")
    return ranks


def stepwise_pieces(ranks: dict[bytes, int]) -> set[bytes]:
    """Pieces that with some neighbour make a piece of lower rank: their occurrences are merged one at a time."""
    found = set()
    for piece, rank in ranks.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ranks and right in ranks:
                found.update(p for p in (left, right) if ranks[p] > rank)
    return found


def rank_slots(ranks: dict[bytes, int]) -> tuple[list[str], list[int]]:
    """Pieces (Latin-1) and values (2 * rank + stepwise) by slot; each piece lies in one of its two slots."""
    import xxhash

    slow = stepwise_pieces(ranks)
    keys, values = [""] * SLOTS, [_NONE] * SLOTS

    def homes(key: str) -> tuple[int, int]:
        h = xxhash.xxh64_intdigest(key.encode(), seed=42)
        return h % SLOTS, (h >> 32) % SLOTS

    for piece, rank in ranks.items():
        key, value = piece.decode("latin-1"), 2 * rank + (piece in slow)
        at = homes(key)[0]
        for _ in range(1000):
            key, keys[at], value, values[at] = keys[at], key, values[at], value
            if not key:
                break
            first, second = homes(key)
            at = second if at == first else first
        else:
            raise ValueError(f"{len(ranks)} pieces do not fit into {SLOTS} slots")
    return keys, values


def rank_table(ranks: dict[bytes, int]) -> Column:
    """The literal rank map: struct of two arrays by slot. Constant folding makes each one literal of the plan."""
    keys, values = rank_slots(ranks)
    return F.struct(F.from_json(F.lit(json.dumps(keys)), "array<string>").alias("keys"), F.from_json(F.lit(json.dumps(values)), "array<int>").alias("values"))


def _value(table: Column, piece: Column) -> Column:
    """2 * rank + stepwise of a piece, ``_NONE`` if it is not in the vocabulary."""

    def look(h: Column) -> Column:
        one, two = h.bitwiseAND(F.lit(SLOTS - 1)).cast("int"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(SLOTS - 1)).cast("int")
        return F.when(F.get(table["keys"], one) == piece, F.get(table["values"], one)).when(F.get(table["keys"], two) == piece, F.get(table["values"], two)).otherwise(F.lit(_NONE))

    return _bind(F.xxhash64(piece), look)


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


# The state of a fold is one array of BIGINT, an entry a piece: the value of the piece with the one after it (``_NONE`` for
# the last) in the high 32 bits, its start in the low ones. The least entry is thus the first pair of least rank.

_LOW = (1 << 32) - 1


def _entry(value: Column, start: Column) -> Column:
    return F.shiftleft(value.cast("long"), 32).bitwiseOR(start)


def _start(entries: Column, i: Column, size: Column) -> Column:
    """Start of piece ``i``; behind the last one the word's size."""
    return F.coalesce(F.get(entries, i).bitwiseAND(F.lit(_LOW)), size)


def _present(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def _part(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def _merge_one(word: Column, entries: Column, least: Column) -> Column:
    """Merge the first pair of least rank. (Index lambdas: slices and their concatenation cost several times as much.)"""
    text, table, size = word["text"], word["table"], word["size"]

    def at(i: Column) -> Column:
        here, after = least.bitwiseAND(F.lit(_LOW)), _start(entries, i + 2, size)
        own = F.when(after < size, _value(table, _part(text, here, _start(entries, i + 3, size)))).otherwise(F.lit(_NONE))
        before = lambda e: _entry(_value(table, _part(text, e.bitwiseAND(F.lit(_LOW)), after)), e.bitwiseAND(F.lit(_LOW)))
        return _present(F.transform(entries, lambda e, j: F.when(j == i, _entry(own, here)).when(j == i - 1, before(e)).when(j == i + 1, F.lit(None)).otherwise(e)))

    return _bind(F.array_position(entries, least).cast("int") - 1, at)


def _merge_all(word: Column, entries: Column, rank: Column) -> Column:
    """Merge all pairs of least rank, of overlapping ones every second: 111 becomes 101."""
    text, table, size = word["text"], word["table"], word["size"]
    marked = F.array_join(F.transform(entries, lambda e: F.when(F.shiftright(e, 32) == rank, "1").otherwise("0")), "")

    def with_marks(mark: Column) -> Column:
        here = lambda i: F.coalesce(F.get(mark, i) == "1", F.lit(False))
        after = lambda i: F.when(here(i), i + 2).otherwise(i + 1)

        def merged(e: Column, i: Column) -> Column:
            start, follows = e.bitwiseAND(F.lit(_LOW)), after(i)
            value = F.when(F.get(entries, follows).isNull(), F.lit(_NONE)).otherwise(_value(table, _part(text, start, _start(entries, after(follows), size))))
            return F.when((i > 0) & here(i - 1), F.lit(None)).when(here(i) | here(i + 1), _entry(value, start)).otherwise(e)

        return _present(F.transform(entries, merged))

    return _bind(F.split(F.replace(marked, F.lit("11"), F.lit("10")), ""), with_marks)


def _step(word: Column, entries: Column) -> Column:
    def with_least(least: Column) -> Column:
        rank = F.shiftright(least, 32)
        hits = F.size(F.filter(entries, lambda e: F.shiftright(e, 32) == rank))
        many = (F.size(entries) > LONG) & (rank % 2 == 0) & (hits > MANY)
        return F.when(rank == _NONE, entries).when(many, _merge_all(word, entries, rank)).otherwise(_merge_one(word, entries, least))

    return _bind(F.array_min(entries), with_least)


def fold_word(word: Column, ranks: dict[bytes, int]) -> Column:
    """Ids of one word (binary): its own if it is a piece, else those of the pieces that the fold of its bytes ends with."""

    def ids(known: Column) -> Column:
        text, table, size = known["text"], known["table"], known["size"]

        def opening(chars: Column) -> Column:
            pair = lambda c, i: F.when(i + 1 < size, _value(table, F.concat(c, F.get(chars, i + 1)))).otherwise(F.lit(_NONE))
            return F.transform(chars, lambda c, i: _entry(pair(c, i), i))

        start = _bind(F.filter(F.split(text, ""), lambda c: c != ""), opening)
        done = F.aggregate(F.sequence(F.lit(2), size), start, lambda entries, _: _step(known, entries))
        pieces = _bind(done, lambda e: F.transform(e, lambda x, i: F.shiftright(_value(table, _part(text, x.bitwiseAND(F.lit(_LOW)), _start(e, i + 1, size))), 1)))
        return _bind(_value(table, text), lambda whole: F.when(whole != _NONE, F.array(F.shiftright(whole, 1))).otherwise(pieces))

    text = F.decode(word, "ISO-8859-1")
    return _bind(F.struct(text.alias("text"), F.octet_length(word).alias("size"), rank_table(ranks).alias("table")), ids)


# --- words ---------------------------------------------------------------------------

@lru_cache(maxsize=4)
def _letters_apart() -> dict[int, str]:
    """Characters whose class differs between ``regex`` and the matched library, each with a stand-in of the latter's class."""
    import regex
    import tiktoken

    everything = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    stand_in, apart = {r"\p{L}": "a", r"\p{N}": "0", r"\s": " "}, {}
    single = {bytes([b]): b for b in range(256)}
    ours = {c: set(regex.findall(c, everything)) for c in stand_in}
    theirs = {c: set(bytes(tiktoken.Encoding("class", pat_str=c, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)).decode()) for c in stand_in}
    for c in stand_in:
        for x in ours[c] ^ theirs[c]:
            apart[ord(x)] = next((stand_in[k] for k in stand_in if x in theirs[k]), "\ue000")  # a private-use character has no class
    return apart


class Splitter:
    """Cuts texts into the matches of the split pattern."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.apart = _letters_apart()
        points = sorted(self.apart)
        starts = [p for p, q in zip(points, [None, *points]) if q is None or p != q + 1]
        ends = [p for p, q in zip(points, [*points[1:], None]) if q is None or q != p + 1]
        # the standard module holds a class of ranges as a bitmap and runs over it in one loop
        self.even = re.compile("[^" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]*").fullmatch if points else None

    def words(self, text: str) -> list[str]:
        if self.even is None or text.isascii() or self.even(text):
            return self.find(text)
        ends = np.cumsum([0] + [len(w) for w in self.find(text.translate(self.apart))]).tolist()
        return [text[a:b] for a, b in zip(ends[:-1], ends[1:])]


class _Numbers(dict):
    """Numbers words that are new by their first appearance, and counts their characters."""

    chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.chars += len(word)
        return n


def _planes(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as four planes of bytes: the high ones are nearly all zero and cost nothing once compressed."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def common_words(df: DataFrame, text_col: str, pattern: str, ranks: dict[bytes, int]) -> dict[str, list[int]]:
    """Ids of words that many documents of a sample of about ``SAMPLE_DOCS`` share, most frequent first: at most ``COMMON_WORDS``.

    They only save moving: a word that is not among them goes the general way.
    """
    sample = df.select(ref(text_col).alias("text")).sample(min(1.0, SAMPLE_DOCS / max(1, df.count())), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        for _, texts in text_slices(batches, "text"):
            seen = Counter(w for t in texts if t for w in set(split.words(t)))
            yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "docs"])

    counts = sample.mapInArrow(run, "word binary, docs long").where(F.octet_length("word") <= COMMON_BYTES).groupBy("word").agg(F.sum("docs").alias("docs"))
    top = counts.where(F.col("docs") >= COMMON_DOCS).orderBy(F.desc("docs"), "word").limit(COMMON_WORDS)
    rows = top.select("word", "docs", fold_word(F.col("word"), ranks).alias("ids")).collect()
    rows.sort(key=lambda r: (-r["docs"], bytes(r["word"])))
    return {bytes(r["word"]).decode(): list(r["ids"]) for r in rows}


def _slices(df: DataFrame, text_col: str, keep: list[str], pattern: str, common: list[str]) -> tuple[DataFrame, T.StructType]:
    """One row a document (``_tl_refs``) and one a slice (``_tl_words``), as a table bucketed by ``_tl_slice``.

    Numbers below ``len(common)`` are those of the common words, the others count the slice's own.
    """
    spark = df.sparkSession
    schema = T.StructType([T.StructField("_tl_slice", T.LongType())] + [T.StructField(f.name, f.dataType) for f in schema_of(df, keep, [])] + [T.StructField("_tl_refs", T.BinaryType()), T.StructField("_tl_words", T.ArrayType(T.BinaryType()))])
    names = [f.name for f in schema.fields]
    nested = pa.list_(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(pattern)
        first = TaskContext.get().partitionId() << 33
        known = {w: i for i, w in enumerate(common)}
        table, total, kinds = _Numbers(known), 0, None

        def table_row() -> pa.RecordBatch:
            words = pa.array([[w.encode() for w in islice(table, len(known), None)]], nested)
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *[pa.nulls(1, t) for t in kinds], pa.nulls(1, pa.binary()), words], names)

        for batch, texts in text_slices(batches, "_tl_text"):
            kinds = [batch.column(batch.schema.get_field_index(c)).type for c in keep]
            refs = []
            for text in texts:
                found = split.words(text) if text else []
                refs.append(_planes(np.fromiter(map(table.__getitem__, found), np.uint32, len(found))))
                total += len(found)
            columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(texts), first)), *columns, pa.array(refs, pa.binary()), pa.nulls(len(texts), nested)], names)
            if len(table) - len(known) > SLICE_WORDS or table.chars > SLICE_CHARS or total > SLICE_TOTAL:
                yield table_row()
                table, total, first = _Numbers(known), 0, first + 1
        if len(table) > len(known):
            yield table_row()

    rows = df.select(*[ref(c) for c in keep], ref(text_col).alias("_tl_text")).mapInArrow(run, schema)
    name = f"tagloom_words_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(buckets, "_tl_slice").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog entry only; the files stay for the frame that reads them
    return table, schema


# --- operator ---------------------------------------------------------------------------

def encode(df: DataFrame, *, ranks_path: str | None = None, pattern: str | None = None, text_col: str = "text", keep=("doc_id",), ids_col: str = "ids") -> DataFrame:
    """``keep`` columns and ``ids_col`` (array of int). Writes the cut texts while the plan is built."""
    ranks = load_ranks(ranks_path or default_ranks())
    keep = kept_columns(df, keep, [ids_col])
    common = common_words(df, text_col, pattern or default_pattern(), ranks)
    table, schema = _slices(df, text_col, keep, pattern or default_pattern(), list(common))
    words = table.where("_tl_words IS NOT NULL").select("_tl_slice", F.posexplode("_tl_words").alias("_tl_number", "_tl_word"))
    same = Window.partitionBy("_tl_word").orderBy("_tl_slice", "_tl_number")
    words = words.withColumn("_tl_nth", F.row_number().over(same))
    width = 2 if max(ranks.values()) < 1 << 16 else 4  # bytes of an id on its way
    packed = F.unhex(F.array_join(F.transform(fold_word(F.col("_tl_word"), ranks), lambda i: F.lpad(F.hex(i), 2 * width, "0")), ""))
    words = words.withColumn("_tl_own", F.when(F.col("_tl_nth") == 1, packed))
    words = words.select("_tl_slice", "_tl_number", F.first("_tl_own").over(same).alias("_tl_ids"))
    common_sizes = np.array([len(ids) for ids in common.values()], np.int64)
    common_ids = np.array([i for ids in common.values() for i in ids], np.int32)
    docs = table.where("_tl_refs IS NOT NULL").drop("_tl_words")
    out = T.StructType([*[f for f in schema.fields if f.name in keep], T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    names = [f.name for f in out.fields]

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("_tl_number")
        own = b"".join(right["_tl_ids"].to_pylist())
        sizes = np.concatenate([common_sizes, pc.binary_length(right["_tl_ids"]).to_numpy().astype(np.int64) // width])
        flat = np.concatenate([common_ids, np.frombuffer(own, f">u{width}").astype(np.int32)])
        starts = np.cumsum(sizes) - sizes
        batches = []
        for batch in left.select([*keep, "_tl_refs"]).to_batches(max_chunksize=1000):
            found, counts = [], []
            for data in batch.column(batch.num_columns - 1):
                refs = _from_planes(data.as_py())
                each = sizes[refs]
                before = np.cumsum(each) - each
                n = int(each.sum())
                found.append(flat[np.repeat(starts[refs] - before, each) + np.arange(n)])
                counts.append(n)
            offsets_out = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets_out, pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))
            batches.append(pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names))
        return pa.Table.from_batches(batches) if batches else pa.Table.from_batches([], schema=pa.schema([*[left.schema.field(c) for c in keep], pa.field(ids_col, pa.list_(pa.int32()))]))

    return docs.groupBy("_tl_slice").cogroup(words.groupBy("_tl_slice")).applyInArrow(look_up, out)


def _by_id(ids: Column, table: Column) -> Column:
    """Binary concatenation of the hexadecimal entries that the ids name."""
    return _bind(table, lambda t: F.unhex(F.array_join(F.transform(ids, lambda i: F.get(t, i)), "")))


def decode(ids: Column, ranks_path: str | None = None) -> Column:
    """The bytes that an array of ids stands for: its pieces, concatenated. Null ids decode to nothing."""
    pieces: list[str] = []
    for piece, rank in load_ranks(ranks_path or default_ranks()).items():
        pieces.extend([""] * (rank + 1 - len(pieces)))
        pieces[rank] = piece.hex()
    return F.coalesce(_by_id(ids, F.from_json(F.lit(json.dumps(pieces)), "array<string>")), F.lit(b""))


def little_endian(ids: Column, n_ids: int) -> Column:
    """Ids below ``n_ids`` as unsigned 32-bit integers, low byte first."""
    return F.coalesce(_by_id(ids, F.from_json(F.lit(json.dumps([i.to_bytes(4, "little").hex() for i in range(n_ids)])), "array<string>")), F.lit(b""))
