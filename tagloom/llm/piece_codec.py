"""SentencePiece encoding and decoding over a distinct-chunk table.

In a model whose pieces never run from a character into a following whitespace
marker, and none of whose pieces holds a line feed, merges cannot pass such a
place. A text is therefore cut there into marked words ("chunks": an optional
run of markers and what follows, or one line feed). Each task keeps a table of
the distinct chunks it has seen, segments every new chunk once with the model,
and joins the ids back to the texts by position with array lookups. The table is
cleared when it holds ``max_chunks`` entries, so its memory is bounded; ids do
not depend on that.

A table shared by all tasks was not chosen: it needs every marked word of the
corpus in a shuffle (about 135 million rows for 0.5 GB of Parquet), which alone
exceeds a disk budget of 1.5 times the input, and it recovers no better from a
lost executor. Here a lost task is just run again.

Defined results: a null or empty text has no ids and decodes to an empty text;
repeated rows are encoded alike; an input column named like an output is
replaced by it.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagloom.llm.common import kept_columns, ref, schema_of, text_slices, with_arrays

MARKER = "▁"
_CHUNK = re.compile(r"\n| *[^ \n]+| +")
#: entries of a task's table, and chunks segmented in one call
MAX_CHUNKS, JOINED_CHUNKS = 300_000, 512


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Distinct chunks of one task with their ids, kept as one flat array."""

    def __init__(self, model_path: str, max_chunks: int = MAX_CHUNKS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.max_chunks = max_chunks
        self._check_model()
        self._clear()

    def _check_model(self) -> None:
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in pieces if "\n" in p or re.search(f"[^{MARKER}]{MARKER}", p)]
        if crossing:
            raise ValueError(f"pieces cross whitespace markers or line feeds, e.g. {crossing[:3]}")
        #: what a line feed in front of a chunk adds: the model's own leading marker, and the line feed
        self.lead = len(self.model.encode("\n"))
        self.feed = self.model.encode("\n")[-1]
        if self.model.encode("\na")[: self.lead] != self.model.encode("\n") or self.model.encode(" a")[:1] == self.model.encode("a"):
            raise ValueError("the model normalises texts; only identity models with a leading marker can be cut into chunks")

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.bounds = np.zeros(1 << 12, np.int64)

    def _add(self, chunks: list[str]) -> None:
        """Segment new chunks; many at a time, with line feeds between them, which no piece can cross."""
        parts, sizes = [], []
        for a in range(0, len(chunks), JOINED_CHUNKS):
            group = ["" if c == "\n" else c for c in chunks[a : a + JOINED_CHUNKS]]
            ids = np.array(self.model.encode("\n" + "\n".join(group) + "\n"), np.int32)
            cuts = np.flatnonzero(ids == self.feed)
            if len(cuts) != len(group) + 1:
                raise ValueError("a chunk holds a line feed's id")
            keep = ids != self.feed
            keep[: self.lead] = False
            counts = np.diff(cuts) - 1
            if "" in group:  # a line feed is its own chunk
                feeds = np.flatnonzero([c == "" for c in group])
                keep[cuts[feeds]], counts[feeds] = True, 1
            parts.append(ids[keep])
            sizes.append(counts)
        ids, n, used = np.concatenate(parts), len(self.rows), int(self.bounds[len(self.rows)])
        ends = used + np.cumsum(np.concatenate(sizes))
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.bounds) <= n + len(ends):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.flat[used : ends[-1]] = ids
        self.bounds[n + 1 : n + 1 + len(ends)] = ends
        self.rows.update(zip(chunks, range(n, n + len(chunks))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of the texts in it."""
        chunks = [_CHUNK.findall(" " + t.replace(MARKER, " ")) if t else [] for t in texts]
        distinct = set(chain.from_iterable(chunks))
        if len(self.rows) + len(distinct) > self.max_chunks:
            self._clear()
        if new := [c for c in distinct if c not in self.rows]:
            self._add(new)
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(chunks)), np.int64)
        starts = self.bounds[rows]
        counts = self.bounds[rows + 1] - starts
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(starts - before[:-1], counts) + np.arange(before[-1])]
        return ids, before[np.concatenate([[0], np.cumsum([len(c) for c in chunks])]).astype(np.int64)]


def _ids_array(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False)))


def encode(df: DataFrame, *, model_path: str | None = None, text_col: str = "text", keep=("doc_id",), ids_col: str = "ids", decoded_col: str | None = None, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """``keep`` columns and ``ids_col`` (array of int); with ``decoded_col`` also the text that the ids decode to."""
    model_path = model_path or default_model()
    new = [(ids_col, T.ArrayType(T.IntegerType()))] + ([(decoded_col, T.StringType())] if decoded_col else [])
    keep = kept_columns(df, keep, [n for n, _ in new])
    schema = schema_of(df, keep, new)
    columns = [ref(c) for c in keep] + [ref(text_col).alias("_tl_text")]

    def run(batches):
        table = ChunkTable(model_path, max_chunks)
        for batch, texts in text_slices(batches, "_tl_text"):
            ids, offsets = table.encode(texts)
            arrays = [_ids_array(ids, offsets)]
            if decoded_col:
                arrays.append(pa.array([table.model.decode(ids[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string()))
            yield with_arrays(batch, keep, schema, arrays)

    return df.select(*columns).mapInArrow(run, schema)


def decode(df: DataFrame, *, model_path: str | None = None, ids_col: str = "ids", keep=("doc_id",), out_col: str = "decoded") -> DataFrame:
    """``keep`` columns and the text of ``ids_col``; null ids decode to an empty text."""
    model_path = model_path or default_model()
    keep = kept_columns(df, keep, [out_col])
    schema = schema_of(df, keep, [(out_col, T.StringType())])
    columns = [ref(c) for c in keep] + [ref(ids_col).alias("_tl_ids")]

    def run(batches):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("_tl_ids"))
            yield with_arrays(batch, keep, schema, [pa.array([model.decode(x.as_py()) if x.is_valid else "" for x in ids], pa.string())])

    return df.select(*columns).mapInArrow(run, schema)
