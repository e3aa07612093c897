"""Helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.session import materialize  # noqa: F401  (the operators take it from here)

#: A word is a run of anything but these six ASCII characters (``bytes.split()`` uses the same six).
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handled in slices of about so many characters, so a task's memory does not follow the batch size.
SLICE_CHARS = 2_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_columns(df: DataFrame, keep: Iterable[str], new: Iterable[str]) -> list[str]:
    """Columns to carry through; one that has the name of a new column is replaced by it."""
    new = set(new)
    return [c for c in keep if c not in new]


def schema_of(df: DataFrame, keep: list[str], new: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t in new])


def ref(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_digest(df: DataFrame, text_col: str = "text") -> Column:
    """A digest of all columns, never null: rows have the same one if they are equal."""
    columns = [F.sha2(ref(c).cast("binary"), 256).alias(c) if c == text_col else ref(c).alias(c) for c in df.columns]
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def text_slices(batches: Iterator[pa.RecordBatch], column: str, chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Zero-copy slices of the batches with the text column as Python strings, each of about ``chars`` characters."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > chars:
                yield batch.slice(begin, i - begin), texts.slice(begin, i - begin).to_pylist()
                begin, size = i, 0
            size += int(n)
        if begin < len(lengths):
            yield batch.slice(begin), texts.slice(begin).to_pylist()
        pa.default_memory_pool().release_unused()  # workers live on; what a batch took goes back


def with_arrays(batch: pa.RecordBatch, keep: list[str], schema: T.StructType, arrays: list[pa.Array]) -> pa.RecordBatch:
    columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    return pa.RecordBatch.from_arrays(columns + arrays, names=[f.name for f in schema.fields])
