"""What the two vector operators share: parsing vectors, and tasks that meet one block of targets with many queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def parse(column: pa.Array) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Each vector in double precision, or None where it is null, empty, zero or holds a null or non-finite component; and which are usable."""
    rows, good = [], np.zeros(len(column), bool)
    for i, value in enumerate(column):
        if not value.is_valid or value.values.null_count or not len(value.values):
            rows.append(None)
            continue
        vector = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
        if np.isfinite(vector).all() and vector.any():
            rows.append(vector)
            good[i] = True
        else:
            rows.append(None)
    return rows, good


def doubles(column: pa.Array) -> np.ndarray:
    """Fixed-size rows of a binary column of doubles (all of one length) as a matrix."""
    column = pa.concat_arrays([column])  # offsets from zero
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(np.float64).reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch], keys: list[str], kind: str, rows: int, met: Callable) -> Iterator[pa.RecordBatch]:
    """Run ``met(key, targets, queries)`` over rows sorted by ``keys`` and ``kind`` (0 target, 1 query).

    A block's targets are gathered (their number is bounded by the layout), its
    queries come as an iterator of tables of at most ``rows`` rows.
    """
    pending: list[pa.RecordBatch] = []
    source = iter(batches)

    def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """Stretches of equal key and kind."""
        for batch in source:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in [*keys, kind]], axis=1)
            cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield tuple(values[a].tolist()), batch.slice(a, b - a)

    stream, held = pieces(), []

    def queries(key: tuple) -> Iterator[pa.RecordBatch]:
        for at, piece in stream:
            if at != (*key, 1):
                held.append((at, piece))
                return
            for a in range(0, piece.num_rows, rows):
                yield piece.slice(a, rows)

    while True:
        at, piece = held.pop() if held else next(stream, (None, None))
        if at is None:
            return
        key, pending = at[:-1], []
        while at == (*key, 0):
            pending.append(piece)
            at, piece = next(stream, (None, None))
        if at is not None:
            held.append((at, piece))
        if not pending:  # queries that meet no target
            if held and held[-1][0] == (*key, 1):
                held.pop()
            continue

        def first_then_rest(key=key):
            if held and held[-1][0] == (*key, 1):
                piece = held.pop()[1]
                for a in range(0, piece.num_rows, rows):
                    yield piece.slice(a, rows)
                yield from queries(key)

        asked = first_then_rest()
        yield from met(key, pa.Table.from_batches(pending).combine_chunks().to_batches()[0], asked)
        for _ in asked:
            pass
