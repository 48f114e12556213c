"""Rows with the same key, as whole groups, out of batches that are sorted by the key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def key_columns(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(batch, starts): batches cut between groups, with each group's first row and the end.

    A group that goes on in the next batch is carried over; memory holds one batch and
    one group. The first `keys` columns are integers without nulls.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        if held and (key_columns(held[-1].slice(len(held[-1]) - 1), keys) == key_columns(batch.slice(len(batch) - 1), keys)).all():
            held.append(batch)  # one group so far
            continue
        whole = _joined([*held, batch])
        k = key_columns(whole, keys)
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
        held = [whole.slice(int(starts[-1]))]
        if len(starts) > 1:
            yield whole.slice(0, int(starts[-1])), starts
    if held:
        whole = _joined(held)
        k = key_columns(whole, keys)
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
        yield whole, np.append(starts, len(whole))


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    table = pa.Table.from_batches(parts).combine_chunks()
    return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns], schema=table.schema)


def binary_matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)
