"""Whole groups out of Arrow batches, for work that takes the rows of a date together and all columns at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of batches that are sorted by their first `keys` columns; the last group of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(table.num_rows, bool)
        for k in range(keys):
            c = pc.fill_null(table.column(k).chunk(0).cast(pa.string()), "")
            change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(change).tolist()]
        for a, b in zip(starts, starts[1:]):
            yield table.slice(a, b - a).combine_chunks()
        held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks from 1 within each column of a matrix; NaN where that is."""
    n, k = x.shape
    order = np.argsort(x, axis=0, kind="stable")  # NaN last
    flat = np.take_along_axis(x, order, axis=0).T.ravel()
    begins = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
    begins[::n] = True
    run = np.cumsum(begins) - 1
    often = np.bincount(run, minlength=0)
    mean = np.cumsum(often) - (often - 1) / 2
    place = mean[run].reshape(k, n).T - np.arange(k) * n
    out = np.empty((n, k))
    np.put_along_axis(out, order, place, axis=0)
    return np.where(np.isnan(x), np.nan, out)
