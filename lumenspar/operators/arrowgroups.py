"""Whole groups out of sorted Arrow batches, without one Python call per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def _changes(cols: list[pa.ChunkedArray]) -> np.ndarray:
    """True where a row's key differs from the row before (the first row: True)."""
    n = len(cols[0])
    out = np.zeros(n, bool)
    if n:
        out[0] = True
    for c in cols:
        a = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if isinstance(a, pa.ChunkedArray):
            a = a.chunk(0)
        if pa.types.is_integer(a.type) and a.null_count == 0:
            v = a.to_numpy(zero_copy_only=False)
        else:
            d = a.dictionary_encode()
            v = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        out[1:] |= v[1:] != v[:-1]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of at least `least` rows that end where a group ends, with the index at which each group begins.

    The rows must come sorted by `keys`. Only the group that is still open is carried over, so memory is bounded by
    a batch plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def flush(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        nonlocal held, rows
        t = pa.Table.from_batches(held).combine_chunks()
        start = np.flatnonzero(_changes([t.column(k) for k in keys]))
        if last:
            held, rows = [], 0
            if t.num_rows:
                yield t, start
            return
        cut = int(start[-1]) if len(start) else 0
        rest = t.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
        if cut:
            yield t.slice(0, cut), start[:-1]

    bound = least
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= bound:
            yield from flush(False)
            bound = max(least, 2 * rows)  # a long open group is not looked at again at each batch
    if held:
        yield from flush(True)


def map_groups(df, keys: list[str], order: list[str], schema: str, fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch], partition: list[str] | None = None):
    """fn over tables of whole groups: shuffled by `partition` (default: keys), sorted by keys and order."""

    def run(batches):
        for t, start in whole_groups(batches, keys):
            out = fn(t, start)
            if out.num_rows:
                yield out

    return df.repartition(*(partition or keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
