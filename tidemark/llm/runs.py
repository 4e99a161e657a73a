"""Groups of rows from a stream of Arrow batches that is sorted by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table per run of equal integer keys; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        starts = np.concatenate(([0], np.flatnonzero((own[1:] != own[:-1]).any(axis=1)) + 1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
            if held and (own[s] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = own[s]
    if held:
        yield pa.Table.from_batches(held)
