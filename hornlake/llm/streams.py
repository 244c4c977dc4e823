"""Whole groups from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables that end where a group ends, and the groups' bounds; rows come sorted by the first `keys` columns of numbers."""

    def cut(rows: pa.Table) -> list[tuple[int, int]]:
        new = np.zeros(rows.num_rows - 1, dtype=bool)
        for k in range(keys):
            values = rows.column(k).to_numpy()
            new |= values[1:] != values[:-1]
        at = (np.flatnonzero(new) + 1).tolist()
        return list(zip([0, *at], [*at, rows.num_rows], strict=True))

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        bounds = cut(held)
        if len(bounds) > 1:
            done = bounds[-1][0]
            yield held.slice(0, done).combine_chunks(), bounds[:-1]
            held = held.slice(done)
    if held is not None:
        held = held.combine_chunks()
        yield held, cut(held)
