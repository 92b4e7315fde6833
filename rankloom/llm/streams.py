"""Streaming over Arrow batches that come sorted by a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """Whole runs of equal keys: (run starts and the end, columns), as many runs at a time as a batch completes."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = {c: b[c].to_numpy(zero_copy_only=False) for c in b.schema.names}
        if held and now[key][0] == held[0][key][0] and now[key][-1] == now[key][0]:
            held.append(now)  # still the same run
            continue
        held.append(now)
        now = {c: np.concatenate([h[c] for h in held]) for c in now}
        keys = now[key]
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        held = [{c: v[cut:] for c, v in now.items()}]
        if cut:
            yield np.append(np.flatnonzero(np.concatenate(([True], keys[1:cut] != keys[: cut - 1]))), cut), {c: v[:cut] for c, v in now.items()}
    if held:
        now = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        yield np.array([0, len(now[key])]), now
