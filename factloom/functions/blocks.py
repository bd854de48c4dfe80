"""Walk sorted frames group by group inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    held: pd.DataFrame | None = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist()]
        yield from (frame.iloc[lo:hi] for lo, hi in zip(cuts[:-1], cuts[1:], strict=True))
        held = frame.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield held
