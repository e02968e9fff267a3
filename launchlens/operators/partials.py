"""Sums over a frame that tasks prepare in numpy: one state for each partition, combined in rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

__all__ = ["batches_of", "combined"]

#: States that one task combines.
FAN_IN = 16
#: Up to so many states go to the driver.
LAST = 64
_STATE = "part long, state binary"


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[np.ndarray]:
    """All columns as one matrix of doubles, up to ``rows`` rows at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            part = batch.slice(begin, rows)
            yield np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in part.columns])


def combined(df: DataFrame, state_of: Callable[[Iterator[pa.RecordBatch]], np.ndarray], join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """One array out of those that ``state_of`` makes of each partition with rows; None without rows.

    More than a few states are combined in tasks first, a fixed number at a time, so
    neither the driver nor a task gets a number of states that grows with the data.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        full = (b for b in batches if b.num_rows)
        first = next(full, None)
        if first is None:
            return

        def chain() -> Iterator[pa.RecordBatch]:
            yield first
            yield from full

        state = np.ascontiguousarray(state_of(chain()), np.float64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([state.tobytes()], pa.binary())], ["part", "state"])

    def fold(states: list[bytes]) -> np.ndarray:
        out = np.frombuffer(states[0])
        for state in states[1:]:
            out = join(out, np.frombuffer(state))
        return out

    def merge(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("part").to_pylist(), group.column("state").to_pylist()))
        return pa.table({"part": pa.array([found[0][0] // FAN_IN], pa.int64()), "state": pa.array([fold([s for _, s in found]).tobytes()], pa.binary())})

    parts = df.rdd.getNumPartitions()
    states = df.mapInArrow(work, _STATE)
    while parts > LAST:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, _STATE)
        parts = -(-parts // FAN_IN)
    found = sorted((r["part"], bytes(r["state"])) for r in states.collect())
    return fold([s for _, s in found]) if found else None
