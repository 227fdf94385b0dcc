"""Counts of hashes in a fixed number of buckets, summed over all tasks.

A bucket's count is at least that of every hash in it. What travels is the buckets that a task has
filled, in chunks; what reaches the driver has a fixed size whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of a chunk, and tasks whose counts meet in one group at most.
CHUNK_BITS, FAN_IN = 16, 256


def chunks(buckets: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk, positions in it, counts) of the filled buckets of one task."""
    for chunk in range(len(buckets) >> CHUNK_BITS):
        part = buckets[chunk << CHUNK_BITS : (chunk + 1) << CHUNK_BITS]
        at = np.flatnonzero(part)
        if len(at):
            yield chunk, at.astype("u2").tobytes(), part[at].astype("i8").tobytes()


def collected(counts: DataFrame, size: int, pack: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``pack`` of the sums of every chunk, one after the other, as bytes; ``size`` is the number of
    buckets, and ``counts`` has chunk, task, at, held. Chunks that no task has filled are zeros."""

    def summed(rows: pd.DataFrame) -> np.ndarray:
        total = np.zeros(1 << CHUNK_BITS, np.int64)
        for at, held in zip(rows["at"], rows["held"]):
            total[np.frombuffer(at, "u2")] += np.frombuffer(held, "i8")
        return total

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        _, at, held = next(chunks(summed(rows)))
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "at": [at], "held": [held]})

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [rows["chunk"].iloc[0]], "bits": [pack(summed(rows)).tobytes()]})

    parts = counts.select("chunk", F.floor(F.col("task") / FAN_IN).cast("int").alias("part"), "at", "held").groupBy("chunk", "part").applyInPandas(merged, "chunk int, at binary, held binary")
    step = len(pack(np.zeros(1 << CHUNK_BITS, np.int64)).tobytes())
    out = np.zeros((size >> CHUNK_BITS) * step, np.uint8)
    for row in parts.groupBy("chunk").applyInPandas(packed, "chunk int, bits binary").toLocalIterator():
        out[row["chunk"] * step : (row["chunk"] + 1) * step] = np.frombuffer(row["bits"], np.uint8)
    return out
