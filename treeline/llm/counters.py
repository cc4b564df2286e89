"""A table of counters over hashes, filled in tasks and summed by Spark: which hashes are frequent, in bounded room.

A hash counts in the bucket of its first bits, so a bucket holds the counts of all its hashes. What is derived from the
sums may order or salt work and must decide nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The table has 2 ** BITS counters, which are sent and summed in parts of 2 ** PART.
BITS, PART = 22, 17


class Counters:
    """One task's counters."""

    def __init__(self, bits: int = BITS):
        self.bits = bits
        self.met = np.zeros(1 << bits, dtype=np.uint32)

    def add(self, hashes: np.ndarray) -> None:
        np.add.at(self.met, bucket_of(hashes, self.bits), np.uint32(1))

    def parts(self) -> Iterator[tuple[int, int, bytes]]:
        """The parts that are not empty: their number, how many hashes they count, and their counts, compressed."""
        press, step = zstandard.ZstdCompressor(level=1), 1 << min(self.bits, PART)
        for at in range(0, 1 << self.bits, step):
            n = int(self.met[at : at + step].sum(dtype=np.int64))
            if n:
                yield at // step, n, press.compress(self.met[at : at + step].tobytes())


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).view(np.int64)


def summed(parts: DataFrame, bits: int, to: Callable[[np.ndarray, float], np.ndarray], dtype: type) -> np.ndarray:
    """parts(part, n, counts) of all tasks, a written table -> to(sums, mean load) of all buckets, which does not go by bucket, as an array of dtype.

    Sums are made and judged in tasks; the driver gets what `to` makes of them, a byte or two a bucket.
    """
    mean = (parts.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    out = pa.schema([("part", pa.int32()), ("values", pa.binary())])

    def run(batches):
        press, unpress, sums = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for part, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(unpress.decompress(counts), dtype=np.uint32)
                sums[part] = sums[part] + counts if part in sums else counts.astype(np.uint64)
        for part, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([press.compress(to(counts, mean).astype(dtype).tobytes())])], schema=out)

    found, step, unpress = np.zeros(1 << bits, dtype=dtype), 1 << min(bits, PART), zstandard.ZstdDecompressor()
    for part, values in parts.select("part", "counts").repartition("part").mapInArrow(run, "part int, values binary").toLocalIterator():
        found[part * step : (part + 1) * step] = np.frombuffer(unpress.decompress(values), dtype=dtype)
    return found
