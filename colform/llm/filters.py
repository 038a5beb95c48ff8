"""Membership filters whose size follows the numbers they hold, built from a distributed table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vectortext as V


class NumberFilter:
    """A Bloom filter over 64-bit numbers: about 16 bits a number, from 1 MB up to 128 MB for 2^26 numbers and more.

    Beyond that false answers grow; they never change a result, as every user of a filter checks what it lets pass.
    """

    SLICES, LEAST, MOST = 64, 17, 24  # slices, and the logarithm of a slice's bits

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.log = (len(bits) * 8 // self.SLICES).bit_length() - 1

    @classmethod
    def log_for(cls, count: int) -> int:
        return min(max((16 * max(count, 1) // cls.SLICES).bit_length(), cls.LEAST), cls.MOST)

    @staticmethod
    def places(values: np.ndarray, log: int) -> tuple[np.ndarray, np.ndarray]:
        h = V.mix(values.view(np.uint64) ^ np.uint64(0x5BD1E995))
        base = (h >> np.uint64(58)) << np.uint64(log)
        low = np.uint64((1 << log) - 1)
        return (base | (h & low)).astype(np.int64), (base | ((h >> np.uint64(log)) & low)).astype(np.int64)

    def has(self, values: np.ndarray) -> np.ndarray:
        a, b = self.places(values, self.log)
        return ((self.bits[a >> 3] >> (a & 7).astype(np.uint8)) & (self.bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

    @classmethod
    def build(cls, numbers: DataFrame, count: int):
        """From a one-column table of ``count`` rows; returns a broadcast variable. The driver gets one row a slice."""
        log, slices = cls.log_for(count), cls.SLICES

        def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = np.unique(np.concatenate(cls.places(batch.column(0).to_numpy(), log)))
                cuts = np.searchsorted(bits, np.arange(slices + 1) << log)
                rows = [(i, (bits[cuts[i] : cuts[i + 1]] & ((1 << log) - 1)).astype(np.int32).tobytes()) for i in range(slices) if cuts[i + 1] > cuts[i]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "bits"])

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    held.setdefault(i, np.zeros(1 << log, bool))[np.frombuffer(raw.as_buffer(), np.int32)] = True
            packed = [np.packbits(x, bitorder="little").tobytes() for x in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], ["slice", "bits"])

        found = numbers.mapInArrow(scatter, "slice int, bits binary").repartition(slices, "slice").mapInArrow(gather, "slice int, bits binary").toArrow()
        bits = np.zeros(slices << (log - 3), np.uint8)
        size = 1 << (log - 3)
        for i, raw in zip(found["slice"].to_pylist(), found["bits"].to_pylist()):
            bits[i * size : (i + 1) * size] = np.frombuffer(raw, np.uint8)
        return numbers.sparkSession.sparkContext.broadcast(bits)
