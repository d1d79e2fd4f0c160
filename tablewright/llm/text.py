"""Text helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents looked at together inside a task; bounds what a task holds beside the Arrow batch.
SLICE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def lower_words(raw: bytes) -> list[bytes]:
    """A-Z lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.

    ``bytes`` methods touch ASCII only, which is exactly that rule in UTF-8.
    """
    return raw.lower().split()


class Numbers(dict):
    """Numbers its keys 0, 1, 2, ... as they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


def crc_remainder(column: str, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def blocks_for(docs: DataFrame, text: str, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` of text hold ``docs``; at least one."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def without(docs: DataFrame, made: list[str]) -> DataFrame:
    """``docs`` without the columns that a result is about to be named like (names differ by more than case)."""
    taken = {name.lower() for name in made}
    return docs.drop(*[c for c in docs.columns if c.lower() in taken])


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices whose texts in ``column`` add up to about ``size`` bytes; one longer text is a slice of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start, before = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, end - start)
            start, before = end, int(ends[end - 1])
