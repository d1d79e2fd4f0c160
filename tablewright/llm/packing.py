"""Best-fit-decreasing packing of token pieces into sequences.

Piece lengths are whole numbers up to the sequence size, so best-fit decreasing
over every piece of the corpus depends only on how many pieces there are of
each length.  That histogram has at most ``capacity`` rows.  Lengths are
handled in falling order; a segment tree over remaining capacities finds the
tightest open bin in logarithmic time, and equal pieces that meet equal
bins are placed as one run.  The runs say where the n-th piece of a length
goes; the pieces are numbered and placed by Spark.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.text import slices
from tablewright.session import materialise

#: Bytes of ids in one Arrow batch of pieces.
BATCH_BYTES = 8 << 20


@functools.cache
def encoder(ranks: str):
    """Byte-pair encoder over a rank file, with its end-of-text string as a special token.

    The JSON vocabulary of the same name gives the same ids through ``tokenizers``,
    six times slower; ``tests/llm`` compares the two over every code point.  Its pattern gives up on
    runs of some 1,000,000 spaces or line feeds: ``token_ids`` gives such texts to ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)}
    )


@functools.cache
def library(vocabulary: str):
    """The tokenizer of a JSON vocabulary, without truncation or padding."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


def token_ids(text: str, ranks: str) -> np.ndarray:
    """Ids of a whole text of any length; the JSON vocabulary stands beside the rank file, under the same name."""
    encode = encoder(ranks)
    try:
        return encode.encode_to_numpy(text, allowed_special=set(encode.special_tokens_set))
    except ValueError:  # the pattern ran out of its stack
        vocabulary = str(Path(ranks).with_suffix(".json"))
        return np.array(library(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n - capacity * (max(n - 1, 0) // capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, ranks: str, end_id: int, capacity: int, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``id_column, piece, start, length, ids`` (little-endian unsigned 32-bit), whole texts.

    Null text is empty: one piece that holds ``end_id`` alone.  Repeated rows and null ids are kept as they come.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    names = [id_column, "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row: list[int] = []
            out: tuple[list, ...] = ([], [], [], [])
            held = 0
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = np.append(token_ids(value or "", ranks), end_id).astype("<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    row.append(i)
                    for column, x in zip(out, (piece, start, length, ids[start : start + length].tobytes())):
                        column.append(x)
                    held += 4 * length
                if held > BATCH_BYTES:
                    yield _piece_batch(batch, row, out, names)
                    row, out, held = [], ([], [], [], []), 0
            yield _piece_batch(batch, row, out, names)

    return docs.select(id_column, text).mapInArrow(
        run, f"`{id_column}` {kind}, piece int, start bigint, length bigint, ids binary"
    )


def _piece_batch(batch: pa.RecordBatch, row: list[int], out: tuple[list, ...], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds))], names
    )


class OpenBins:
    """Open bins by remaining capacity, below a segment tree of the capacities in use."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.used[at] += n
            at //= 2

    def push(self, room: int, first: int, bins: int) -> None:
        if room and bins:
            self.ranges[room].append((first, bins))
            self._add(room, 1)

    def pop(self, room: int) -> tuple[int, int]:
        self._add(room, -1)
        return self.ranges[room].pop()

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that some open bin has."""
        at = length + self.size
        if self.used[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.used[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


@dataclass
class Runs:
    """Per length: run starts among its pieces, first bins, pieces a bin, offsets in the bin."""

    by_length: dict[int, tuple[np.ndarray, ...]]
    bins: int

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, first, per_bin, offset = self.by_length[length]
        run = np.searchsorted(start, rank, side="right") - 1
        inside = rank - start[run]
        return first[run] + inside // per_bin[run], offset[run] + inside % per_bin[run] * length


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> Runs:
    """Best-fit decreasing for ``histogram[length]`` pieces of each length.

    A bin that takes a piece becomes the tightest one for the next equal
    piece while it has room, so it takes as many in a row as fit.  The number
    of runs is bounded by capacity alone: each step uses up a range of bins or a length.
    """
    bins, runs, open_bins = 0, {}, OpenBins(capacity)
    for length in sorted(histogram, reverse=True):
        left, done, found = histogram[length], 0, []
        while left:
            room = open_bins.tightest(length)
            if room is None:
                room = capacity
                first, count = bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins.pop(room)
            per_bin = room // length
            full, part = divmod(min(left, count * per_bin), per_bin)
            found.append((done, first, per_bin, capacity - room))
            open_bins.push(room - per_bin * length, first, full)
            touched = full
            if part:
                open_bins.push(room - part * length, first + full, 1)
                touched += 1
            open_bins.push(room, first + touched, count - touched)
            placed = full * per_bin + part
            left, done = left - placed, done + placed
        runs[length] = tuple(np.array(c, np.int64) for c in zip(*found))
    return Runs(runs, bins)


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (with a long ``length`` of 1 to ``capacity``) plus ``sequence_id`` and ``offset``.

    One best-fit-decreasing packing over all pieces.  Ties are broken by ``order``
    within the partition a piece was written in; equal rows are interchangeable.
    No pieces give no rows.
    """
    columns = pieces.columns
    kept = materialise(pieces.withColumn("_part", F.spark_partition_id()), "pieces")
    counted = materialise(kept.groupBy("_part", "length").agg(F.count("*").alias("_n")), "piece-lengths")
    histogram = {r[0]: r[1] for r in counted.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    runs = best_fit_decreasing(histogram, capacity)
    # one row per written partition and length: as many as tasks, however many pieces a length has
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part", "length").orderBy(*order)
    ranked = (
        kept.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, ["_part", "length"])
        .withColumn("_rank", F.col("_before") + F.col("_row"))
        .select(*columns, "_rank")
    )
    at = columns.index("length")
    shared = pieces.sparkSession.sparkContext.broadcast(runs)  # bounded by capacity, see best_fit_decreasing

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(at).to_numpy(zero_copy_only=False)
            rank = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            by_length = np.argsort(length, kind="stable")
            bounds = np.flatnonzero(np.diff(length[by_length])) + 1
            for rows in np.split(by_length, bounds) if len(by_length) else ():
                sequence[rows], offset[rows] = shared.value.place(int(length[rows[0]]), rank[rows])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, each of at most ``capacity`` ids."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(ordered.alias("parts")).select(
        "sequence_id",
        F.expr("aggregate(parts, cast('' as binary), (whole, p) -> concat(whole, p.ids))").alias("ids"),
    )
