"""Delimited records that span lines, cut in parallel.

Whether a line break ends a record depends on all quotes before it.  Seen from the start of a split there
are only two cases, inside a quoted cell or not, so one pass over the raw lines maps each case to its case at
the end of the split.  Chaining those maps along a file gives every split its start, and a second pass cuts records.  A
record that crosses splits leaves one fragment in each; only fragments are shuffled.  No file is read whole by a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Split = tuple[str, int]
HEAD, MIDDLE, TAIL = 0, 1, 2


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether the break after ``line`` lies in a quoted cell.

    A quote opens a cell at its very start only, and a doubled quote inside stays inside; other quotes are text.
    """
    if b'"' not in line:
        return inside
    at = 0
    if not inside and line[:1] != b'"':
        at = line.find(delimiter + b'"')
        if at < 0:
            return False
        at += len(delimiter)
    at += 0 if inside else 1
    while True:
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == b'"':
            at += 2
            continue
        at = line.find(delimiter + b'"', at + 1)  # the next cell that opens with a quote
        if at < 0:
            return False
        at += len(delimiter) + 1


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def split_starts(lines: DataFrame, delimiter: str) -> tuple[set[Split], bool]:
    """The splits that start inside a quoted cell, and whether any record is left open at the end of its split.

    One row per split reaches the driver, which lists the splits anyway.
    """
    cell = delimiter.encode()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found = None, []
        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != now:
                    now = (file, start)
                    found.append([file, start, False, True])
                found[-1][2] = ends_inside(line, found[-1][2], cell)
                found[-1][3] = ends_inside(line, found[-1][3], cell)
        columns = list(zip(*found)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file", "start", "outside", "inside"])

    maps = lines.mapInArrow(ends, "file string, start long, outside boolean, inside boolean").collect()
    inside, open_at_end, state = set(), False, {}
    for r in sorted(maps, key=lambda r: (r["file"], r["start"])):
        before = state.get(r["file"], False)
        if before:
            inside.add((r["file"], r["start"]))
        state[r["file"]] = r["inside"] if before else r["outside"]
        open_at_end |= state[r["file"]]
    return inside, open_at_end


def cut_records(
    spark: SparkSession, path: str, delimiter: str = ",", encodings: Mapping[str, str] | None = None, skipped: Sequence[str] = ()
) -> DataFrame:
    """(file, leads, record): every record of delimited files as text, in as many tasks as the files have splits.

    ``leads`` marks the first record of a file.  ``encodings`` names a codec for files that are not UTF-8; ``skipped`` files are left out.  Breaks inside quoted cells are kept, a carriage return
    before the break that ends a record is not, and records without any character are left out.  A cell that is
    never closed takes the rest of its file.
    """
    lines = raw_lines(spark, path)
    lines = lines.filter(~F.col("file").isin(list(skipped))) if skipped else lines
    starts, crossing = split_starts(lines, delimiter)
    shared = spark.sparkContext.broadcast((starts, dict(encodings or {})))  # one entry per split or odd file at most
    cell = delimiter.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside_at, codecs = shared.value
        now, inside, head, codec, leads = None, False, False, None, False
        held: list[bytes] = []
        rows: list[tuple] = []

        def close(kind: int | None) -> None:
            nonlocal leads
            raw = b"\n".join(held)
            if kind in (None, HEAD) and raw.endswith(b"\r"):
                raw = raw[:-1]
            held.clear()
            if raw or kind is not None:
                text = raw.decode(codec, "replace").encode() if codec else raw
                rows.append((now[0], now[1], kind, leads, text))
                leads = False

        def leave() -> None:  # what is held at the end of a split goes on in the next
            if now is not None and held:
                close(MIDDLE if head else TAIL)

        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != now:
                    leave()
                    now = (file, start)
                    inside = head = now in inside_at
                    codec, leads = codecs.get(file), start == 0
                held.append(line)
                inside = ends_inside(line, inside, cell)
                if not inside:
                    close(HEAD if head else None)
                    head = False
            yield _batch(rows)
            rows.clear()
        leave()
        yield _batch(rows)

    pieces = lines.mapInArrow(cut, "file string, start long, kind int, leads boolean, record string")
    whole = pieces.filter("kind IS NULL").select("file", "leads", "record")
    if not crossing:
        return whole
    # at most two fragments per split; a tail opens a record, middles and a head belong to the tail before them
    opened = f"max(CASE WHEN kind = {TAIL} THEN start END) OVER (PARTITION BY file ORDER BY start, kind ROWS UNBOUNDED PRECEDING)"
    fragments = pieces.filter("kind IS NOT NULL").withColumn("opened", F.expr(opened))
    parts = F.sort_array(F.collect_list(F.struct("start", "kind", "record")))
    joined = fragments.groupBy("file", "opened").agg(F.bool_or("leads").alias("leads"), parts.alias("parts"))
    return whole.unionByName(joined.select("file", "leads", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, start, kind, leads, record = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [
            pa.array(file, pa.string()), pa.array(start, pa.int64()), pa.array(kind, pa.int32()), pa.array(leads, pa.bool_()),
            pa.array(record, pa.binary()).cast(pa.string()),
        ],
        ["file", "start", "kind", "leads", "record"],
    )
