"""Fill-in-the-middle transformation by block rotation inside one buffer, undone by the inverse rotations.

The text is copied once, with its sentinels, into a bytearray as prefix, middle, suffix.  Two neighbouring segments
change places by reversing each and then both together, so no second copy of a text is ever made.  ``restore`` turns
the segments back and cuts the sentinels out, which gives the very bytes of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.text import raw_texts, slices, without

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MADE = T.StructType(
    [
        T.StructField("output", T.StringType()),
        T.StructField("form", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
    ]
)


def unit_starts(raw: bytes) -> np.ndarray:
    """Byte offsets of the units ``[A-Za-z]+|[^A-Za-z]``: a letter after none, or any other code point's first byte."""
    at = np.frombuffer(raw, np.uint8)
    lower = at | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A)
    first = (at & 0xC0) != 0x80
    first[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(first)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the SHA-256 of ``1:`` and the decimal id; a null id adds nothing."""
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else str(doc_id).encode())).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """``[start, cut)`` and ``[cut, end)`` change places: each is reversed, then both as one."""
    view = np.frombuffer(buffer, np.uint8)
    for a, b in ((start, cut), (cut, end), (start, end)):
        half = (b - a) // 2
        front, back = view[a : a + half], view[b - half : b][::-1]
        front[:], back[:] = back.copy(), front.copy()


def code_points(raw: bytes | memoryview) -> int:
    return int(((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).sum())


def rearrange(raw: bytes, doc_id: int | None, plain_from: int = 90, spm_below: int = 20) -> tuple[bytes, str, int, int | None, int | None]:
    """Output, form, units, and the code points of prefix and middle (None if plain)."""
    starts = unit_starts(raw)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    if not raw or h3 % 100 >= plain_from or any(mark in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return raw, "plain", n, None, None
    bounds = np.append(starts, len(raw))
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(bounds[low]), int(bounds[high])
    buffer = bytearray(raw)
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    middle_at = a + len(PREFIX)
    suffix_at = b + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle_at, suffix_at, len(buffer))  # prefix, suffix, middle
    form = "psm"
    if h4 % 100 < spm_below:
        form = "spm"
        rotate(buffer, 0, middle_at, middle_at + len(buffer) - suffix_at)  # suffix, prefix, middle
    return bytes(buffer), form, n, code_points(raw[:a]), code_points(raw[a:b])


def rebuild(output: bytes, form: str) -> bytes:
    """The text that ``rearrange`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "spm":
        rotate(buffer, 0, buffer.find(PREFIX), buffer.find(MIDDLE))
    suffix_at, middle_at = buffer.find(SUFFIX), buffer.find(MIDDLE)
    rotate(buffer, suffix_at, middle_at, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):  # from the back, so offsets in front stay right
        at = buffer.find(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def transform(docs: DataFrame, id_column: str = "doc_id", text: str = "text", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``docs`` without ``text``, plus ``output``, ``form`` (plain, psm, spm), ``n`` units, ``prefix_chars``, ``middle_chars``.

    Cuts depend on the id alone, so rows that share an id and a text get one result, and copies under other ids get
    others.  A null text counts as empty, and an empty text is plain; a null id draws like an empty one.  Texts that hold a
    sentinel stay plain.  Whole texts are used, however long.  No rows give no rows.  Columns of ``docs`` that are
    named like a result are left out.
    """
    kept = without(docs.drop(text), MADE.fieldNames())
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, *MADE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, raws = batch.column(len(names)).to_pylist(), raw_texts(batch.column(len(names) + 1))
            made = [rearrange(raw, i, plain_from, spm_below) for i, raw in zip(ids, raws)]
            output, form, n, prefix, middle = (list(x) for x in zip(*made)) if made else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[: len(names)],
                    pa.array(output, pa.binary()).cast(pa.string()),
                    pa.array(form, pa.string()),
                    *(pa.array(x, pa.int64()) for x in (n, prefix, middle)),
                ],
                [*names, *MADE.fieldNames()],
            )

    wide = docs.select(*names, docs[id_column].alias("_id"), docs[text].alias("_raw"))
    return wide.mapInArrow(run, schema)


def restore(made: DataFrame, output: str = "output", form: str = "form", restored: str = "restored") -> DataFrame:
    """``made`` plus the text rebuilt from ``output`` and ``form``; a null output is empty, a null form is plain.

    A column already named ``restored`` is replaced.  Repeated rows are rebuilt alike, and no rows give no rows.
    """
    kept = without(made, [restored])
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField(restored, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws, forms = raw_texts(batch.column(len(names))), batch.column(len(names) + 1).to_pylist()
            back = [rebuild(raw, form or "plain") for raw, form in zip(raws, forms)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(back, pa.binary()).cast(pa.string())], [*names, restored]
            )

    return made.select(*names, made[output].alias("_output"), made[form].alias("_form")).mapInArrow(run, schema)
