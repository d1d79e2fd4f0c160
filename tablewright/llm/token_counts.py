"""Token counts with a whole-token shortcut.

Before the job starts the vocabulary itself is encoded, each entry alone; the
strings that come back as one token are proven whole.  In the job a pre-token
that is one of them counts as one without any merging; only the others go
through the tokenizer's merges, each distinct one once per task as long as the
bounded memory of counts holds it.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablewright.llm.text import raw_texts, slices

#: Counts in each of the two generations that a worker remembers; bounds its memory, not its results.
REMEMBERED = 400_000


class Remembered:
    """Counts by key in two generations: what is asked for moves to the young one, the old one is dropped when that is full."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, keys) -> list:
        """Those of ``keys`` without a count; the others are in ``young`` from now on."""
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        new = []
        for k in keys:
            if k not in self.young:
                n = self.old.get(k)
                if n is None:
                    new.append(k)
                else:
                    self.young[k] = n
        return new


# The pre-tokenisation pattern of the vocabulary file, and the
# characters for which lower-casing and composition are plain (tested one by one).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN = r"[!-~¡-¬®-ÿ]+"

# The vocabulary writes bytes as characters: printable ones as themselves, the others from U+0100 on.
SHOWN = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
BYTE_OF = {chr(b): b for b in SHOWN} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


class WholeTokenCounter:
    """Counts tokens of UTF-8 texts as ``tokenizers`` gives them, without added ones.

    White space ends every pre-token and is dropped by the vocabulary, so a text's count
    is the sum over its parts between ASCII white space.  A part with characters
    outside ``PLAIN``, or with ``<|`` (special strings), is encoded by the library as it stands.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.whole = self._proven()
        self.split = regex.compile(PRE_TOKEN).findall
        self.plain = regex.compile(PLAIN).fullmatch
        self.parts = Remembered()
        self.merges = Remembered()

    def _proven(self) -> frozenset[str]:
        """Lower-case strings, each one pre-token, whose encoding alone is one token."""
        pattern = regex.compile(PRE_TOKEN)
        asked = []
        for entry in self.tokenizer.get_vocab():
            try:
                spelled = bytes(BYTE_OF[c] for c in entry.removesuffix("</w>")).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # special strings and parts of characters
            if spelled == spelled.lower() and regex.fullmatch(PLAIN, spelled) and pattern.findall(spelled) == [spelled]:
                asked.append(spelled)
        found = self.tokenizer.encode_batch(asked, add_special_tokens=False)
        return frozenset(x for x, e in zip(asked, found) if len(e.ids) == 1)

    def _merged(self, parts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(parts, add_special_tokens=False)]

    def learn(self, parts: set[bytes]) -> None:
        """Make sure every part has its count."""
        rest: set[str] = set()
        open_parts: list[tuple[bytes, int, list[str]]] = []
        for part in self.parts.missing(parts):
            text = part.decode()
            if self.plain(text) and "<|" not in text:
                pieces = self.split(text.lower())
                others = [p for p in pieces if p not in self.whole]
            else:
                pieces = others = [text]
            open_parts.append((part, len(pieces) - len(others), others))
            rest.update(others)
        names = self.merges.missing(rest)
        merges = self.merges.young
        merges.update(zip(names, self._merged(names)))
        self.parts.young.update((part, ones + sum(merges[p] for p in others)) for part, ones, others in open_parts)

    def count(self, raws: list[bytes]) -> list[int]:
        parts = [r.split() for r in raws]
        self.learn(set().union(*parts))
        get = self.parts.young.__getitem__
        return [sum(map(get, p)) for p in parts]


@functools.cache
def _counter(vocabulary: str) -> WholeTokenCounter:
    """One per worker process: the proof and the remembered counts serve all its tasks."""
    return WholeTokenCounter(vocabulary)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, n_bytes, n_tokens, over_limit``, one row per row of ``docs``.

    Null text counts as empty (0 bytes, 0 tokens).  Repeated rows and null ids
    give a row each; other columns are ignored; whole texts are counted.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in slices(batches):
            raws = raw_texts(batch.column(1))
            counts = counter.count(raws)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(r) for r in raws], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([c > limit for c in counts], pa.bool_()),
                ],
                [id_column, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_column, text).mapInArrow(
        run, f"`{id_column}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
