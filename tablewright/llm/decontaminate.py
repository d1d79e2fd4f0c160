"""Benchmark decontamination with a generalised suffix automaton.

The automaton of the normalised test items is built once.  A document's
words stream through it; the state and the longest matching length at each word tell
which words lie in a window of some item.  Matches of at least ``window`` words
(or of a whole shorter item) are hits; a document whose hits cover too much is contaminated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import raw_texts, slices

#: Words of items in one automaton; more items are split over several, and every document meets all of them.
SHARD_WORDS = 100_000

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
_NORMAL = bytes(
    b if b >= 0x80 or b in _LETTERS else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[^\x20]+")


def words_of(raw: bytes) -> list[bytes]:
    """A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return raw.translate(_NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton over the word numbers of several items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        spelled = [[self.number.setdefault(w, len(self.number)) for w in words] for _, words in items]
        for symbols in spelled:
            last = 0
            for c in symbols:
                last = self._extend(last, c)
        self.items = [set() for _ in self.next]
        whole: dict[int, set[int]] = {}
        for k, symbols in enumerate(spelled):
            state = 0
            for c in symbols:
                state = self.next[state][c]
                up = state
                while up and k not in self.items[up]:
                    self.items[up].add(k)
                    up = self.link[up]
            if 0 < len(symbols) < window:
                whole.setdefault(state, set()).add(k)
        self.shortest = min([window, *(len(s) for s in spelled if s)])
        self._resolve(whole, spelled)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            at = self.next[last][c]
            return at if self.length[at] == self.length[last] + 1 else self._clone(last, c, at)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and c not in self.next[last]:
            self.next[last][c] = new
            last = self.link[last]
        if last >= 0:
            at = self.next[last][c]
            self.link[new] = at if self.length[at] == self.length[last] + 1 else self._clone(last, c, at)
        return new

    def _clone(self, last: int, c: int, at: int) -> int:
        copy = self._state(self.length[last] + 1, dict(self.next[at]), self.link[at])
        self.link[at] = copy
        while last >= 0 and self.next[last].get(c) == at:
            self.next[last][c] = copy
            last = self.link[last]
        return copy

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _resolve(self, whole: dict[int, set[int]], spelled: list[list[int]]) -> None:
        """For each state: the state of its last ``window`` words, and the short items it ends with, longest first."""
        states = len(self.next)
        self.windowed = [-1] * states
        self.short: list[tuple[tuple[int, int], ...]] = [()] * states
        for s in sorted(range(1, states), key=self.length.__getitem__):
            up = self.link[s]
            if self.length[s] >= self.window:
                self.windowed[s] = s if self.length[up] < self.window else self.windowed[up]
            own = tuple((len(spelled[k]), k) for k in sorted(whole.get(s, ())))
            self.short[s] = own + self.short[up]

    def hits(self, numbers: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word ranges (first, end) and the items whose windows occur."""
        found, items = [], set()
        known = np.concatenate([[False], numbers >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        following, link, length, window = self.next, self.link, self.length, self.window
        for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - first < self.shortest:
                continue  # no window fits between words that no item has
            state = matched = 0
            for i, c in enumerate(numbers[first:end].tolist(), first):
                while state and c not in following[state]:
                    state = link[state]
                    matched = length[state]
                if c in following[state]:
                    state, matched = following[state][c], matched + 1
                if matched >= window:
                    found.append((i + 1 - matched, i + 1))
                    items |= self.items[self.windowed[state]]
                for size, k in self.short[state] if state else ():
                    if size <= matched:
                        found.append((i + 1 - size, i + 1))
                        items.add(k)
        return found, items

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        get = self.number.get
        return self.hits(np.fromiter((get(w, -1) for w in words), np.int64, len(words)))


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def cut(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """``raw`` without the bytes from the first to the last word of each range."""
    spans = [m.span() for m in _WORD.finditer(raw.translate(_NORMAL))]
    out, at = [], 0
    for first, end in ranges:
        out.append(raw[at : spans[first][0]])
        at = spans[end - 1][1]
    return b"".join([*out, raw[at:]])


def _automata(benchmark: DataFrame, item: str, text: str, window: int, shard_words: int) -> list:
    """One broadcast automaton for each shard of items, each of a bounded number of words."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // (shard_words * 4)))  # a word and its separator take two bytes at least, six or so mostly
    made = []
    for shard in range(shards):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        rows = [(r[0], words_of(r[1].encode())) for r in part.collect()]  # one shard
        made.append(spark.sparkContext.broadcast(SuffixAutomaton(sorted(rows, key=repr), window)))
    return made


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    percent: int = 5,
    id_column: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` plus ``n_words, n_hit, items, contaminated, cleaned``.

    ``items`` are the distinct ids (as text, sorted) of the items whose windows
    occur; a null id adds no name, but its words count as hit.  A document is contaminated if
    some word is hit and hits make up ``percent`` of its words or more.  ``cleaned`` is the text
    without the hit spans (repeated until none is left), null where nothing is
    hit.  Null texts have no words.  Repeated rows give a row each; no items, no hits.
    """
    columns = docs.columns
    at = columns.index(text)
    shared = _automata(benchmark, item, item_text, window, shard_words)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    clash = {"n_words", "n_hit", "items", "contaminated", "cleaned"} & set(columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be hidden by the result")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [s.value for s in shared]

        def scan(words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
            ranges, names = [], set()
            for a in automata:
                found, items = a.scan(words)
                ranges += found
                names |= {a.names[k] for k in items}
            return union(ranges), names

        for batch in slices(batches):
            rows = []
            for raw in raw_texts(batch.column(at)):
                words = words_of(raw)
                ranges, names = scan(words)
                hit = sum(end - first for first, end in ranges)
                left = raw
                while ranges:
                    left = cut(left, ranges)
                    ranges, _ = scan(words_of(left))
                over = hit > 0 and 100 * hit >= percent * len(words)
                rows.append((len(words), hit, sorted(n for n in names if n is not None), over, left.decode() if hit else None))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string())
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *made], [*columns, "n_words", "n_hit", "items", "contaminated", "cleaned"]
            )

    return docs.mapInArrow(
        run, f"{fields}, n_words bigint, n_hit bigint, items array<string>, contaminated boolean, cleaned string"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, without any hit span; same columns.

    Documents over the coverage limit go whole, shorter hits are cut out of the others.
    """
    text = options.get("text", "text")
    found = contamination(docs, benchmark, **options)
    kept = found.filter(~F.col("contaminated")).withColumn(text, F.coalesce("cleaned", text))
    return kept.select(*docs.columns)


def joined_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode()).hexdigest()
