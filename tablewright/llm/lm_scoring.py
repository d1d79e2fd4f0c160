"""Language-model scores from a probabilistic suffix tree over words.

A context is a run of up to ``DEPTH`` words before a position; every one that a training text holds is a candidate.
A candidate stays if the distribution of the word after it diverges from that of the context
without its oldest word, or if a longer one stays.  Distributions are smoothed: stored words are discounted and
the rest of the mass goes to the shorter context, in the end to the root, which knows
every training word and keeps a part for unknown ones.  A position is scored by the longest
suffix of its history that is in the tree.

The tree grows with the corpus and is nowhere whole.  It is cut into subtrees by the newest words of a history: a word that
is not frequent has all contexts that end with it in one subtree, after a frequent word the word before decides as well, and
so on.  Blocks of documents deal each position with its history to the shard of its subtree, once; the shard counts, tests
and scores all contexts of its subtrees by itself.  Contexts of frequent words alone are the trunk above the subtrees; their
counts, tests and whether a longer context stays come from all blocks by rounds, in which blocks ask shards for the n-grams
they hold, dealt by hash, and shards add up.  So no subtree has more positions than its oldest word has.
Words have numbers of their own; n-grams of the trunk are told apart by 64 bits of hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import Numbers, blocks_for
from tablewright.session import materialise, settle, tidy_shuffles

#: Bytes of text in a block; one task holds one block at a time.
BLOCK_BYTES = 4 << 20
#: Longest context in words.
DEPTH = 3
#: A word is frequent if more than one position holds it for so many bytes of text in a block.
FREQUENT = 8
#: Positions are dealt to subtrees in so many parts, one after another, each with the disk of its part.
PARTS = 2
#: Taken off every stored count and left to the shorter context.
DISCOUNT = 0.5
#: A context stays if N * divergence (nats) is at least so much for every word it stores.
GAIN = 3.0
#: Less than this for n * log(N / n) proves that a context seen n times does not stay by itself, if without its oldest word it is seen N
#: times.  A word that follows it m times has a chance of at least (m - DISCOUNT) / N after the shorter one, so k stored
#: words gain at most n * log(N / n) - k * log(1 - DISCOUNT), and k is at least 1.  A little is left for rounding.
LEAST_GAIN = 2 * GAIN + math.log(1 - DISCOUNT) - 1e-3
#: That is N / e at most: of what is seen less often no longer context stays.
LEAST_SEEN = math.e * LEAST_GAIN

#: Rounds after that of words, which is 0.
COUNTS, SUBTREES, TESTS, LONGER = 1, 2, 3, 4

END = "\n"  # the token that ends every text; no word holds white space


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the largest needs, one plane of bytes after another."""
    wide = np.ascontiguousarray(values, "<u8")
    width = max(1, -(-int(wide.max(initial=0)).bit_length() // 8))
    return bytes([width]) + wide.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : raw[0]] = planes.T
    return wide.view("<i8").ravel()


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def packed_lists(lists: list[np.ndarray]) -> bytes:
    """Lists of one length."""
    return squeezed(len(lists[0]).to_bytes(8, "little") + b"".join(map(packed, lists)))


def unpacked_lists(raw: bytes) -> list[np.ndarray]:
    raw = unsqueezed(raw)
    size, at, out = int.from_bytes(raw[:8], "little"), 8, []
    while at < len(raw):
        end = at + 1 + raw[at] * size
        out.append(unpacked(raw[at:end]))
        at = end
    return out


def _mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = context * np.uint64(0x9E3779B97F4A7C15) + word
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    return key


@dataclass
class Root:
    """Chances without a history: counts less ``discount``; what that frees belongs to unknown words."""

    total: int
    kinds: int
    once: int

    @property
    def discount(self) -> float:
        return (self.once + 1) / (self.kinds + 2)

    def chances(self, counts: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(counts))
        return np.where(counts > 0, counts - self.discount, self.discount * self.kinds) / self.total


class Grams:
    """The distinct n-grams of a block, for each length, sorted by hash from length 2 on: the same whatever the order of the texts.

    ``context`` is an n-gram without its last word and ``shorter`` one without its first, as places in the
    lists of the length below.  Index 0 is for length 1.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, sizes: np.ndarray, train: np.ndarray):
        """``words``: hashes; ``at``: which of them stands at each position of the texts laid end to end."""
        self.place = np.arange(len(at), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        self.learnt = np.repeat(train, sizes)
        self.keys, self.at = [words], [at]  # ``at``: the n-gram that ends at each position, or -1
        none = np.zeros(0, np.int32)
        self.held, self.context, self.shorter = [none], [none], [none]  # ``held``: how often training texts of the block hold it

    def lengthen(self, contexts: np.ndarray) -> None:
        """Adds the n-grams one word longer, of ``contexts`` (true or false for each of the longest so far)."""
        last = self.at[-1]
        open_ = self.place >= len(self.at)
        open_[1:] &= np.append(contexts, False)[last[:-1]]  # -1 is none
        ends = np.flatnonzero(open_).astype(np.int32)
        key = _mixed(self.keys[-1][last[ends - 1]], self.keys[0][self.at[0][ends]])
        order = np.argsort(key)
        key, ends = key[order], ends[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        first = ends[starts]
        mine = np.full(len(last), -1, np.int32)
        mine[ends] = np.cumsum(new, dtype=np.int32) - 1
        held = np.add.reduceat(self.learnt[ends], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        self.keys.append(key[starts])
        self.at.append(mine)
        self.held.append(held)
        self.context.append(last[first - 1])
        self.shorter.append(last[first])


def _bounds(shards: int) -> np.ndarray:
    """The least hash of each shard."""
    return np.array([-(-(s << 64) // shards) for s in range(shards)], np.uint64)


#: Rows of a block: its texts (round -1), lists for a shard, and the answers of a round to them.
_ROWS = "block int, round int, shard int, keys binary, numbers binary, sums binary"
_ROW = pa.schema(
    [("block", pa.int32()), ("round", pa.int32()), ("shard", pa.int32())] + [(c, pa.binary()) for c in ("keys", "numbers", "sums")]
)


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROW)], schema=_ROW)


def _deal(block: int, round_: int, shards: int, keys: list[np.ndarray], numbers: list[np.ndarray], *sums: list[np.ndarray]) -> list[tuple]:
    """Rows for the shards: hashes as differences, numbers and sums (8 bytes each), all in the order of hashes."""
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key, number, sums = key[order], np.concatenate(numbers)[order], [np.concatenate(s)[order] for s in sums]
    low = _bounds(shards)
    return [
        (block, round_, s, packed(np.diff(key[at], prepend=low[s])), packed(number[at]), b"".join(x[at].tobytes() for x in sums))
        for s, at in _dealt(key, low)
    ]


def _dealt(key: np.ndarray, low: np.ndarray) -> list[tuple[int, slice]]:
    cut = [*np.searchsorted(key, low).tolist(), len(key)]
    return [(s, slice(cut[s], cut[s + 1])) for s in range(len(low)) if cut[s + 1] > cut[s]]


def _answered(dealt: DataFrame, shards: int, root: Root, answers: dict[int, Callable]) -> DataFrame:
    """What the shards make of the rows dealt to them: an answer to each row.

    Rows of subtrees are answered whole.  For other rounds ``answers`` has a function of ``place, size, numbers, sums``: of all rows
    of a shard end to end in the order of blocks; ``place`` is the place of each hash among ``size`` distinct ones.
    It returns numbers and, or None, sums.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        if rows[0]["round"] == SUBTREES:
            return _rows(subtrees(rows, root))
        low = _bounds(shards)[rows[0]["shard"]]
        keys = [low + np.cumsum(unpacked(r["keys"]).view(np.uint64)) for r in rows]
        sizes = [len(k) for k in keys]
        numbers = np.concatenate([unpacked(r["numbers"]) for r in rows])
        sums = np.concatenate([np.frombuffer(r["sums"]).reshape(2, -1) for r in rows], axis=1)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        numbers, sums = answers[rows[0]["round"]](place, len(distinct), numbers, sums)
        parts = [slice(end - n, end) for end, n in zip(np.cumsum(sizes), sizes)]
        return _rows([
            (r["block"], r["round"], r["shard"], None, packed(numbers[at]), b"" if sums is None else sums[at].tobytes())
            for r, at in zip(rows, parts)
        ])

    return dealt.groupBy("round", "shard").applyInArrow(run, _ROWS)


def _count(place: np.ndarray, size: int, numbers: np.ndarray, sums: np.ndarray):
    """Round ``COUNTS``: 2 * the count of all, + 1 for the first that counted any."""
    total = np.bincount(place, numbers, size).astype(np.int64)
    counted = np.flatnonzero(numbers)[::-1]
    first = np.zeros(size, np.int64)
    first[place[counted]] = counted  # of equal places the last one assigned stays
    mine = np.zeros(len(place), bool)
    mine[first[total > 0]] = True
    return 2 * total[place] + mine, None


def _diverge(place: np.ndarray, size: int, numbers: np.ndarray, sums: np.ndarray):
    """Round ``TESTS``, of stored words with their gains and chances: 2 * the words of all, + 1 if the context stays by itself, and the chances of all."""
    kinds = np.bincount(place, numbers, size).astype(np.int64)
    gain, spent = np.bincount(place, sums[0], size), np.bincount(place, sums[1], size)
    return 2 * kinds[place] + (gain >= GAIN)[place], spent[place]


def _any(place: np.ndarray, size: int, numbers: np.ndarray, sums: np.ndarray):
    """Round ``LONGER``, of whether a longer context stays."""
    return (np.bincount(place, numbers, size) > 0)[place], None


def _left(kinds: np.ndarray, total: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """The factor on the shorter context's chance: what the discount frees, over what the stored words leave of it."""
    return DISCOUNT * kinds / np.maximum(total, 1) / np.maximum(1 - spent, 1e-12)


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the distinct ones, and where one of each stands."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return rank, order[new]


def _gains(n: np.ndarray, total: np.ndarray, shorter: np.ndarray, context: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For each context its part in the test, its stored words and their chances after the shorter one; ``n`` is 1 or more."""
    # of no rows at all, bincount makes whole numbers
    gain = np.bincount(context, n * np.log(n / total / shorter) - GAIN, size).astype(float)
    return gain, np.bincount(context, minlength=size), np.bincount(context, shorter, size).astype(float)


def subtrees(rows: list[dict], root: Root) -> list[tuple]:
    """A shard's answers to ``Block.positions``, rows of one round in the order of blocks.

    For each document of a row the sum of what its positions take from the subtrees; for each position below the trunk
    1 if it also takes the trunk's value, + 2 if its shortest context in the subtree stays.
    """
    parts = []
    for r in rows:
        *words, m, total, flags, doc = unpacked_lists(r["numbers"])
        words[-1] = np.cumsum(words[-1] >> 1 ^ -(words[-1] & 1))
        trunk, value = flags > 1, root.chances(m)
        shorter = np.where(trunk, (m - DISCOUNT) / np.maximum(total, 1), value)  # the chance of the word after the context one shorter
        value = np.where(trunk, 0.0, np.log10(value))
        parts.append((*(x.astype(np.uint32) for x in words), value, shorter, (flags >> 1).astype(np.int8), (flags & 1).astype(bool), doc.astype(np.int32)))
    *history, word, value, shorter, level, learnt, doc = (np.concatenate(x) for x in zip(*parts))
    sizes = [len(x[0]) for x in parts]
    del parts
    asks = level > 0
    at, c = np.arange(len(word), dtype=np.int32), np.zeros(len(word), np.int64)
    levels = []
    for i, older in enumerate(history):
        c, at = c[older[at] > 0], at[older[at] > 0]
        parent = c
        c, first = _ranked(c.astype(np.int64) << 32 | older[at])
        parent, size = parent[first], len(first)
        here = level[at] <= i
        mine, context = at[here], c[here]
        gram, first = _ranked(context.astype(np.int64) << 32 | word[mine])
        n = np.bincount(gram, learnt[mine], len(first)).astype(np.int64)
        total = np.bincount(context, learnt[mine], size).astype(np.int64)
        of, held = context[first], n > 0
        gain, kinds, spent = _gains(n[held], total[of[held]], shorter[mine[first[held]]], of[held], size)
        chance = np.where(held, (n - DISCOUNT) / np.maximum(total[of], 1), 0.0)[gram]
        shorter[mine] = chance
        often = np.ones(len(at), bool)
        often[here] = (total >= LEAST_SEEN)[context]  # others have no longer contexts that stay
        at, c = at[often], c[often]
        levels.append((mine, context, held[gram], chance, _left(kinds, total, spent), gain >= GAIN, parent))
    for (*_, kept, _), (*_, longer, parent) in zip(levels[-2::-1], levels[:0:-1]):
        kept[parent[longer]] = True
    shortest = np.zeros(len(word), bool)
    for i, (mine, context, stored, chance, left, kept, _) in enumerate(levels):
        k = kept[context]
        edge = level[mine] == i
        shortest[mine[edge]] = k[edge]
        # a stored word takes its chance; another one takes the factor and asks the shorter context
        takes, passes = k & stored, k & ~stored
        value[mine[takes]] = np.log10(chance[takes])
        asks[mine[takes]] = False
        value[mine[passes]] += np.log10(left[context[passes]])
    answers = asks + 2 * shortest
    out = []
    for r, end, n in zip(rows, np.cumsum(sizes), sizes):
        part = slice(end - n, end)
        docs = np.flatnonzero(np.bincount(doc[part]))
        sums = np.bincount(doc[part], value[part])[docs]
        out.append((r["block"], SUBTREES, r["shard"], packed(np.diff(docs, prepend=0)), packed(answers[part][level[part] > 0]), sums.tobytes()))
    return out


class Block:
    """A block's positions, the n-grams of the trunk and, step by step, what the rounds answered; ``table`` holds its rows.

    Index 0 is for length 1.
    """

    def __init__(self, table: pa.Table, root: Root):
        self.root = root
        self.rows: dict[int, list[dict]] = {r: [] for r in range(-1, LONGER + 1)}
        for row in table.to_pylist():
            self.rows[row["round"]].append(row)
        (text,) = self.rows.pop(-1)
        self.number = text["block"]
        self.docs = pa.ipc.open_stream(unsqueezed(text["sums"])).read_all()
        self.sizes = self.docs.column("size").to_numpy()
        words = self._sorted(0)
        order = np.argsort(unpacked(unsqueezed(text["keys"])), kind="stable")
        known, self.ids = np.empty((2, len(order)), np.int64)
        known[order] = np.concatenate([unpacked(unsqueezed(r["numbers"])) for r in words])
        self.ids[order] = np.concatenate([unpacked(unsqueezed(r["keys"])) for r in words])
        self.n, self.frequent = [known >> 1], [known & 1 > 0]
        train = self.docs.column("train").to_numpy().astype(bool)
        hashed = _mixed(self.ids.view(np.uint64), np.uint64(0))
        self.grams = g = Grams(hashed, unpacked(unsqueezed(text["numbers"])).astype(np.int32), self.sizes, train)
        for i in range(1, DEPTH + 1):
            g.lengthen(self.frequent[-1])
            self.frequent.append(self.frequent[-1][g.context[i]] & self.frequent[-1][g.shorter[i]])

    def counts_dealt(self, shards: int) -> list[tuple]:
        return _deal(self.number, COUNTS, shards, self.grams.keys[1:], self.grams.held[1:])

    def counted(self) -> None:
        """Counts of all blocks; from them the chances of stored words, and this block's part in the test of their contexts."""
        g = self.grams
        found = self._answers(COUNTS, g.keys[1:])
        self.chance = [self.root.chances(self.n[0])]
        self.gain, self.kinds, self.spent = [], [], []
        for i, (numbers, _) in enumerate(found, 1):
            n, context = numbers >> 1, g.context[i]
            self.n.append(n)
            total = self.n[i - 1][context]
            self.chance.append(np.where(n > 0, (n - DISCOUNT) / np.maximum(total, 1), 0.0))
            mine = np.flatnonzero(numbers & 1)  # every stored word counts in one block only
            parts = _gains(n[mine], total[mine], self.chance[i - 1][g.shorter[i][mine]], context[mine], len(g.keys[i - 1]))
            for sums, part in zip((self.gain, self.kinds, self.spent), parts):
                sums.append(part)

    def positions(self, shards: int, part: int | None = None, below: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions that a subtree (of one of ``PARTS``, or ``below`` a frequent word) holds, with their shards, in the order of these; and of all positions how many of the newest words are frequent."""
        g = self.grams
        at = g.at[0]
        self.history = [np.zeros(len(at), np.int64) for _ in range(DEPTH)]
        for back, older in enumerate(self.history, 1):
            older[back:] = self.ids[at[:-back]]
            older[g.place < back] = 0
            if back > 1:  # a word that training texts have too seldom ends the history
                seen = np.zeros(len(at), np.int64)
                seen[back - 1 :] = self.n[0][at[: 1 - back]]
                older[(self.history[back - 2] == 0) | (seen < LEAST_SEEN)] = 0
        level = sum((g.at[i] >= 0).astype(np.int64) for i in range(1, DEPTH + 1))
        inside = np.zeros(len(at), bool)
        for i, older in enumerate(self.history):
            if i or not below:
                inside |= (level == i) & (older > 0)
        there = np.flatnonzero(inside)
        deep = level[there]
        key = np.zeros(len(there), np.uint64)
        for i, older in enumerate(self.history):
            key = _mixed(key, np.where(deep >= i, older[there], 0).view(np.uint64))
        shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        if part is not None:
            mine = np.flatnonzero(shard * PARTS // shards == part)
            there, shard, deep = there[mine], shard[mine], deep[mine]
        # equal words side by side pack well, below the trunk equal newest words as well
        order = np.lexsort((self.ids[at[there]], shard << 32 | np.where(deep > 0, self.history[0][there], 0)))
        return there[order], shard[order], level

    def positions_dealt(self, shards: int, part: int) -> list[tuple]:
        """For each shard the histories and words of its positions, the counts of the longest context in the trunk with and without the word, and whose they are."""
        g = self.grams
        there, shard, level = self.positions(shards, part)
        deep = level[there]
        m, total = self.n[0][g.at[0][there]], np.zeros(len(there), np.int64)
        for i in range(1, DEPTH):
            below = np.flatnonzero(deep == i)
            at = there[below]
            m[below], total[below] = self.n[i][g.at[i][at]], self.n[i - 1][g.at[i - 1][at - 1]]
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[there]
        words = self.ids[g.at[0][there]]
        before = [older[there] for older in self.history]
        after = [m, total, 2 * deep + g.learnt[there], doc]
        out = []
        cut = np.flatnonzero(np.diff(shard, prepend=-1, append=-1) if len(shard) else []).tolist()
        for start, end in zip(cut, cut[1:]):
            here = slice(start, end)
            steps = np.diff(words[here], prepend=0)
            lists = [*(x[here] for x in before), steps << 1 ^ steps >> 63, *(x[here] for x in after)]
            out.append((self.number, SUBTREES, int(shard[start]), None, packed_lists(lists), b""))
        return out

    def tests_dealt(self, shards: int) -> list[tuple]:
        keys, kinds, gain, spent = (_where(x, self.frequent[:DEPTH]) for x in (self.grams.keys, self.kinds, self.gain, self.spent))
        return _deal(self.number, TESTS, shards, keys, kinds, gain, spent)

    def tested(self, shards: int) -> None:
        """Which contexts stay by themselves, and which of this block's have a longer one that stays; what the subtrees give."""
        g = self.grams
        below, _, level = self.positions(shards, below=True)
        self.of_subtrees = np.zeros(len(self.sizes))
        self.asks = (level > 0) | (self.history[0] == 0)
        answers = self._sorted(SUBTREES)
        for r in answers:
            self.of_subtrees[np.cumsum(unpacked(r["keys"]))] += np.frombuffer(r["sums"])
        found = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["numbers"]) for r in answers)])
        self.asks[below] = found & 1
        self.stays = [np.zeros(len(k), bool) for k in g.keys[:DEPTH]]
        tests = self._answers(TESTS, _where(g.keys, self.frequent[:DEPTH]))
        for i, (numbers, spent) in enumerate(tests):
            at = self.frequent[i]
            self.stays[i][at], self.kinds[i][at], self.spent[i][at] = numbers & 1, numbers >> 1, spent
        self.left = [_left(k, n, s) for k, n, s in zip(self.kinds, self.n, self.spent)]
        self.longer = [np.zeros(len(s), bool) for s in self.stays]
        stay = below[found > 1]
        for i in range(1, DEPTH):
            above = stay[level[stay] == i]
            self.longer[i - 1][g.at[i - 1][above - 1]] = True
        for i in range(DEPTH - 1, 0, -1):
            self.longer[i - 1][g.shorter[i][self.stays[i] | self.longer[i]]] = True

    def longer_dealt(self, shards: int) -> list[tuple]:
        at = self.frequent[: DEPTH - 1]
        return _deal(self.number, LONGER, shards, _where(self.grams.keys, at), _where(self.longer, at))

    def scores(self) -> pa.Table:
        """The rows of the result without ``train_tokens``."""
        g = self.grams
        for i, (found, _) in enumerate(self._answers(LONGER, _where(g.keys, self.frequent[: DEPTH - 1]))):
            self.longer[i][self.frequent[i]] = found
        chance = np.log10(self.chance[0])
        value = chance[g.at[0]]
        for i in range(1, DEPTH + 1):
            kept = (self.stays[i - 1] | self.longer[i - 1])[g.context[i]]
            # as in the subtrees
            chance = chance[g.shorter[i]]
            stored = kept & (self.n[i] > 0)
            chance[stored] = np.log10(self.chance[i][stored])
            asks = kept & (self.n[i] == 0)
            chance[asks] += np.log10(self.left[i - 1][g.context[i][asks]])
            there = np.flatnonzero(g.at[i] >= 0)
            value[there] = chance[g.at[i][there]]
        starts = np.cumsum(self.sizes) - self.sizes
        even = math.log10(self.root.total + self.root.kinds + 1)
        return pa.table({
            "id": self.docs.column("id"),
            "n_tokens": pa.array(self.sizes),
            "n_known": pa.array(np.add.reduceat((self.n[0] > 0).astype(np.int64)[g.at[0]], starts)),
            "base_score": pa.array(np.add.reduceat((np.log10(self.n[0] + 1.0) - even)[g.at[0]], starts)),
            "score": pa.array(np.add.reduceat(np.where(self.asks, value, 0.0), starts) + self.of_subtrees),
        })

    def _sorted(self, round_: int) -> list[dict]:
        return sorted(self.rows.pop(round_), key=lambda r: r["shard"])

    def _answers(self, round_: int, keys: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Numbers and sums that a round answered for the n-grams ``keys``, for each length."""
        rows = self._sorted(round_)
        order = np.argsort(np.concatenate(keys), kind="stable")
        parts = np.cumsum([len(k) for k in keys])[:-1]
        numbers = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["numbers"]) for r in rows)])
        sums = np.concatenate([np.zeros(0), *(np.frombuffer(r["sums"]) for r in rows)])
        out = []
        for found in (numbers, sums):
            back = np.zeros(len(order), found.dtype)
            if len(found):
                back[order] = found
            out.append(np.split(back, parts))
        return list(zip(*out))


def _where(lists: list[np.ndarray], at: list[np.ndarray]) -> list[np.ndarray]:
    return [x[a] for x, a in zip(lists, at)]


def hashes(tokens: list[bytes]) -> np.ndarray:
    held = np.empty(len(tokens), object)
    held[:] = tokens
    return pd.util.hash_array(held, categorize=False)


def _tokens(texts: pa.ChunkedArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, the end first and words as they are first seen; which of them stands at each position; and the tokens of each text."""
    words, counts = [], []
    for part in texts.chunks:
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(part, "")))
        flat = split.flatten()
        there = pc.greater(pc.binary_length(flat), 0)  # white space at either end leaves an empty one
        of = np.repeat(np.arange(len(split)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        words.append(flat.filter(there))
        counts.append(np.bincount(of[there.to_numpy(zero_copy_only=False)], minlength=len(split)))
    coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
    sizes = np.concatenate(counts) + 1
    at = np.zeros(sizes.sum(), np.int32)
    inside = np.ones(len(at), bool)
    inside[np.cumsum(sizes) - 1] = False
    at[inside] = coded.indices.to_numpy() + 1
    return [END.encode(), *coded.dictionary.cast(pa.binary()).to_pylist()], at, sizes


def _read(table: pa.Table, shards: int) -> pa.Table:
    """A block's texts as numbers of its tokens, and for each shard the tokens with how often its training documents and all of them hold them."""
    tokens, at, sizes = _tokens(table.column("text"))
    keys = hashes(tokens)
    train = table.column("train").combine_chunks()
    counts = np.bincount(at[np.repeat(train.to_numpy(zero_copy_only=False), sizes)], minlength=len(tokens))
    docs = pa.table({"id": table.column("id"), "size": pa.array(sizes, pa.int64()), "train": train.cast(pa.int8())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as stream:
        stream.write_table(docs)
    block = table.column("block")[0].as_py()
    shard = np.searchsorted(_bounds(shards), keys, "right") - 1
    texts = (block, -1, -1, squeezed(packed(shard)), squeezed(packed(at)), squeezed(sink.getvalue().to_pybytes()))
    order = np.argsort(shard, kind="stable")
    tokens, counts, every = [tokens[i] for i in order.tolist()], counts[order], np.bincount(at)[order]
    parts = _dealt(shard[order], np.arange(shards))
    return _rows([texts, *((block, 0, s, b" ".join(tokens[part]), packed(counts[part]), packed(every[part])) for s, part in parts)])


_STATS = "total bigint, kinds bigint, once bigint"


def _words(table: pa.Table, shards: int, often: int) -> pa.Table:
    """Round 0, of the counts of words, told apart by themselves: 2 * the count of all, + 1 if more than ``often`` positions hold the word.

    Keys are numbers of the words, small ones for frequent words and 0 for those that no training text has.
    Beside the first answer stands the shard's part of the root.
    """
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    number: Numbers = Numbers()
    places = [number.of(r["keys"].split(b" ")) for r in rows]
    place = np.concatenate(places)
    c, every = (np.bincount(place, np.concatenate([unpacked(r[k]) for r in rows])).astype(np.int64) for k in ("numbers", "sums"))
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
    ids = np.where(c > 0, 1 + rank * shards + rows[0]["shard"], 0)
    answer = 2 * c + ((c > 0) & (every > often))
    out = _rows([(r["block"], 0, r["shard"], squeezed(packed(ids[p])), squeezed(packed(answer[p])), b"") for r, p in zip(rows, places)])
    for name, n in (("total", c.sum()), ("kinds", (c > 0).sum()), ("once", (c == 1).sum())):
        out = out.append_column(name, pa.array([int(n)] + [0] * (len(rows) - 1), pa.int64()))
    return out


def score_texts(
    docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``id_column, n_tokens, n_known, train_tokens, base_score, score``, a row per row of ``docs``.

    Learns from the rows where ``train`` is true (null: not).  Tokens are A-Z lower-cased words and one
    end per text; null text is empty and has the end alone.  ``base_score`` sums log10((c + 1) / (N + V + 1)),
    ``score`` is the tree's log10 probability; unknown words are one symbol in both.  With nothing to learn from, N = V = 0 and both are 0.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    blocks = blocks_for(docs, text, block_bytes)
    shards = -(-blocks // 2)  # each gets as much as two blocks hold
    placed = docs.select(
        F.pmod(F.xxhash64(F.col(id_column), F.octet_length(text)), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_column).alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
    )
    with tidy_shuffles(spark):
        def texts_and_words() -> DataFrame:
            read = materialise(placed.groupBy("block").applyInArrow(lambda table: _read(table, shards), _ROWS), "lm-read")
            count = lambda table: _words(table, shards, block_bytes // FREQUENT)
            words = read.filter("round = 0").groupBy("shard").applyInArrow(count, f"{_ROWS}, {_STATS}")
            return words.unionByName(read.filter("round = -1"), allowMissingColumns=True)

        base = settle(spark, texts_and_words, "lm-texts")
        found = base.agg(*(F.sum(c) for c in ("total", "kinds", "once"))).first()
        root = Root(*(n or 0 for n in found))
        rows = [base.drop("total", "kinds", "once")]

        def by_block(run: Callable, schema: str) -> DataFrame:
            every = rows[0]
            for more in rows[1:]:
                every = every.union(more)
            return every.groupBy("block").applyInArrow(run, schema)

        def counts(table: pa.Table) -> pa.Table:
            return _rows(Block(table, root).counts_dealt(shards))

        def positions(part: int) -> Callable:
            def run(table: pa.Table) -> pa.Table:
                block = Block(table, root)
                block.counted()
                return _rows(block.positions_dealt(shards, part) + ([] if part else block.tests_dealt(shards)))

            return run

        def longer(table: pa.Table) -> pa.Table:
            block = Block(table, root)
            block.counted()
            block.tested(shards)
            return _rows(block.longer_dealt(shards))

        def round_of(*runs: Callable) -> None:
            dealt = [by_block(run, _ROWS) for run in runs]
            answers = {COUNTS: _count, TESTS: _diverge, LONGER: _any}
            rows.extend([materialise(_answered(rows_dealt, shards, root, answers), "lm-round") for rows_dealt in dealt])

        round_of(counts)
        round_of(*map(positions, range(PARTS)))
        round_of(longer)

    names = [id_column, "n_tokens", "n_known", "base_score", "score"]

    def score(table: pa.Table) -> pa.Table:
        block = Block(table, root)
        block.counted()
        block.tested(shards)
        return block.scores().rename_columns(names)

    scored = by_block(score, f"`{id_column}` {kind}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(id_column, "n_tokens", "n_known", F.lit(root.total).cast("long").alias("train_tokens"), "base_score", "score")
