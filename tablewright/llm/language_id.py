"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of a word and its two borders.  The n-grams
of all languages share sorted arrays of 64-bit hashes, with a column of probabilities
per language, so a lookup is a binary search.  The language with the lowest
cross-entropy per symbol wins; how low it must be, and how sure the answer is, is
calibrated on training documents that were left out of the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.text import raw_texts, slices

ORDER = 4
#: Training documents per language at most: one for each slot of a hash.
SLOTS = 600
#: Every so many-th slot is kept for calibration.
CALIBRATE = 5
#: Parts of text a task remembers before it starts anew; bounds its memory, not its results.
REMEMBERED = 200_000

_LETTERS = re.compile(r"[^\W\d_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
BORDER = 1  # stands before the first and after the last letter


def _symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``border word border`` one after the other, and each symbol's place in its word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "".join([f"\x01{w}\x01" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    return codes, np.arange(len(codes)) - np.repeat(starts, sizes)


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each place; the first ``order - 1`` are of no use."""
    h = np.full(len(codes), order, np.uint64)
    for back in range(order - 1, -1, -1):
        shifted = np.concatenate([np.zeros(back, np.uint64), codes])[: len(codes)]
        h = (h ^ shifted) * _FACTOR
        h ^= h >> np.uint64(29)
    return h


def gram_counts(words: list[str], times: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per order: distinct grams, counts, their contexts and their suffixes (hashes)."""
    codes, place = _symbols(words)
    weight = np.repeat(times, np.fromiter(map(len, words), np.int64, len(words)) + 2)
    out = []
    hashes = [np.zeros(len(codes), np.uint64)] + [_grams(codes, k) for k in range(1, ORDER + 1)]
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(place >= max(k - 1, 1))  # the first border is only ever a context
        grams, first, inverse = np.unique(hashes[k][at], return_index=True, return_inverse=True)
        counts = np.bincount(inverse, weight[at], len(grams)).astype(np.int64)
        context = hashes[k - 1][at[first] - 1] if k > 1 else np.zeros(len(grams), np.uint64)
        suffix = hashes[k - 1][at[first]] if k > 1 else np.zeros(len(grams), np.uint64)
        out.append((grams, counts, context, suffix))
    return out


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # sorted, one array per order
    chance: list[np.ndarray]  # probability of the last symbol, (gram, language)
    contexts: list[np.ndarray]
    spare: list[np.ndarray]  # mass a context leaves to the next lower order
    unseen: np.ndarray  # chance of a symbol never seen, per language
    worst: np.ndarray  # highest accepted cross-entropy per symbol
    sharpness: float

    def cross_entropies(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed -ln P of each word under each language, and its symbols."""
        codes, place = _symbols(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        chance = np.tile(self.unseen, (len(codes), 1))
        before = np.zeros(len(codes), np.uint64)
        for k in range(1, ORDER + 1):
            here = _grams(codes, k)
            usable = place >= max(k - 1, 1)
            if k > 1:
                context = np.concatenate([np.zeros(1, np.uint64), before[:-1]])
                found, at = _search(self.contexts[k - 1], context, usable)
                chance[found] *= self.spare[k - 1][at]
            found, at = _search(self.grams[k - 1], here, usable)
            chance[found] = self.chance[k - 1][at]
            before = here
        cost = -np.log(chance)
        cost[place == 0] = 0
        return np.add.reduceat(cost, np.cumsum(sizes) - sizes, axis=0), sizes - 1


def _search(table: np.ndarray, keys: np.ndarray, usable: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = np.flatnonzero(usable)
    if not len(table):
        return rows[:0], rows[:0]
    at = np.minimum(np.searchsorted(table, keys[rows]), len(table) - 1)
    hit = table[at] == keys[rows]
    return rows[hit], at[hit]


def fit(counted: dict[str, list[tuple[np.ndarray, ...]]]) -> Model:
    """Interpolated Kneser-Ney: lower orders count in how many contexts a gram continues."""
    languages = sorted(counted)
    n = len(languages)
    grams = [np.unique(np.concatenate([counted[x][k][0] for x in languages])) for k in range(ORDER)]
    contexts = [np.unique(np.concatenate([counted[x][k][2] for x in languages])) for k in range(ORDER)]
    chance = [np.zeros((len(g), n)) for g in grams]
    spare = [np.ones((len(c), n)) for c in contexts]
    alphabet = len(grams[0]) + 1
    unseen = np.full(n, 1.0 / alphabet)
    for j, language in enumerate(languages):
        lower = None
        for k in range(ORDER):
            table, counts, context, suffix = counted[language][k]
            if k < ORDER - 1:  # distinct symbols before the gram; a gram that starts a word keeps its count
                longer = counted[language][k + 1]
                kinds = np.zeros(len(table), np.int64)
                np.add.at(kinds, np.searchsorted(table, longer[3]), 1)
                counts = np.where(kinds > 0, kinds, counts)
            once, twice = int((counts == 1).sum()), int((counts == 2).sum())
            discount = once / (once + 2 * twice) if once and twice else 0.5
            ctx = np.searchsorted(contexts[k], context)
            total = np.bincount(ctx, counts, len(contexts[k]))
            kinds = np.bincount(ctx, minlength=len(contexts[k]))
            seen = total > 0
            spare[k][seen, j] = discount * kinds[seen] / total[seen]
            at = np.searchsorted(grams[k], table)
            own = np.zeros(len(grams[k]))
            own[at] = (counts - discount) / total[ctx]
            if k == 0:
                chance[0][:, j] = own + spare[0][0, j] / alphabet
                unseen[j] = spare[0][0, j] / alphabet
            else:
                # a gram that this language lacks still needs its context and suffix, which are those of any language
                chance[k][:, j] = own + spare[k][parents[k][0], j] * lower[parents[k][1]]
            if k + 1 < ORDER:
                if j == 0 and k == 0:
                    parents = [None] + [_parents(counted, languages, i, grams, contexts) for i in range(1, ORDER)]
                lower = chance[k][:, j]
    return Model(languages, grams, chance, contexts, spare, unseen, np.full(n, np.inf), 1.0)


def _parents(counted, languages, k, grams, contexts) -> tuple[np.ndarray, np.ndarray]:
    """For every gram of an order: the row of its context and of its suffix in the order below."""
    context, suffix = np.zeros(len(grams[k]), np.uint64), np.zeros(len(grams[k]), np.uint64)
    for language in languages:
        table, _, c, s = counted[language][k]
        at = np.searchsorted(grams[k], table)
        context[at], suffix[at] = c, s
    return np.searchsorted(contexts[k], context), np.searchsorted(grams[k - 1], suffix)


def _words(raw: bytes) -> list[str]:
    return _LETTERS.findall(raw.decode().lower())


class Judge:
    """Scores texts with a model; remembers the parts between white space it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.model.languages) + 1))

    def learn(self, parts: set[bytes]) -> None:
        if len(self.rows) > REMEMBERED:
            self.forget()
        new = [p for p in parts if p not in self.rows]
        words, owner = [], []
        for i, part in enumerate(new):
            found = _words(part)
            words += found
            owner += [i] * len(found)
        cost = np.zeros((len(new), self.table.shape[1]))
        if words:
            entropy, symbols = self.model.cross_entropies(words)
            np.add.at(cost, np.array(owner), np.column_stack([entropy, symbols]))
        base = len(self.rows)
        while base + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[base : base + len(new)] = cost
        self.rows.update((p, base + i) for i, p in enumerate(new))

    def entropies(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per symbol under each language, and the symbols; no letter, no symbol."""
        parts = [r.split() for r in raws]
        self.learn(set().union(*parts))
        get = self.rows.__getitem__
        sums = np.zeros((len(raws), self.table.shape[1]))
        for i, p in enumerate(parts):
            if p:
                sums[i] = self.table[np.fromiter(map(get, p), np.int64, len(p))].sum(axis=0)
        symbols = sums[:, -1]
        return sums[:, :-1] / np.maximum(symbols, 1)[:, None], symbols


def chances(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    low = np.exp(-sharpness * (entropy - entropy.min(axis=1, keepdims=True)))
    return low / low.sum(axis=1, keepdims=True)


def _sample(docs: DataFrame, id_column: str, text: str, lang: str, train: Column) -> DataFrame:
    """At most ``SLOTS`` labelled documents per language: the one with the smallest hash of each slot.

    Rows that share an id, or have none, are in one slot and give one text, the least of them.
    """
    labelled = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    mark = F.xxhash64(F.col(id_column).cast("string"))
    chosen = (
        labelled.groupBy(F.col(lang).alias("_lang"), F.pmod(mark, F.lit(SLOTS)).alias("_slot"))
        .agg(F.min(F.struct(F.xxhash64(mark).alias("h"), F.col(id_column).alias("id"))).alias("x"))
        .select("_lang", "_slot", "x.id")
    )
    # bounded: SLOTS rows per language; so is the result, however many rows have one id
    return labelled.join(F.broadcast(chosen), F.expr(f"`{lang}` = _lang AND `{id_column}` <=> id")).groupBy(
        F.col("_lang").cast("string").alias("lang"), F.col("_slot").cast("int").alias("slot")
    ).agg(F.min(text).alias("text"))


def _count_language(rows: pd.DataFrame) -> pd.DataFrame:
    words: dict[str, int] = {}
    counts = rows["slot"] % CALIBRATE != 0
    # a language that has nothing else is learned from the slots kept for calibration
    for text in rows.loc[counts if counts.any() else ~counts, "text"]:
        for w in _words(text.encode()):
            words[w] = words.get(w, 0) + 1
    counted = gram_counts(list(words), np.fromiter(words.values(), np.int64, len(words)))
    return pd.DataFrame(
        [(rows["lang"].iloc[0], k, *(a.tobytes() for a in arrays)) for k, arrays in enumerate(counted)],
        columns=["lang", "k", "grams", "counts", "context", "suffix"],
    )


def train_model(docs: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on a bounded sample of the rows where ``train`` holds; None if no labelled text has a letter."""
    sample = _sample(docs, id_column, text, lang, train)
    kinds = "lang string, k int, grams binary, counts binary, context binary, suffix binary"
    tables = sample.groupBy("lang").applyInPandas(_count_language, kinds).collect()  # n-grams of the sample
    counted: dict[str, list] = {}
    for r in sorted(tables, key=lambda r: r["k"]):
        if r["grams"] or r["lang"] in counted:  # words of one letter have no gram of the highest order
            counted.setdefault(r["lang"], []).append(
                tuple(np.frombuffer(r[c], np.int64 if c == "counts" else np.uint64) for c in ("grams", "counts", "context", "suffix"))
            )
    if not counted:
        return None
    model = fit(counted)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    left_out = sample.filter(F.col("slot") % CALIBRATE == 0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value)
        for batch in slices(batches):
            entropy, symbols = judge.entropies(raw_texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(symbols), pa.array(entropy.tolist(), pa.list_(pa.float64()))], ["lang", "symbols", "entropy"]
            )

    seen = left_out.select("lang", "text").mapInArrow(measure, "lang string, symbols double, entropy array<double>").collect()
    seen = [r for r in seen if r["symbols"] > 0 and r["lang"] in model.languages]
    if seen:
        entropy = np.array([r["entropy"] for r in seen])
        truth = np.array([model.languages.index(r["lang"]) for r in seen])
        for j in range(len(model.languages)):
            own = entropy[truth == j, j]
            if len(own):
                model.worst[j] = np.quantile(own, 0.99) + 3 * own.std()
        likelihood = [np.log(np.maximum(chances(entropy, s)[np.arange(len(truth)), truth], 1e-12)).sum() for s in SHARPNESSES]
        model.sharpness = SHARPNESSES[int(np.argmax(likelihood))]
    return model


SHARPNESSES = [2.0**k for k in range(-1, 8)]


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, plus ``lang_pred``, ``score`` (0 to 1), ``entropy`` per symbol and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, as is everything without a
    model.  ``rejected`` marks texts whose best cross-entropy lies beyond what
    training documents of that language showed.  Ties go to the language first by name.
    """
    columns = [c for c in docs.columns if c != text]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value) if shared.value else None
        for batch in slices(batches):
            n = batch.num_rows
            names, score, best, rejected = ["und"] * n, np.zeros(n), [None] * n, np.ones(n, bool)
            if judge and n:
                entropy, symbols = judge.entropies(raw_texts(batch.column(len(columns))))
                pick = entropy.argmin(axis=1)
                sure = chances(entropy, judge.model.sharpness)
                for i in np.flatnonzero(symbols > 0).tolist():
                    names[i] = judge.model.languages[pick[i]]
                    score[i] = sure[i, pick[i]]
                    best[i] = float(entropy[i, pick[i]])
                    rejected[i] = entropy[i, pick[i]] > judge.model.worst[pick[i]]
            made = [pa.array(names), pa.array(score), pa.array(best, pa.float64()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *made], [*columns, "lang_pred", "score", "entropy", "rejected"]
            )

    head = f"{fields}, " if fields else ""
    return docs.select(*columns, text).mapInArrow(
        run, f"{head}lang_pred string, score double, entropy double, rejected boolean"
    )
