"""Quality rules whose cutoffs follow the data.

Each document gets a few counts.  Their ratios go into mergeable quantile
sketches, one for each language, source and ratio: counts by logarithmic bucket, so
that merging is adding, the answer does not hang on partitioning, and a
quantile is right to a relative error of ``ACCURACY``.  Fences read from the sketches
are joined back to the documents and decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.text import Numbers, raw_texts, slices
from tablewright.session import materialise

#: Relative error of a quantile.
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: A language-and-source sketch of fewer documents is merged into its language's, that one into all.
LEAST = 200
#: Up to so many pairs of language and source the cutoffs are broadcast, else joined by a shuffle.
FEW_GROUPS = 20_000
WINDOW = 8

_SPACE = b" \t\n\r\x0b\x0c"
_NOT_FIRST = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

_CAPITALS = bytes(range(0x41, 0x5B))
_STOPS = b"!.,;:?"

#: ratio: (numerator, denominator, tolerance).  The cutoff is the far fence of the ratio's
#: logarithm: the upper quartile times the quartiles' quotient to the power SPREAD (plus SPREAD
#: times their difference where the lower one is 0).  It is never below the tolerance, so that
#: a group in which nearly all values are 0 does not lose its ordinary documents.
RATIOS = {
    "symbols": ("n_symbols", "n_words", 0.10),
    "stops": ("n_stops", "n_words", 0.25),
    "capitals": ("n_capitals", "word_chars", 0.05),
    "same_word": ("n_same", "n_words", 0.10),
    "dup_lines": ("n_dup_lines", "n_lines", 0.50),
    "repeats": ("n_repeat_words", "n_words", 0.30),
    "word_length": ("word_chars", "n_words", 1.0),
}
#: The ratio that must not be too low either.
LOW_RATIO = "word_length"
SPREAD = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_stops", "n_capitals", "n_same", "n_lines", "n_dup_lines", "n_repeat_words")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeated_words(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per document, words inside a window of ``WINDOW`` words that the document has twice or more.

    ``words`` holds the word numbers of the documents one after the other, ``counts`` how many each has.
    """
    n = len(words)
    out = np.zeros(len(counts), np.int64)
    if n < WINDOW + 1:
        return out
    owner = np.repeat(np.arange(len(counts)), counts)
    h = _mix(words)
    factor = np.full(1, 0xD6E8FEB86659FD93, np.uint64)
    step = 1
    while step < WINDOW:  # h[i] covers words i .. i + step - 1
        h = h[:-step] + factor * h[step:]
        factor = factor * factor
        step *= 2
    inside = owner[: len(h)] == owner[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    h = h[at] ^ _mix(owner[at])
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return out
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(counts)).astype(np.int64)


def document_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus a long column for each of ``COUNTS``, over whole texts; null has none."""
    columns = docs.columns
    at = columns.index(text)
    clash = set(COUNTS) & set(columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be hidden by the result")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raws = raw_texts(batch.column(at))
            number, parts, rows = Numbers(), [], []
            for raw in raws:
                ids = number.of(raw.split())
                parts.append(ids)
                worded = [x for x in raw.split(b"\n") if x.strip()]
                size = len(raw)
                rows.append((
                    len(ids),
                    len(raw.translate(None, _SPACE + _NOT_FIRST)),
                    size - len(raw.translate(None, _SYMBOLS)),
                    size - len(raw.translate(None, _STOPS)),
                    size - len(raw.translate(None, _CAPITALS)),
                    int(np.count_nonzero(ids[1:] == ids[:-1])),
                    len(worded),
                    len(worded) - len(set(worded)),
                ))
            made = np.array(rows, np.int64).reshape(-1, len(COUNTS) - 1)
            repeats = repeated_words(made[:, 0], np.concatenate([*parts, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in (*made.T.copy(), repeats))], [*columns, *COUNTS]
            )

    return docs.mapInArrow(run, f"{fields}, " + ", ".join(f"{n} bigint" for n in COUNTS))


def _bucket(value):
    return F.when(value > 0, F.ceil(F.log(value) / F.lit(float(np.log(GAMMA)))).cast("int"))


def sketches(counted: DataFrame, by: list[str]) -> DataFrame:
    """``*by, ratio, bucket, n``: one sketch per group and ratio.  Bucket null holds zeros.

    Only documents with words are sketched.  Partial counts combine before the shuffle, so a hot group costs no more.
    """
    ratios = F.array(
        *[F.struct(F.lit(r).alias("ratio"), _bucket(F.try_divide(F.col(a), F.col(b))).alias("bucket")) for r, (a, b, _) in RATIOS.items()]
    )
    return (
        counted.filter("n_words > 0")
        .select(*by, F.explode(ratios).alias("x"))
        .groupBy(*by, "x.ratio", "x.bucket")
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame, by: list[str], shares: tuple[float, ...]) -> DataFrame:
    """``*by, ratio, total, q_0, q_1, ...`` from the sketches of each group; a sketch has a bounded number of buckets."""
    group = [*by, "ratio"]
    order = Window.partitionBy(*group).orderBy(F.col("bucket").asc_nulls_first())
    ranked = sketch.withColumn("seen", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(*group)))
    middle = F.coalesce(F.lit(2 * GAMMA / (GAMMA + 1)) * F.pow(F.lit(GAMMA), F.col("bucket") - 1), F.lit(0.0))
    picks = [
        F.min(F.when(F.col("seen") >= F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("total"))), middle)).alias(f"q_{i}")
        for i, s in enumerate(shares)
    ]
    return ranked.groupBy(*group).agg(F.first("total").alias("total"), *picks)


def fences(counted: DataFrame, lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """``lang, source, ratio, low, high`` for every pair that occurs (nulls are values of their own).

    A pair with fewer than ``least`` documents takes the fences of its language, a small language those of all.
    """
    fine = materialise(sketches(counted, [lang, source]), "sketches")
    found = fine.select(lang, source, "ratio").distinct()
    for i, by in enumerate(([lang, source], [lang], [])):
        merged = fine.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
        read = quantiles(merged, by, (0.25, 0.75)).select(
            *[F.col(c).alias(f"_{c}") for c in (*by, "ratio")],
            F.struct("total", F.col("q_0").alias("q1"), F.col("q_1").alias("q3")).alias(f"level_{i}"),
        )
        same = " AND ".join(f"`{c}` <=> `_{c}`" for c in (*by, "ratio"))
        found = found.join(read, F.expr(same)).drop(*[f"_{c}" for c in (*by, "ratio")])
    chosen = F.expr(f"CASE WHEN level_0.total >= {least} THEN level_0 WHEN level_1.total >= {least} THEN level_1 ELSE level_2 END")
    tolerance = F.create_map(*[F.lit(x) for r, (_, _, least_high) in RATIOS.items() for x in (r, least_high)])
    high = F.expr(f"CASE WHEN q.q1 > 0 THEN q.q3 * power(q.q3 / q.q1, {SPREAD}) ELSE q.q3 + {SPREAD} * (q.q3 - q.q1) END")
    low = F.expr(f"CASE WHEN ratio = '{LOW_RATIO}' AND q.q1 > 0 THEN q.q1 * power(q.q1 / q.q3, {SPREAD}) ELSE 0D END")
    return found.withColumn("q", chosen).select(
        lang, source, "ratio", low.alias("low"), F.greatest(high, tolerance[F.col("ratio")]).alias("high")
    )


def judge(counted: DataFrame, lang: str = "lang", source: str = "source", least: int = LEAST) -> DataFrame:
    """``counted`` plus ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated windows.  The
    others are kept if every ratio lies within the fences of their language and source.
    """
    wide = (
        fences(counted, lang, source, least)
        .groupBy(F.col(lang).alias("_lang"), F.col(source).alias("_source"))
        .agg(*[F.max(F.when(F.col("ratio") == r, F.col(side))).alias(f"_{side}_{r}") for r in RATIOS for side in ("low", "high")])
    )
    wide = materialise(wide, "fences")
    if wide.count() <= FEW_GROUPS:
        wide = F.broadcast(wide)
    joined = counted.join(wide, F.expr(f"`{lang}` <=> _lang AND `{source}` <=> _source"), "left")
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    fine = F.lit(True)
    for r, (a, b, _) in RATIOS.items():
        fine = fine & F.try_divide(F.col(a), F.col(b)).between(F.col(f"_low_{r}"), F.col(f"_high_{r}"))
    return joined.select(
        *counted.columns, failed.alias("base_failed"), F.coalesce(~failed & fine, F.lit(False)).alias("kept")
    )


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``docs`` plus the counts, ``base_failed`` and ``kept``; every row stays.

    Null and empty texts have no words and fail the base; null languages and sources
    are groups of their own; repeated rows are counted as often as they come.
    """
    return judge(document_counts(docs, text), lang, source)
