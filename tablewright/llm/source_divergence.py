"""How the sources of each language differ in wording, from chunks that are tokenized once.

Whitespace chunks are counted per document inside the tasks; only (language, source, chunk) totals are shuffled.  The chunk of
each total is then cut into terms once, in the task that holds it.  A term is kept by the number of
distinct documents that hold it, over all its chunks: a row of totals with fewer than three documents carries them
all (its first and its last), and one with three or more needs no list.  Hashed marks of the listed documents prove
most terms; where they fall short of three, the listed documents themselves are counted.  Divergences between all sources of a
language are sums over blocks of terms and pairs of source tiles, so neither a source nor a frequent term is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tablewright.llm.text import byte_slices
from tablewright.session import materialise, settle, tidy_shuffles

#: A run of ASCII letters and characters beyond ASCII.
TERM = r"([^\x00-\x40\x5B-\x60\x7B-\x7F]+)"
#: Documents of a language that must hold a term; two document keys a row prove it, so it is no parameter.
LEAST_DOCUMENTS = 3
#: Probabilities are whole billionths.
SCALE = 1_000_000_000
SLICE_BYTES = 8 * 1024 * 1024
#: Sources and terms that meet in one task.
TILE, TERMS = 128, 4096
GROUP = ["lang", "source"]
CHUNKS = "lang string, source string, chunk string, n long, n_docs long, first_doc long, last_doc long"


def _chunk_totals(batches: Iterator[pa.RecordBatch], slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Chunks of slices of documents: occurrences, documents, and the first and last document's key, by language and source."""
    row = TaskContext.get().partitionId() << 33  # a key per document, the same again if the task is repeated
    for batch in byte_slices(batches, 2, slice_bytes):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(batch.column(2)))
        doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        chunk, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        blank = pc.index(words, "").as_py() if len(words) else -1
        if blank >= 0:
            doc, chunk = doc[chunk != blank], chunk[chunk != blank]
        width = max(len(words), 1)
        pair, n = np.unique(doc * width + chunk, return_counts=True)  # chunks counted per document
        del coded, lists, doc, chunk  # most of a slice's memory
        doc, chunk = np.divmod(pair, width)
        names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        kinds = {g: k for k, g in enumerate(dict.fromkeys(names))}
        key = np.array([kinds[g] for g in names], np.int64)[doc] * width + chunk
        order = np.argsort(key, kind="stable")  # documents stay in order within a group's chunk
        key, doc, n = key[order], doc[order], n[order]
        group, chunk = np.divmod(key, width)
        start = np.flatnonzero(np.r_[len(doc) > 0, np.diff(key) != 0][: len(doc)])
        end = np.r_[start[1:], len(doc)].astype(np.int64)[: len(start)]
        owners = list(kinds)
        lang, source = (pa.array([o[i] for o in owners], pa.string()).take(pa.array(group[start])) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [
                lang, source, words.take(pa.array(chunk[start])),
                pa.array(np.add.reduceat(n, start).astype(np.int64) if len(start) else start),
                pa.array(end - start), pa.array(row + doc[start]), pa.array(row + doc[end - 1]),
            ],
            ["lang", "source", "chunk", "n", "n_docs", "first_doc", "last_doc"],
        )
        row += batch.num_rows


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, source, term, n, m, lead) for every term that at least three documents of its language hold.

    ``m`` counts the term in its language, and ``lead`` marks one row of each.

    A document is a row: repeated rows and ids count each, and no id is needed.  Null text, language and source are empty strings.  Whole
    texts count.  Other columns are not read.  No rows give no rows.
    """
    plain = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))))

    def chunks_and_terms() -> DataFrame:
        totals = (
            plain.mapInArrow(lambda batches: _chunk_totals(batches, slice_bytes), CHUNKS)
            .groupBy("lang", "source", "chunk")
            .agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"), F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
        )
        # outer: Catalyst puts no filter on the terms below the grouping, where each chunk would be cut again for every task
        terms = F.explode_outer(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(1))).alias("term")
        return totals.select(*totals.columns, terms).drop("chunk").filter("term IS NOT NULL")

    found = materialise(chunks_and_terms(), "chunk-terms")
    bit = "shiftleft(1L, CAST(pmod(xxhash64({}), 64) AS INT))".format  # two bits never show more documents than there are
    marks = F.expr(f"CASE WHEN n_docs < {LEAST_DOCUMENTS} THEN {bit('first_doc')} | {bit('last_doc')} ELSE 0L END")
    listed = F.expr(f"CASE WHEN n_docs < {LEAST_DOCUMENTS} AND first_doc = last_doc THEN 1L WHEN n_docs < {LEAST_DOCUMENTS} THEN 2L ELSE n_docs END")
    within = W.partitionBy("lang", "term")
    seen = (
        found.withColumn("marks", marks).withColumn("listed", listed)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.max("n_docs").alias("most"), F.bit_or("marks").alias("marks"), F.sum("listed").alias("listed"))
        .withColumn("m", F.sum("n").over(within))
        .withColumn("sure", (F.max("most").over(within) >= LEAST_DOCUMENTS) | (F.bit_count(F.bit_or("marks").over(within)) >= LEAST_DOCUMENTS))
        .withColumn("listed", F.sum("listed").over(within))
        .withColumn("lead", F.col("source") == F.min("source").over(within))
        .filter(F.col("sure") | (F.col("listed") >= LEAST_DOCUMENTS))
        .select("lang", "source", "term", "n", "m", "lead", "sure")
    )
    seen = materialise(seen, "term-counts")
    unsure = seen.filter("NOT sure").select("lang", "term").distinct()
    proven = (
        found.filter(F.col("n_docs") < LEAST_DOCUMENTS).join(unsure, ["lang", "term"])
        .select("lang", "term", F.explode(F.array("first_doc", "last_doc")).alias("doc"))
        .groupBy("lang", "term").agg(F.count_distinct("doc").alias("docs")).filter(F.col("docs") >= LEAST_DOCUMENTS)
    )
    proven = materialise(proven.select("lang", "term"), "proven-terms")
    return seen.filter("sure").unionByName(seen.filter("NOT sure").join(proven, ["lang", "term"], "left_semi")).drop("sure")


def chance(count: str, total: str, terms: str) -> str:
    """SQL for p = 1 + floor(SCALE * (count + 1) / (total + terms)); decimals where the product may pass 64 bits.

    A language without kept terms divides by one; its pairs have value 0 and it has no terms.
    """
    whole = f"greatest({total} + {terms}, 1)"
    exact = f"(CAST({SCALE} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(20, 0))) div CAST({whole} AS DECIMAL(20, 0))"
    return f"1 + IF({count} < {9 * SCALE}, {SCALE}L * ({count} + 1) div {whole}, {exact})"


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) for every row of ``p`` against the row ``q``; at most 1e18, so 64 bits hold it."""
    d = p - q
    return d * d // q


def chances(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    if len(counts) and counts.max(initial=0) >= 9 * 10**9:  # the product would pass 64 bits
        wide = SCALE * (counts.astype(object) + 1) // (totals.astype(object)[:, None] + terms)
        return (wide + 1).astype(np.int64)
    return 1 + SCALE * (counts + 1) // (totals[:, None] + terms)


PARTS = "lang string, left long, right long, part long"


def _tile_sums(rows: pa.Table, tile: int) -> pa.Table:
    """One block of terms and one pair of tiles: for each pair of sources, what its terms add beyond those neither source has."""
    lang, a, b, terms = (rows.column(c)[0].as_py() for c in ("lang", "a", "b", "terms"))
    marks = rows.filter(pc.is_null(rows.column("term"))).sort_by("at")  # every source of the two tiles, with its total
    at, totals = marks.column("at").to_numpy(), marks.column("total").to_numpy()
    seen = rows.filter(pc.is_valid(rows.column("term")))
    coded = pc.dictionary_encode(seen.column("term").combine_chunks())
    counts = np.zeros((len(at), len(coded.dictionary)), np.int64)
    counts[np.searchsorted(at, seen.column("at").to_numpy()), coded.indices.to_numpy()] = seen.column("n").to_numpy()
    p, p0 = chances(counts, totals, terms), chances(np.zeros((len(at), 1), np.int64), totals, terms)
    in_a, in_b = np.flatnonzero(at // tile == a), np.flatnonzero(at // tile == b)
    pairs, parts = [np.zeros((2, 0), np.int64)], [np.zeros(0, np.int64)]
    for lefts, rights in [(in_a, in_b)] if a == b else [(in_a, in_b), (in_b, in_a)]:
        for h in rights.tolist():
            pairs.append(np.stack([at[lefts], np.full(len(lefts), at[h])]))
            parts.append((divergences(p[lefts], p[h]) - divergences(p0[lefts], p0[h])).sum(axis=1))
    left, right = np.concatenate(pairs, axis=1)
    return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "left": left, "right": right, "part": np.concatenate(parts)})


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", ranks: int = 200, tile: int = TILE, block_terms: int = TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank), written: how far each source is from the others of its language, and by which terms.

    Part ``pair`` has every other source, part ``term`` the source's ``ranks`` terms that stand out most against the
    language.  Every (lang, source) group of ``docs`` takes part, also one without terms; a language without kept
    terms has pairs of value 0.  ``tile`` sources and ``block_terms`` terms meet in one task.  Ties rank by item.  See ``term_counts`` for nulls, repeats, long texts, empty
    tables and other columns.  Whole numbers throughout.
    """
    with tidy_shuffles(docs.sparkSession):
        return settle(docs.sparkSession, lambda: _audit(docs, text, lang, source, ranks, tile, block_terms), "source-divergence")


def _audit(docs: DataFrame, text: str, lang: str, source: str, ranks: int, tile: int, block_terms: int) -> DataFrame:
    counts = term_counts(docs, text, lang, source)
    group = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source")))).distinct()
    totals = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    languages = counts.groupBy("lang").agg(F.count_if("lead").alias("terms"), F.sum("n").alias("lang_total"))
    groups = (
        group.join(totals, GROUP, "left")
        .join(languages, "lang", "left")
        .fillna(0, ["total", "terms", "lang_total"])
        .withColumn("at", F.row_number().over(W.partitionBy("lang").orderBy("source")).cast("long") - 1)
    )
    groups = materialise(groups, "source-groups")
    by_value = W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    p, q = F.expr(chance("n", "total", "terms")), F.expr(chance("m", "lang_total", "terms"))
    term = (
        counts.join(groups, GROUP)
        .select(*GROUP, F.col("term").alias("item"), p.alias("p"), q.alias("q"))
        .filter("p > q").select(*GROUP, "item", F.expr("(p - q) * (p - q) div q").alias("value"))
        .withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= ranks)
        .withColumn("part", F.lit("term"))
    )
    base = F.expr("terms * ((p0 - q0) * (p0 - q0) div q0)")
    left = groups.selectExpr("lang", "source", "at AS left", "terms", f"{chance('0L', 'total', 'terms')} AS p0")
    right = groups.selectExpr("lang", "source AS item", "at AS right", f"{chance('0L', 'total', 'terms')} AS q0")
    pair = (
        left.join(right, "lang").filter("left <> right")  # the report's own rows: sources, not documents or terms
        .join(_pair_parts(counts, groups, tile, block_terms), ["lang", "left", "right"], "left")
        .select(*GROUP, "item", F.when(F.col("terms") == 0, 0).otherwise(base + F.coalesce("part", F.lit(0))).cast("long").alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
        .withColumn("part", F.lit("pair"))
    )
    order = [*GROUP, "part", "item", "value", "rank"]
    return pair.select(order).unionByName(term.select(order))


def _pair_parts(counts: DataFrame, groups: DataFrame, tile: int, block_terms: int) -> DataFrame:
    """(lang, left, right, part): summed over the terms that either source has, in blocks of terms by pairs of tiles."""
    tiles = groups.groupBy("lang").agg(F.expr(f"max(at) div {tile}").alias("last_tile"))
    blocks = F.ceil(F.col("terms") / block_terms)
    spread = groups.join(tiles, "lang").filter("terms > 0").withColumn("blocks", blocks)
    facts = spread.select(*GROUP, "at", "total", "terms", "last_tile", "blocks")
    seen = counts.join(facts, GROUP).withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    lone = facts.withColumn("term", F.lit(None).cast("string")).withColumn("n", F.lit(0).cast("long"))
    lone = lone.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["lang", "at", "total", "terms", "last_tile", "block", "term", "n"]
    other, own = F.explode(F.sequence(F.lit(0).cast("long"), "last_tile")), F.expr(f"at div {tile}")
    rows = seen.select(columns).unionByName(lone.select(columns)).withColumn("other", other).withColumn("own", own)
    rows = rows.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "block", "at", "total", "terms", "term", "n")
    sums = rows.groupBy("lang", "a", "b", "block").applyInArrow(lambda found: _tile_sums(found, tile), PARTS)
    return sums.groupBy("lang", "left", "right").agg(F.sum("part").alias("part"))
