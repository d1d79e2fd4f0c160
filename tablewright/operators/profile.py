"""Deterministic column profiles.

Two inputs feed every fact: one plain aggregate in native types with a sketch of
the quantiles, and the value-count table.  Each is one scan; ``profile`` reads the
long texts that it shows in a third one, of their columns alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.functions import casts
from tablewright.functions.identity import compact_number
from tablewright.operators import counts
from tablewright.session import materialise, settle

# What a profile holds.
SAMPLE_CAP = 20
QUANTILES = (0.25, 0.5, 0.75)
BINS = 15
TOP_VALUES = 10
LOW_CARDINALITY = 25
MAJORITY = 0.5
NARROWER = (t.INTEGER, t.DECIMAL, t.BOOLEAN, t.DATE, t.DATETIME)
# how far a bracket reaches to each side, as a share of rows, and the sketch's size
BRACKET = 0.002
SKETCH = 2000
RELEASED_SAMPLES = 5
RELEASED_LENGTH = 200


Bracket = tuple[float | None, float | None]  # both ends belong to it; None is open


def text_columns(df: DataFrame) -> list[str]:
    """Columns holding plain text (nested values are JSON, never mixed)."""
    return [f.name for f in df.schema.fields
            if t.domain_type(f.dataType) == t.TEXT and not t.is_nested(f.dataType)]


_FACTS = (
    "column_name string, position int, inferred_type string, is_nested boolean, row_count bigint, null_count bigint, "
    "minimum double, maximum double, minimum_exact string, maximum_exact string"
)


def _fact_aggregates(df: DataFrame) -> list[Column]:
    aggs = [F.count("*").alias("row_count")]
    for i, f in enumerate(df.schema.fields):
        c = t.column(f.name)
        aggs.append(F.count(c).alias(f"c{i}"))
        if t.domain_type(f.dataType) in t.NUMERIC:
            for name, end in (("lo", F.min(c)), ("hi", F.max(c))):
                aggs += [end.cast("double").alias(f"{name}{i}"), end.cast("string").alias(f"{name}_text{i}")]
    return aggs


def column_facts(df: DataFrame) -> DataFrame:
    """Row count, nulls and numeric range per column, from one aggregate.

    ``minimum`` and ``maximum`` are doubles; ``minimum_exact`` and ``maximum_exact`` are the column's own values as text.
    """
    cells = []
    for i, f in enumerate(df.schema.fields):
        kind, span = t.domain_type(f.dataType), ["CAST(NULL AS DOUBLE)"] * 2 + ["CAST(NULL AS STRING)"] * 2
        if kind in t.NUMERIC:
            span = [f"lo{i}", f"hi{i}", f"lo_text{i}", f"hi_text{i}"]
        nested = str(t.is_nested(f.dataType)).lower()
        head = f"{counts.text_literal(f.name)}, {i}, '{kind}', {nested}, row_count, row_count - c{i}"
        cells.append(f"{head}, {', '.join(span)}")
    names = ", ".join(x.split()[0] for x in _FACTS.split(", "))
    return df.agg(*_fact_aggregates(df)).selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS ({names})")


def null_rate() -> Column:
    return F.when(F.col("row_count") == 0, F.lit(0.0)).otherwise(
        F.col("null_count") / F.col("row_count")
    )


def distinct_counts(vc: DataFrame) -> DataFrame:
    return vc.groupBy("column_name").agg(F.count("*").alias("distinct_count"))


def samples(vc: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """The smallest ``cap`` distinct values per column, in native order."""
    w = Window.partitionBy("column_name").orderBy(*counts.NATIVE)
    return (
        vc.withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= cap)
        .select("column_name", "position", counts.shown().alias("sample"))
    )


def top_values(vc: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values per column as text; ties by value."""
    shown = vc.select("column_name", counts.shown().alias("label"), "n")
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("label"))
    return shown.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def quantiles(df: DataFrame, ps: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact interpolated quantiles of every numeric column of ``df``; NaN ranks last.

    Two scans.  The first counts each column and sketches a bracket around each quantile.  The second counts the
    regions that the brackets cut a column into, exactly, and keeps the distinct values inside brackets only.  The
    counts tell which region holds a rank; the sketch never decides a result: where a rank falls outside the
    brackets, that region is read as well.  Inside a region the rank is found by radix selection (``_select``).
    """
    names = _numeric(df)
    numbers = df.select(*[t.column(n).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    totals, brackets = _brackets(numbers, ps) if names else ([], [])
    return _interpolated(df.sparkSession, names, totals, brackets, ps, lambda found: _regions(numbers, found))


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if t.domain_type(f.dataType) in t.NUMERIC]


def _interpolated(
    spark: SparkSession, names: Sequence[str], totals: Sequence[int], brackets: list[list[Bracket]], ps: Sequence[float],
    regions: Callable[[list[list[Bracket]]], tuple[DataFrame, dict]],
) -> DataFrame:
    """Quantiles of the columns ``names``, whose values ``regions`` counts between and inside given brackets."""
    held, sizes = regions(brackets)
    targets, missed = _targets(totals, sizes, ps)
    if missed:  # the sketch was off there: those regions are read as well
        for i, region in missed:
            lo, hi = _edges(brackets[i], region)
            brackets[i] = sorted([*brackets[i], (lo, hi)], key=lambda b: (b[0] is not None, b[0] or 0.0))
        held, sizes = regions(brackets)
        targets, missed = _targets(totals, sizes, ps)
        assert not missed
    value = _select(held, sizes, targets) if targets else {}
    rows = []
    for i, name in enumerate(names):
        found = []
        for q, p in enumerate(ps if totals[i] else ()):
            below, above = value[i, q, 0], value[i, q, 1]
            at = p * (totals[i] - 1)
            found.append(below if below == above else below + (above - below) * (at - math.floor(at)))
        if found:
            rows.append((name, found))
    return spark.createDataFrame(rows, "column_name string, quantiles array<double>")  # one row per column


def _double(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _brackets(numbers: DataFrame, ps: Sequence[float]) -> tuple[list[int], list[list[Bracket]]]:
    """Per column: its values, and disjoint brackets in order.  One aggregate, one row to the driver."""
    row = numbers.agg(*_sketches({c: F.col(c) for c in numbers.columns}, ps)).first()
    return [row[f"{c}_n"] for c in numbers.columns], [_merged(row[c]) for c in numbers.columns]


def _sketches(numbers: dict[str, Column], ps: Sequence[float]) -> list[Column]:
    """Aggregates per double: values (``_n``) and the two ends of a bracket around each quantile."""
    near = [x for p in ps for x in (max(p - BRACKET, 0.0), min(p + BRACKET, 1.0))]
    ends = [F.percentile_approx(F.nullif(v, F.lit(float("nan"))), near, SKETCH).alias(c) for c, v in numbers.items()]
    return ends + [F.count(v).alias(f"{c}_n") for c, v in numbers.items()]


def _merged(ends: Sequence[float] | None) -> list[Bracket]:
    merged: list[Bracket] = []
    for lo, hi in sorted(zip((ends or [])[::2], (ends or [])[1::2])):
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def _edges(brackets: Sequence[Bracket], region: int) -> Bracket:
    """The bracket of a region between brackets (an even number), from the end of one to the start of the next."""
    before, after = region // 2 - 1, region // 2
    return (brackets[before][1] if before >= 0 else None, brackets[after][0] if after < len(brackets) else None)


def _region_sql(c: str, brackets: Sequence[Bracket]) -> str:
    """The number of the region a value lies in: 0 below the first bracket, 1 inside it, 2 up to the next, and so on."""
    cases = []
    for k, (lo, hi) in enumerate(brackets):
        cases += [] if lo is None else [f"WHEN {c} < {_double(lo)} THEN {2 * k}"]
        cases.append("WHEN true" if hi is None else f"WHEN {c} <= {_double(hi)}")
        cases[-1] += f" THEN {2 * k + 1}"
    return f"CASE {' '.join(cases)} ELSE {2 * len(brackets)} END" if cases else "0"


def _regions(numbers: DataFrame, brackets: Sequence[Sequence[Bracket]]) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    """(col_no, region, v, n), v only inside brackets, and per (col_no, region) its rows and distinct values."""
    cells = []
    for i, c in enumerate(numbers.columns):
        region = _region_sql(c, brackets[i])
        cells.append(f"{i}, IF({c} IS NULL, NULL, {region}), IF(({region}) % 2 = 1, {c}, NULL)")
    if not cells:
        return numbers, {}
    long = numbers.selectExpr(f"stack({len(cells)}, {', '.join(cells)}) AS (col_no, region, v)").filter("region IS NOT NULL")
    return _held(long.withColumn("n", F.lit(1)))


def _counted_regions(vc: DataFrame, positions: Sequence[int], brackets: Sequence[Sequence[Bracket]]) -> tuple[DataFrame, dict]:
    """``_regions`` from value counts instead of the rows; ``positions`` are the numeric columns' places in the table."""
    if not positions:
        return vc, {}
    # whole numbers and decimals that become the same double are one value
    v = "coalesce(real, CAST(whole AS DOUBLE))"
    number = " ".join(f"WHEN {at} THEN {i}" for i, at in enumerate(positions))
    region = " ".join(f"WHEN {i} THEN {_region_sql('v', b)}" for i, b in enumerate(brackets))
    cells = vc.selectExpr(f"CASE col_no {number} END AS col_no", f"{v} AS v", "n").filter("col_no IS NOT NULL")
    placed = cells.selectExpr("col_no", f"CASE col_no {region} END AS region", "v", "n")
    return _held(placed.selectExpr("col_no", "region", "IF(region % 2 = 1, v, NULL) AS v", "n"))


def _held(cells: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], tuple[int, int]]]:
    held = materialise(cells.groupBy("col_no", "region", "v").agg(F.sum("n").alias("n")), "regions")
    sizes = held.groupBy("col_no", "region").agg(F.sum("n").alias("n"), F.count("*").alias("values")).collect()  # a few rows per column
    return held, {(r["col_no"], r["region"]): (r["n"], r["values"]) for r in sizes}


Target = tuple[int, int, int, int, int]  # column, quantile, below (0) or above (1), region, rank in the region


def _targets(totals: Sequence[int], sizes: dict, ps: Sequence[float]) -> tuple[list[Target], list[tuple[int, int]]]:
    """The two ranks of each quantile within their regions, and the regions outside brackets that hold a rank."""
    targets, missed = [], set()
    for i, total in enumerate(totals):
        for q, p in enumerate(ps if total else ()):
            for side, rank in enumerate((math.floor(p * (total - 1)), math.ceil(p * (total - 1)))):
                for region in sorted(r for c, r in sizes if c == i):
                    if rank < sizes[i, region][0]:
                        break
                    rank -= sizes[i, region][0]
                targets.append((i, q, side, region, rank))
                if region % 2 == 0:
                    missed.add((i, region))
    return targets, sorted(missed, reverse=True)


#: Values of one region, or of one prefix of the key, that a window may rank.
RANKED = 65_536
KEY_BITS, DIGIT_BITS = 64, 16


def order_key(v: str) -> str:
    """SQL for a whole number that orders as the double ``v`` does: its bits, mirrored below zero; NaN is last."""
    text = f"format_string('%a', abs({v}))"  # 0x1.<mantissa>p<exponent>, exact
    mantissa = f"CAST(conv(rpad(regexp_extract({text}, '[.]([0-9a-f]+)p', 1), 13, '0'), 16, 10) AS BIGINT)"
    exponent = f"IF(substr({text}, 3, 1) = '1', CAST(regexp_extract({text}, 'p(-?[0-9]+)', 1) AS BIGINT) + 1023, 0)"
    bits = f"IF(abs({v}) = double('inf'), shiftleft(2047L, 52), shiftleft({exponent}, 52) + {mantissa})"
    return f"CASE WHEN isnan({v}) THEN {2**63 - 1} WHEN {v} < 0 THEN -({bits}) - 1 ELSE {bits} END"


def _select(held: DataFrame, sizes: dict, targets: Sequence[Target]) -> dict[tuple[int, int, int], float]:
    """The value at each target's rank.

    Regions of few distinct values are ranked by a window.  Others go digit by digit from the top of an order-preserving key: values are counted per
    digit among those that share the digits found so far, and the digit that holds the rank is the next one.  Values are never
    sorted or laid out by range; each step moves at most 65,536 counts per target.
    """
    spark = held.sparkSession
    found, wide = {}, [x for x in targets if sizes[x[0], x[3]][1] > RANKED]
    narrow = [x for x in targets if sizes[x[0], x[3]][1] <= RANKED]
    kinds = "col_no int, q int, side int, region int, rank bigint"
    if narrow:
        # bounded: RANKED rows per partition; one broadcast row per column, quantile and side
        by_value = "OVER (PARTITION BY col_no, region ORDER BY v ROWS UNBOUNDED PRECEDING)"
        asked = F.broadcast(spark.createDataFrame(narrow, kinds))
        wanted = spark.createDataFrame(sorted({(x[0], x[3]) for x in narrow}), "col_no int, region int")
        ranked = held.join(F.broadcast(wanted), ["col_no", "region"]).withColumn("upto", F.expr(f"sum(n) {by_value}"))
        hit = ranked.join(asked, ["col_no", "region"]).filter("upto - n <= rank AND rank < upto")
        found |= {(r["col_no"], r["q"], r["side"]): r["v"] for r in hit.collect()}
    if wide:
        wanted = spark.createDataFrame(sorted({(x[0], x[3]) for x in wide}), "col_no int, region int")
        keyed = materialise(held.join(F.broadcast(wanted), ["col_no", "region"]).withColumn("key", F.expr(order_key("v"))), "keys")
        state = [(*x, 0) for x in wide]
        for shift in range(KEY_BITS - DIGIT_BITS, -1, -DIGIT_BITS):
            asked = F.broadcast(spark.createDataFrame(state, f"{kinds}, prefix bigint"))
            same = "true" if shift == KEY_BITS - DIGIT_BITS else f"shiftright(key, {shift + DIGIT_BITS}) = prefix"
            digits = (
                keyed.join(asked, ["col_no", "region"]).filter(same)
                .groupBy("col_no", "q", "side", "region", "rank", F.shiftright("key", shift).alias("next"))
                .agg(F.sum("n").alias("n"), F.min("v").alias("v"))
                .withColumn("upto", F.expr("sum(n) OVER (PARTITION BY col_no, q, side ORDER BY next ROWS UNBOUNDED PRECEDING)"))
                .filter("upto - n <= rank AND rank < upto")
            )
            hit = digits.collect()  # one row per target
            state = [(r["col_no"], r["q"], r["side"], r["region"], r["rank"] - (r["upto"] - r["n"]), r["next"]) for r in hit]
        found |= {(r["col_no"], r["q"], r["side"]): r["v"] for r in hit}
    return found


def histogram(vc: DataFrame, facts: DataFrame) -> DataFrame:
    """Fifteen equal-width bins; the top edge counts into the last, empty bins are absent."""
    spread = facts.filter(
        F.col("inferred_type").isin(*t.NUMERIC)
        & (F.col("distinct_count") > LOW_CARDINALITY)
        & (F.col("maximum") > F.col("minimum"))
        & (F.abs(F.col("maximum")) < float("inf"))
        & (F.abs(F.col("minimum")) < float("inf"))
    ).select(
        "column_name",
        F.col("minimum").alias("lo"),
        ((F.col("maximum") - F.col("minimum")) / BINS).alias("width"),
    )
    at = F.floor((F.col("v") - F.col("lo")) / F.col("width")).cast("int")
    binned = (
        vc.select("column_name", counts.number().alias("v"), "n")
        .join(F.broadcast(spread), "column_name")  # one row per column
        .groupBy("column_name", "lo", "width", F.least(F.lit(BINS - 1), at).alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    start = F.col("lo") + F.col("bin") * F.col("width")
    return binned.select(
        "column_name",
        "bin",
        F.concat(compact_number(start), F.lit("–"), compact_number(start + F.col("width"))).alias("label"),
        "n",
    )


def _fits(vc: DataFrame, kind: str) -> Column:
    """Does a text fit a narrower type?  Long texts of ``counts.count_digests`` know it from their rows."""
    whole = casts.lenient(F.col("txt"), kind).isNotNull()
    return F.when(F.col("digest").isNull(), whole).otherwise(F.col(kind)) if "digest" in vc.columns else whole


def mixed_types(vc: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Text columns most of whose values fit one narrower type, but not all."""
    values = vc.filter(F.col("column_name").isin(*texts)) if texts else vc.limit(0)
    fits = values.groupBy("column_name").agg(
        F.sum("n").alias("non_null"),
        *[
            F.sum(F.when(_fits(vc, k), F.col("n")).otherwise(0)).alias(f"fits_{k}")
            for k in NARROWER
        ],
    )
    verdicts = [
        F.when(
            (F.col(f) > 0) & (F.col(f) < F.col("non_null")) & (F.col(f) >= MAJORITY * F.col("non_null")),
            F.lit(k),
        )
        for k, f in ((k, f"fits_{k}") for k in NARROWER)
    ]
    return fits.select("column_name", F.coalesce(*verdicts).alias("dominant_type"), "non_null", *[F.col(f"fits_{k}").alias(k) for k in NARROWER])


def off_type_values(vc: DataFrame, mixed: DataFrame, cap: int = SAMPLE_CAP) -> DataFrame:
    """Up to ``cap`` distinct values that fail the dominant cast, smallest first."""
    w = Window.partitionBy("column_name").orderBy("txt")
    return (
        _misses(vc, mixed)
        .withColumn("position", F.row_number().over(w))
        .filter(F.col("position") <= cap)
        .select("column_name", "position", F.col("txt").alias("example"))
    )


def _misses(vc: DataFrame, mixed: DataFrame) -> DataFrame:
    """The values of mixed columns that do not fit the dominant type."""
    dominant = mixed.filter("dominant_type is not null").select("column_name", "dominant_type")
    missed = [(F.col("dominant_type") == k) & ~_fits(vc, k) for k in NARROWER]
    joined = vc.join(F.broadcast(dominant), "column_name")  # one row per column
    return joined.filter(reduce(Column.__or__, missed)).select(*vc.columns)


def _first_scan(df: DataFrame) -> tuple[DataFrame, list[int], list[list[Bracket]]]:
    """Facts of every column, and per numeric column its values and quantile brackets: one aggregate, one row to the driver."""
    numbers = {f"v{i}": t.column(n).cast("double") for i, n in enumerate(_numeric(df))}
    row = df.agg(*_fact_aggregates(df), *_sketches(numbers, QUANTILES)).first()
    facts = []
    for i, f in enumerate(df.schema.fields):
        kind = t.domain_type(f.dataType)
        span = [row[f"{end}{i}"] if kind in t.NUMERIC else None for end in ("lo", "hi", "lo_text", "hi_text")]
        facts.append((f.name, i, kind, t.is_nested(f.dataType), row["row_count"], row["row_count"] - row[f"c{i}"], *span))
    known = df.sparkSession.createDataFrame(facts, _FACTS)  # one row per column
    return known, [row[f"{c}_n"] for c in numbers], [_merged(row[c]) for c in numbers]


def _picked(df: DataFrame, vc: DataFrame, mixed: DataFrame, cap: int) -> dict[str, DataFrame]:
    """Values that may be shown, per list, with their whole texts.

    Long texts are ranked by their beginning, and all that share the last one's are kept: the exact order is decided afterwards.
    """
    rank = lambda *order: F.rank().over(Window.partitionBy("column_name").orderBy(*order))
    lists = {
        "samples": vc.withColumn("_rank", rank(*counts.NATIVE)).filter(F.col("_rank") <= cap),
        "tops": vc.withColumn("_rank", rank(F.desc("n"), counts.shown())).filter(F.col("_rank") <= TOP_VALUES),
        "misses": _misses(vc, mixed).withColumn("_rank", rank("txt")).filter(F.col("_rank") <= cap),
    }
    stacked = reduce(DataFrame.unionByName, [d.withColumn("list", F.lit(name)) for name, d in lists.items()])
    short = materialise(stacked.select("list", "col_no", "column_name", *counts.NATIVE, "digest", "n"), "picked-values")
    whole = materialise(counts.fetch_texts(df, short), "picked-texts").drop("digest")
    return {name: whole.filter(F.col("list") == name) for name in lists}


def profile(df: DataFrame, sample_cap: int = SAMPLE_CAP) -> DataFrame:
    """One row per column with every profile fact."""
    return settle(df.sparkSession, lambda: _profile(df, sample_cap), "profile")


def _profile(df: DataFrame, sample_cap: int) -> DataFrame:
    known, totals, brackets = _first_scan(df)
    long_facts = {k: casts.lenient(F.col("txt"), k).isNotNull() for k in NARROWER}
    vc = materialise(counts.count_digests(df, long_facts), "value-counts")
    names = _numeric(df)
    positions = [df.columns.index(n) for n in names]
    ranked = _interpolated(df.sparkSession, names, totals, brackets, QUANTILES, lambda found: _counted_regions(vc, positions, found))
    facts = known.join(F.broadcast(distinct_counts(vc)), "column_name", "left").fillna(0, ["distinct_count"])
    facts = materialise(facts.withColumn("null_rate", null_rate()), "column-facts")

    def listed(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
        # at most `cap` entries per column reach each list
        pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
        return rows.groupBy("column_name").agg(F.transform(pairs, lambda p: p["v"]).alias(name))

    bar = F.struct(F.col("label"), F.col("n").alias("count"))
    bins = listed(histogram(vc, facts), "bin", bar, "bins")
    mixed = materialise(mixed_types(vc, text_columns(df)), "mixed-types")
    picked = _picked(df, vc, mixed, sample_cap)
    tops = listed(top_values(picked["tops"]), "position", bar, "tops")
    off = listed(off_type_values(picked["misses"], mixed, sample_cap), "position", F.col("example"), "off_type_examples")
    shown = listed(samples(picked["samples"], sample_cap), "position", F.col("sample"), "samples")
    out = facts
    # every side here is one row per column
    for part in (ranked, shown, bins, tops, mixed.select("column_name", "dominant_type"), off):
        out = out.join(F.broadcast(part), "column_name", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "column_name",
        "position",
        "inferred_type",
        "is_nested",
        "row_count",
        "null_count",
        "null_rate",
        "distinct_count",
        "minimum",
        "maximum",
        "minimum_exact",
        "maximum_exact",
        F.coalesce("quantiles", F.array().cast("array<double>")).alias("quantiles"),
        F.coalesce("samples", none).alias("samples"),
        F.coalesce("bins", "tops", F.array().cast("array<struct<label:string,count:bigint>>")).alias("distribution"),
        F.col("dominant_type").isNotNull().alias("is_mixed"),
        "dominant_type",
        F.coalesce("off_type_examples", none).alias("off_type_examples"),
    )


def released_samples(profiled: DataFrame) -> DataFrame:
    """What may leave as metadata: five samples per column, cut to 200 characters."""
    few = F.slice(F.array_sort("samples"), 1, RELEASED_SAMPLES)
    return profiled.select(
        "column_name",
        "inferred_type",
        "null_rate",
        "distinct_count",
        F.transform(few, lambda s: F.left(s, F.lit(RELEASED_LENGTH))).alias("samples"),
        F.size(few).alias("released"),
    )
