"""Profiles, value counts, metadata samples and standardisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.operators import counts, normalize, profile
from tablewright.session import materialise, scratch_path
from tablewright.sources.store import DatasetStore
from tablewright.suite.registry import Suite
from tablewright.suite.tables import given, shop, with_shop

suite = Suite()

# Column kinds of the tables the checks spell out.
KINDS = {
    "customers": {"customer_id": "integer", "name": "text", "nation_id": "integer", "balance": "decimal", "segment": "text"},
    "shop_orders": {"order_id": "integer", "customer_id": "integer", "status": "text", "total": "decimal", "order_date": "date", "priority": "text"},
    "line_items": {
        "line_id": "text", "order_id": "integer", "sale_id": "integer", "part_id": "integer", "supplier_id": "integer",
        "quantity": "decimal", "price": "decimal", "discount": "decimal", "return_flag": "text", "ship_date": "date",
    },
    "mixed_orders": {"order_id": "integer", "code": "text", "day": "text", "large": "text", "note": "text"},
}
PROFILED = ("customers", "shop_orders", "line_items")


def _cells(tables=PROFILED, only=None):
    return [(n, c, k) for n in tables for c, k in KINDS[n].items() if only is None or k in only]


def _union_sql(tables, part, only=None) -> str:
    return with_shop(*tables) + " " + " UNION ALL ".join(part(n, c, k) for n, c, k in _cells(tables, only))


def _stacked(frames: dict[str, DataFrame], fn) -> DataFrame:
    parts = [fn(df).withColumn("table_name", F.lit(name)) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def _numeric(df: DataFrame) -> list[str]:
    return [c for c, k in t.schema_of(df) if k in t.NUMERIC]


# ---- P1-P3 ------------------------------------------------------------------
def _summary_sql(n: str, c: str, k: str) -> str:
    span = f"CAST(min({c}) AS DOUBLE) AS minimum, CAST(max({c}) AS DOUBLE) AS maximum"
    if k not in t.NUMERIC:
        span = "CAST(NULL AS DOUBLE) AS minimum, CAST(NULL AS DOUBLE) AS maximum"
    return (
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, '{k}' AS inferred_type, count(*) AS row_count, "
        f"count(*) - count({c}) AS null_count, round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS null_rate, "
        f"count(DISTINCT {c}) AS distinct_count, {span} FROM {n}"
    )


@suite.query("profile_summary", _union_sql(PROFILED, _summary_sql))
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(df: DataFrame) -> DataFrame:
        found = profile.distinct_counts(counts.count_values(df))
        facts = profile.column_facts(df).join(F.broadcast(found), "column_name", "left").fillna(0, ["distinct_count"])
        return facts.select(
            "column_name", "inferred_type", "row_count", "null_count",
            F.round(profile.null_rate(), 6).alias("null_rate"), "distinct_count", "minimum", "maximum",
        )

    return _stacked(shop(spark, sf_dir, *PROFILED), one)


# ---- P4 ---------------------------------------------------------------------
def _quantile_sql(n: str, c: str, k: str) -> str:
    picks = ", ".join(
        f"round(quantile_cont(CAST({c} AS DOUBLE), {p}), 4) AS {name}" for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))
    )
    return f"SELECT '{n}' AS table_name, '{c}' AS column_name, {picks} FROM {n}"


@suite.query("profile_quantiles", _union_sql(PROFILED, _quantile_sql, t.NUMERIC))
def profile_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(df: DataFrame) -> DataFrame:
        q = profile.quantiles(df)
        return q.select("column_name", *[F.round(F.col("quantiles")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])

    return _stacked(shop(spark, sf_dir, *PROFILED), one)


# ---- P5 ---------------------------------------------------------------------
def _sample_sql(n: str, c: str, k: str) -> str:
    return (
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS position, "
        f"CAST(v AS VARCHAR) AS sample FROM (SELECT DISTINCT {c} AS v FROM {n} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 20)"
    )


@suite.query("profile_samples", _union_sql(PROFILED, _sample_sql))
def profile_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(shop(spark, sf_dir, *PROFILED), lambda df: profile.samples(counts.count_values(df)))


# ---- P6 ---------------------------------------------------------------------
def _edge(x: str) -> str:
    r = f"round({x}, 2)"
    return f"CASE WHEN {r} = floor({r}) THEN CAST(CAST({r} AS BIGINT) AS VARCHAR) ELSE format('{{:g}}', {r}) END"


def _histogram_sql(n: str, c: str, k: str) -> str:
    start = "(lo + b * w)"
    return (
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, CAST(b AS INTEGER) AS bin, "
        f"{_edge(start)} || '–' || {_edge(start[:-1] + ' + w)')} AS label, n FROM ("
        f"SELECT lo, w, least(14, floor((CAST({c} AS DOUBLE) - lo) / w)) AS b, count(*) AS n FROM {n}, "
        f"(SELECT CAST(min({c}) AS DOUBLE) AS lo, (CAST(max({c}) AS DOUBLE) - CAST(min({c}) AS DOUBLE)) / 15 AS w, "
        f"count(DISTINCT {c}) AS d FROM {n}) WHERE {c} IS NOT NULL AND d > 25 AND w > 0 GROUP BY ALL)"
    )


@suite.query("profile_histogram", _union_sql(PROFILED, _histogram_sql, t.NUMERIC))
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(df: DataFrame) -> DataFrame:
        numbers = df.select(*_numeric(df))
        vc = materialise(counts.count_values(numbers), "value-counts")  # read for the distinct counts and for the bins
        facts = profile.column_facts(numbers).join(F.broadcast(profile.distinct_counts(vc)), "column_name")
        return profile.histogram(vc, facts)

    return _stacked(shop(spark, sf_dir, *PROFILED), one)


# ---- P7, P11 ----------------------------------------------------------------
TOPPED = {"customers": ("nation_id", "segment"), "shop_orders": ("status", "priority", "order_date"), "line_items": ("quantity", "return_flag", "ship_date")}


def _top_sql() -> str:
    parts = [
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, "
        f"CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS position, label, n FROM "
        f"(SELECT CAST({c} AS VARCHAR) AS label, count(*) AS n FROM {n} WHERE {c} IS NOT NULL GROUP BY 1 "
        f"ORDER BY 2 DESC, 1 LIMIT 10)"
        for n, cs in TOPPED.items() for c in cs
    ]
    return with_shop(*TOPPED) + " " + " UNION ALL ".join(parts)


@suite.query("profile_topk", _top_sql())
def profile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, df in shop(spark, sf_dir, *TOPPED).items():
        top = profile.top_values(counts.count_values(df, TOPPED[name]))
        parts.append(top.select(F.lit(name).alias("table_name"), "column_name", "position", "label", "n"))
    return reduce(DataFrame.unionByName, parts)


@suite.query("value_counts", "SELECT user_id AS value, count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.value_counts(given(spark, sf_dir, "events"), "user_id")


# ---- P8, P9 -----------------------------------------------------------------
_CASTS = {"integer": "BIGINT", "decimal": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "datetime": "TIMESTAMP"}
_MIXED_TEXTS = ("code", "day", "large", "note")


def _mixed_sql(n: str, c: str, k: str) -> str:
    verdict = " ".join(
        f"WHEN count(TRY_CAST({c} AS {d})) > 0 AND count(TRY_CAST({c} AS {d})) < count({c}) "
        f"AND count(TRY_CAST({c} AS {d})) >= 0.5 * count({c}) THEN '{kind}'"
        for kind, d in _CASTS.items()
    )
    return f"SELECT '{c}' AS column_name, CASE {verdict} END AS dominant_type, count({c}) AS non_null FROM mixed_orders"


@suite.query("profile_mixed", _union_sql(("mixed_orders",), _mixed_sql, ("text",)))
def profile_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shop(spark, sf_dir, "mixed_orders")["mixed_orders"]
    texts = profile.text_columns(df)
    found = profile.mixed_types(counts.count_values(df, texts), texts)
    return found.select("column_name", "dominant_type", "non_null")


def _off_sql() -> str:
    parts = [
        f"SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS position, v AS example FROM "
        f"(SELECT DISTINCT {c} AS v FROM mixed_orders WHERE {c} IS NOT NULL AND TRY_CAST({c} AS {d}) IS NULL ORDER BY 1 LIMIT 20)"
        for c, d in (("code", "BIGINT"), ("day", "DATE"), ("large", "BOOLEAN"))
    ]
    return with_shop("mixed_orders") + " " + " UNION ALL ".join(parts)


@suite.query("profile_offtype", _off_sql())
def profile_offtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shop(spark, sf_dir, "mixed_orders")["mixed_orders"]
    texts = profile.text_columns(df)
    vc = counts.count_values(df, texts)
    return profile.off_type_values(vc, profile.mixed_types(vc, texts))


# ---- P1 whole, P12, S8 ------------------------------------------------------
KINDS_FULLY = KINDS | {"documents": {"doc_id": "integer", "text": "text", "lang": "text", "source": "text", "n_chars": "integer"}}
#: What is shown as a list, joined to one text by a character that no value holds.
_BAR = "chr(31)"


def _whole_sql(n: str, c: str, k: str) -> str:
    numeric, text = k in t.NUMERIC, k == t.TEXT
    top = (
        f"(SELECT string_agg(label || '=' || n, {_BAR} ORDER BY n DESC, label) FROM (SELECT CAST({c} AS VARCHAR) AS label, "
        f"count(*) AS n FROM {n} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10))"
    )
    bins = f"(SELECT string_agg(label || '=' || n, {_BAR} ORDER BY bin) FROM ({_histogram_sql(n, c, k)}))"
    quantiles, dominant, off, span = "''", "NULL", "NULL", "NULL"
    if numeric:
        quantiles = (
            f"(SELECT array_to_string(list_transform(quantile_cont(CAST({c} AS DOUBLE), [0.25, 0.5, 0.75]), "
            f"lambda x: CAST(round(x, 2) AS VARCHAR)), ' ') FROM {n})"
        )
        span = "CAST({end}(" + c + ") AS DOUBLE)"
    if text:
        dominant = f"(SELECT dominant_type FROM ({_mixed_sql(n, c, k).replace('mixed_orders', n)}))"
        fails = " ".join(f"WHEN '{kind}' THEN TRY_CAST(v AS {d}) IS NULL" for kind, d in _CASTS.items())
        off = (
            f"(SELECT string_agg(v, {_BAR} ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {n} "
            f"WHERE {c} IS NOT NULL AND CASE {dominant} {fails.replace('v AS', c + ' AS')} ELSE false END ORDER BY 1 LIMIT 20))"
        )
    exact = k == t.INTEGER
    return (
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, {list(KINDS_FULLY[n]).index(c)} AS position, '{k}' AS inferred_type, "
        f"false AS is_nested, count(*) AS row_count, count(*) - count({c}) AS null_count, "
        f"round(CAST(count(*) - count({c}) AS DOUBLE) / count(*), 6) AS null_rate, count(DISTINCT {c}) AS distinct_count, "
        f"CAST({span.format(end='min')} AS DOUBLE) AS minimum, CAST({span.format(end='max')} AS DOUBLE) AS maximum, "
        f"{f'CAST(min({c}) AS VARCHAR)' if exact else 'CAST(NULL AS VARCHAR)'} AS minimum_exact, "
        f"{f'CAST(max({c}) AS VARCHAR)' if exact else 'CAST(NULL AS VARCHAR)'} AS maximum_exact, "
        f"{quantiles} AS quantiles, "
        f"coalesce((SELECT string_agg(CAST(v AS VARCHAR), {_BAR} ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM {n} "
        f"WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 20)), '') AS samples, "
        f"coalesce({f'CASE WHEN count(DISTINCT {c}) > 25 THEN {bins} ELSE {top} END' if numeric else top}, '') AS distribution, "
        f"{dominant} IS NOT NULL AS is_mixed, CAST({dominant} AS VARCHAR) AS dominant_type, "
        f"coalesce(CAST({off} AS VARCHAR), '') AS off_type_examples FROM {n}"
    )


def _full_sql(*names: str) -> str:
    parts = [_whole_sql(n, c, k) for n in names for c, k in KINDS_FULLY[n].items()]
    return with_shop("shop_orders", "mixed_orders") + " " + " UNION ALL ".join(parts)


def _fully(frames: dict[str, DataFrame]) -> DataFrame:
    """Every field of the profile; the native range is compared for whole numbers, whose text both engines write alike."""
    shown = {
        "null_rate": F.round("null_rate", 6),
        "minimum_exact": F.when(F.col("inferred_type") == t.INTEGER, F.col("minimum_exact")),
        "maximum_exact": F.when(F.col("inferred_type") == t.INTEGER, F.col("maximum_exact")),
        "quantiles": F.array_join(F.transform("quantiles", lambda x: F.round(x, 2).cast("string")), " "),
        "samples": F.array_join("samples", "\x1f"),
        "distribution": F.concat_ws("\x1f", F.transform("distribution", lambda x: F.concat(x["label"], F.lit("="), x["count"]))),
        "off_type_examples": F.array_join("off_type_examples", "\x1f"),
    }
    return _stacked(frames, lambda df: profile.profile(df).withColumns(shown))


@suite.query("profile_full", _full_sql("shop_orders"))
def profile_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fully(shop(spark, sf_dir, "shop_orders"))


@suite.query("profile_full_texts", _full_sql("mixed_orders", "documents"))
def profile_full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents among them, told apart by digests."""
    return _fully(shop(spark, sf_dir, "mixed_orders") | {"documents": given(spark, sf_dir, "documents")})


_FAR = 9_007_199_254_740_993  # the first whole number that no double holds


@suite.query(
    "profile_exact_range",
    f"SELECT 'id' AS column_name, CAST(min(o_orderkey + {_FAR}) AS VARCHAR) AS minimum_exact, "
    f"CAST(max(o_orderkey + {_FAR}) AS VARCHAR) AS maximum_exact FROM orders UNION ALL "
    "SELECT 'cents', CAST(min(CAST(o_totalprice AS DECIMAL(30, 4))) AS VARCHAR), "
    "CAST(max(CAST(o_totalprice AS DECIMAL(30, 4))) AS VARCHAR) FROM orders",
)
def profile_exact_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = given(spark, sf_dir, "orders").selectExpr(f"o_orderkey + {_FAR} AS id", "CAST(o_totalprice AS DECIMAL(30, 4)) AS cents")
    return profile.column_facts(wide).select("column_name", "minimum_exact", "maximum_exact")


def _released_sql(n: str, c: str, k: str) -> str:
    return (
        f"SELECT '{c}' AS column_name, '{k}' AS inferred_type, CAST(count(*) AS INTEGER) AS released, "
        f"string_agg(left(v, 200), '|' ORDER BY v) AS samples FROM (SELECT v FROM (SELECT DISTINCT CAST(x AS VARCHAR) AS v, x "
        f"FROM (SELECT {c} AS x FROM {n}) WHERE x IS NOT NULL ORDER BY x LIMIT 20) ORDER BY v LIMIT 5)"
    )


@suite.query("sample_payload", _union_sql(("mixed_orders",), _released_sql))
def sample_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shop(spark, sf_dir, "mixed_orders")["mixed_orders"]
    released = profile.released_samples(profile.profile(df))
    return released.select("column_name", "inferred_type", "released", F.array_join("samples", "|").alias("samples"))


def _fingerprint_sql() -> str:
    parts = []
    for n in PROFILED:
        text = "|".join(sorted(f"{c}:{k}" for c, k in KINDS[n].items()))
        parts.append(f"SELECT '{n}' AS table_name, '{text}' AS fingerprint, count(*) AS row_count FROM {n}")
    return with_shop(*PROFILED) + " " + " UNION ALL ".join(parts)


@suite.query("schema_fingerprint", _fingerprint_sql())
def schema_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(
        shop(spark, sf_dir, *PROFILED),
        lambda df: df.agg(F.count("*").alias("row_count")).withColumn("fingerprint", F.lit(t.schema_fingerprint(df))),
    )


# ---- N1-N8 ------------------------------------------------------------------
_KEY = "lower(trim(regexp_replace(v, '\\s+', ' ', 'g')))"
_KEYED = (
    with_shop("messy_customers")
    + f", vocab AS (SELECT 'segment' AS column_name, segment AS v, count(*) AS n FROM messy_customers GROUP BY 2), "
    f"keyed AS (SELECT column_name, v, n, {_KEY} AS k, v = trim(regexp_replace(v, '\\s+', ' ', 'g')) AS is_clean, "
    f"v = upper(substr(v, 1, 1)) || lower(substr(v, 2)) AS is_title FROM vocab), "
    f"ranked AS (SELECT *, first_value(v) OVER (PARTITION BY column_name, k ORDER BY n DESC, is_clean DESC, is_title DESC, v) "
    f"AS canonical, count(*) OVER (PARTITION BY column_name, k) AS size FROM keyed) "
)


def _messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shop(spark, sf_dir, "messy_customers")["messy_customers"]


@suite.query(
    "norm_candidates",
    _KEYED + "SELECT column_name, CAST(count(*) AS BIGINT) AS distinct_count, count(DISTINCT k) AS identities, "
    "CAST(sum(n) AS BIGINT) AS rows_seen FROM keyed GROUP BY 1 HAVING count(*) BETWEEN 2 AND 200 "
    "AND count(DISTINCT k) < 0.9 * sum(n)",
)
def norm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = normalize.keyed_vocabulary(_messy(spark, sf_dir))
    return keyed.groupBy("column_name").agg(
        F.count("*").alias("distinct_count"), F.count_distinct("key").alias("identities"), F.sum("rows").alias("rows_seen")
    )


@suite.query(
    "norm_groups",
    _KEYED + "SELECT column_name, k AS identity, canonical, string_agg(v || '=' || n, ';' ORDER BY n DESC, v) AS variants, "
    "CAST(sum(n) AS BIGINT) AS group_rows FROM ranked WHERE size >= 2 GROUP BY 1, 2, 3",
)
def norm_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = normalize.variant_groups(_messy(spark, sf_dir))
    each = F.transform("variants", lambda v: F.concat(v["value"], F.lit("="), v["rows"].cast("string")))
    return groups.select("column_name", F.col("key").alias("identity"), "canonical", F.array_join(each, ";").alias("variants"), "group_rows")


@suite.query("norm_mapping", _KEYED + "SELECT column_name, v AS raw, canonical, n AS row_count FROM ranked WHERE size >= 2 AND v <> canonical")
def norm_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.mapping(normalize.variant_groups(_messy(spark, sf_dir))).withColumnRenamed("rows", "row_count")


@suite.query(
    "norm_rules",
    _KEYED + "SELECT 'norm:' || column_name AS rule_id, 'Standardize \"' || column_name || '\": merge ' || "
    "string_agg(size || ' variants into \"' || canonical || '\" (' || rows_seen || ' rows)', ', ' ORDER BY k) || '.' AS description "
    "FROM (SELECT column_name, k, canonical, size, sum(n) AS rows_seen FROM ranked WHERE size >= 2 GROUP BY ALL) GROUP BY column_name",
)
def norm_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.rules(normalize.variant_groups(_messy(spark, sf_dir))).select("rule_id", "description")


_TOTALS = "count(*) AS customers, CAST(round(sum(balance), 2) AS DOUBLE) AS balance"


def _totals(df: DataFrame) -> DataFrame:
    return df.groupBy("segment").agg(F.count("*").alias("customers"), F.round(F.sum("balance"), 2).alias("balance"))


@suite.query(
    "norm_apply_totals",
    _KEYED + f"SELECT coalesce(canonical, segment) AS segment, {_TOTALS} FROM messy_customers "
    "LEFT JOIN (SELECT v, canonical FROM ranked WHERE size >= 2) ON v = segment GROUP BY 1",
)
def norm_apply_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _messy(spark, sf_dir)
    return _totals(normalize.apply_mapping_table(df, "segment", normalize.mapping(normalize.variant_groups(df))))


@suite.query(
    "norm_approve",
    _KEYED + f"SELECT coalesce(canonical, segment) AS segment, {_TOTALS} FROM messy_customers "
    "LEFT JOIN (SELECT v, canonical FROM ranked WHERE size >= 2) ON v = segment GROUP BY 1",
)
def norm_approve(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = normalize.Standardisation(_messy(spark, sf_dir))
    work.approve("norm:segment")
    return _totals(work.view())


@suite.query("norm_revoke", with_shop("messy_customers") + f" SELECT segment, {_TOTALS} FROM messy_customers GROUP BY 1")
def norm_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = normalize.Standardisation(_messy(spark, sf_dir))
    work.approve("norm:segment")
    work.revoke("norm:segment")
    return _totals(work.view())


@suite.query(
    "norm_dismiss_persisted",
    with_shop("messy_customers") + f" SELECT segment, 0::BIGINT AS open_proposals, {_TOTALS} FROM messy_customers GROUP BY 1",
)
def norm_dismiss_persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dismissal outlives its session: opened again, the store proposes nothing and shows the data as it is."""
    root = scratch_path(spark, "store")
    first = DatasetStore(spark, root)
    first.write("customers", _messy(spark, sf_dir))
    first.standardisation("customers").dismiss("norm:segment")
    again = DatasetStore(spark, root)
    left = again.standardisation("customers").proposals().filter("column_name = 'segment'").count()
    return _totals(again.read("customers")).withColumn("open_proposals", F.lit(left).cast("bigint"))


@suite.query(
    "norm_profile_after_approval",
    _KEYED + ", shown AS (SELECT coalesce(canonical, segment) AS segment, balance FROM messy_customers "
    "LEFT JOIN (SELECT v, canonical FROM ranked WHERE size >= 2) ON v = segment) "
    "SELECT 'segment' AS column_name, count(*) AS row_count, count(*) - count(segment) AS null_count, count(DISTINCT segment) AS distinct_count, "
    "(SELECT string_agg(segment, '|' ORDER BY segment) FROM (SELECT DISTINCT segment FROM shown WHERE segment IS NOT NULL ORDER BY 1 LIMIT 20)) AS samples FROM shown",
)
def norm_profile_after_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once a rule is approved, what is profiled is the standardised view; the stored version stays as it was."""
    root = scratch_path(spark, "store")
    DatasetStore(spark, root).write("customers", _messy(spark, sf_dir))
    DatasetStore(spark, root).standardisation("customers").approve("norm:segment")
    found = profile.profile(DatasetStore(spark, root).read("customers").select("segment"))
    return found.select("column_name", "row_count", "null_count", "distinct_count", F.array_join("samples", "|").alias("samples"))
