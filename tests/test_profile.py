from __future__ import annotations

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from conftest import rows

from tablewright.operators import counts, profile
from tablewright.suite import profiles


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def test_basic(spark):
    df = spark.createDataFrame([(1, "a", 10.5), (2, None, 20.0), (3, "c", 30.25)], "id int, name string, amount double")
    p = by_column(profile.profile(df))
    assert p["amount"]["minimum"] == 10.5 and p["amount"]["maximum"] == 30.25
    assert p["amount"]["quantiles"] == [15.25, 20.0, 25.125]
    assert p["name"]["null_count"] == 1 and p["name"]["quantiles"] == [] and p["name"]["minimum"] is None
    assert p["id"]["samples"] == ["1", "2", "3"] and p["id"]["distinct_count"] == 3
    assert [c for c, r in sorted(p.items(), key=lambda x: x[1]["position"])] == ["id", "name", "amount"]


def test_empty_table(spark):
    p = by_column(profile.profile(spark.createDataFrame([], "a int, b string")))
    assert p["a"]["null_rate"] == 0.0 and p["a"]["distinct_count"] == 0 and p["b"]["samples"] == []
    assert p["a"]["distribution"] == []


def test_mixed(spark):
    df = spark.createDataFrame([(v,) for v in ("1", "2", "3", "4", "5", "abc", "def")], "code string")
    p = by_column(profile.profile(df))["code"]
    assert p["inferred_type"] == "text" and p["is_mixed"] and p["dominant_type"] == "integer"
    assert p["off_type_examples"] == ["abc", "def"]


def test_mixed_needs_a_majority_and_a_straggler(spark):
    df = spark.createDataFrame([("1", "1", "2024-01-01"), ("x", "2", "2024-02-30"), ("z", "3", "2024-02-28")], "a string, b string, c string")
    p = by_column(profile.profile(df))
    assert not p["a"]["is_mixed"] and not p["b"]["is_mixed"]
    assert p["c"]["dominant_type"] == "date" and p["c"]["off_type_examples"] == ["2024-02-30"]


def test_distribution(spark):
    df = spark.createDataFrame([(i, "gold" if i % 3 else "silver") for i in range(1, 61)], "amount int, tier string")
    p = by_column(profile.profile(df))
    assert sum(b["count"] for b in p["amount"]["distribution"]) == 60
    assert len(p["amount"]["distribution"]) == 15
    assert [(b["label"], b["count"]) for b in p["tier"]["distribution"]] == [("gold", 40), ("silver", 20)]


def test_histogram_skips_empty_bins_and_keeps_the_top_edge(spark):
    values = [float(i) for i in range(30)] + [1000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    bins = by_column(profile.profile(df))["x"]["distribution"]
    assert [(b["label"], b["count"]) for b in bins] == [("0–66.67", 30), ("933.33–1000", 1)]


def test_names_do_not_shadow(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "z", "3")], "v string, c string, k string")
    p = by_column(profile.profile(df))
    assert [(b["label"], b["count"]) for b in p["v"]["distribution"]] == [("a", 2), ("b", 1)]


def test_odd_names_and_types(spark):
    schema = "`a.b` int, `it's` string, `t``q` date, d decimal(10,2), n struct<x:int>, f boolean"
    row = (1, "x'y", dt.date(2024, 1, 2), Decimal("1.50"), (3,), True)
    p = by_column(profile.profile(spark.createDataFrame([row, (None,) * 6], schema)))
    assert {c: r["inferred_type"] for c, r in p.items()} == {
        "a.b": "integer", "it's": "text", "t`q": "date", "d": "decimal", "n": "text", "f": "boolean"
    }
    assert p["n"]["is_nested"] and p["n"]["samples"] == ['{"x":3}']
    assert p["d"]["samples"] == ["1.50"] and p["f"]["samples"] == ["true"]
    assert all(r["null_count"] == 1 and r["null_rate"] == 0.5 for r in p.values())


def test_long_integers_stay_distinct(spark):
    big = 2**60
    df = spark.createDataFrame([(big,), (big + 1,), (big + 2,)], "id bigint")
    p = by_column(profile.profile(df))["id"]
    assert p["distinct_count"] == 3 and p["samples"] == [str(big), str(big + 1), str(big + 2)]


def test_quantiles_with_a_hot_value(many_slices):
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(5000, 7.0), rng.normal(0, 100, 10000)])
    df = many_slices.createDataFrame([(float(v), float(-v)) for v in values], "a double, b double")
    found = by_column(profile.quantiles(df, (0.0, 0.1, 0.5, 0.99, 1.0)))
    np.testing.assert_allclose(found["a"]["quantiles"], np.quantile(values, [0, 0.1, 0.5, 0.99, 1]), rtol=1e-12)
    np.testing.assert_allclose(found["b"]["quantiles"], np.quantile(-values, [0, 0.1, 0.5, 0.99, 1]), rtol=1e-12)


def test_quantiles_do_not_depend_on_the_sketch(spark, monkeypatch):
    values = [float(i % 97) ** 3 for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "a double")
    monkeypatch.setattr(profile, "SKETCH", 2)  # far too coarse: brackets miss and are opened
    monkeypatch.setattr(profile, "BRACKET", 0.0)
    (row,) = profile.quantiles(df, (0.1, 0.37, 0.9)).collect()
    np.testing.assert_allclose(row["quantiles"], np.quantile(values, [0.1, 0.37, 0.9]), rtol=1e-12)


def test_quantiles_by_radix_selection(spark, monkeypatch):
    monkeypatch.setattr(profile, "RANKED", 3)  # regions of more values go digit by digit
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.normal(0, 1, 3000) * 10.0 ** rng.integers(-300, 300, 3000), np.full(500, -2.5), [0.0, -0.0, 5e-324, 1e308]])
    whole = rng.integers(-(2**62), 2**62, len(values))
    df = spark.createDataFrame([(float(v), int(w)) for v, w in zip(values, whole)], "a double, b bigint").repartition(4)
    ps = (0.0, 0.01, 0.25, 0.5, 0.51, 0.999, 1.0)
    found = by_column(profile.quantiles(df, ps))
    for name, plain in (("a", values), ("b", whole.astype(float))):
        ordered = np.sort(plain)
        for p, got in zip(ps, found[name]["quantiles"]):
            at = p * (len(ordered) - 1)
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert min(low, high) <= got <= max(low, high) and (low != high or got == low)


def test_the_key_orders_as_doubles_do(spark):
    values = [float("-inf"), -1e308, -1.5, -1.0, -5e-324, 0.0, 5e-324, 2.2250738585072014e-308, 0.1, 1.0, 1.0000000000000002, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in [*values, float("nan")]], "v double").selectExpr("v", f"{profile.order_key('v')} AS key")
    keys = {str(r["v"]): r["key"] for r in df.collect()}
    for v in values:
        bits = int(np.float64(abs(v)).view(np.int64))
        assert keys[str(v)] == (bits if v >= 0 else -bits - 1)
    assert keys["nan"] > keys["inf"]


def test_quantiles_scan_twice(spark):
    df = spark.range(2000).selectExpr("CAST(id AS DOUBLE) AS a", "id % 7 AS b")
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        for name in ("_brackets", "_regions"):
            patch.setattr(profile, name, lambda *a, f=getattr(profile, name), n=name: (seen.append(n), f(*a))[1])
        profile.quantiles(df).collect()
    assert seen == ["_brackets", "_regions"]


def test_quantiles_of_empty_and_odd_columns(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1.0, nan), (None, nan, nan), (None, 3.0, nan)], "a double, b double, c double")
    found = {c: r["quantiles"] for c, r in by_column(profile.quantiles(df, (0.0, 0.5))).items()}
    assert found["b"] == [1.0, 3.0] and "a" not in found and all(np.isnan(found["c"]))


def test_long_texts_are_told_apart_shown_whole_and_ordered(spark):
    head = "https://example.org/" + "a" * 100
    rng = np.random.default_rng(5)
    links = [head + str(i) for i in rng.integers(0, 60, 500)] + ["b", head, head[:64], "", "é" * 70, "é" * 64 + "f"]
    numbers = ["0" * 80 + str(i % 9) for i in range(len(links) - 30)] + [f"{i % 3}" + "x" * 90 + str(i) for i in range(30)]
    df = spark.createDataFrame(list(zip(links, numbers)), "link string, code string").repartition(3)
    p = by_column(profile.profile(df))
    for name, values in (("link", links), ("code", numbers)):
        plain = sorted(set(values), key=str.encode)
        assert p[name]["distinct_count"] == len(plain) and p[name]["samples"] == plain[:20]
        top = sorted(((-values.count(v), v.encode(), v) for v in plain))[:10]
        assert [(b["label"], b["count"]) for b in p[name]["distribution"]] == [(v, -n) for n, _, v in top]
    assert p["code"]["dominant_type"] == "integer" and not p["link"]["is_mixed"]
    assert p["code"]["off_type_examples"] == sorted(numbers[-30:])[:20]


def test_the_range_is_kept_in_the_columns_own_type(spark):
    df = spark.createDataFrame([(2**53 + 1, Decimal("0.10"), 1.5, "a"), (2**62 + 1, Decimal("12345678901234567890.25"), None, None)], "a bigint, b decimal(30,2), c double, d string")
    want = {"a": (str(2**53 + 1), str(2**62 + 1)), "b": ("0.10", "12345678901234567890.25"), "c": ("1.5", "1.5"), "d": (None, None)}
    for found in (profile.column_facts(df), profile.profile(df)):
        assert {c: (r["minimum_exact"], r["maximum_exact"]) for c, r in by_column(found).items()} == want


def test_value_counts_leave_nulls_out(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "x string")
    assert rows(counts.value_counts(df, "x")) == [("a", 2), ("b", 1)]


def test_released_samples(spark):
    df = spark.createDataFrame([("x" * 300 + str(i),) for i in range(9)], "long string")
    sent = profile.released_samples(profile.profile(df)).first()
    assert sent["released"] == 5 and {len(s) for s in sent["samples"]} == {200}


def test_the_histogram_query_counts_values_once(spark, tmp_path):
    tables = {
        "customer": "id AS c_custkey, 'n' AS c_name, 1 AS c_nationkey, id * 0.5D AS c_acctbal, 's' AS c_mktsegment",
        "orders": "id AS o_orderkey, id AS o_custkey, 'O' AS o_orderstatus, id * 2.0D AS o_totalprice, DATE '1999-01-01' AS o_orderdate, 'p' AS o_orderpriority",
        "lineitem": "id AS l_orderkey, 1 AS l_linenumber, id AS l_partkey, id AS l_suppkey, id * 1.0D AS l_quantity, id * 3.0D AS l_extendedprice, "
        "0.1D AS l_discount, 'R' AS l_returnflag, DATE '1999-01-01' AS l_shipdate",
    }
    for name, select in tables.items():
        spark.range(60).selectExpr(*[x.strip() for x in select.split(",")]).write.parquet(str(tmp_path / f"{name}.parquet"))
    found = profiles.profile_histogram(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [l_orderkey") == 1  # for the range alone
    bins = [r["n"] for r in found.filter("table_name = 'line_items' AND column_name = 'price'").collect()]
    assert len(bins) == 15 and sum(bins) == 60
    assert not found.filter("column_name = 'discount'").count()


def test_value_counts_keep_all_their_parts(spark):
    df = spark.createDataFrame([(1, 2.5, Decimal("1.50"), "x")] * 2, "a int, b double, c decimal(9,2), d string")
    parts = {"a": (1, None, None), "b": (None, 2.5, None), "c": (None, 1.5, "1.50"), "d": (None, None, "x")}
    assert rows(counts.count_values(df)) == sorted([(c, *v, 2) for c, v in parts.items()], key=repr)
    for c, v in parts.items():
        assert rows(counts.count_values(df, [c])) == [(c, *v, 2)]
