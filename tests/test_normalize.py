from __future__ import annotations

import pytest
from conftest import rows

from tablewright.operators import normalize


def column(spark, values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], "region string, amount int")


@pytest.fixture
def sales(spark):
    data = [("East", 10), ("east", 20), ("EAST", 30), ("West", 40), ("West", 50)]
    return spark.createDataFrame(data, "region string, amount int")


def totals(df):
    return rows(df.groupBy("region").sum("amount"))


def test_approve_then_revoke(sales):
    work = normalize.Standardisation(sales)
    rule = work.proposals().first()
    assert rule["rule_id"] == "norm:region"
    assert rule["description"] == 'Standardize "region": merge 3 variants into "East" (3 rows).'
    assert rule["mapping"] == {"EAST": "East", "east": "East"}
    work.approve("norm:region")
    assert totals(work.view()) == [("East", 60), ("West", 90)]
    assert work.proposals().count() == 0
    assert work.stored.select("region").distinct().count() == 4
    work.revoke("norm:region")
    assert work.view().select("region").distinct().count() == 4
    assert work.proposals().count() == 1


def test_dismiss_and_unknown_rules(sales):
    work = normalize.Standardisation(sales)
    work.dismiss("norm:region")
    assert work.proposals().count() == 0 and work.view().select("region").distinct().count() == 4
    for action in (work.approve, work.dismiss, work.revoke):
        with pytest.raises(normalize.UnknownRuleError):
            action("norm:region")


def test_later_values_are_not_covered(spark, sales):
    mapping = {"region": {"EAST": "East", "east": "East"}}
    grown = sales.union(spark.createDataFrame([("eAsT", 5)], sales.schema))
    assert totals(normalize.apply_mappings(grown, mapping)) == [("East", 60), ("West", 90), ("eAsT", 5)]


def test_blanks(spark):
    df = column(spark, ["New York", " New York", "New  York", "Boston"] * 2)
    (group,) = normalize.variant_groups(df).collect()
    assert group["canonical"] == "New York" and len(group["variants"]) == 3


def test_unicode_identity(spark):
    df = column(spark, ["Straße", "STRASSE", "Straße", "x", "x", "x"])
    (group,) = normalize.variant_groups(df).collect()
    assert group["canonical"] == "Straße" and group["key"] == "strasse"


@pytest.mark.parametrize(
    "values, canonical",
    [
        (["EAST", "EAST", "East"], "EAST"),  # most rows
        ([" East", "EAST"], "EAST"),  # tidy before title
        (["EAST", "East", "east"], "East"),  # title case
        (["eaST", "EAst"], "EAst"),  # smallest
        (["o'neil", "O'Neil"], "O'Neil"),  # words start after any non-letter
    ],
)
def test_choice(spark, values, canonical):
    filler = ["West"] * 20
    (group,) = normalize.variant_groups(column(spark, values + filler)).collect()
    assert group["canonical"] == canonical


def test_identifiers_are_left_alone(spark):
    assert normalize.variant_groups(column(spark, ["A1", "a1"] + [f"B{i}" for i in range(2, 10)])).count() == 0


def test_candidate_gates(spark):
    many = column(spark, [f"Value {i % 201}" for i in range(1000)] + ["value 1"])
    assert normalize.vocabulary(many).count() == 0
    assert normalize.vocabulary(column(spark, ["same"] * 5)).count() == 0
    assert normalize.variant_groups(column(spark, ["  ", " ", "a", "a", "a"])).count() == 0
    assert normalize.vocabulary(spark.range(5)).count() == 0


def test_mapping_table_equals_literal_mapping(spark, sales):
    groups = normalize.variant_groups(sales)
    by_join = normalize.apply_mapping_table(sales, "region", normalize.mapping(groups))
    assert totals(by_join) == [("East", 60), ("West", 90)]


def test_approved_mappings_outlive_the_session(spark, sales, tmp_path):
    from tablewright.sources.store import DatasetStore

    store = DatasetStore(spark, str(tmp_path))
    store.write("sales", sales)
    work = normalize.Standardisation(store.read("sales"))
    work.approve("norm:region")
    store.set_mappings("sales", work.approved())
    again = DatasetStore(spark, str(tmp_path))
    assert totals(again.read("sales")) == [("East", 60), ("West", 90)]
    again.set_mappings("sales", {})
    assert again.read("sales").select("region").distinct().count() == 4


def test_decisions_outlive_the_session_and_the_latest_holds(spark, sales, tmp_path):
    from tablewright.sources.store import DatasetStore

    store = DatasetStore(spark, str(tmp_path))
    store.write("sales", sales)
    store.standardisation("sales").dismiss("norm:region")
    again = DatasetStore(spark, str(tmp_path))
    assert again.standardisation("sales").proposals().filter("column_name = 'region'").count() == 0
    with pytest.raises(normalize.UnknownRuleError):
        again.standardisation("sales").approve("norm:region")
    again.journal("sales").add("region", "revoked")  # open again
    work = again.standardisation("sales")
    work.approve("norm:region")
    assert totals(DatasetStore(spark, str(tmp_path)).read("sales")) == [("East", 60), ("West", 90)]
    again.standardisation("sales").revoke("norm:region")
    assert again.read("sales").select("region").distinct().count() == 4
    assert [r["status"] for r in again.journal("sales").entries().orderBy("number").collect()] == ["dismissed", "revoked", "approved", "revoked"]
    assert store.stored("sales").count() == sales.count()
