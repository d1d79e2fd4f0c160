from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.functions.prefix import running_totals
from tablewright.plans.guard import QueryWorkspace
from tablewright.relational import features, labels, neighbors, spec, transforms
from tablewright.relational.spec import DatasetSpec, ForeignKey, RelationalError, TableSpec, TaskSpec

DAY = dt.date


def day(offset):
    return DAY(2020, 1, 1) + dt.timedelta(days=offset)


# ---- running totals -----------------------------------------------------------
@pytest.mark.parametrize("keys", [["k"], []])
def test_running_totals_across_slices(many_slices, keys):
    rng = random.Random(5)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(50)}", i, rng.randrange(100), rng.random()) for i in range(6000)]
    df = many_slices.createDataFrame(data, "k string, o int, n bigint, m double").repartition(5)
    found = {(r["k"], r["o"]): r for r in running_totals(df, keys, ["o"], ["n"], ["m"], with_totals=True).collect()}
    assert len(found) == len(data)
    total, top = {}, {}
    order = sorted(data, key=lambda r: (r[0], r[1]) if keys else r[1])
    for k, o, n, m in order:
        g = k if keys else ""
        total[g] = total.get(g, 0) + n
        top[g] = max(top.get(g, 0), m)
        assert found[(k, o)]["run_n"] == total[g] and found[(k, o)]["run_m"] == top[g]
    for k, o, _, _ in data:
        assert found[(k, o)]["total_n"] == total[k if keys else ""]


def test_a_hot_key_is_spread_over_slices(many_slices, monkeypatch):
    from tablewright.functions import prefix

    kept = []
    keep = prefix.materialise
    monkeypatch.setattr(prefix, "materialise", lambda df, label: kept.append(keep(df, label)) or kept[-1])
    df = many_slices.range(40000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id % 101)) AS k", "id AS o", "1L AS n")
    last = running_totals(df, ["k"], ["o"], ["n"]).groupBy("k").agg(F.max("run_n").alias("n"))
    assert last.filter("k = 'hot'").first()["n"] == 13334
    sizes = [r["count"] for r in kept[0].groupBy("_slice").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 40000 / 8 * 1.6
    assert kept[0].filter("k = 'hot'").select("_slice").distinct().count() >= 3


# ---- a miniature bank ----------------------------------------------------------
@pytest.fixture
def bank(spark):
    frames = {
        "district": spark.createDataFrame([(1, "N"), (2, "S")], "district_id bigint, region string"),
        "account": spark.createDataFrame(
            [(1, 1, day(-400)), (2, 1, day(-100)), (3, 2, day(-50))], "account_id bigint, district_id bigint, open_date date"
        ),
        "trans": spark.createDataFrame(
            [
                (1, 1, day(0), 10.0),  # at as-of: seen
                (2, 1, day(1), 99.0),  # after: never seen
                (3, 1, day(-29), 1.0),  # inside 30 days
                (4, 1, day(-30), 2.0),  # exactly 30 days back: outside
                (5, 1, day(-365), 4.0),  # outside every window
                (6, 1, day(-364), None),  # counted, no amount
                (7, 2, day(-200), 5.0),
                (8, 1, day(-29), 0.5),  # same day as 3
            ],
            "trans_id bigint, account_id bigint, trans_date date, amount double",
        ),
    }
    kinds = {"district_id": "int", "region": "string"}
    tables = {
        "district": TableSpec("district", "district_id", kinds),
        "account": TableSpec(
            "account", "account_id", {"account_id": "int", "district_id": "int", "open_date": "date"}, "open_date",
            (ForeignKey("district_id", "district", "district_id"),),
        ),
        "trans": TableSpec(
            "trans", "trans_id", {"trans_id": "int", "account_id": "int", "trans_date": "date", "amount": "float"}, "trans_date",
            (ForeignKey("account_id", "account", "account_id"),),
        ),
    }
    return DatasetSpec("bank", tables, "2020-02-01", "2020-03-01"), frames


TASK = TaskSpec("t", "account", "account_id", "open_date", 90)


def path_to(bank_spec, entity, *targets):
    return next(p for p in features.temporal_paths(bank_spec, entity) if tuple(e.target for e in p) == targets)


def test_paths(bank):
    found = {tuple(e.target for e in p) for p in features.temporal_paths(bank[0], "account")}
    assert found == {("trans",), ("district", "account"), ("trans", "account")}
    assert {features.path_name(p) for p in features.temporal_paths(bank[0], "account")} == {
        "account_trans_account_id", "account_district_district_id_account_district_id", "account_trans_account_id_account_account_id"
    }


def test_window_edges(spark, bank):
    bank_spec, frames = bank
    training = spark.createDataFrame([(1, day(0)), (2, day(0)), (3, day(0))], "account_id bigint, as_of date")
    path = path_to(bank_spec, "account", "trans")
    out = {r["account_id"]: r for r in features.path_features(bank_spec, TASK, frames, training, path).collect()}
    p = "account_trans_account_id"
    one = out[1]
    assert one[f"{p}_30d_count"] == 3 and one[f"{p}_30d_sum_amount"] == 11.5  # as-of included, day 30 not
    assert one[f"{p}_90d_count"] == 4 and one[f"{p}_90d_sum_amount"] == 13.5
    assert one[f"{p}_365d_count"] == 5 and one[f"{p}_365d_sum_amount"] == 13.5  # 364 counted, its amount missing
    assert one[f"{p}_365d_avg_amount"] == pytest.approx(13.5 / 4)
    assert one[f"{p}_30d_days_since_last"] == 0
    assert out[2][f"{p}_180d_count"] is None and out[2][f"{p}_365d_count"] == 1
    assert out[2][f"{p}_365d_days_since_last"] == 200
    assert out[3][f"{p}_365d_count"] is None
    matrix = features.feature_matrix(bank_spec, TASK, frames, training.withColumn("label", F.lit(0)), [path])
    got = {r["account_id"]: r for r in matrix.collect()}
    assert got[3][f"{p}_365d_count"] == 0 and got[3][f"{p}_365d_sum_amount"] is None and got[3]["district_id"] == 2
    assert "open_date" not in matrix.columns


def test_fan_out_through_a_parent_is_kept(spark, bank):
    bank_spec, frames = bank
    training = spark.createDataFrame([(1, day(0)), (2, day(0))], "account_id bigint, as_of date")
    path = path_to(bank_spec, "account", "district", "account")
    out = {r["account_id"]: r for r in features.path_features(bank_spec, TASK, frames, training, path).collect()}
    name = features.path_name(path)
    assert out[1][f"{name}_180d_count"] == 1 and out[2][f"{name}_180d_count"] == 1  # account 2 opened 100 days back
    back = features.path_name(path_to(bank_spec, "account", "trans", "account"))
    down = features.path_features(bank_spec, TASK, frames, training, path_to(bank_spec, "account", "trans", "account"))
    row = {r["account_id"]: r for r in down.collect()}[2]
    assert row[f"{back}_180d_count"] == 1 and row[f"{back}_180d_days_since_last"] == 100


def test_features_against_brute_force_with_a_hot_key(many_slices, bank):
    bank_spec, _ = bank
    rng = random.Random(11)
    trans = [(i, 1 if i % 3 == 0 else rng.randrange(2, 40), day(rng.randrange(-500, 100)), round(rng.random() * 100, 2)) for i in range(3000)]
    accounts = [(a, 1, day(-600)) for a in range(1, 41)]
    training = [(a, day(d)) for a in range(1, 41) for d in (-90, 0, 45)]
    s = many_slices
    frames = {
        "account": s.createDataFrame(accounts, "account_id bigint, district_id bigint, open_date date"),
        "trans": s.createDataFrame(trans, "trans_id bigint, account_id bigint, trans_date date, amount double"),
    }
    base = s.createDataFrame(training, "account_id bigint, as_of date")
    path = path_to(bank_spec, "account", "trans")
    out = {(r["account_id"], r["as_of"]): r for r in features.path_features(bank_spec, TASK, frames, base, path).collect()}
    p = features.path_name(path)
    for a, as_of in training:
        for w in features.WINDOWS:
            seen = [t for t in trans if t[1] == a and as_of - dt.timedelta(days=w) < t[2] <= as_of]
            row = out.get((a, as_of))
            assert ((row and row[f"{p}_{w}d_count"]) or 0) == len(seen)
            if seen:
                assert row[f"{p}_{w}d_sum_amount"] == pytest.approx(sum(t[3] for t in seen), abs=1e-9)
                assert row[f"{p}_{w}d_days_since_last"] == (as_of - max(t[2] for t in seen)).days


def test_small_keys_meet_one_shuffle_and_hot_ones_the_same_rows(spark, monkeypatch, bank):
    """F9 to F12, F14: keys that fit one task write nothing on the way; a hot key is laid out by range and gives the same."""
    from tablewright.functions import prefix

    bank_spec, frames = bank
    training = spark.createDataFrame([(a, day(d)) for a in (1, 2, 3) for d in (-60, 0, 45)], "account_id bigint, as_of date")
    written = []
    keep = prefix.materialise
    monkeypatch.setattr(prefix, "materialise", lambda df, label: written.append(label) or keep(df, label))
    frames = {**frames, "trans": frames["trans"].unionByName(frames["trans"])}  # times and rows repeat
    for path in features.temporal_paths(bank_spec, "account"):
        few = features.path_features(bank_spec, TASK, frames, training, path)
        assert not written
        monkeypatch.setattr(prefix, "MOST_ROWS", 2)
        many = features.path_features(bank_spec, TASK, frames, training, path)
        assert written and few.columns == many.columns and rows(few) == rows(many) and few.count()
        monkeypatch.undo()
        written.clear()
        monkeypatch.setattr(prefix, "materialise", lambda df, label: written.append(label) or keep(df, label))


def test_hidden_columns_never_appear(spark, bank):
    bank_spec, frames = bank
    training = spark.createDataFrame([(1, day(0), 1)], "account_id bigint, as_of date, label int")
    task = TASK.hide("trans.amount", "account.district_id")
    matrix = features.feature_matrix(bank_spec, task, frames, training, [path_to(bank_spec, "account", "trans")])
    assert not [c for c in matrix.columns if "amount" in c or c == "district_id"]
    assert task.hide("a.b").hidden > task.hidden


def test_last_k_with_a_hot_key(many_slices):
    rng = random.Random(2)
    data = [(i, "hot" if i % 3 == 0 else f"k{i % 7}", day(rng.randrange(0, 60)), i * 1.0) for i in range(2000)]
    ask = [(k, day(d)) for k in ["hot", *[f"k{j}" for j in range(7)], "none"] for d in (-1, 10, 10, 59)]
    s = many_slices
    moments = s.createDataFrame(ask, "key string, as_of date").distinct()
    table = s.createDataFrame(data, "id bigint, k string, t date, v double")
    found = {}
    for r in neighbors.last_k(moments, table, "k", "t", "id", 5).collect():
        found.setdefault((r["key"], r["as_of"]), []).append((r["recency"], r["id"]))
    for k, as_of in set(ask):
        seen = sorted(((t, i) for i, kk, t, _ in data if kk == k and t <= as_of), reverse=True)[:5]
        assert sorted(found.get((k, as_of), [])) == [(n + 1, i) for n, (_, i) in enumerate(seen)]


def test_last_k_of_small_and_hot_keys_agree(spark, monkeypatch):
    """small keys write nothing on the way; either way a moment looks up two chunks at most, not every row."""
    from tablewright.functions import prefix

    table = spark.createDataFrame([(i, i % 3, day(i // 4)) for i in range(90)], "id bigint, k bigint, t date")
    moments = spark.createDataFrame([(k, day(d)) for k in range(4) for d in (-1, 0, 3, 9, 40)], "key bigint, as_of date")
    written = []
    keep = prefix.materialise
    monkeypatch.setattr(prefix, "materialise", lambda df, label: written.append(label) or keep(df, label))
    few = rows(neighbors.last_k(moments, table, "k", "t", "id", 4))
    assert few and not written
    monkeypatch.setattr(prefix, "MOST_ROWS", 5)
    assert rows(neighbors.last_k(moments, table, "k", "t", "id", 4)) == few and written


def test_last_k_without_a_time(spark):
    moments = spark.createDataFrame([("a", day(0))], "key string, as_of date")
    table = spark.createDataFrame([(i, "a") for i in range(10)], "id bigint, k string")
    assert rows(neighbors.last_k(moments, table, "k", None, "id", 3), "id") == [(7,), (8,), (9,)]


# ---- labels ----------------------------------------------------------------------
def test_grid_respects_eligibility(spark, bank):
    grid = labels.time_grid(bank[1]["account"], "account_id", F.col("open_date"), "2019-10-01", "2020-01-01", 3)
    assert rows(grid) == [(1, DAY(2019, 10, 1)), (1, DAY(2020, 1, 1)), (2, DAY(2019, 10, 1)), (2, DAY(2020, 1, 1)), (3, DAY(2020, 1, 1))]


def test_future_event_edges(spark):
    grid = spark.createDataFrame([(i, day(0)) for i in range(1, 7)], "id int, as_of date")
    events = spark.createDataFrame([(1, day(0)), (2, day(1)), (3, day(10)), (4, day(11)), (5, day(-3)), (5, day(2))], "e int, t date")
    found = labels.future_event_label(grid, "id", events, "e", "t", 10)
    assert rows(found, "id", "label") == [(2, 1), (3, 1), (4, 0), (6, 0)]


def test_volume_edges(spark):
    events = spark.createDataFrame(
        [(1, day(0), 4.0), (1, day(-90), 100.0), (1, day(-89), 6.0), (1, day(1), 4.0), (1, day(90), 0.5), (1, day(91), 100.0)],
        "e int, t date, a double",
    )
    found = labels.volume_around(events, "e", "t", "a", "2020-01-01", "2020-01-01", 3, 90, 90)
    assert [(int(r["before"]), float(r["after"])) for r in found.collect()] == [(10, 4.5)]
    grid = spark.createDataFrame([(1, day(0)), (2, day(0))], "id int, as_of date")
    assert rows(labels.volume_drop_label(grid, "id", found)) == [(1, day(0), 1)]


def test_splits_and_validation(spark):
    data = [(i, day(d), label) for i, d in enumerate((0, 31, 60, 90)) for label in (0, 1)]
    table = labels.assign_splits(spark.createDataFrame(data, "id int, as_of date, label int"), "2020-02-01", "2020-03-01")
    assert {(r["as_of"], r["split"]) for r in table.collect()} == {
        (day(0), "train"), (day(31), "val"), (day(60), "test"), (day(90), "test")
    }
    assert labels.validate_training_table("t", table)["test"]["rows"] == 4
    bad = [table.filter("1=0"), table.filter("split <> 'val'"), table.filter("split <> 'val' OR label = 1"), table.withColumn("label", F.lit(2))]
    for broken in bad:
        with pytest.raises(RelationalError):
            labels.validate_training_table("t", broken)


def test_label_query_must_return_its_columns(spark, bank):
    space = QueryWorkspace(spark)
    space.register("trans", bank[1]["trans"])
    with pytest.raises(RelationalError):
        labels.query_label(space, TaskSpec("t", "trans", "trans_id", "trans_date", 1, "SELECT trans_id, 1 AS label FROM q_trans"))


# ---- specification ---------------------------------------------------------------
def test_spec_is_checked():
    good = TableSpec("a", "id", {"id": "int", "t": "date"}, "t")
    for broken in (
        TableSpec("a", "nope", {"id": "int"}),
        TableSpec("a", "id", {"id": "int"}, "t"),
        TableSpec("a", "id", {"id": "money"}),
        TableSpec("a", "id", {"id": "int"}, None, (ForeignKey("id", "b", "id"),)),
    ):
        with pytest.raises(RelationalError):
            DatasetSpec("d", {"a": broken}, "2020-01-01", "2020-02-01")
    with pytest.raises(RelationalError):
        DatasetSpec("d", {"a": good}, "2020-02-01", "2020-02-01")


def test_derived_spec_uses_only_found_links(spark, bank):
    frames = bank[1]
    schema = "child_table string, child_column string, parent_table string, parent_column string"
    found = spark.createDataFrame(
        [("trans", "account_id", "account", "account_id"), ("trans", "account_id", "district", "district_id"), ("x", "y", "account", "account_id")], schema
    )
    derived = spec.derive_spec("bank", frames, found, {"trans": "trans_date"}, "2020-01-01", "2020-02-01")
    assert spec.foreign_keys(derived) == [("trans", "account_id", "account", "account_id")]
    assert derived.tables["account"].time_column is None and derived.tables["trans"].time_column == "trans_date"
    assert derived.tables["account"].primary_key == "account_id" and derived.tables["trans"].primary_key == "trans_id"
    with pytest.raises(RelationalError):
        spec.derive_spec("bank", frames, found.limit(0), {}, "2020-01-01", "2020-02-01")
    with pytest.raises(RelationalError):
        spec.derive_spec("bank", {"district": frames["district"], "x": frames["district"]}, found, {}, "2020-01-01", "2020-02-01")


def test_hops_reach_one_past_the_farthest_table(bank):
    assert spec.hops(bank[0], "account") == (128, 128)
    assert spec.hops(bank[0], "trans") == (16, 64, 16)
    assert spec.hops(bank[0], "district") == (16, 64, 16)


def test_label_columns_and_time_candidates(bank):
    assert spec.label_columns('SELECT "Status", amount FROM loan', ["status", "amount", "duration"]) == ["amount", "status"]
    assert spec.time_candidates(bank[1]) == {"district": [], "account": ["open_date"], "trans": ["trans_date"]}


def test_inputs_are_cast_and_checked(spark, bank):
    bank_spec, frames = bank
    text = {n: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for n, df in frames.items()}
    built = spec.build_inputs(bank_spec, text)
    assert dict(built["trans"].dtypes)["amount"] == "double" and dict(built["trans"].dtypes)["trans_date"] == "date"
    orphan = text | {"account": text["account"].filter("account_id <> 2")}
    with pytest.raises(RelationalError, match="1 rows of 'trans.account_id'"):
        spec.build_inputs(bank_spec, orphan)
    with pytest.raises(RelationalError, match="missing"):
        spec.build_inputs(bank_spec, text | {"trans": text["trans"].drop("amount")})
    with pytest.raises(Exception):
        spec.cast_declared(text["trans"].withColumn("amount", F.lit("abc")), bank_spec.tables["trans"]).collect()


def test_decoders(spark):
    df = spark.createDataFrame([(930107, "706213", "930107 00:00:00", "?"), (10203, "701213", "010203", " 7.5 ")], "d int, b string, s string, n string")
    born, gender = transforms.decode_birth(F.col("b"))
    out = df.select(transforms.decode_date(F.col("d")), born, gender, transforms.decode_stamp(F.col("s")), transforms.number_or_missing(F.col("n")))
    assert [tuple(r) for r in out.collect()] == [
        (DAY(1993, 1, 7), DAY(1970, 12, 13), "female", DAY(1993, 1, 7), None),
        (DAY(1901, 2, 3), DAY(1970, 12, 13), "male", DAY(1901, 2, 3), 7.5),
    ]


def test_pair_ids(spark):
    data = [("AB", "12"), (None, "0"), ("", ""), (None, None), (None, "7.0"), ("AB", None), (" AB ", " 12 ")]
    df = spark.createDataFrame(data, "b string, a string")
    assert [r[0] for r in df.select(transforms.pair_id(F.col("b"), F.col("a"))).collect()] == ["AB|12", None, None, None, "|7", "AB|", "AB|12"]


def test_the_horizon_counts_from_the_moment_itself(spark):
    grid = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-01 12:00:00' AS as_of")
    events = spark.sql("SELECT 1 AS id, TIMESTAMP '2024-01-11 06:00:00' AS at")
    assert labels.future_event_label(grid, "id", events, "id", "at", 10).first()["label"] == 1
    assert labels.future_event_label(grid, "id", events, "id", "at", 9).first()["label"] == 0


def test_walks_are_counted_as_often_as_they_lead_somewhere(spark):
    """Totals taken inwards equal the walks listed one by one, on a graph with a hub, a loop back and a hidden column."""
    graph = DatasetSpec(
        "g",
        {
            "people": TableSpec("people", "person_id", {"person_id": "int", "team_id": "int", "age": "float"}, None, (ForeignKey("team_id", "teams", "team_id"),)),
            "teams": TableSpec("teams", "team_id", {"team_id": "int", "size": "float"}),
            "notes": TableSpec(
                "notes", "note_id", {"note_id": "int", "person_id": "int", "length": "float", "secret": "float", "day": "date"}, "day",
                (ForeignKey("person_id", "people", "person_id"),),
            ),
        },
        "2020-01-01", "2021-01-01",
    )
    task = TaskSpec("t", "people", "person_id", "", 30, hidden=frozenset({"notes.secret"}))
    people = [(i, None if i == 7 else i % 2, None if i == 3 else float("nan") if i == 5 else 20.0 + i) for i in range(12)]
    teams = [(0, 4.0), (1, 9.0)]
    notes = [(100 + j, j % 5, j * 1.5, 1.0, dt.date(2019, 1, 1 + j % 20)) for j in range(60)]
    frames = {
        "people": spark.createDataFrame(people, "person_id int, team_id int, age double"),
        "teams": spark.createDataFrame(teams, "team_id int, size double"),
        "notes": spark.createDataFrame(notes, "note_id int, person_id int, length double, secret double, day date"),
    }
    grid = [(i, dt.date(2019, 1, d)) for i in range(12) for d in (1, 9, 25)]
    fan_out = (3, 4, 2)
    plain_rows = {
        "people": [dict(zip(("person_id", "team_id", "age"), r)) for r in people],
        "teams": [dict(zip(("team_id", "size"), r)) for r in teams],
        "notes": [dict(zip(("note_id", "person_id", "length", "secret", "day"), r)) for r in notes],
    }

    def seen(edge, key, as_of, k):
        table = graph.tables[edge.target]
        found = [r for r in plain_rows[edge.target] if key is not None and r[edge.target_column] == key]
        if table.time_column:
            found = [r for r in found if r["day"] <= as_of]
        found.sort(key=lambda r: (r.get("day", 0) if table.time_column else 0, r[table.primary_key]), reverse=True)
        return found[: 1 if edge.target_column == table.primary_key else k]

    want = {}
    for person, as_of in grid:
        level = [("people", "hop", plain_rows["people"][person])]
        for hop, k in enumerate(fan_out, 1):
            level = [
                (e.target, f"{name}_{e.label}", r)
                for table, name, row in level for e in features.edges(graph) if e.source == table
                for r in seen(e, row[e.source_column], as_of, k)
            ]
            for _, name, r in level:
                for c in ("age", "size", "length"):
                    if r.get(c) is not None and r[c] == r[c]:
                        want.setdefault((person, as_of, f"{name}_{hop}_mean_{c}"), []).append(r[c])
                want.setdefault((person, as_of, f"{name}_{hop}_rows"), []).append(1)
    df = neighbors.graph_features(graph, task, frames, spark.createDataFrame(grid, "person_id int, as_of date"), fan_out)
    assert not [c for c in df.columns if "secret" in c] and len([c for c in df.columns if c.endswith("_3_rows")]) == 4
    got = df.collect()
    assert len(got) == len(grid)
    for r in got:
        for c in df.columns[2:]:
            values = want.get((r["person_id"], r["as_of"], c), [])
            if c.endswith("_rows"):
                assert r[c] == len(values), (c, r)
            else:
                assert (r[c] is None) == (not values) and (not values or abs(r[c] - sum(values) / len(values)) < 1e-9), (c, r)


def test_walks_list_rows_only_where_they_go_on_to_other_keys(spark, monkeypatch):
    """nothing is written on the way but the seeds; hot keys, rows that come twice and null keys give the same."""
    from tablewright.functions import prefix
    from tablewright.suite import training as tr

    sales = [(j, None if j == 3 else j % 4, "F", j * 1.5, day(j % 30), "1") for j in range(40)]
    lines = [(f"{j}-{n}", None if (j, n) == (5, 1) else j, float(n), j + n / 8, "R", day(j % 30 + 3 * n)) for j in range(40) for n in range(j % 5)]
    frames = {
        "customers": spark.createDataFrame([(i, i, 10.0 * i, "s") for i in (0, 1, 2, 2, 9)], "customer_id bigint, nation_id bigint, balance double, segment string"),
        "sales": spark.createDataFrame([*sales, *sales[:5]], "sale_id bigint, customer_id bigint, status string, total double, sale_date date, priority string"),
        "line_items": spark.createDataFrame([*lines, *lines[:7]], "line_id string, sale_id bigint, quantity double, price double, return_flag string, ship_date date"),
    }
    asked = spark.createDataFrame([(i, d and day(d)) for i in (0, 1, 2, 3, 9, None) for d in (1, 20, 45, None)], "customer_id bigint, as_of date")
    written, keep = [], neighbors.materialise
    monkeypatch.setattr(neighbors, "materialise", lambda df, label: written.append(label) or keep(df, label))
    shown = lambda: rows(neighbors.graph_features(tr.SPEC, tr.ADOPTS, frames, asked, (3, 2, 4)))
    rounded = lambda found: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in found]
    few = shown()
    assert written == ["seeds"] and len(few) == 28 and any(r[2] for r in few)
    monkeypatch.setattr(prefix, "MOST_ROWS", 1)
    assert rounded(shown()) == rounded(few) and "asked" in written


def test_whole_numbers_are_summed_as_whole_numbers(spark, monkeypatch):
    """ids, cents and numbers of four decimals need no decimals; others keep them, and the windows are the same."""
    numbers = [(1.0, 0.1, 1.0001, 1 / 3, 2.0**52, None), (-7.0, 19.99, None, 2.0, 3.0, None), (float(10**6), -0.0, 0.5, 1.0, 1.0, None)]
    df = spark.createDataFrame(numbers, ", ".join(f"v{i} double" for i in range(6)))
    held = features.how_held(df, 6, 500_000)
    assert [(h.scale, h.gaps) for h in held] == [(0, False), (2, False), (4, True), (None, False), (None, False), (0, True)]
    assert features.how_held(df, 1, 2**40)[0].scale is None  # the sums of so many could lose digits

    columns = {"id": "int", "k": "int", "at": "date", "cents": "float", "third": "float", "gap": "float"}
    two = DatasetSpec(
        "two",
        {
            "own": TableSpec("own", "k", {"k": "int"}),
            "mid": TableSpec("mid", "m", {"m": "int", "k": "int"}, None, (ForeignKey("k", "own", "k"),)),
            "ev": TableSpec("ev", "id", columns, "at", (ForeignKey("k", "own", "k"),)),
            "far": TableSpec("far", "id", {"id": "int", "m": "int", "at": "date", "cents": "float"}, "at", (ForeignKey("m", "mid", "m"),)),
        },
        "2020-01-01", "2021-01-01",
    )
    rng = random.Random(3)
    events = [(i, i % 5, day(rng.randrange(500)), rng.randrange(10**7) / 100, rng.random(), None if i % 4 else float(i)) for i in range(300)]
    frames = {
        "own": spark.range(5).selectExpr("id AS k"),
        "mid": spark.createDataFrame([(i, i % 5) for i in (*range(20), 3, 4)], "m bigint, k bigint"),  # some come twice
        "ev": spark.createDataFrame(events, "id bigint, k bigint, at date, cents double, third double, gap double"),
        "far": spark.createDataFrame([(i, i % 20, d, c) for i, _, d, c, *_ in events], "id bigint, m bigint, at date, cents double"),
    }
    asked = spark.createDataFrame([(k, day(d)) for k in range(5) for d in (100, 200, 499)], "k bigint, as_of date")
    task = TaskSpec("t", "own", "k", "", 30)
    for path in features.temporal_paths(two, "own"):
        found = lambda: features.path_features(two, task, frames, asked, path)  # noqa: E731, B023
        whole = rows(found())
        with monkeypatch.context() as m:
            m.setattr(features, "SCALES", ())
            assert rows(found()) == whole and len(whole) == 15
