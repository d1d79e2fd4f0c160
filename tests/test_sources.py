from __future__ import annotations

import csv
import datetime as dt
import io
import json
import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows

from tablewright import session
from tablewright import types as t
from tablewright.sources import database, delimited, json_records, store
from tablewright.sources.delimited import plan_read, read_delimited


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


@pytest.mark.parametrize(
    "data, encoding",
    [
        ("id,city\n1,Málaga\n".encode(), "utf-8"),
        (b"\xef\xbb\xbf" + "id,city\n1,Málaga\n".encode(), "utf-8-sig"),
        (b"\xef\xbb\xbfid,city\r\n1,x", "utf-8-sig"),
        ("id,city\n1,Málaga\n".encode("utf-16"), "utf-16"),
        ("id,city\n1,Málaga\n".encode("latin-1"), "cp1252"),
        (b"id,city\r\n1,plain\r\n", "utf-8"),
        (b"id,city\n1,plain", "utf-8"),
    ],
)
def test_encoding(spark, tmp_path, data, encoding):
    path = write(tmp_path, "a.csv", data)
    assert delimited.detect_encoding(spark, path) == encoding
    df, plan = read_delimited(spark, path)
    assert plan.column_names == ("id", "city")
    expected = data.decode(encoding).splitlines()[1].split(",")[1]
    assert rows(df) == [(1, expected)]


def test_cp1252_characters_outside_latin_1(spark, tmp_path):
    path = write(tmp_path, "a.csv", "id,price\n1,10 €\n2,“x” – ñ\n".encode("cp1252"))
    assert rows(read_delimited(spark, path)[0]) == [(1, "10 €"), (2, "“x” – ñ")]


def test_headerless_file(spark, tmp_path):
    df, plan = read_delimited(spark, write(tmp_path, "a.csv", "1,alice,10.5\n2,bob,20\n"))
    assert plan.synthesized_headers and not plan.has_header
    assert t.schema_of(df) == [("column_1", "integer"), ("column_2", "text"), ("column_3", "decimal")]
    assert df.count() == 2


@pytest.mark.parametrize(
    "header, names, repeated",
    [
        ("total,total", ("total", "total_2"), True),
        ("total,total,total", ("total", "total_2", "total_3"), True),
        ("total,total,total_2", ("total", "total_3", "total_2"), True),
        ("a, b ", ("a", "b"), False),
    ],
)
def test_header_names(spark, tmp_path, header, names, repeated):
    cells = ",".join("x" for _ in names)
    plan = plan_read(spark, write(tmp_path, "a.csv", f"{header}\n{cells}\n"))
    assert plan.column_names == names
    assert plan.had_duplicate_columns is repeated


def test_types_need_every_value(spark, tmp_path):
    text = "i,f,b,d,ts,s,m\n1,1.5,true,2024-01-02,2024-01-02 10:00:00,x,1\n2,2,FALSE,2024/1/3,2024-01-03 00:00:01,,abc\n,,,,,z,3\n"
    df, _ = read_delimited(spark, write(tmp_path, "a.csv", text))
    assert [k for _, k in t.schema_of(df)] == ["integer", "decimal", "boolean", "date", "datetime", "text", "text"]
    assert rows(df, "i", "b", "d")[0] == (1, True, dt.date(2024, 1, 2))
    assert df.filter("s is null").count() == 1


def test_quoted_line_breaks(spark, tmp_path):
    df, plan = read_delimited(spark, write(tmp_path, "a.csv", 'id,note\n1,"two\nlines, ""quoted"""\n2,plain\n'))
    assert plan.multi_line
    assert rows(df) == [(1, 'two\nlines, "quoted"'), (2, "plain")]


def test_tab_separated(spark, tmp_path):
    df, _ = read_delimited(spark, write(tmp_path, "a.tsv", "id\tname\n1\ta,b\n"), "\t")
    assert rows(df) == [(1, "a,b")]


def test_empty_and_header_only(spark, tmp_path):
    for data in ("", "  \n\t\r\n"):
        with pytest.raises(delimited.EmptyFileError):
            read_delimited(spark, write(tmp_path, "e.csv", data))
    df, _ = read_delimited(spark, write(tmp_path, "h.csv", "a,b\n"))
    assert df.columns == ["a", "b"] and df.count() == 0


def test_json_array_and_lines(spark, tmp_path):
    records = [{"id": 1, "shipping": {"city": "Rome", "zip": "1"}, "day": "2024-01-02"}, {"id": 2, "shipping": None, "day": None}]
    array = write(tmp_path, "a.json", json.dumps(records, indent=1))
    lines = write(tmp_path, "l.json", "\n".join(json.dumps(r) for r in records))
    for path in (array, lines):
        df, nested = json_records.read_json(spark, path)
        assert nested == ["shipping"]
        assert dict(t.schema_of(df)) == {"day": "date", "id": "integer", "shipping": "text"}
        assert json.loads(df.filter("id = 1").first()["shipping"]) == records[0]["shipping"]


def test_json_malformed(spark, tmp_path):
    with pytest.raises(json_records.MalformedFileError):
        json_records.read_json(spark, write(tmp_path, "b.json", '[{"id": 1,'))[0].count()


def test_versions_survive_gaps(spark, tmp_path):
    kept = store.DatasetStore(spark, str(tmp_path))
    df = spark.range(3)
    assert kept.versions("x") == []
    df.write.parquet(f"{tmp_path}/x/version=1")
    df.limit(1).write.parquet(f"{tmp_path}/x/version=3")
    assert kept.write("x", df.limit(2)) == 4
    assert kept.versions("x") == [1, 3, 4]
    assert kept.read("x").count() == 2 and kept.read("x", 3).count() == 1
    assert kept.read("x").columns == ["id"]
    with pytest.raises(KeyError):
        kept.read("y")


def test_refresh(spark, tmp_path):
    kept = store.DatasetStore(spark, str(tmp_path / "s"))
    name = kept.ingest(write(tmp_path, "My Data.CSV".lower(), "id,v\n1,2\n"))
    assert name == "my_data.csv"
    assert kept.refresh(name, write(tmp_path, "b.csv", "id,v\n3,4\n5,6\n")).version == 2
    refused = kept.refresh(name, write(tmp_path, "c.csv", "id,v\n3,text\n"))
    assert not refused.replaced and refused.question and kept.read(name).count() == 2
    assert kept.refresh(name, write(tmp_path, "d.csv", "id,v\n3,text\n"), loosen=True).version == 3
    assert kept.versions(name) == [1, 2, 3]


def test_unsupported_formats(spark, tmp_path):
    kept = store.DatasetStore(spark, str(tmp_path / "s"))
    with pytest.raises(delimited.UnsupportedFormatError):
        kept.ingest(write(tmp_path, "a.bin", "x"))
    with pytest.raises(ValueError):
        store.export(spark.range(1), "xlsx", str(tmp_path / "o"))


def test_schema_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    assert t.schema_fingerprint(a) == t.schema_fingerprint(a.select("b", "a")) == "a:integer|b:text"


def test_database_options_and_pushed_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    place = database.Connection("crm", "jdbc:postgresql://db/crm", {"user": "u"})
    options = database.table_options(place, "orders", database.Split("id", "0", "1000", 8))
    assert options["dbtable"] == "orders" and options["numPartitions"] == "8" and options["pushDownLimit"] == "true"
    schema = [("id", "integer"), ("name", "text")]
    sql = database.pushed_profile_sql("things", schema)
    con = duckdb.connect()
    con.execute("CREATE TABLE things AS SELECT * FROM (VALUES (1, 'a'), (2, NULL), (2, 'a')) t(id, name)")
    one = spark.createDataFrame(con.execute(sql).df())
    assert rows(database.unfold_pushed(one, schema)) == [
        ("id", "integer", 3, 0, 2, 1.0, 2.0),
        ("name", "text", 3, 1, 1, None, None),
    ]


def test_settle_deletes_what_was_written_on_the_way(spark):
    """The result and tables of an outer step stay, inner ones go, also if the step fails."""
    before = session.materialise(spark.range(5), "before")
    on_the_way = []

    def inner():
        on_the_way.append(session.materialise(spark.range(7), "inner"))
        return on_the_way[0].filter("id > 1")

    def outer():
        found = session.settle(spark, inner, "found")
        on_the_way.append(found)
        return found.join(before, "id")

    got = session.settle(spark, outer, "got")
    assert sorted(r["id"] for r in got.collect()) == [2, 3, 4]
    assert before.count() == 5

    def broken():
        on_the_way.append(session.materialise(spark.range(3), "broken"))
        raise ValueError("stopped")

    with pytest.raises(ValueError):
        session.settle(spark, broken, "never")
    for gone in on_the_way:
        assert not os.path.exists(gone.inputFiles()[0].removeprefix("file://"))


@pytest.mark.parametrize("split", [1 << 20, 40])
def test_records_span_lines_and_splits(spark, tmp_path, split):
    """However the files are split, records come out as the standard csv module reads them."""
    rng = random.Random(4)
    cells = ["plain", 'say "hi"', "two\nlines", "a,b", '5" pipe', "", '"', '""', "crlf\r\ninside", "\n\n", "x" * 90, "é€" * 9]
    folder = tmp_path / "many.csv"
    folder.mkdir()
    expected = []
    for k in range(3):
        body = io.StringIO()
        writer = csv.writer(body, lineterminator="\r\n" if k == 1 else "\n")
        writer.writerow(["id", "one", "two"])
        for i in range(60):
            row = [str(1000 * k + i), rng.choice(cells), rng.choice(cells)]
            writer.writerow(row)
            expected.append((int(row[0]), row[1] or None, row[2] or None))
        body.write('9999,5" stray,quote" in text\n')
        expected.append((9999, '5" stray', 'quote" in text'))
        (folder / f"part-{k}.csv").write_bytes(body.getvalue().encode())
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(split))
    try:
        df, plan = read_delimited(spark, str(folder))
        assert plan.multi_line and plan.column_names == ("id", "one", "two")
        assert (df.rdd.getNumPartitions() > 20) == (split == 40)
        assert rows(df) == sorted(expected, key=repr)
    finally:
        spark.conf.set(key, before)


def test_ragged_rows_are_reported(spark, tmp_path):
    path = write(tmp_path, "r.csv", 'a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,"x\ny",12\n13,"p,q",14,"s\nt"\n')
    plan = plan_read(spark, path)
    found = [r["record"] for r in delimited.ragged_rows(spark, path, plan).collect()]
    assert sorted(found) == sorted(["4,5", "6,7,8,9", '13,"p,q",14,"s\nt"'])
    assert rows(delimited.read_text_columns(spark, path, plan)) == sorted(
        [("1", "2", "3"), ("4", "5", None), ("6", "7", "8"), ("10", "x\ny", "12"), ("13", "p,q", "14")], key=repr
    )


def test_each_file_has_its_own_encoding(spark, tmp_path):
    folder = tmp_path / "mixed files+.csv"
    folder.mkdir()
    for k, encoding in enumerate(("utf-8", "cp1252", "utf-16", "utf-8-sig")):
        (folder / f"p {k}+.csv").write_bytes(f'id,price\n{k},"10 € – é"\n1{k},"two\nlines ñ"\n'.encode(encoding))
    df, plan = read_delimited(spark, str(folder))
    assert plan.encoding == "cp1252" and sorted(e for _, e in plan.other_encodings) == ["utf-16", "utf-8", "utf-8-sig"]
    assert rows(df) == sorted([(k, "10 € – é") for k in range(4)] + [(10 + k, "two\nlines ñ") for k in range(4)], key=repr)


def test_uncommitted_versions_are_not_seen(spark, tmp_path):
    kept = store.DatasetStore(spark, str(tmp_path))
    assert kept.write("x", spark.range(3)) == 1
    spark.range(5).write.parquet(f"{tmp_path}/x/version=2")
    (tmp_path / "x/version=2/_SUCCESS").unlink()  # as a lost writer leaves it: files, no commit
    assert kept.versions("x") == [1] and kept.read("x").count() == 3
    with pytest.raises(KeyError):
        kept.read("x", 2)
    assert kept.write("x", spark.range(7)) == 3
    assert kept.versions("x") == [1, 3] and kept.read("x").count() == 7
    (tmp_path / "x" / "version=abc").mkdir()
    assert kept.versions("x") == [1, 3] and kept.versions("y") == []


def test_writers_at_the_same_time_get_their_own_numbers(spark, tmp_path):
    kept = store.DatasetStore(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda n: kept.write("x", spark.range(n)), range(1, 9)))
    assert sorted(numbers) == kept.versions("x") and len(set(numbers)) == 8
    assert [kept.read("x", v).count() for v in numbers] == list(range(1, 9))
    crashed = kept.claim("x")
    assert kept.write("x", spark.range(1)) == crashed + 1 and crashed not in kept.versions("x")
