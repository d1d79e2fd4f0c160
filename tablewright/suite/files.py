"""Reading, versioning and writing files made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.operators import profile
from tablewright.relational import spec as rel
from tablewright.session import scratch_path
from tablewright.sources import delimited, json_records
from tablewright.sources.store import DatasetStore, export
from tablewright.suite.registry import Suite
from tablewright.suite.tables import given, shop, with_shop

suite = Suite()


def _written_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", **options) -> str:
    writer = df.write.option("header", header).option("sep", sep).option("quote", '"').option("escape", '"')
    writer.options(**options).csv(path)
    return path


_SALES = "SELECT sale_id, customer_id, status, total, sale_date, priority FROM sales"


@suite.query("csv_roundtrip", with_shop("sales") + " " + _SALES)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types come back from text alone."""
    path = _written_csv(shop(spark, sf_dir, "sales")["sales"], scratch_path(spark, "sales") + ".csv")
    return delimited.read_delimited(spark, path)[0]


@suite.query(
    "csv_headerless",
    with_shop("sales") + " SELECT sale_id AS column_1, status AS column_2, total AS column_3, sale_date AS column_4 FROM sales",
)
def csv_headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = shop(spark, sf_dir, "sales")["sales"].select("sale_id", "status", "total", "sale_date")
    path = _written_csv(sales, scratch_path(spark, "sales") + ".csv", header=False)
    return delimited.read_delimited(spark, path)[0]


@suite.query(
    "csv_duplicate_names",
    with_shop("sales") + " SELECT priority AS total, total AS total_2, status AS total_3 FROM sales",
)
def csv_duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header that says ``total`` three times."""
    sales = shop(spark, sf_dir, "sales")["sales"]
    line = F.concat_ws(",", "priority", F.col("total").cast("string"), "status")
    # the first row of each file is preceded by the header, as a writer of many files leaves it
    leads = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    both = F.when(leads, F.array(F.lit("total,total,total"), line)).otherwise(F.array(line))
    path = scratch_path(spark, "dup") + ".csv"
    sales.select(F.explode(both).alias("value")).write.text(path)
    return delimited.read_delimited(spark, path)[0]


@suite.query(
    "tsv_whole_texts",
    "SELECT doc_id, lang, md5(text) AS digest, n_chars FROM documents",
)
def tsv_whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, line breaks, quotes and tabs included."""
    docs = given(spark, sf_dir, "documents").select("doc_id", "lang", "text", "n_chars")
    path = _written_csv(docs, scratch_path(spark, "docs") + ".tsv", sep="\t")
    df, _ = delimited.read_delimited(spark, path, "\t")
    return df.select("doc_id", "lang", F.md5("text").alias("digest"), "n_chars")


@suite.query("csv_encodings", "SELECT doc_id, lang, md5(text) AS digest FROM documents")
def csv_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in a single-byte encoding and in UTF-8 side by side, each read in its own."""
    docs = given(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    path = scratch_path(spark, "mixed") + ".csv"
    for english, encoding in ((True, "ISO-8859-1"), (False, "UTF-8")):
        part = docs.filter((F.col("lang") == "de") == english)
        part.write.mode("append").options(header=True, quote='"', escape='"', encoding=encoding).csv(path)
    df, plan = delimited.read_delimited(spark, path)
    assert plan.encoding == "cp1252" and {e for _, e in plan.other_encodings} == {"utf-8"}
    return df.select("doc_id", "lang", F.md5("text").alias("digest"))


_LINE = "concat_ws(',', CAST(sale_id AS VARCHAR(20)), {}priority{})"


@suite.query(
    "csv_ragged",
    with_shop("sales") + f" SELECT {_LINE.format('', '')} AS record FROM sales WHERE status = 'F' "
    f"UNION ALL SELECT {_LINE.format('status, ', ', status')} FROM sales WHERE status = 'P'",
)
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with too few or too many cells, reported as they stand in the file."""
    sales = shop(spark, sf_dir, "sales")["sales"]
    line = F.when(F.col("status") == "F", F.expr(_LINE.format("", ""))).when(F.col("status") == "P", F.expr(_LINE.format("status, ", ", status")))
    leads = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # a header in each file
    rows = F.array(F.coalesce(line, F.expr(_LINE.format("status, ", ""))))
    path = scratch_path(spark, "ragged") + ".csv"
    sales.select(F.explode(F.when(leads, F.concat(F.array(F.lit("sale_id,status,priority")), rows)).otherwise(rows))).write.text(path)
    return delimited.ragged_rows(spark, path, delimited.plan_read(spark, path)).select("record")


@suite.query(
    "json_nested",
    "SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS who, value FROM events",
)
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record stays as JSON text and is reported as nested."""
    events = given(spark, sf_dir, "events")
    nested = events.select("event_id", F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")).alias("who"), "value")
    path = scratch_path(spark, "events") + ".json"
    nested.write.json(path)
    df, kept = json_records.read_json(spark, path)
    assert kept == ["who"]
    return df


@suite.query("ingest_dataset", with_shop("sales") + " SELECT status, count(*) AS n, CAST(round(sum(total), 2) AS DOUBLE) AS total FROM sales GROUP BY 1")
def ingest_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ingest")
    _written_csv(shop(spark, sf_dir, "sales")["sales"], f"{folder}/My Sales.csv")
    store = DatasetStore(spark, f"{folder}/store")
    name = store.ingest(f"{folder}/My Sales.csv")
    assert name == "my_sales.csv"
    return store.read(name).groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@suite.query(
    "refresh_versions",
    "SELECT CAST(v AS INTEGER) AS version, (SELECT count(*) FROM orders WHERE v = 1 OR o_orderstatus <> 'F') AS n FROM range(1, 3) r(v)",
)
def refresh_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitting file is a new version, a misfitting one is refused, old versions stay."""
    folder = scratch_path(spark, "refresh")
    sales = shop(spark, sf_dir, "sales")["sales"]
    _written_csv(sales, f"{folder}/sales.csv")
    _written_csv(sales.filter("status <> 'F'"), f"{folder}/open.csv")
    _written_csv(sales.drop("priority"), f"{folder}/narrow.csv")
    store = DatasetStore(spark, f"{folder}/store")
    name = store.ingest(f"{folder}/sales.csv")
    assert store.refresh(name, f"{folder}/open.csv").replaced
    assert not store.refresh(name, f"{folder}/narrow.csv").replaced
    one, two = (store.read(name, v).agg(F.lit(v).alias("version"), F.count("*").alias("n")) for v in store.versions(name))
    return one.union(two)


@suite.query("export_csv", with_shop("sales") + " " + _SALES)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "export") + ".csv"
    export(shop(spark, sf_dir, "sales")["sales"], "csv", path)
    return delimited.read_delimited(spark, path)[0]


@suite.query("export_parquet", with_shop("messy_customers") + " SELECT trim(lower(segment)) AS segment, count(*) AS n FROM messy_customers GROUP BY 1")
def export_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An export sees the standardised values."""
    store = DatasetStore(spark, scratch_path(spark, "store"))
    df = shop(spark, sf_dir, "messy_customers")["messy_customers"]
    store.write("customers", df)
    raw = [r["segment"] for r in df.select("segment").distinct().collect()]  # twenty renderings
    store.set_mappings("customers", {"segment": {v: v.strip().lower() for v in raw}})
    path = scratch_path(spark, "export")
    export(store.read("customers"), "parquet", path)
    return spark.read.parquet(path).groupBy("segment").agg(F.count("*").alias("n"))


_TYPED = rel.TableSpec("sales", "sale_id", {"sale_id": "int", "sold": "date", "total": "float", "open": "bool"}, "sold", delimiter=";")


@suite.query(
    "typed_load",
    with_shop("sales") + " SELECT sale_id, sale_date AS sold, total, status <> 'F' AS open FROM sales",
)
def typed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text first, then a transform, then the declared types."""
    path = scratch_path(spark, "typed")
    _written_csv(shop(spark, sf_dir, "sales")["sales"], path, sep=";")

    def shape(df: DataFrame) -> DataFrame:
        return df.withColumn("sold", F.col("sale_date")).withColumn("open", F.col("status") != "F")

    return rel.cast_declared(rel.read_declared(spark, path, _TYPED), _TYPED, shape)


@suite.query(
    "input_fingerprint",
    "SELECT substr(sha256('customers=' || (SELECT count(*) FROM customer) || ';line_items=' || (SELECT count(*) FROM lineitem) "
    "|| ';sales=' || (SELECT count(*) FROM orders)), 1, 16) AS fingerprint",
)
def input_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.fingerprint(rel.table_sizes(shop(spark, sf_dir, "customers", "sales", "line_items")))


@suite.query(
    "predictions_dataset",
    "SELECT o_orderkey AS sale_id, CAST(round(o_totalprice * 2, 2) AS DOUBLE) AS predicted, 'flat' AS model, CAST(2 AS INTEGER) AS model_version FROM orders",
)
def predictions_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second set of predictions replaces the first."""
    store = DatasetStore(spark, scratch_path(spark, "store"))
    sales = shop(spark, sf_dir, "sales")["sales"]
    for version, factor in ((1, 1.0), (2, 2.0)):
        predicted = sales.select("sale_id", F.round(F.col("total") * factor, 2).alias("predicted"))
        store.save_predictions("sales_predictions", predicted, "flat", version)
    assert [c for c, _ in t.schema_of(store.read("sales_predictions"))] == ["sale_id", "predicted", "model", "model_version"]
    return store.read("sales_predictions")


# ---- whole jobs the baseline names ----------------------------------------------
_INGESTED = {
    "order_id": "integer", "part_id": "integer", "quantity": "decimal", "price": "decimal",
    "return_flag": "text", "ship_date": "date",
}


@suite.query(
    "ingest_profile",
    with_shop("line_items") + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{k}' AS inferred_type, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count, "
        + (f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4)" if k in t.NUMERIC else "CAST(NULL AS DOUBLE)")
        + f" AS median FROM line_items"
        for c, k in _INGESTED.items()
    ),
)
def ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file becomes a typed dataset and is profiled."""
    folder = scratch_path(spark, "ingest")
    _written_csv(shop(spark, sf_dir, "line_items")["line_items"].select(*_INGESTED), f"{folder}/lines.csv")
    store = DatasetStore(spark, f"{folder}/store")
    found = profile.profile(store.read(store.ingest(f"{folder}/lines.csv")))
    return found.select(
        "column_name", "inferred_type", "row_count", "distinct_count", F.round(F.get("quantiles", F.lit(1)), 4).alias("median")
    )


@suite.query(
    "export_lines",
    "SELECT l_returnflag AS return_flag, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(l_shipdate) AS shipped FROM lineitem GROUP BY 1",
)
def export_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest table exported in full and read back."""
    path = scratch_path(spark, "export") + ".csv"
    export(given(spark, sf_dir, "lineitem"), "csv", path)
    back = spark.read.option("header", True).csv(path)
    return back.groupBy(F.col("l_returnflag").alias("return_flag")).agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"), F.count("l_shipdate").alias("shipped")
    )
