"""Training tables and relational features."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import links
from tablewright.plans.guard import QueryWorkspace
from tablewright.relational import features, labels, neighbors, transforms
from tablewright.relational import spec as rel
from tablewright.suite.registry import Suite
from tablewright.suite.tables import given, shop, with_shop

suite = Suite()

VAL, TEST = "1999-01-01", "2000-01-01"
SPEC = rel.DatasetSpec(
    "shop",
    {
        "customers": rel.TableSpec(
            "customers", "customer_id", {"customer_id": "int", "nation_id": "int", "balance": "float", "segment": "string"}
        ),
        "sales": rel.TableSpec(
            "sales",
            "sale_id",
            {"sale_id": "int", "customer_id": "int", "status": "string", "total": "float", "sale_date": "date", "priority": "string"},
            "sale_date",
            (rel.ForeignKey("customer_id", "customers", "customer_id"),),
        ),
        "line_items": rel.TableSpec(
            "line_items",
            "line_id",
            {"line_id": "string", "sale_id": "int", "quantity": "float", "price": "float", "return_flag": "string", "ship_date": "date"},
            "ship_date",
            (rel.ForeignKey("sale_id", "sales", "sale_id"),),
        ),
    },
    VAL,
    TEST,
)
ADOPTS = rel.TaskSpec("buys_urgent", "customers", "customer_id", "", 365)
SETTLED = rel.TaskSpec("settled", "sales", "sale_id", "sale_date", 365, hidden=frozenset({"sales.status"}))

GRID = ("1997-01-01", "2000-07-01", 6)
QUARTERS = ("1996-01-01", "2000-10-01", 3)


def frames_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    shaped = shop(spark, sf_dir, "customers", "sales", "line_items")
    return {n: rel.cast_declared(shaped[n], table) for n, table in SPEC.tables.items()}


def accounts(frames: dict[str, DataFrame]) -> DataFrame:
    """Customers and the day of their first sale."""
    return frames["sales"].groupBy("customer_id").agg(F.min("sale_date").alias("open_date"))


def review_grid(frames: dict[str, DataFrame]) -> DataFrame:
    return labels.time_grid(accounts(frames), "customer_id", F.col("open_date"), *GRID)


_BASE = with_shop("customers", "sales", "line_items") + (
    ", accounts AS (SELECT customer_id, min(sale_date) AS open_date FROM sales GROUP BY 1), "
    "grid AS (SELECT customer_id, CAST(g AS DATE) AS as_of FROM accounts, "
    "generate_series(DATE '1997-01-01', DATE '2000-07-01', INTERVAL 6 MONTH) s(g) WHERE open_date <= g)"
)


@suite.query("time_grid", _BASE + " SELECT customer_id, as_of FROM grid")
def time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_grid(frames_of(spark, sf_dir))


# ---- labels -----------------------------------------------------------------
_SETTLED = "SELECT sale_id, sale_date AS as_of, CAST(CASE WHEN status IN ('F') THEN 1 ELSE 0 END AS INTEGER) AS label FROM sales"


def settled(frames: dict[str, DataFrame]) -> DataFrame:
    return labels.attribute_label(frames["sales"], "sale_id", F.col("sale_date"), F.col("status").isin("F"))


@suite.query("label_attribute", with_shop("sales") + " " + _SETTLED)
def label_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(shop(spark, sf_dir, "sales"))


_ADOPTS = (
    "SELECT customer_id, as_of, CAST(CASE WHEN EXISTS (SELECT 1 FROM sales s WHERE s.customer_id = g.customer_id AND "
    "priority = '1-URGENT' AND sale_date > as_of AND sale_date <= as_of + INTERVAL 365 DAY) THEN 1 ELSE 0 END AS INTEGER) AS label "
    "FROM grid g WHERE NOT EXISTS (SELECT 1 FROM sales s WHERE s.customer_id = g.customer_id AND priority = '1-URGENT' AND sale_date <= as_of)"
)


def adopts(frames: dict[str, DataFrame]) -> DataFrame:
    urgent = frames["sales"].filter("priority = '1-URGENT'")
    return labels.future_event_label(review_grid(frames), "customer_id", urgent, "customer_id", "sale_date", 365)


@suite.query("label_future_event", _BASE + " " + _ADOPTS)
def label_future_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adopts(frames_of(spark, sf_dir))


def quiet(frames: dict[str, DataFrame]) -> DataFrame:
    grid = labels.time_grid(accounts(frames), "customer_id", F.date_add("open_date", 90), *QUARTERS)
    volumes = labels.volume_around(frames["sales"], "customer_id", "sale_date", "total", *QUARTERS, 90, 90)
    return labels.volume_drop_label(grid, "customer_id", volumes)


@suite.query(
    "label_volume_drop",
    _BASE + ", quarters AS (SELECT customer_id, CAST(g AS DATE) AS as_of FROM accounts, "
    "generate_series(DATE '1996-01-01', DATE '2000-10-01', INTERVAL 3 MONTH) s(g) WHERE open_date <= g - INTERVAL 90 DAY), "
    "volume AS (SELECT q.customer_id, q.as_of, "
    "sum(CASE WHEN sale_date <= as_of THEN CAST(total AS DECIMAL(18, 6)) ELSE 0 END) AS prev, "
    "sum(CASE WHEN sale_date > as_of THEN CAST(total AS DECIMAL(18, 6)) ELSE 0 END) AS next "
    "FROM quarters q JOIN sales s ON s.customer_id = q.customer_id AND sale_date > as_of - INTERVAL 90 DAY "
    "AND sale_date <= as_of + INTERVAL 90 DAY GROUP BY 1, 2) "
    "SELECT customer_id, as_of, CAST(CASE WHEN next < 0.5 * prev THEN 1 ELSE 0 END AS INTEGER) AS label FROM volume WHERE prev > 0",
)
def label_volume_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiet(frames_of(spark, sf_dir))


@suite.query(
    "label_query",
    with_shop("sales") + " SELECT sale_id, sale_date AS as_of, CAST(CASE WHEN total > 200000 THEN 1 ELSE 0 END AS INTEGER) AS label FROM sales",
)
def label_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = QueryWorkspace(spark)
    space.register("sales", shop(spark, sf_dir, "sales")["sales"])
    task = rel.TaskSpec(
        "large", "sales", "sale_id", "sale_date", 1,
        "SELECT sale_id, sale_date AS as_of, CASE WHEN total > 200000 THEN 1 ELSE 0 END AS label FROM q_sales",
    )
    return labels.query_label(space, task)


_SPLIT = f"CASE WHEN as_of >= DATE '{TEST}' THEN 'test' WHEN as_of >= DATE '{VAL}' THEN 'val' ELSE 'train' END AS split"


def training(labelled: DataFrame) -> DataFrame:
    return labels.assign_splits(labelled, VAL, TEST)


@suite.query("oot_split", _BASE + f" SELECT *, {_SPLIT} FROM ({_ADOPTS})")
def oot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training(adopts(frames_of(spark, sf_dir)))


@suite.query(
    "split_report",
    with_shop("sales") + f" SELECT split, count(*) AS row_count, count(*) FILTER (WHERE label = 1) AS positive, "
    f"count(*) FILTER (WHERE label = 0) AS negative FROM (SELECT *, {_SPLIT} FROM ({_SETTLED})) GROUP BY 1",
)
def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = training(settled(shop(spark, sf_dir, "sales")))
    labels.validate_training_table("settled", table)
    return labels.split_report(table).select("split", F.col("rows").alias("row_count"), "positive", "negative")


# ---- windows ----------------------------------------------------------------
def _path(spark_name: str, *targets: str) -> features.Path:
    return next(
        p for p in features.temporal_paths(SPEC, spark_name) if tuple(e.target for e in p) == targets
    )


def _shown(df: DataFrame, keys: list[str], prefix: str, columns: tuple[str, ...]) -> DataFrame:
    """Short names, rounded to what both engines agree on."""
    out = [F.col(k) for k in keys]
    for w in features.WINDOWS:
        out.append(F.col(f"{prefix}_{w}d_count").alias(f"n_{w}"))
        out.append(F.col(f"{prefix}_{w}d_days_since_last").cast("bigint").alias(f"days_{w}"))
        for c in columns:
            out.append(F.round(f"{prefix}_{w}d_sum_{c}", 2).alias(f"sum_{c}_{w}"))
            out.append(F.round(f"{prefix}_{w}d_avg_{c}", 8).alias(f"avg_{c}_{w}"))
    return df.select(*out)


def _window_sql(base: str, keys: str, joins: str, time: str, columns: tuple[str, ...]) -> str:
    parts = []
    for w in features.WINDOWS:
        inside = f"FILTER (WHERE {time} > as_of - INTERVAL {w} DAY)"
        parts.append(f"nullif(count(*) {inside}, 0) AS n_{w}")
        parts.append(f"date_diff('day', max({time}) {inside}, max(as_of)) AS days_{w}")
        for c in columns:
            parts.append(f"round(CAST(sum(CAST({c} AS DECIMAL(18, 4))) {inside} AS DOUBLE), 2) AS sum_{c}_{w}")
            parts.append(
                f"round(CAST(sum(CAST({c} AS DECIMAL(18, 4))) {inside} AS DOUBLE) / count({c}) {inside}, 8) AS avg_{c}_{w}"
            )
    found = (
        f"SELECT {keys}, {', '.join(parts)} FROM {base} b {joins} "
        f"WHERE {time} <= as_of AND {time} > as_of - INTERVAL 365 DAY GROUP BY {keys}"
    )
    # rows without any event stay, with gaps
    return f"SELECT * FROM (SELECT {keys} FROM {base} b) LEFT JOIN ({found}) USING ({keys.replace('b.', '')})"


@suite.query(
    "feat_windows",
    _BASE + " " + _window_sql("grid", "b.customer_id, b.as_of", "JOIN sales s ON s.customer_id = b.customer_id", "sale_date", ("total",)),
)
def feat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frames_of(spark, sf_dir)
    path = _path("customers", "sales")
    df = features.path_features(SPEC, ADOPTS, frames, review_grid(frames), path)
    return _shown(df, ["customer_id", "as_of"], features.path_name(path), ("total",))


@suite.query(
    "feat_windows_wide_range",
    _BASE + ", f AS (SELECT g.customer_id, g.as_of, count(s.sale_id) AS n, sum(s.total) AS t FROM grid g LEFT JOIN sales s ON s.customer_id = g.customer_id "
    "AND s.sale_date <= g.as_of AND s.sale_date > g.as_of - INTERVAL 365 DAY GROUP BY 1, 2) "
    "SELECT customer_id, as_of, round(t, 4) AS tiny, round(t, 4) AS huge, CASE WHEN n > 0 THEN round(t, 4) END AS both FROM f",
)
def feat_windows_wide_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window sums of numbers near 1e-12 and near 1e15, scaled back, and of both in one column taken apart again."""
    frames = frames_of(spark, sf_dir)
    sales = frames["sales"].withColumns({"tiny": F.col("total") * 1e-17, "huge": F.col("total") * 1e10})
    mixed = sales.withColumn("huge", F.lit(-3e15)).unionByName(sales).unionByName(sales.withColumn("huge", F.lit(3e15)))  # cancels out
    table = SPEC.tables["sales"]
    scaled = replace(table, columns={**table.columns, "tiny": "float", "huge": "float"})
    spec = replace(SPEC, tables={**SPEC.tables, "sales": scaled})
    path = _path("customers", "sales")
    df = features.path_features(spec, ADOPTS, {**frames, "sales": mixed}, review_grid(frames), path)
    name = f"{features.path_name(path)}_365d_sum"
    return df.select(
        "customer_id", "as_of", F.round(F.col(f"{name}_tiny") / 3 * 1e17, 4).alias("tiny"), F.round(F.col(f"{name}_huge") / 1e10, 4).alias("huge"),
        F.round(F.col(f"{name}_total") / 3, 4).alias("both"),
    )


@suite.query(
    "feat_windows_two_edges",
    _BASE + " " + _window_sql(
        "grid", "b.customer_id, b.as_of",
        "JOIN sales s ON s.customer_id = b.customer_id JOIN line_items l ON l.sale_id = s.sale_id", "ship_date", ("price", "quantity"),
    ),
)
def feat_windows_two_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frames_of(spark, sf_dir)
    path = _path("customers", "sales", "line_items")
    df = features.path_features(SPEC, ADOPTS, frames, review_grid(frames), path)
    return _shown(df, ["customer_id", "as_of"], features.path_name(path), ("price", "quantity"))


@suite.query(
    "feat_windows_siblings",
    with_shop("sales") + " " + _window_sql(
        "(SELECT sale_id, customer_id, sale_date AS as_of FROM sales)", "b.sale_id, b.as_of",
        "JOIN sales s ON s.customer_id = b.customer_id", "s.sale_date", ("total",),
    ),
)
def feat_windows_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to the customer and back down to all of the customer's sales."""
    frames = frames_of(spark, sf_dir)
    path = _path("sales", "customers", "sales")
    df = features.path_features(SPEC, SETTLED, frames, settled(frames), path)
    return _shown(df, ["sale_id", "as_of"], features.path_name(path), ("total",))


@suite.query(
    "feat_entity_attrs",
    with_shop("sales") + " SELECT sale_id, sale_date AS as_of, customer_id, total, priority FROM sales",
)
def feat_entity_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome column is hidden, the time column is no attribute."""
    frames = frames_of(spark, sf_dir)
    return features.entity_attributes(SPEC, SETTLED, frames, settled(frames))


@suite.query(
    "feat_date_offsets",
    with_shop("sales", "line_items") + " SELECT s.sale_id, sale_date AS as_of, date_diff('day', sale_date, first_ship) AS entity_days_to_first_ship "
    "FROM sales s JOIN (SELECT sale_id, min(ship_date) AS first_ship FROM line_items GROUP BY 1) f ON f.sale_id = s.sale_id",
)
def feat_date_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frames_of(spark, sf_dir)
    first = frames["line_items"].groupBy("sale_id").agg(F.min("ship_date").alias("first_ship"))
    shipped = frames["sales"].select("sale_id", "sale_date").join(first, "sale_id")
    columns = {"sale_id": "int", "sale_date": "date", "first_ship": "date"}
    one = rel.DatasetSpec("shipped", {"sales": rel.TableSpec("sales", "sale_id", columns, "sale_date")}, VAL, TEST)
    rows = shipped.select("sale_id", F.col("sale_date").alias("as_of"))
    df = features.entity_attributes(one, SETTLED, {"sales": shipped}, rows)
    return df.withColumn("entity_days_to_first_ship", F.col("entity_days_to_first_ship").cast("bigint"))


@suite.query(
    "feat_matrix",
    _BASE + f" SELECT t.customer_id, t.as_of, t.label, t.split, c.segment, c.balance, "
    "coalesce(a.n_90, 0) AS sales_90, coalesce(a.n_365, 0) AS sales_365, a.sum_total_365 AS total_365, "
    "coalesce(l.n_180, 0) AS lines_180, l.avg_price_365 AS price_365 "
    f"FROM (SELECT *, {_SPLIT} FROM ({_ADOPTS})) t LEFT JOIN customers c USING (customer_id) LEFT JOIN ("
    + _window_sql("grid", "b.customer_id, b.as_of", "JOIN sales s ON s.customer_id = b.customer_id", "sale_date", ("total",))
    + ") a ON a.customer_id = t.customer_id AND a.as_of = t.as_of LEFT JOIN ("
    + _window_sql(
        "grid", "b.customer_id, b.as_of",
        "JOIN sales s ON s.customer_id = b.customer_id JOIN line_items l ON l.sale_id = s.sale_id", "ship_date", ("price",),
    )
    + ") l ON l.customer_id = t.customer_id AND l.as_of = t.as_of",
)
def feat_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frames_of(spark, sf_dir)
    paths = [_path("customers", "sales"), _path("customers", "sales", "line_items")]
    df = features.feature_matrix(SPEC, ADOPTS, frames, training(adopts(frames)), paths)
    sales, lines = (features.path_name(p) for p in paths)
    return df.select(
        "customer_id", "as_of", "label", "split", "segment", "balance",
        F.col(f"{sales}_90d_count").alias("sales_90"), F.col(f"{sales}_365d_count").alias("sales_365"),
        F.round(f"{sales}_365d_sum_total", 2).alias("total_365"), F.col(f"{lines}_180d_count").alias("lines_180"),
        F.round(f"{lines}_365d_avg_price", 8).alias("price_365"),
    )


# ---- neighbours -------------------------------------------------------------
_LAST_SALES = (
    "SELECT * FROM (SELECT g.customer_id, g.as_of, s.sale_id, s.total, row_number() OVER (PARTITION BY g.customer_id, g.as_of "
    "ORDER BY s.sale_date DESC, s.sale_id DESC) AS recency FROM grid g JOIN sales s ON s.customer_id = g.customer_id "
    "AND s.sale_date <= g.as_of) WHERE recency <= 16"
)


@suite.query("neighbors_last_k", _BASE + " " + _LAST_SALES)
def neighbors_last_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = frames_of(spark, sf_dir)
    moments = review_grid(frames).withColumnRenamed("customer_id", "key")
    found = neighbors.last_k(moments, frames["sales"].select("customer_id", "sale_id", "total", "sale_date"), "customer_id", "sale_date", "sale_id", rel.hops(SPEC, "customers")[0])
    return found.select("customer_id", "as_of", "sale_id", "total", "recency")


@suite.query(
    "graph_mean_features",
    _BASE + f", one AS ({_LAST_SALES}), two AS (SELECT * FROM (SELECT o.customer_id, o.as_of, o.sale_id, l.price, l.quantity, row_number() OVER "
    "(PARTITION BY o.customer_id, o.as_of, o.sale_id ORDER BY l.ship_date DESC, l.line_id DESC) AS r FROM one o JOIN line_items l "
    "ON l.sale_id = o.sale_id AND l.ship_date <= o.as_of) WHERE r <= 64), "
    "again AS (SELECT o.customer_id, o.as_of, x.total FROM one o JOIN one x ON x.customer_id = o.customer_id AND x.as_of = o.as_of), "
    "back AS (SELECT w.customer_id, w.as_of, s.total FROM two w JOIN sales s ON s.sale_id = w.sale_id AND s.sale_date <= w.as_of) "
    "SELECT g.customer_id, g.as_of, coalesce(a.n, 0) AS sales, a.total, coalesce(a.n, 0) AS owners, "
    "CASE WHEN a.n > 0 THEN c.balance END AS balance, coalesce(b.n, 0) AS lines, b.price, b.quantity, "
    "coalesce(d.n, 0) AS owners_sales, d.total AS owners_total, coalesce(e.n, 0) AS lines_sales, e.total AS lines_total "
    "FROM (SELECT DISTINCT * FROM grid) g JOIN customers c USING (customer_id) "
    "LEFT JOIN (SELECT customer_id, as_of, count(*) AS n, round(avg(total), 6) AS total FROM one GROUP BY 1, 2) a USING (customer_id, as_of) "
    "LEFT JOIN (SELECT customer_id, as_of, count(*) AS n, round(avg(price), 6) AS price, round(avg(quantity), 6) AS quantity FROM two GROUP BY 1, 2) b USING (customer_id, as_of) "
    "LEFT JOIN (SELECT customer_id, as_of, count(*) AS n, round(avg(total), 6) AS total FROM again GROUP BY 1, 2) d USING (customer_id, as_of) "
    "LEFT JOIN (SELECT customer_id, as_of, count(*) AS n, round(avg(total), 6) AS total FROM back GROUP BY 1, 2) e USING (customer_id, as_of)",
)
def graph_mean_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every walk of the specification's own schedule: 16 sales, 64 rows of each, 16 of each of those."""
    frames = frames_of(spark, sf_dir)
    df = neighbors.graph_features(SPEC, ADOPTS, frames, review_grid(frames))
    one = "hop_sales_customer_id"
    lines, owner = f"{one}_line_items_sale_id", f"{one}_customers_customer_id"
    again, back = f"{owner}_sales_customer_id", f"{lines}_sales_sale_id"
    return df.select(
        "customer_id", "as_of",
        F.col(f"{one}_1_rows").alias("sales"), F.round(f"{one}_1_mean_total", 6).alias("total"),
        F.col(f"{owner}_2_rows").alias("owners"), F.round(f"{owner}_2_mean_balance", 6).alias("balance"),
        F.col(f"{lines}_2_rows").alias("lines"), F.round(f"{lines}_2_mean_price", 6).alias("price"), F.round(f"{lines}_2_mean_quantity", 6).alias("quantity"),
        F.col(f"{again}_3_rows").alias("owners_sales"), F.round(f"{again}_3_mean_total", 6).alias("owners_total"),
        F.col(f"{back}_3_rows").alias("lines_sales"), F.round(f"{back}_3_mean_total", 6).alias("lines_total"),
    )


# ---- transforms, derived structure -------------------------------------------
_PAIR = "CASE WHEN bank <> '' OR account NOT IN ('', '0') THEN bank || '|' || account END"


@suite.query(
    "derived_entities",
    with_shop("sales", "line_items") + f" SELECT DISTINCT {_PAIR} AS counterparty_id, bank FROM ("
    "SELECT CASE WHEN priority = '5-LOW' THEN '' ELSE priority END AS bank, CAST(customer_id AS VARCHAR) AS account FROM sales UNION ALL "
    f"SELECT return_flag, CAST(supplier_id AS VARCHAR) FROM line_items) WHERE {_PAIR} IS NOT NULL",
)
def derived_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = shop(spark, sf_dir, "sales", "line_items")

    def mentioned(df: DataFrame, bank, account) -> DataFrame:
        return df.select(transforms.pair_id(bank, account).alias("counterparty_id"), F.coalesce(bank, F.lit("")).alias("bank"))

    low = F.when(F.col("priority") != "5-LOW", F.col("priority"))
    return transforms.derived_entities(
        [
            mentioned(frames["sales"], low, F.col("customer_id")),
            mentioned(frames["line_items"], F.col("return_flag"), F.col("supplier_id")),
        ],
        "counterparty_id",
        "bank",
    )


@suite.query(
    "decode_dates",
    "SELECT o_orderkey AS order_id, CAST(d AS DATE) AS opened, CAST(d AS DATE) AS issued, CAST(d AS DATE) AS birth_date, "
    "CASE WHEN o_orderstatus = 'F' THEN 'female' ELSE 'male' END AS gender, "
    "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS salary "
    "FROM (SELECT *, o_orderdate - INTERVAL 6 YEAR AS d FROM orders)",
)
def decode_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = given(spark, sf_dir, "orders")
    day = F.expr("o_orderdate - INTERVAL '6' YEAR")
    code = F.date_format(day, "yyMMdd").cast("int")
    coded = orders.select(
        F.col("o_orderkey").alias("order_id"),
        code.alias("code"),
        F.concat(F.lpad(code.cast("string"), 6, "0"), F.lit(" 00:00:00")).alias("stamp"),
        (code + F.when(F.col("o_orderstatus") == "F", 5000).otherwise(0)).alias("birth_number"),
        F.when(F.col("o_orderstatus") == "P", "?").otherwise(F.col("o_totalprice").cast("string")).alias("salary"),
    )
    born, gender = transforms.decode_birth(F.col("birth_number"))
    return coded.select(
        "order_id", transforms.decode_date(F.col("code")).alias("opened"), transforms.decode_stamp(F.col("stamp")).alias("issued"),
        born.alias("birth_date"), gender.alias("gender"), transforms.number_or_missing(F.col("salary")).alias("salary"),
    )


@suite.query(
    "derive_spec",
    with_shop("customers", "sales", "line_items") + " SELECT 'line_items' AS child_table, 'sale_id' AS child_column, 'sales' AS parent_table, "
    "'sale_id' AS parent_column, (SELECT count(*) FROM line_items WHERE sale_id NOT IN (SELECT sale_id FROM sales)) AS orphans "
    "UNION ALL SELECT 'sales', 'customer_id', 'customers', 'customer_id', "
    "(SELECT count(*) FROM sales WHERE customer_id NOT IN (SELECT customer_id FROM customers))",
)
def derive_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges come from links found in the data, then hold on the typed tables."""
    frames = shop(spark, sf_dir, "customers", "sales", "line_items")
    derived = rel.derive_spec("shop", frames, links.discover(frames), {"sales": "sale_date", "line_items": "ship_date"}, VAL, TEST)
    built = rel.build_inputs(derived, frames)
    return links.orphans(built, rel.foreign_keys(derived))
