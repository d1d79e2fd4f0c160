"""The guarded SQL surface, relational algebra and dashboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.plans import dashboards
from tablewright.plans.guard import QueryWorkspace, SavedQuery
from tablewright.session import scratch_path
from tablewright.sources import json_records
from tablewright.sources.store import DatasetStore
from tablewright.suite.registry import Suite
from tablewright.suite.tables import given, shop

suite = Suite()

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def workspace(spark: SparkSession, sf_dir: str, *names: str) -> QueryWorkspace:
    """Given tables under their query aliases ``q_<name>``."""
    space = QueryWorkspace(spark)
    space.register_all({n: given(spark, sf_dir, n) for n in names or TABLES})
    return space


def _guarded(name: str, sql: str, oracle: str | None = None) -> None:
    """Register one SELECT that runs through the guard; the check reads the plain names."""
    used = [t for t in TABLES if f"q_{t}" in sql]
    plain = oracle or sql
    for t in TABLES:
        plain = plain.replace(f"q_{t}", t)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return workspace(spark, sf_dir, *used).select(sql)

    suite.query(name, plain)(run)


_guarded(
    "revenue_by_segment",
    "SELECT c_mktsegment AS segment, count(DISTINCT o_orderkey) AS orders, "
    "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue "
    "FROM q_customer JOIN q_orders ON o_custkey = c_custkey JOIN q_lineitem ON l_orderkey = o_orderkey "
    "GROUP BY c_mktsegment ORDER BY segment",
)

# ---- A1-A13 -----------------------------------------------------------------
_guarded(
    "sql_projection",
    "SELECT o_orderkey AS order_id, CASE WHEN o_totalprice > 250000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' "
    "ELSE 'small' END AS size, CAST(o_orderdate AS DATE) AS day, CAST(round(o_totalprice) AS BIGINT) AS whole FROM q_orders",
)
_guarded(
    "sql_filter",
    "SELECT o_orderkey AS order_id FROM q_orders WHERE (o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 300000 "
    "AND o_orderpriority LIKE '%-%' AND NOT o_orderpriority ILIKE '%urgent') OR o_orderdate IS NULL",
)
_guarded(
    "sql_join_inner_using",
    "SELECT n_name AS nation, count(*) AS customers FROM q_customer JOIN (SELECT n_nationkey AS c_nationkey, n_name FROM q_nation) n "
    "USING (c_nationkey) GROUP BY n_name",
)
_guarded(
    "sql_join_left",
    "SELECT c_custkey AS customer_id, count(o_orderkey) AS orders FROM q_customer LEFT JOIN q_orders ON o_custkey = c_custkey "
    "AND o_orderpriority = '1-URGENT' GROUP BY c_custkey",
)
_guarded(
    "sql_join_right",
    "SELECT s_nationkey AS nation_id, n_name AS nation, count(s_suppkey) AS suppliers FROM q_supplier RIGHT JOIN q_nation "
    "ON n_nationkey = s_nationkey GROUP BY s_nationkey, n_name",
)
_guarded(
    "sql_join_full",
    "SELECT coalesce(a.k, b.k) AS customer_id, a.n AS urgent, b.n AS large FROM "
    "(SELECT o_custkey AS k, count(*) AS n FROM q_orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) a FULL OUTER JOIN "
    "(SELECT o_custkey AS k, count(*) AS n FROM q_orders WHERE o_totalprice > 300000 GROUP BY o_custkey) b ON a.k = b.k",
)
_guarded(
    "sql_theta_join",
    "SELECT o.o_orderpriority AS priority, count(*) AS late_lines FROM q_orders o JOIN q_lineitem l ON l.l_orderkey = o.o_orderkey "
    "AND l.l_shipdate > o.o_orderdate + INTERVAL '60' DAY GROUP BY o.o_orderpriority",
)
_guarded(
    "sql_semi_join",
    "SELECT c_custkey AS customer_id FROM q_customer c WHERE EXISTS (SELECT 1 FROM q_orders o WHERE o.o_custkey = c.c_custkey "
    "AND o.o_totalprice > c.c_acctbal * 40) AND c_nationkey IN (SELECT n_nationkey FROM q_nation WHERE n_regionkey <= 2)",
)
_guarded(
    "sql_anti_join",
    "SELECT c_custkey AS customer_id FROM q_customer c WHERE NOT EXISTS (SELECT 1 FROM q_orders o WHERE o.o_custkey = c.c_custkey "
    "AND o.o_totalprice > c.c_acctbal * 60) AND c_nationkey NOT IN (SELECT n_nationkey FROM q_nation WHERE n_regionkey = 4)",
)
_guarded(
    "sql_aggregates",
    "SELECT l_returnflag AS return_flag, l_linestatus AS line_status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity, "
    "round(avg(l_extendedprice), 2) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, "
    "count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_discount > 0.05) AS discounted FROM q_lineitem "
    "GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10",
)
_guarded(
    "sql_window_rows",
    "SELECT o_orderkey AS order_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS nth, "
    "lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous, "
    "lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following, "
    "CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
    "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS DOUBLE) AS last_three, "
    "CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS so_far FROM q_orders",
)
_guarded(
    "sql_window_range",
    "SELECT o_orderkey AS order_id, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS place, "
    "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS step, "
    "count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS last_month "
    "FROM q_orders",
)
_guarded(
    "sql_sort_limit",
    "SELECT c_custkey AS customer_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance FROM q_customer "
    "ORDER BY balance DESC NULLS LAST, c_custkey ASC NULLS FIRST LIMIT 25 OFFSET 10",
)
_guarded(
    "sql_set_operations",
    "(SELECT o_custkey AS id FROM q_orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM q_orders WHERE o_orderstatus = 'O') "
    "EXCEPT SELECT o_custkey FROM q_orders WHERE o_orderpriority = '1-URGENT' UNION ALL "
    "(SELECT s_suppkey AS id FROM q_supplier UNION SELECT DISTINCT s_nationkey FROM q_supplier)",
)
_guarded(
    "sql_subqueries",
    "WITH spent AS (SELECT o_custkey AS id, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS total FROM q_orders GROUP BY o_custkey) "
    "SELECT id, CAST(total AS DOUBLE) AS total FROM spent WHERE total > (SELECT avg(total) FROM spent) "
    "AND id IN (SELECT c_custkey FROM q_customer WHERE c_mktsegment = 'BUILDING')",
)
_guarded(
    "sql_recursive",
    "WITH RECURSIVE years(y) AS (SELECT CAST(min(extract(YEAR FROM o_orderdate)) AS INTEGER) FROM q_orders UNION ALL "
    "SELECT y + 1 FROM years WHERE y < 2003) SELECT y AS year, count(o_orderkey) AS orders FROM years LEFT JOIN q_orders "
    "ON CAST(extract(YEAR FROM o_orderdate) AS INTEGER) = y GROUP BY y",
)
# Left as a correlated sub-query, Spark pairs every line with every order date;
# the join on the order key says the same and stays an equality join.
_guarded(
    "sql_correlated",
    "SELECT o.o_orderkey AS order_id, count(l.l_orderkey) AS soon FROM q_orders o LEFT JOIN q_lineitem l "
    "ON l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL '30' DAY "
    "GROUP BY o.o_orderkey",
    "SELECT o_orderkey AS order_id, (SELECT count(*) FROM q_lineitem l WHERE l.l_orderkey = o.o_orderkey "
    "AND l.l_shipdate > o.o_orderdate AND l.l_shipdate <= o.o_orderdate + INTERVAL '30' DAY) AS soon FROM q_orders o",
)
_guarded(
    "sql_dates",
    "SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS year, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS month, count(*) AS orders, "
    "max(CAST(o_orderdate + INTERVAL '1' MONTH AS DATE)) AS due, CAST(max(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS age "
    "FROM q_orders GROUP BY extract(YEAR FROM o_orderdate), extract(MONTH FROM o_orderdate)",
    "SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS year, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS month, count(*) AS orders, "
    "max(CAST(o_orderdate + INTERVAL '1' MONTH AS DATE)) AS due, CAST(max(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')) AS BIGINT) AS age "
    "FROM q_orders GROUP BY 1, 2",
)
_guarded(
    "sql_scalars",
    "SELECT p_partkey AS part_id, round(p_retailprice * 1.07, 2) AS taxed, coalesce(nullif(p_size, 1), 0) AS size, "
    "least(p_size, 10) AS small, greatest(p_size, 10) AS big, CAST(floor(p_retailprice / 100) AS BIGINT) AS hundreds, "
    "upper(p_brand) AS brand, CAST(length(p_name) AS BIGINT) AS name_length, abs(p_size - 25) AS distance FROM q_part",
)


# ---- Q1, Q3-Q6 --------------------------------------------------------------
_CAPPED = "SELECT o_orderkey AS order_id, o_totalprice AS total FROM {} ORDER BY o_totalprice DESC, o_orderkey"


@suite.query("select_capped", _CAPPED.format("orders") + " LIMIT 200")
def select_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The display form: 200 rows and a flag that more exist."""
    shown = workspace(spark, sf_dir, "orders").run(_CAPPED.format("q_orders"))
    assert shown.truncated
    return spark.createDataFrame(list(shown.rows), "order_id bigint, total double")


@suite.query("saved_query", "SELECT c_mktsegment AS segment, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def saved_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved while one table is registered, opened after it was replaced."""
    space = QueryWorkspace(spark)
    space.register("customer", given(spark, sf_dir, "customer"))
    kept = SavedQuery("segments", "SELECT c_mktsegment AS segment, count(*) AS customers FROM q_customer GROUP BY c_mktsegment")
    space.register("customer", given(spark, sf_dir, "customer").filter("c_acctbal > 0"))
    return kept.open(space)


@suite.query("projection_view", "SELECT o_orderstatus AS status, count(*) AS n, CAST(round(max(o_totalprice), 2) AS DOUBLE) AS top FROM orders GROUP BY 1")
def projection_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = workspace(spark, sf_dir, "orders")
    name = space.project("order_facts", "orders", ["o_orderstatus", "o_totalprice"])
    return space.select(f"SELECT o_orderstatus AS status, count(*) AS n, round(max(o_totalprice), 2) AS top FROM {name} GROUP BY o_orderstatus")


@suite.query(
    "cross_source_join",
    "SELECT c_mktsegment AS segment, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS DOUBLE) AS total "
    "FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def cross_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON customers joined to Parquet orders in one statement."""
    folder = scratch_path(spark, "crm")
    given(spark, sf_dir, "customer").write.json(f"{folder}/customers.json")
    space = QueryWorkspace(spark)
    space.register("crm.customers", json_records.read_json(spark, f"{folder}/customers.json")[0])
    space.register("orders", given(spark, sf_dir, "orders"))
    return space.select(
        "SELECT c_mktsegment AS segment, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS DOUBLE) AS total "
        "FROM q_crm_customers JOIN q_orders ON o_custkey = c_custkey GROUP BY c_mktsegment"
    )


@suite.query("save_result", "SELECT o_custkey AS customer_id, count(*) AS orders FROM orders GROUP BY 1")
def save_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole answer becomes a dataset and is read back."""
    store = DatasetStore(spark, scratch_path(spark, "store"))
    answer = workspace(spark, sf_dir, "orders").select("SELECT o_custkey AS customer_id, count(*) AS orders FROM q_orders GROUP BY o_custkey")
    store.save_result("orders_per_customer", answer)
    return store.read("orders_per_customer")


# ---- D1-D3 ------------------------------------------------------------------
_BY_PRIORITY = (
    "SELECT priority, count(*) AS orders, CAST(round(sum(CAST(total AS DECIMAL(18, 2))), 2) AS DOUBLE) AS total "
    "FROM {} WHERE {}1=1 GROUP BY priority"
)
_BY_STATUS = "SELECT status, count(*) AS orders FROM {} WHERE {}1=1 GROUP BY status"
_BY_SEGMENT = "SELECT segment, count(*) AS customers FROM {} WHERE {}1=1 GROUP BY segment"
_MARK = dashboards.FILTER_MARKER + " "
WIDGETS = (
    dashboards.Widget("by_priority", _BY_PRIORITY.format("q_sales", _MARK), "sales"),
    dashboards.Widget("by_status", _BY_STATUS.format("q_sales", _MARK), "sales"),
    dashboards.Widget("by_segment", _BY_SEGMENT.format("q_customers", _MARK), "customers"),
    dashboards.Widget("broken", "SELECT nothing FROM q_sales WHERE /*FILTERS*/ 1=1", "sales"),
)


def _board(spark: SparkSession, sf_dir: str, filters) -> dict[str, dashboards.WidgetResult]:
    frames = shop(spark, sf_dir, "sales", "customers")
    space = QueryWorkspace(spark)
    space.register_all(frames)
    return dashboards.run_dashboard(space, WIDGETS, frames, filters)


def _bars(results: dict[str, dashboards.WidgetResult]) -> DataFrame:
    """Every widget's bars, and which filters did not concern it."""
    out = None
    for name, result in results.items():
        if result.answer is None:
            continue
        label, value = result.answer.columns[:2]
        bars = result.answer.select(
            F.lit(name).alias("widget_id"), F.col(label).alias("label"), F.col(value).alias("value"),
            F.lit(",".join(result.unaffected_by)).alias("unaffected_by"),
        )
        out = bars if out is None else out.union(bars)
    return out


def _bars_sql(where: str, unaffected: str) -> str:
    sales = f"FROM orders WHERE {where}"
    return (
        f"SELECT 'by_priority' AS widget_id, o_orderpriority AS label, count(*) AS value, '' AS unaffected_by {sales} GROUP BY 2 "
        f"UNION ALL SELECT 'by_status', o_orderstatus, count(*), '' {sales} GROUP BY 2 "
        f"UNION ALL SELECT 'by_segment', c_mktsegment, count(*), '{unaffected}' FROM customer GROUP BY 2"
    )


@suite.query("dash_unfiltered", _bars_sql("1=1", ""))
def dash_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(_board(spark, sf_dir, []))


@suite.query("dash_filtered", _bars_sql("o_orderstatus = 'F'", "status"))
def dash_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(_board(spark, sf_dir, [("status", "F")]))


@suite.query("dash_crossfilter", _bars_sql("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'", "priority,status"))
def dash_crossfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicked = dashboards.cross_filter([("status", "F"), ("priority", "1-URGENT")], "status", "O")
    return _bars(_board(spark, sf_dir, clicked))


@suite.query(
    "dash_filter_before_aggregate",
    "SELECT o_orderpriority AS priority, count(*) AS orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS DOUBLE) AS total "
    "FROM orders WHERE o_custkey = 7 GROUP BY 1",
)
def dash_filter_before_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text filter value compared in the column's own type."""
    return _board(spark, sf_dir, [("customer_id", "7")])["by_priority"].answer


@suite.query(
    "dash_drill",
    "SELECT o_orderkey AS sale_id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS total, "
    "CAST(o_orderdate AS DATE) AS sale_date, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'",
)
def dash_drill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboards.drill_down(shop(spark, sf_dir, "sales")["sales"], [("status", "F"), ("priority", "5-LOW"), ("unknown", 1)])


# ---- Q2: what may run, and over how many rows --------------------------------
#: (case, text, the SQL that counts its rows, or None where the text must be refused)
_VERDICTS = (
    ("plain", "SELECT * FROM q_orders", "SELECT count(*) FROM orders"),
    ("literal_word", "SELECT 'reflect' AS t FROM q_customer", "SELECT count(*) FROM customer"),
    ("dotted_name_of_a_cte", "WITH `a.b` AS (SELECT * FROM q_nation) SELECT * FROM `a.b`", "SELECT count(*) FROM nation"),
    (
        "nested_sub_query",
        "SELECT * FROM q_orders WHERE o_custkey IN (WITH x AS (SELECT c_custkey FROM q_customer WHERE c_acctbal > 0) SELECT * FROM x)",
        "SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
    ),
    ("dotted_cte_for_a_path", "WITH `text./etc/passwd` AS (SELECT 1 AS x FROM q_orders) SELECT * FROM text.`/etc/passwd`", None),
    ("file_path", "SELECT * FROM text.`/etc/passwd`", None),
    ("computed_name", "SELECT * FROM IDENTIFIER('q_' || 'orders')", None),
    ("qualified_name", "SELECT * FROM spark_catalog.default.q_orders", None),
    ("cte_out_of_scope", "SELECT * FROM (WITH x AS (SELECT * FROM q_orders) SELECT * FROM x) JOIN x", None),
    ("outside_call", "SELECT reflect('java.lang.System', 'getProperty', o_orderstatus) FROM q_orders", None),
    ("quoted_outside_call", "SELECT `java_method`('java.lang.System', 'getProperty', o_orderstatus) FROM q_orders", None),
    ("table_function", "SELECT * FROM q_orders, range(3)", None),
    ("stacked", "SELECT * FROM q_orders; SELECT 1", None),
    ("write", "INSERT INTO q_orders SELECT * FROM q_orders", None),
    ("unknown_dataset", "SELECT * FROM q_events", None),
)


@suite.query(
    "guard_verdicts",
    " UNION ALL ".join(
        f"SELECT '{case}' AS case_name, {count is not None} AS allowed, {f'({count})' if count else 'NULL::BIGINT'} AS n_rows"
        for case, _, count in _VERDICTS
    ),
)
def guard_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that read the given tables and texts that try to read past them; what may run is counted."""
    space = workspace(spark, sf_dir, "orders", "customer", "nation")
    answers = []
    for case, sql, _ in _VERDICTS:
        refused = bool(space.problems(sql))
        counted = spark.range(1).select(F.lit(None).cast("long").alias("n_rows")) if refused else space.select(sql).agg(F.count("*").alias("n_rows"))
        answers.append(counted.select(F.lit(case).alias("case_name"), F.lit(not refused).alias("allowed"), "n_rows"))
    return reduce(DataFrame.unionByName, answers)
