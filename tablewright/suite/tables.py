"""The given tables, plain and under the names the link rules expect.

The renamed tables are stated once, as SQL both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SHOP = {
    "customers": (
        "SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nation_id, "
        "c_acctbal AS balance, c_mktsegment AS segment FROM customer"
    ),
    "shop_orders": (
        "SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS customer_id, "
        "o_orderstatus AS status, o_totalprice AS total, CAST(o_orderdate AS DATE) AS order_date, "
        "o_orderpriority AS priority FROM orders"
    ),
    "sales": (
        "SELECT o_orderkey AS sale_id, o_custkey AS customer_id, o_orderstatus AS status, "
        "o_totalprice AS total, CAST(o_orderdate AS DATE) AS sale_date, o_orderpriority AS priority FROM orders"
    ),
    "line_items": (
        "SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)), "
        "CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20))) AS line_id, l_orderkey AS order_id, "
        "l_orderkey AS sale_id, l_partkey AS part_id, l_suppkey AS supplier_id, l_quantity AS quantity, "
        "l_extendedprice AS price, l_discount AS discount, l_returnflag AS return_flag, "
        "CAST(l_shipdate AS DATE) AS ship_date FROM lineitem"
    ),
    "parts": "SELECT p_partkey AS part_id, p_brand AS brand, p_size AS size, p_retailprice AS retail_price FROM part",
    "suppliers": "SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey AS nation_id FROM supplier",
    "nations": "SELECT n_nationkey AS nation_id, n_name AS name, n_regionkey AS region_id FROM nation",
    "regions": "SELECT r_regionkey AS region_id, r_name AS name FROM region",
    "messy_customers": (
        "SELECT c_custkey AS customer_id, c_acctbal AS balance, "
        "CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) WHEN c_acctbal < 2000 THEN '  ' || c_mktsegment "
        "WHEN c_acctbal < 5000 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) "
        "ELSE c_mktsegment END AS segment, c_name AS name FROM customer"
    ),
    "mixed_orders": (
        "SELECT o_orderkey AS order_id, "
        "CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a-' || o_orderstatus "
        "ELSE CAST(o_custkey AS VARCHAR(20)) END AS code, "
        "CASE WHEN o_orderstatus = 'P' THEN 'pending ' || o_orderpriority "
        "ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS day, "
        "CASE WHEN o_totalprice < 100000 THEN 'unknown' WHEN o_totalprice < 300000 THEN 'false' "
        "ELSE 'true' END AS large, "
        "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS note FROM orders"
    ),
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BASE = {
    "customers": "customer",
    "shop_orders": "orders",
    "sales": "orders",
    "line_items": "lineitem",
    "parts": "part",
    "suppliers": "supplier",
    "nations": "nation",
    "regions": "region",
    "messy_customers": "customer",
    "mixed_orders": "orders",
}


def shop(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """The renamed tables asked for."""
    out = {}
    for name in names:
        source = given(spark, sf_dir, BASE[name])
        select, table = SHOP[name].rsplit(" FROM ", 1)
        assert table == BASE[name]
        out[name] = spark.sql(f"{select} FROM {{source}}", source=source)
    return out


def with_shop(*names: str) -> str:
    """The same tables as the opening WITH of a check."""
    return "WITH " + ", ".join(f"{n} AS ({SHOP[n]})" for n in names)
