"""Links between tables, joins that follow them, and the column catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators import catalog, counts, links, profile
from tablewright.session import scratch_path
from tablewright.sources import delimited, json_records
from tablewright.suite.registry import Suite
from tablewright.suite.tables import given, shop, with_shop

suite = Suite()

STAR = ("customers", "shop_orders", "line_items", "parts", "suppliers", "nations", "regions")
# Links the names of the star suggest: child, column, parent, column.
STAR_LINKS = (
    ("customers", "nation_id", "nations", "nation_id"),
    ("shop_orders", "customer_id", "customers", "customer_id"),
    ("line_items", "order_id", "shop_orders", "order_id"),
    ("line_items", "part_id", "parts", "part_id"),
    ("line_items", "supplier_id", "suppliers", "supplier_id"),
    ("suppliers", "nation_id", "nations", "nation_id"),
    ("nations", "region_id", "regions", "region_id"),
)


def _evidence_sql(c: str, cc: str, p: str, pc: str) -> str:
    return (
        f"SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, '{pc}' AS parent_column, "
        f"(SELECT count(*) - count({cc}) FROM {c}) AS child_nulls, (SELECT count({cc}) FROM {c}) AS child_rows, "
        f"(SELECT count(*) FROM {c} WHERE {cc} IN (SELECT {pc} FROM {p})) AS matched_rows, "
        f"(SELECT count({pc}) = count(DISTINCT {pc}) FROM {p}) AS parent_unique"
    )


_EVIDENCE = with_shop(*STAR) + ", evidence AS (" + " UNION ALL ".join(_evidence_sql(*x) for x in STAR_LINKS) + ") "
_LINK_COLUMNS = ("child_table", "child_column", "parent_table", "parent_column", "origin", "join_type", "coverage")


def _star(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return shop(spark, sf_dir, *STAR)


@suite.query(
    "link_evidence",
    _EVIDENCE + "SELECT *, round(CAST(matched_rows AS DOUBLE) / child_rows, 6) AS coverage FROM evidence",
)
def link_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _star(spark, sf_dir)
    found = links.link_evidence(frames, links.candidates(frames))
    return found.select(
        "child_table", "child_column", "parent_table", "parent_column", "child_nulls", "child_rows",
        "matched_rows", "parent_unique", F.round("coverage", 6).alias("coverage"),
    )


@suite.query(
    "link_unique_keys",
    with_shop(*STAR) + " " + " UNION ALL ".join(
        f"SELECT '{p}' AS parent_table, '{pc}' AS parent_column, count({pc}) AS parent_rows, "
        f"count(DISTINCT {pc}) AS parent_distinct, count({pc}) = count(DISTINCT {pc}) AS parent_unique FROM {p}"
        for p, pc in sorted({(x[2], x[3]) for x in STAR_LINKS})
    ),
)
def link_unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _star(spark, sf_dir)
    found = links.link_evidence(frames, links.candidates(frames))
    return found.select("parent_table", "parent_column", "parent_rows", "parent_distinct", "parent_unique").distinct()


@suite.query(
    "link_discover",
    _EVIDENCE + "SELECT child_table, child_column, parent_table, parent_column, 'inferred' AS origin, "
    "CASE WHEN child_nulls > 0 THEN 'optional' ELSE 'required' END AS join_type, CAST(1.0 AS DOUBLE) AS coverage "
    "FROM evidence WHERE parent_unique AND matched_rows = child_rows AND child_rows > 0",
)
def link_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.discover(_star(spark, sf_dir)).select(*_LINK_COLUMNS)


DECLARED = {
    "line_items": links.TableKeys(("line_id",), (links.ForeignKey(("order_id",), "Shop_Orders", ("order_id",)),
                                                 links.ForeignKey(("part_id", "supplier_id"), "stocked", ("part_id", "supplier_id")))),
    "shop_orders": links.TableKeys(("order_id",), (links.ForeignKey(("customer_id",), "customers", ("customer_id",)),)),
}


@suite.query(
    "link_declared",
    with_shop("line_items", "shop_orders")
    + " SELECT 'line_items' AS child_table, 'order_id' AS child_column, 'shop_orders' AS parent_table, 'order_id' AS parent_column, "
    "'declared' AS origin, CASE WHEN count(*) > count(order_id) THEN 'optional' ELSE 'required' END AS join_type, "
    "CAST(1.0 AS DOUBLE) AS coverage, '' AS extra FROM line_items UNION ALL "
    "SELECT 'line_items', 'part_id', 'stocked', 'part_id', 'declared', CASE WHEN count(*) > count(part_id) OR "
    "count(*) > count(supplier_id) THEN 'optional' ELSE 'required' END, 1.0, 'supplier_id=supplier_id' FROM line_items UNION ALL "
    "SELECT 'shop_orders', 'customer_id', 'customers', 'customer_id', 'declared', "
    "CASE WHEN count(*) > count(customer_id) THEN 'optional' ELSE 'required' END, 1.0, '' FROM shop_orders",
)
def link_declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.declared_links(shop(spark, sf_dir, "customers", "shop_orders", "line_items"), DECLARED)
    extra = F.array_join(F.transform("extra_columns", lambda e: F.concat(e["child"], F.lit("="), e["parent"])), ",")
    return found.select(*_LINK_COLUMNS, extra.alias("extra"))


@suite.query(
    "link_cross_source",
    "SELECT 'crm.customers.csv' AS parent_table, 'customer_id' AS parent_column, 'billing.json' AS child_table, "
    "'customer_id' AS child_column, 'required' AS join_type, count(*) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer)) "
    "AS matched_rows FROM orders",
)
def link_cross_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited file and a JSON file, linked like any two tables."""
    folder = scratch_path(spark, "cross")
    shop(spark, sf_dir, "customers")["customers"].write.option("header", True).csv(f"{folder}/customers.csv")
    bills = shop(spark, sf_dir, "sales")["sales"].select("sale_id", "customer_id", "total")
    bills.write.json(f"{folder}/billing.json")
    frames = {
        "crm.customers.csv": delimited.read_delimited(spark, f"{folder}/customers.csv")[0],
        "billing.json": json_records.read_json(spark, f"{folder}/billing.json")[0],
    }
    evidence = links.link_evidence(frames, links.candidates(frames))
    found = links.inferred_links(evidence)
    return found.join(F.broadcast(evidence.select("child_table", "child_column", "parent_table", "matched_rows")),
                      ["child_table", "child_column", "parent_table"]).select(
        "child_table", "child_column", "parent_table", "parent_column", "join_type", "matched_rows"
    )


FOREIGN_KEYS = (
    ("line_items", "order_id", "open_orders", "order_id"),
    ("line_items", "part_id", "parts", "part_id"),
)
_OPEN = ", open_orders AS (SELECT * FROM shop_orders WHERE status <> 'F') "


@suite.query(
    "fk_orphans",
    with_shop("line_items", "shop_orders", "parts") + _OPEN + " UNION ALL ".join(
        f"SELECT '{c}' AS child_table, '{cc}' AS child_column, '{p}' AS parent_table, '{pc}' AS parent_column, "
        f"count(*) FILTER (WHERE {cc} IS NOT NULL AND {cc} NOT IN (SELECT {pc} FROM {p})) AS orphans FROM {c}"
        for c, cc, p, pc in FOREIGN_KEYS
    ),
)
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = shop(spark, sf_dir, "line_items", "shop_orders", "parts")
    frames["open_orders"] = frames["shop_orders"].filter("status <> 'F'")
    return links.orphans(frames, FOREIGN_KEYS)


_JOINED = "coalesce(segment, 'none') AS segment, count(*) AS orders, CAST(round(sum(total), 2) AS DOUBLE) AS total"


def _joined(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("segment", F.lit("none")).alias("segment")).agg(
        F.count("*").alias("orders"), F.round(F.sum("total"), 2).alias("total")
    )


@suite.query(
    "join_optional",
    with_shop("shop_orders", "customers") + f" SELECT {_JOINED} FROM shop_orders LEFT JOIN customers USING (customer_id) GROUP BY 1",
)
def join_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = shop(spark, sf_dir, "shop_orders", "customers")
    return _joined(links.join_linked(frames["shop_orders"], frames["customers"], [("customer_id", "customer_id")], optional=True))


@suite.query(
    "join_required",
    with_shop("shop_orders", "customers") + f" SELECT {_JOINED} FROM shop_orders JOIN customers USING (customer_id) GROUP BY 1",
)
def join_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = shop(spark, sf_dir, "shop_orders", "customers")
    return _joined(links.join_linked(frames["shop_orders"], frames["customers"], [("customer_id", "customer_id")], optional=False))


_STOCKED = (
    ", stocked AS (SELECT part_id, supplier_id, count(*) AS lines FROM line_items GROUP BY 1, 2) "
)


@suite.query(
    "join_composite",
    with_shop("line_items") + _STOCKED + "SELECT lines, count(*) AS joined, CAST(round(sum(price), 2) AS DOUBLE) AS price "
    "FROM line_items JOIN stocked USING (part_id, supplier_id) GROUP BY 1",
)
def join_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = shop(spark, sf_dir, "line_items")["line_items"]
    stocked = items.groupBy("part_id", "supplier_id").agg(F.count("*").alias("lines"))
    joined = links.join_linked(items, stocked, [("part_id", "part_id"), ("supplier_id", "supplier_id")], optional=False)
    return joined.groupBy("lines").agg(F.count("*").alias("joined"), F.round(F.sum("price"), 2).alias("price"))


@suite.query(
    "affected_tables",
    _EVIDENCE + "SELECT DISTINCT CASE WHEN child_table IN ('shop_orders') THEN parent_table ELSE child_table END AS table_name "
    "FROM evidence WHERE parent_unique AND matched_rows = child_rows AND 'shop_orders' IN (child_table, parent_table)",
)
def affected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.affected_tables(links.discover(_star(spark, sf_dir)), ["shop_orders"])


@suite.query(
    "links_of_table",
    _EVIDENCE + "SELECT child_table, child_column, parent_table, parent_column FROM evidence "
    "WHERE parent_unique AND matched_rows = child_rows AND 'customers' IN (child_table, parent_table)",
)
def links_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.links_of(links.discover(_star(spark, sf_dir)), "customers")
    return found.select("child_table", "child_column", "parent_table", "parent_column")


# ---- catalog ----------------------------------------------------------------
CATALOGUED = ("customers", "shop_orders")
# column, kind, followed link (or none)
_COLUMNS = {
    "customers": (("customer_id", "integer", None), ("name", "text", None), ("nation_id", "integer", None), ("balance", "decimal", None), ("segment", "text", None)),
    "shop_orders": (("order_id", "integer", None), ("customer_id", "integer", "customers.customer_id"), ("status", "text", None),
                    ("total", "decimal", None), ("order_date", "date", None), ("priority", "text", None)),
}
KEYS = {"customers": ["customer_id"], "shop_orders": ["order_id"]}


def _role_sql(n: str, c: str, kind: str, link) -> str:
    if link or c in KEYS[n]:
        return "'identifier'"
    by_kind = {"integer": "'measure'", "decimal": "'measure'", "date": "'timestamp'"}
    return by_kind.get(kind, f"CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 25 THEN 'category' ELSE 'text' END")


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frames = shop(spark, sf_dir, *CATALOGUED)
    found = links.discover(frames)
    profiled = catalog.profile_tables({n: profile.profile(df) for n, df in frames.items()})
    return catalog.column_roles(profiled, found, KEYS), found


@suite.query(
    "column_roles",
    with_shop(*CATALOGUED) + " " + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, max({_role_sql(n, c, k, l).replace('CASE WHEN', '(SELECT CASE WHEN').replace('END', f'END FROM {n})')}) AS role FROM {n}"
        for n in CATALOGUED for c, k, l in _COLUMNS[n]
    ),
)
def column_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _roles(spark, sf_dir)[0].select("table_name", "column_name", "role")


def _missing_sql(c: str) -> str:
    return (
        f"CASE WHEN count(*) > count({c}) THEN ' ' || CAST(round_even((count(*) - count({c})) * 100.0 / count(*), 0) AS BIGINT) "
        f"|| '% of values are missing.' ELSE '' END"
    )


def _few(n: str, c: str) -> str:
    return (
        f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT v FROM (SELECT CAST(x AS VARCHAR) AS v FROM "
        f"(SELECT DISTINCT {c} AS x FROM {n} WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 20)) ORDER BY v LIMIT 3))"
    )


def _description_sql(n: str, c: str, kind: str, link) -> str:
    d = f"count(DISTINCT {c})"
    if link:
        return (
            f"'Foreign key: each {c} references {link} (' || CASE WHEN count(*) > count({c}) THEN 'optional' ELSE 'required' END "
            f"|| ').' || {_missing_sql(c)}"
        )
    if c in KEYS[n]:
        return f"'Primary key of the table — ' || {d} || ' unique {c} values, e.g. ' || {_few(n, c)} || '.'"
    if kind in ("integer", "decimal"):
        return f"'Numeric {c} — ' || {d} || ' distinct values, ranging ' || min({c}) || ' to ' || max({c}) || '.' || {_missing_sql(c)}"
    if kind == "date":
        return f"'Date/time {c}.' || {_missing_sql(c)}"
    return (
        f"CASE WHEN {d} <= 25 THEN 'Categorical {c} — ' ELSE 'Text {c} — ' END || {d} || ' distinct values across ' || count(*) "
        f"|| ' rows, e.g. ' || {_few(n, c)} || '.' || {_missing_sql(c)}"
    )


_DESCRIBED = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c}' AS column_name, {_description_sql(n, c, k, l)} AS description FROM {n}"
    for n in CATALOGUED for c, k, l in _COLUMNS[n]
)


@suite.query("column_descriptions", with_shop(*CATALOGUED) + " " + _DESCRIBED)
def column_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.describe_columns(_roles(spark, sf_dir)[0]).select("table_name", "column_name", "description")


@suite.query(
    "table_descriptions",
    with_shop(*CATALOGUED) + " SELECT 'customers' AS table_name, 'customers: ' || count(*) || ' rows, 5 columns. "
    "Referenced by shop_orders.' AS description FROM customers UNION ALL SELECT 'shop_orders', 'shop_orders: ' || count(*) || "
    "' rows, 6 columns. References customers (via customer_id). customers: People who buy.' FROM shop_orders",
)
def table_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles, found = _roles(spark, sf_dir)
    known = spark.createDataFrame([("customers", "People who buy. One row each.")], "table_name string, description string")
    return catalog.describe_tables(roles, found, known)


@suite.query(
    "declared_descriptions",
    with_shop(*CATALOGUED) + " " + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c}' AS column_name, '{text}' AS description, count({c}) AS filled FROM {n}"
        for n, c, text in (
            ("shop_orders", "order_id", "Primary key of shop_orders (declared)."),
            ("shop_orders", "customer_id", "Declared foreign key referencing customers.customer_id."),
            ("shop_orders", "status", "Text column from the source table."),
            ("shop_orders", "total", "Numeric column from the source table."),
            ("shop_orders", "order_date", "Date column from the source table."),
            ("shop_orders", "priority", "Text column from the source table."),
        )
    ),
)
def declared_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shop(spark, sf_dir, "shop_orders")["shop_orders"]
    facts = profile.column_facts(df).withColumn("table_name", F.lit("shop_orders"))
    described = catalog.describe_declared(facts, {"shop_orders": DECLARED["shop_orders"]})
    filled = facts.select("column_name", (F.col("row_count") - F.col("null_count")).alias("filled"))
    return described.drop("role").join(F.broadcast(filled), "column_name")


_FIXED = "Kind of business the customer is in."


@suite.query(
    "curation_overlay",
    with_shop(*CATALOGUED) + f" SELECT table_name, column_name, CASE WHEN table_name = 'customers' AND column_name = 'segment' "
    f"THEN '{_FIXED}' ELSE description END AS description FROM ({_DESCRIBED})",
)
def curation_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = catalog.describe_columns(_roles(spark, sf_dir)[0]).select("table_name", "column_name", "description")
    fixed = spark.createDataFrame(
        [("customers", "segment", _FIXED)], "table_name string, column_name string, description string"
    )
    return catalog.overlay_corrections(described, fixed)


@suite.query(
    "key_metadata",
    "SELECT 'lineitem' AS table_name, 'to_orders' AS constraint_name, 'l_orderkey' AS columns, 'o_orderkey' AS ref_columns, "
    "count(l_orderkey) AS filled FROM lineitem UNION ALL SELECT 'lineitem', 'to_stock', 'l_partkey,l_suppkey', 'p_key,s_key', "
    "count(l_partkey) FROM lineitem",
)
def key_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint rows as a database lists them, grouped into composite keys."""
    rows = spark.createDataFrame(
        [
            ("lineitem", "to_stock", "FOREIGN KEY", 2, "l_suppkey", "stock", "s_key"),
            ("lineitem", "to_stock", "FOREIGN KEY", 1, "l_partkey", "stock", "p_key"),
            ("lineitem", "to_orders", "FOREIGN KEY", 1, "l_orderkey", "orders", "o_orderkey"),
        ],
        "table_name string, constraint_name string, constraint_type string, seq int, column_name string, ref_table string, ref_column string",
    )
    keys = links.keys_from_metadata(rows)
    vc = counts.count_values(given(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])
    filled = vc.groupBy("column_name").agg(F.sum("n").alias("filled"))
    return keys.join(F.broadcast(filled), F.col("columns")[0] == F.col("column_name")).select(
        "table_name", "constraint_name", F.array_join("columns", ",").alias("columns"),
        F.array_join("ref_columns", ",").alias("ref_columns"), "filled",
    )
