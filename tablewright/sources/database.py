"""Tables of a connected database, read through Spark's JDBC source.

Reads are lazy and read-only; projections, filters and limits go to the source.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import types as t

FETCH_CAP = 200

# Where each engine keeps its declared keys.  Columns: table,
# constraint, type, position, column, referenced table, referenced column.
KEY_QUERIES = {
    "postgresql": (
        "SELECT own.relname AS table_name, c.conname AS constraint_name, "
        "CASE c.contype WHEN 'p' THEN 'PRIMARY KEY' ELSE 'FOREIGN KEY' END AS constraint_type, k.seq, "
        "own_column.attname AS column_name, ref.relname AS ref_table, ref_column.attname AS ref_column "
        "FROM pg_constraint c JOIN pg_class own ON own.oid = c.conrelid "
        "CROSS JOIN LATERAL unnest(c.conkey, c.confkey) WITH ORDINALITY AS k(own_no, ref_no, seq) "
        "JOIN pg_attribute own_column ON own_column.attrelid = own.oid AND own_column.attnum = k.own_no "
        "LEFT JOIN pg_class ref ON ref.oid = c.confrelid "
        "LEFT JOIN pg_attribute ref_column ON ref_column.attrelid = ref.oid AND ref_column.attnum = k.ref_no "
        "WHERE c.contype IN ('p', 'f')"
    ),
    # object ids, not names: the same constraint name in two schemas stays apart
    "sqlserver": (
        "SELECT OBJECT_NAME(pk.parent_object_id) AS table_name, pk.name AS constraint_name, 'PRIMARY KEY' AS constraint_type, "
        "part.key_ordinal AS seq, COL_NAME(part.object_id, part.column_id) AS column_name, NULL AS ref_table, NULL AS ref_column "
        "FROM sys.key_constraints pk "
        "JOIN sys.index_columns part ON part.object_id = pk.parent_object_id AND part.index_id = pk.unique_index_id "
        "WHERE pk.type = 'PK' AND part.key_ordinal > 0 "
        "UNION ALL "
        "SELECT OBJECT_NAME(fk.parent_object_id), OBJECT_NAME(fk.constraint_object_id), 'FOREIGN KEY', fk.constraint_column_id, "
        "COL_NAME(fk.parent_object_id, fk.parent_column_id), OBJECT_NAME(fk.referenced_object_id), "
        "COL_NAME(fk.referenced_object_id, fk.referenced_column_id) "
        "FROM sys.foreign_key_columns fk"
    ),
    "db2": (
        "SELECT c.TABNAME AS table_name, c.CONSTNAME AS constraint_name, "
        "DECODE(c.TYPE, 'P', 'PRIMARY KEY', 'FOREIGN KEY') AS constraint_type, own.COLSEQ AS seq, own.COLNAME AS column_name, "
        "r.REFTABNAME AS ref_table, ref.COLNAME AS ref_column "
        "FROM SYSCAT.TABCONST c "
        "JOIN SYSCAT.KEYCOLUSE own ON own.TABSCHEMA = c.TABSCHEMA AND own.TABNAME = c.TABNAME AND own.CONSTNAME = c.CONSTNAME "
        "LEFT JOIN SYSCAT.REFERENCES r ON r.TABSCHEMA = c.TABSCHEMA AND r.TABNAME = c.TABNAME AND r.CONSTNAME = c.CONSTNAME "
        "LEFT JOIN SYSCAT.KEYCOLUSE ref ON ref.TABSCHEMA = r.REFTABSCHEMA AND ref.TABNAME = r.REFTABNAME "
        "AND ref.CONSTNAME = r.REFKEYNAME AND ref.COLSEQ = own.COLSEQ "
        "WHERE c.TYPE IN ('P', 'F')"
    ),
    "sqlite": (
        "SELECT m.name AS table_name, 'key' AS constraint_name, 'PRIMARY KEY' AS constraint_type, i.pk AS seq, i.name AS column_name, "
        "NULL AS ref_table, NULL AS ref_column "
        "FROM sqlite_master m JOIN pragma_table_info(m.name) i WHERE m.type = 'table' AND i.pk > 0 "
        "UNION ALL "
        "SELECT m.name, 'link ' || f.id, 'FOREIGN KEY', f.seq + 1, f.\"from\", f.\"table\", f.\"to\" "
        "FROM sqlite_master m JOIN pragma_foreign_key_list(m.name) f WHERE m.type = 'table'"
    ),
}


@dataclass(frozen=True)
class Connection:
    """Where a database is; ``properties`` holds user, password and driver."""

    name: str
    url: str
    properties: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Split:
    """How a large table is read by many tasks."""

    column: str
    lower: str
    upper: str
    parts: int


def table_options(connection: Connection, table: str, split: Split | None = None) -> dict[str, str]:
    options = {
        **connection.properties,
        "url": connection.url,
        "dbtable": table,
        "pushDownLimit": "true",
        "pushDownAggregate": "true",
    }
    if split:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": split.lower,
            "upperBound": split.upper,
            "numPartitions": str(split.parts),
        }
    return options


def read_table(spark: SparkSession, connection: Connection, table: str, split: Split | None = None) -> DataFrame:
    """The whole table, lazily."""
    return spark.read.format("jdbc").options(**table_options(connection, table, split)).load()


def fetch_capped(spark: SparkSession, connection: Connection, table: str, limit: int = FETCH_CAP) -> DataFrame:
    """The first rows for display; the source applies the cap."""
    return read_table(spark, connection, table).limit(limit)


def read_keys(spark: SparkSession, connection: Connection, engine: str) -> DataFrame:
    """Declared keys as rows for ``links.declared_keys``."""
    options = {**connection.properties, "url": connection.url, "query": KEY_QUERIES[engine]}
    return spark.read.format("jdbc").options(**options).load()


def dataset_name(connection: Connection, table: str) -> str:
    return f"{connection.name}.{table}"


def pushed_profile_sql(table: str, schema: Sequence[tuple[str, str]]) -> str:
    """One aggregate the source runs itself: rows, nulls, distinct, numeric range."""
    parts = ["COUNT(*) AS row_count"]
    for i, (name, kind) in enumerate(schema):
        c = '"' + name.replace('"', '""') + '"'
        parts += [f"COUNT(*) - COUNT({c}) AS nulls_{i}", f"COUNT(DISTINCT {c}) AS distinct_{i}"]
        if kind in t.NUMERIC:
            parts += [f"MIN({c}) AS min_{i}", f"MAX({c}) AS max_{i}"]
    return f"SELECT {', '.join(parts)} FROM {table}"


def pushed_profile(spark: SparkSession, connection: Connection, table: str) -> DataFrame:
    """One row per column; only aggregates leave the source."""
    schema = t.schema_of(read_table(spark, connection, table))
    options = {**connection.properties, "url": connection.url, "query": pushed_profile_sql(table, schema)}
    one = spark.read.format("jdbc").options(**options).load()
    return unfold_pushed(one, schema)


def unfold_pushed(one: DataFrame, schema: Sequence[tuple[str, str]]) -> DataFrame:
    cells = []
    for i, (name, kind) in enumerate(schema):
        numeric = kind in t.NUMERIC
        none = F.lit(None).cast("double")
        cells += [
            F.lit(name),
            F.lit(kind),
            F.col("row_count").cast("bigint"),
            F.col(f"nulls_{i}").cast("bigint"),
            F.col(f"distinct_{i}").cast("bigint"),
            F.col(f"min_{i}").cast("double") if numeric else none,
            F.col(f"max_{i}").cast("double") if numeric else none,
        ]
    return one.select(
        F.stack(F.lit(len(schema)), *cells).alias(
            "column_name", "inferred_type", "row_count", "null_count", "distinct_count", "minimum", "maximum"
        )
    )


def pushed_samples(spark: SparkSession, connection: Connection, table: str, name: str, cap: int = 20) -> DataFrame:
    """Distinct non-null values of one column; the source finds and caps them."""
    c = '"' + name.replace('"', '""') + '"'
    inner = f"(SELECT DISTINCT {c} FROM {table} WHERE {c} IS NOT NULL) AS sampled"
    return read_table(spark, connection, inner).limit(cap)
