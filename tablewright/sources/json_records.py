"""JSON records: an array of objects, or one object per line."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.sources import delimited


class MalformedFileError(ValueError):
    """The file cannot be parsed."""


def _is_one_per_line(spark: SparkSession, path: str) -> bool:
    """True when the first filled line is itself a whole object."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    if first is None:
        raise delimited.EmptyFileError("Nothing to read: the file holds no records.")
    line = first["value"].strip()
    return line.startswith("{") and line.endswith("}")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The table and the names of columns kept as JSON text.

    One object per line splits across tasks; an array has to be parsed by one
    task per file, so large inputs should come as lines.
    """
    reader = spark.read.option("mode", "FAILFAST").option("multiLine", not _is_one_per_line(spark, path))
    try:
        df = reader.json(path)
    except (PySparkException, Py4JJavaError) as bad:  # schema inference reads the file
        raise MalformedFileError("The JSON file could not be read.") from bad
    flat, nested = t.flatten_nested(df)
    plain = flat.select(*[t.column(c) for c in flat.columns if c not in nested])
    kinds = delimited.infer_types(plain, (t.DATE, t.DATETIME))
    return delimited.typed(flat, kinds), nested
