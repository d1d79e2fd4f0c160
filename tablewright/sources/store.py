"""Datasets as versioned Parquet folders with a view on the latest version."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright import types as t
from tablewright.operators import normalize
from tablewright.sources import delimited, json_records

EXPORT_FORMATS = ("csv", "parquet")


def dataset_id(path: str) -> str:
    """``Orders 2024.CSV`` -> ``orders_2024.csv``; a name without letters or digits becomes ``dataset``."""
    name, ext = os.path.splitext(os.path.basename(path.rstrip("/")).lower())
    words = re.findall("[a-z0-9]+", name)
    return ("_".join(words) if words else "dataset") + ext


@dataclass(frozen=True)
class RefreshResult:
    dataset: str
    replaced: bool
    version: int
    question: str | None = None


class DatasetStore:
    """Named datasets below one folder: ``<root>/<dataset>/version=<n>/``.

    A writer first claims its number by creating ``_claims/<n>``, which one writer only can do, so writers at the same time get
    different numbers and a number is never used again.  The version counts once its job has committed, which
    Spark marks with ``_SUCCESS``; what a failed or running writer has left behind is not seen.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ---- the file system ------------------------------------------------
    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, pattern: str, parent: bool) -> list[int]:
        found = self._files().globStatus(self._path(pattern)) or []
        names = [(f.getPath().getParent() if parent else f.getPath()).getName() for f in found]
        return sorted(int(n.removeprefix("version=")) for n in names if n.removeprefix("version=").isdigit())

    # ---- versions -------------------------------------------------------
    def versions(self, dataset: str) -> list[int]:
        """Committed versions, ascending."""
        return self._numbers(f"{self.root}/{dataset}/version=*/_SUCCESS", parent=True)

    def claim(self, dataset: str) -> int:
        """The next number, taken for good: higher than any claimed or present, and no other writer's."""
        taken = self._numbers(f"{self.root}/{dataset}/version=*", False) + self._numbers(f"{self.root}/{dataset}/_claims/*", False)
        number = max(taken, default=0) + 1
        self._files().mkdirs(self._path(f"{self.root}/{dataset}/_claims"))
        while not self._created(f"{self.root}/{dataset}/_claims/{number}"):
            number += 1  # another writer was faster
        return number

    def _created(self, text: str) -> bool:
        """Create an empty file; false if it is there already."""
        files, path = self._files(), self._path(text)
        if files.getUri().getScheme() == "file":  # this file system looks and creates in two steps, the JVM in one
            return self.spark._jvm.java.io.File(path.toUri().getPath()).createNewFile()
        try:
            files.create(path, False).close()
        except Py4JJavaError:
            if files.exists(path):
                return False
            raise
        return True

    def write(self, dataset: str, df: DataFrame) -> int:
        """A new version; returns its number once it is committed."""
        number = self.claim(dataset)
        df.write.mode("error").parquet(f"{self.root}/{dataset}/version={number}")
        return number

    def stored(self, dataset: str, version: int | None = None) -> DataFrame:
        """A dataset as it was written: the latest committed version, or the one asked for."""
        known = self.versions(dataset)
        if not known or (version is not None and version not in known):
            raise KeyError(dataset)
        return self.spark.read.parquet(f"{self.root}/{dataset}/version={version or known[-1]}")

    def read(self, dataset: str, version: int | None = None) -> DataFrame:
        """A dataset as queries see it, mappings folded in."""
        return normalize.apply_mappings(self.stored(dataset, version), self.mappings(dataset))

    # ---- decisions about values ------------------------------------------
    def journal(self, dataset: str) -> "Journal":
        return Journal(self.spark, f"{self.root}/{dataset}/_decisions")

    def mappings(self, dataset: str) -> dict[str, dict[str, str]]:
        """Column -> raw -> canonical, as approved last; a rule holds at most a few hundred values."""
        return {c: d["mapping"] for c, d in self.journal(dataset).replay().items() if d["status"] == "approved"}

    def set_mappings(self, dataset: str, mappings: dict[str, dict[str, str]]) -> None:
        """Approve exactly these mappings beside the data, which is never touched; others are revoked."""
        journal = self.journal(dataset)
        for column in self.mappings(dataset).keys() - mappings.keys():
            journal.add(column, "revoked")
        for column, mapping in mappings.items():
            journal.add(column, "approved", mapping)

    def standardisation(self, dataset: str) -> normalize.Standardisation:
        """Proposals for the stored data, with every decision taken so far; new decisions are kept."""
        return normalize.Standardisation(self.stored(dataset), self.journal(dataset))

    # ---- ingest ---------------------------------------------------------
    def _load(self, path: str) -> DataFrame:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        if ext in delimited.DELIMITERS:
            return delimited.read_delimited(self.spark, path, delimited.DELIMITERS[ext])[0]
        if ext == ".json":
            return json_records.read_json(self.spark, path)[0]
        raise delimited.UnsupportedFormatError(f"'{ext}' is not supported (CSV, TSV, JSON).")

    def ingest(self, path: str, dataset: str | None = None) -> str:
        name = dataset or dataset_id(path)
        self.write(name, self._load(path))
        return name

    def refresh(self, dataset: str, path: str, loosen: bool = False) -> RefreshResult:
        """A new version if the ordered schema matches, or if loosened."""
        current = self.versions(dataset)
        if not current:
            raise KeyError(dataset)
        candidate = self._load(path)
        if loosen or t.schema_of(candidate) == t.schema_of(self.read(dataset)):
            return RefreshResult(dataset, True, self.write(dataset, candidate))
        return RefreshResult(
            dataset,
            False,
            current[-1],
            f"Columns or types of the new file differ from those of '{dataset}'. Replace it all the same?",
        )

    # ---- results --------------------------------------------------------
    def save_result(self, dataset: str, df: DataFrame) -> int:
        """A query result becomes an ordinary dataset, in full."""
        return self.write(dataset, df)

    def save_predictions(self, dataset: str, df: DataFrame, model: str, model_version: int) -> None:
        """Predictions land as a dataset; an earlier set of them is replaced."""
        stamped = df.withColumn("model", F.lit(model)).withColumn("model_version", F.lit(model_version))
        stamped.write.mode("overwrite").parquet(f"{self.root}/{dataset}/version=1")  # replaced, not versioned


class Journal:
    """Decisions about a dataset's columns, only ever added to; the latest per column holds.

    An entry is a file of its own that is complete or absent, so a lost driver leaves no half decision.
    """

    ENTRY = "number bigint, column_name string, status string, mapping map<string, string>, description string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def entries(self) -> DataFrame:
        """Every decision ever taken, in no order; ``number`` orders them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.ENTRY)
        return self.spark.read.schema(self.ENTRY).json(self.folder)

    def add(self, column: str, status: str, mapping: dict[str, str] | None = None, description: str | None = None) -> None:
        last = self.entries().agg(F.max("number")).first()[0] or 0
        entry = self.spark.createDataFrame([(last + 1, column, status, mapping, description)], self.ENTRY)
        entry.coalesce(1).write.mode("append").json(self.folder)

    def replay(self) -> dict[str, dict]:
        """Column -> its latest decision; revoked ones are gone.  One row per decided column."""
        entry = F.struct("number", "status", F.to_json("mapping").alias("mapping"), "description")
        latest = self.entries().groupBy("column_name").agg(F.max(entry).alias("e")).select("column_name", "e.*").filter("status <> 'revoked'")
        return {
            r["column_name"]: {"status": r["status"], "mapping": json.loads(r["mapping"] or "{}"), "description": r["description"]}
            for r in latest.collect()
        }


def export(df: DataFrame, fmt: str, path: str) -> None:
    """Every row, never display-capped, as CSV with a header or as Parquet."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"Exports are written as {' or '.join(EXPORT_FORMATS)}, not as {fmt!r}.")
    if fmt == "parquet":
        df.write.parquet(path)
        return
    flat, _ = t.flatten_nested(df)
    flat.write.option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", '""'
    ).csv(path)
