"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on everything the stage before kept, and
returns a DataFrame; all but the last return the columns of ``documents``.  A stage whose
text changes also renews ``n_chars``.  Between stages the rows are written and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from tablewright.llm.text import table
from tablewright.session import materialise
from tablewright.suite.registry import Suite

suite = Suite()


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_rules(docs).filter("kept").select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later matching lines go; a document goes with them only if no word is left of it."""
    done = line_dedup.line_dedup(_row_keyed(docs), "_key")
    return _renewed(done.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest row key stays; wordless documents link with nothing."""
    keyed = _row_keyed(docs)
    found = jaccard_join.jaccard_components(keyed, "_key")
    stays = found.filter("_key <=> component_id OR n_shingles = 0").selectExpr("_key AS _stays", "n_shingles > 0 AS _wordy")
    repeated = stays.filter("_wordy").groupBy("_stays").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).collect()
    kept = keyed.join(stays.distinct(), F.col("_key") == F.col("_stays"))
    if repeated:  # rows of one key are copies of each other, id and text alike
        kept = kept.filter("NOT _wordy").unionByName(kept.filter("_wordy").dropDuplicates(["_key"]))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, shorter benchmark passages are cut out of the others."""
    return _renewed(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of at most 1024 tokens."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), end_id=2, capacity=1024)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=1024)


def _row_keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_key``, which tells rows apart that share an id or have none: the id (none comes last) and two hashes of the text."""
    hashes = F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")
    return docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *hashes))


def _renewed(done: DataFrame, docs: DataFrame) -> DataFrame:
    sized = done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
    return sized.select(*docs.columns)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Byte-pair encoding and best-fit packing are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


@suite.query("pipeline", sql=ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
