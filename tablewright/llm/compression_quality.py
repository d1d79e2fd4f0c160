"""Text quality from two compressors, one primed with good and one with bad labelled text.

A zstandard dictionary is built from blocks of each class.  A text is cut into blocks, every block is compressed with both
dictionaries, and the difference of the two sizes over the text's own size says which class it resembles:
what looks like good text gets smaller with the good dictionary.  A logistic curve, fitted on labelled documents that
gave no block to a dictionary, turns the difference into a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tablewright.llm.text import raw_texts, slices, without

#: Bytes compressed at once; short enough for the dictionary to matter in the whole of a long text.
BLOCK = 2048
#: The fitted sample: at most so many labelled documents a class, half for the dictionary and half for the curve,
#: and of the first half at most so many blocks.
DOCUMENTS, BLOCKS = 4096, 2048
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
MADE = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("good_bytes", T.LongType()),
        T.StructField("bad_bytes", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


@dataclass
class Model:
    """Dictionaries as (bytes, trained or plain content), by class; score = 1 / (1 + exp(-(slope * difference + offset)))."""

    dictionaries: dict[int, tuple[bytes, bool]]
    slope: float
    offset: float

    def scores(self, n_bytes: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        difference = (bad - good) / np.maximum(n_bytes, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.offset, -700, 700)))


class Sizer:
    """Compressed sizes of whole texts under each dictionary."""

    def __init__(self, dictionaries: dict[int, tuple[bytes, bool]]):
        kind = {True: zstandard.DICT_TYPE_FULLDICT, False: zstandard.DICT_TYPE_RAWCONTENT}
        self.compressors = []
        for label in (1, 0):
            raw, trained = dictionaries[label]
            primed = zstandard.ZstdCompressionDict(raw, dict_type=kind[trained])
            primed.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def sizes(self, raw: bytes) -> tuple[int, int]:
        blocks = list(cut(raw))
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self.compressors)
        return good, bad


def cut(raw: bytes) -> Iterator[bytes]:
    for start in range(0, len(raw), BLOCK):
        yield raw[start : start + BLOCK]


def build_dictionary(blocks: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or the blocks themselves where there is too little text to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=64, d=8).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:], False


def fit_curve(difference: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic curve, with targets drawn in by one row a class so that it stays finite."""
    ones, zeros = float((label == 1).sum()), float((label == 0).sum())
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    spread = float(difference.std()) or 1.0
    x = np.column_stack([difference / spread, np.ones(len(difference))])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-6 * beta
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] / spread), float(beta[1])


def _chosen(docs: DataFrame, labels: DataFrame, train: Column, id_column: str, text: str, label: str) -> DataFrame:
    """(id, label, for_dictionary, for_curve) of at most ``DOCUMENTS`` documents a class: the smallest hash of each slot."""
    with_text = docs.filter(F.octet_length(F.col(text)) > 0).select(F.col(id_column).alias("_id")).distinct()
    usable = labels.filter(train & F.col(label).isin(0, 1)).select(F.col(id_column).alias("_id"), F.col(label).cast("int").alias("_label"))
    mark = F.xxhash64(F.col("_id").cast("string"))
    slots = (
        usable.join(with_text, "_id")
        .groupBy("_label", F.pmod(mark, F.lit(DOCUMENTS)).alias("_slot"))
        .agg(F.min(F.struct(F.xxhash64(mark).alias("h"), F.col("_id").alias("_id"))).alias("x"))
    )
    place, class_rows = W.partitionBy("_label").orderBy("x.h", "x._id"), W.partitionBy("_label")
    ranked = slots.select("_label", "x._id", F.row_number().over(place).alias("r"), F.count("*").over(class_rows).alias("of"))
    return ranked.select("_id", "_label", (F.col("r") % 2 == 1).alias("_for_dictionary"), ((F.col("r") % 2 == 0) | (F.col("of") == 1)).alias("_for_curve"))


def train_model(docs: DataFrame, labels: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """Fit on a bounded sample of the labelled rows where ``train`` (over the columns of ``labels``) holds.

    Labels other than 0 and 1, labels without a document that has text, and null ids teach nothing.  Without text of both
    classes there is no model (None).  An id with several labels or rows may serve each of them.
    """
    chosen = _chosen(docs, labels, train, id_column, text, label)
    sample = (
        docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text"))
        .filter(F.octet_length("_text") > 0)
        .join(F.broadcast(chosen), "_id")  # bounded: DOCUMENTS rows a class
    )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[int, bytes]] = {}
        for batch in slices(batches):
            for kind, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                for block in cut(raw):
                    crc = zlib.crc32(block)
                    key, found = (kind, crc % BLOCKS), (crc // BLOCKS, block)
                    if key not in best or found < best[key]:
                        best[key] = found
        labels_, slots_ = [k for k, _ in best], [s for _, s in best]
        order, block = [o for o, _ in best.values()], [b for _, b in best.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels_, pa.int32()), pa.array(slots_, pa.int32()), pa.array(order, pa.int64()), pa.array(block, pa.binary())],
            ["label", "slot", "place", "block"],
        )

    picked = (
        sample.filter("_for_dictionary")
        .select("_label", "_text")
        .mapInArrow(pick, "label int, slot int, place long, block binary")
        .groupBy("label", "slot")
        .agg(F.min(F.struct("place", "block")).alias("x"))
        .select("label", "slot", "x.block")
        .collect()  # bounded: BLOCKS blocks a class
    )
    blocks: dict[int, list[bytes]] = {}
    for r in sorted(picked, key=lambda r: r["slot"]):
        blocks.setdefault(r["label"], []).append(bytes(r["block"]))
    if len(blocks) < 2:
        return None
    dictionaries = {kind: build_dictionary(found) for kind, found in blocks.items()}
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(shared.value)
        for batch in slices(batches):
            found = [(len(raw), *sizer.sizes(raw)) for raw in raw_texts(batch.column(2))]
            difference = [(bad - good) / n for n, good, bad in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(difference, pa.float64())], ["_label", "_id", "d"])

    kinds = T.StructType([T.StructField("_label", T.IntegerType()), sample.schema["_id"], T.StructField("d", T.DoubleType())])
    measured = (
        sample.filter("_for_curve").select("_label", "_id", "_text").mapInArrow(measure, kinds)
        .groupBy("_label", "_id").agg(F.min("d").alias("d")).collect()  # bounded: half of DOCUMENTS a class
    )
    totals = dict(labels.filter(train & F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    label_of = np.array([r["_label"] for r in measured])
    difference = np.array([r["d"] for r in measured])[np.lexsort(([r["d"] for r in measured], label_of))]
    label_of = np.sort(label_of)
    weight = np.array([totals[k] / (label_of == k).sum() for k in label_of.tolist()])  # the sample evens the classes out
    return Model(dictionaries, *fit_curve(difference, label_of, weight / weight.mean()))


def score_texts(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, plus ``n_bytes``, ``good_bytes``, ``bad_bytes`` and ``score`` (0 to 1; higher: label 1 likelier).

    Whole texts count, however long.  Null and empty texts have no bytes and get the score of a text that both
    dictionaries shorten alike; without a model every score is 0.5.  Equal texts score alike.  No rows give no
    rows.  Columns of ``docs`` that are named like a result are left out.
    """
    kept = without(docs.drop(text), MADE.fieldNames())
    names = kept.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sizer = Sizer(known.dictionaries) if known else None
        for batch in slices(batches):
            raws = raw_texts(batch.column(len(names)))
            n = np.array([len(raw) for raw in raws], np.int64)
            found = np.array([sizer.sizes(raw) if sizer else (0, 0) for raw in raws], np.int64).reshape(-1, 2)
            score = known.scores(n, found[:, 0], found[:, 1]) if known else np.full(len(n), 0.5)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(score)], [*names, *MADE.fieldNames()]
            )

    schema = T.StructType([*kept.schema.fields, *MADE.fields])
    return docs.select(*names, docs[text].alias("_raw")).mapInArrow(run, schema)
