"""Threshold-scaled document fingerprints.

A fingerprint retains every shingle hash below a fixed fraction of the hash range. Unlike a
sketch of fixed size it grows with the document, so the part of a short document that a very
long one contains can be estimated, and the fingerprint of a union is the union of fingerprints.

As text a fingerprint is ``n.key.hashes``: the number of distinct shingles, a key of the whole
set, and the retained hashes, ascending, six bytes each, in base64.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import column, partitions

#: One hash in SCALE is retained.
SCALE = 8
#: Buckets of neighbouring documents per shuffle partition.
SPREAD = 4


class Fingerprint:
    __slots__ = ("n", "key", "kept")

    def __init__(self, hashes: np.ndarray, scale: int):
        self.n = len(hashes)
        self.key = int(K.mix(K.mix(hashes).sum(keepdims=True) + np.uint64(self.n))[0]) if self.n else 0
        # the six bytes below the top two are as random, and enough to tell hashes apart
        self.kept = np.unique(hashes[hashes < np.uint64((1 << 64) // scale)] & np.uint64((1 << 48) - 1))

    def text(self) -> str:
        raw = self.kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
        return f"{self.n}.{self.key:016x}.{base64.b64encode(raw).decode()}"

    def common(self, other: Fingerprint) -> int:
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True))

    def likeness(self, other: Fingerprint) -> float:
        """Estimated Jaccard similarity. Equal sets are alike even if nothing was retained."""
        if (self.n, self.key) == (other.n, other.key):
            return 1.0
        both = self.common(other)
        return both / union if (union := len(self.kept) + len(other.kept) - both) else 0.0

    def containment(self, other: Fingerprint) -> float:
        """Estimated part of this set that the other one holds."""
        if (self.n, self.key) == (other.n, other.key):
            return 1.0
        return self.common(other) / len(self.kept) if len(self.kept) else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, size: int = K.SHINGLE) -> DataFrame:
    """doc_id, n_shingles and the retained hashes of every row. Null and wordless texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Fingerprint(one, scale) for one in K.shingle_sets(batch.column(1), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.n for f in made], pa.int64()),
                 pa.array([f.kept.view(np.int64) for f in made], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "sketch"])

    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, sketch array<long>")


def containment(part: str | F.Column, whole: str | F.Column) -> F.Column:
    """Estimated part of one sketch's set that another one's holds; null if nothing was retained."""
    part = F.col(part) if isinstance(part, str) else part
    return F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part))


def group_containment(sketches: DataFrame, group_col: str, whole: DataFrame) -> DataFrame:
    """For each group of documents the estimated part of its shingles that occur in ``whole``.

    Sketches merge as sets: distinct hashes per group, by a shuffle, never in one list.
    """
    mine = sketches.select(column(sketches, group_col).alias("grp"), F.explode("sketch").alias("hash")).distinct()
    theirs = whole.select(F.explode("sketch").alias("hash")).distinct().withColumn("there", F.lit(1))
    return mine.join(theirs, "hash", "left").groupBy("grp").agg(
        F.count(F.lit(1)).alias("retained"), (F.count("there") / F.count(F.lit(1))).alias("containment"))


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ("kept_in_edited", pa.float64()), ("kept_in_next", pa.float64())])


def _compare(scale: int, size: int):
    """Rows come by bucket, own rows first, then the row that follows the bucket."""
    def result(pairs: list) -> pa.RecordBatch:
        texts = [_edited(a[2], b[2]) for a, b in pairs]
        sets = K.shingle_sets(pa.array(texts, pa.string()), size)
        rows = []
        for (a, b), text, one in zip(pairs, texts, sets):
            mine, changed, other = a[3], Fingerprint(one, scale), b[3]
            rows.append((
                a[1], len(a[2]), hashlib.sha256(text.encode()).hexdigest(), mine.text(), changed.text(),
                mine.likeness(changed), mine.likeness(other), mine.containment(changed), mine.containment(other)))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], schema=_RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            buckets, copied, ids, texts = (batch.column(i) for i in range(4))
            for a, b, _, _ in K.text_slices(texts):
                part = texts.slice(a, b - a)
                pairs = []
                for bucket, extra, doc, text, one in zip(
                        buckets.slice(a, b - a).to_pylist(), copied.slice(a, b - a).to_pylist(),
                        ids.slice(a, b - a).to_pylist(), part.to_pylist(), K.shingle_sets(part, size)):
                    row = (bucket, doc, text or "", Fingerprint(one, scale))
                    if before is not None and before[0] == bucket:
                        pairs.append((before, row))
                    before = None if extra else row
                if pairs:
                    yield result(pairs)
    return run


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, size: int = K.SHINGLE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document (or all it has), by descending id; the first document follows the last. Null ids come
    last; equal ids follow each other by text. A null text counts as empty. Other columns are not
    read. An empty table gives an empty result; a single row follows itself.

    Ids are cut into buckets of neighbours at quantiles, and the first row of each bucket is also
    sent to the bucket before it: one shuffle, and no order over all rows in one task.
    """
    spark = docs.sparkSession
    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    parts = partitions(spark)
    ids = source.select(F.col("doc_id").cast("double").alias("at"), "doc_id")
    n = parts * SPREAD
    cuts = sorted(set(ids.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n)))) or [0.0]
    split = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="at", outputCol="rising", handleInvalid="keep")
    last = len(cuts) + 1  # null ids get this number; the others count down from it

    def bucketed(df: DataFrame) -> DataFrame:
        rising = F.col("rising").cast("int")
        return split.transform(df).withColumn("bucket", F.when(rising.isNull() | (rising >= last), last).otherwise(len(cuts) - rising)).drop("rising", "at")

    heads = sorted((r.bucket, r.head) for r in bucketed(ids).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return spark.createDataFrame(pa.Table.from_batches([], _RESULT))
    numbers = [b for b, _ in heads]
    before = spark.createDataFrame(pa.table({
        "bucket": pa.array(numbers, pa.int32()), "head": pa.array([h for _, h in heads], pa.int64()),
        "to": pa.array([numbers[i - 1] for i in range(len(numbers))], pa.int32())}))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copied"))
    sent = F.struct(F.col("to").alias("bucket"), F.lit(True).alias("copied"))
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    rows = bucketed(source.withColumn("at", F.col("doc_id").cast("double"))).join(before, "bucket")
    places = F.explode(F.when(is_head, F.array(own, sent)).otherwise(F.array(own)))
    dealt = (
        rows.select(places.alias("place"), "doc_id", "text").select("place.bucket", "place.copied", "doc_id", "text")
        .repartition(parts, "bucket").sortWithinPartitions("bucket", "copied", F.desc_nulls_last("doc_id"), "text")
    )
    schema = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double' if f.type == pa.float64() else 'string'}" for f in _RESULT)
    return dealt.mapInArrow(_compare(scale, size), schema)
