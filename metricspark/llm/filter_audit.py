"""Filter interaction audit: what every filter does at every place of every order of the filters.

A document is the mask of the filters that it fails, with one bit more per label. What happens to
it in all orders depends on the mask alone, so each mask is mapped to one big integer: for every
order and step a field per outcome (kept after the step, removed by it, failing its filter but gone
before, failing its filter only, removed with a label). Fields are wide enough for the count of all
documents, so integers of documents can be added without a carry into the next field: one sum per
part holds all of its counters, and unpacking the bytes of the sum gives the whole audit.

Rows of one part and mask are counted before anything is shuffled; a group that Spark hands to one
task holds at most one row per mask, however many documents the part has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import column, stored

#: Bits of a field. Spark counts rows in 63 bits, so no field can overflow into the next one.
FIELD_BITS = 64
SALTS = 64

# The five conditions under which a document fails.
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_UPPER = 5
SYMBOLS = "#$%&*|"


def filter_orders(filters: str = FILTERS) -> list[str]:
    """All orders of the filters, as strings, ascending."""
    return ["".join(p) for p in permutations(sorted(filters))]


def outcome_names(labels: list[str]) -> list[str]:
    return ["kept", "removed", "redundant", "unique_fails", *[f"{x}_lost" for x in labels]]


def mask_integer(code: int, filters: str = FILTERS, labels: int = 2, field_bits: int = FIELD_BITS) -> int:
    """The outcomes of one document in every order and step; bits of ``code`` are its failing
    filters, those above them its labels. The first order's first step has the lowest fields."""
    orders = np.array([[sorted(filters).index(f) for f in order] for order in filter_orders(filters)])
    fails = np.array([code >> i & 1 for i in range(len(filters))], bool)[orders]
    gone_after = np.logical_or.accumulate(fails, axis=1)
    gone = np.pad(gone_after, ((0, 0), (1, 0)))[:, :-1]
    here = fails & ~gone
    marks = [here & bool(code >> (len(filters) + i) & 1) for i in range(labels)]
    fields = np.stack([~gone_after, here, fails & gone, fails & (fails.sum(axis=1, keepdims=True) == 1), *marks], axis=2).ravel()
    if field_bits == 64:
        return int.from_bytes(fields.astype("<i8").tobytes(), "little")
    return sum(1 << (int(i) * field_bits) for i in np.flatnonzero(fields))


def unpack(total: int, filters: str = FILTERS, labels: int = 2, field_bits: int = FIELD_BITS) -> np.ndarray:
    """counts[order and step, outcome] of a sum of such integers."""
    steps, outcomes = len(filter_orders(filters)) * len(filters), 4 + labels
    if total >> (steps * outcomes * field_bits):
        raise OverflowError("a sum of mask integers outgrew its fields")
    if field_bits == 64:
        data = total.to_bytes(steps * outcomes * 8, "little")
        return np.frombuffer(data, "<i8").reshape(steps, outcomes)
    cell = (1 << field_bits) - 1
    flat = [total >> (i * field_bits) & cell for i in range(steps * outcomes)]
    return np.array(flat, np.int64).reshape(steps, outcomes)


def audit(codes: DataFrame, filters: str = FILTERS, labels: list[str] = ("good", "toxic")) -> DataFrame:
    """The audit of rows (part, code): part, filter_order, step, the outcomes and shapley.

    ``filter_order`` lists the filters in the order applied, ``step`` counts from 1. All orders and
    steps of every part that has rows are there, zeros included; ``shapley`` is what the step's
    filter removes, summed over all orders. Rows without a code are left out.
    """
    letters, names = "".join(sorted(filters)), outcome_names(list(labels))
    places = [(order, step, order[step - 1]) for order in filter_orders(letters) for step in range(1, len(letters) + 1)]
    counted = codes.filter("code IS NOT NULL").groupBy("part", "code").agg(F.count(F.lit(1)).alias("n"))

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = sum(int(n) * mask_integer(int(code), letters, len(labels)) for code, n in zip(pdf["code"], pdf["n"]))
        counts = unpack(packed, letters, len(labels))
        out = pd.DataFrame(places, columns=["filter_order", "step", "filter"])
        out.insert(0, "part", pdf["part"].iloc[0])
        for i, name in enumerate(names):
            out[name] = counts[:, i]
        out["shapley"] = out.groupby("filter")["removed"].transform("sum")
        return out.drop(columns="filter")

    fields = "".join(f", {x} long" for x in (*names, "shapley"))
    return counted.groupBy("part").applyInPandas(total, f"part string, filter_order string, step int{fields}")


def _text_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, part, digest, mask): which of the filters A to D each text fails, counted over its bytes."""
    byte = np.arange(256)
    upper, symbol = (byte >= 65) & (byte <= 90), np.isin(byte, [ord(x) for x in SYMBOLS])
    for batch in batches:
        for a, b, data, offsets in K.text_slices(batch.column(2), 1 << 20):
            starts, ends, counts = K.words(data, offsets)
            doc = np.repeat(np.arange(b - a), counts)
            keys = K.mix(K.word_hashes(data, starts, ends, fold=False) + K.mix(doc.astype(np.uint64)))
            _, first = np.unique(keys, return_index=True)
            distinct = np.bincount(doc[first], minlength=b - a)
            uppers, symbols = (np.diff(np.concatenate(([0], np.cumsum(x[data])))[offsets]) for x in (upper, symbol))
            fails = (counts < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * counts,
                     100 * uppers > MOST_UPPER * K.char_counts(data, offsets), symbols > 0)
            mask = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
            digests = [hashlib.sha256(data[x:y]).digest() for x, y in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(digests, pa.binary()), pa.array(mask, pa.int32())],
                names=["doc_id", "part", "digest", "mask"])


def failure_codes(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, code) of every document: bits 0 to 4 for the filters A to E that it fails, bit 5 for
    quality 1, bit 6 for toxic 1.

    Null texts count as empty, null parts as empty strings. A document without id has no labels and
    no smaller id, so it does not fail E. Rows that repeat id and text are no copies of each other:
    E asks for a smaller id. Several label rows of one id count together: a label is set if any of
    them sets it. An empty table gives an empty result.
    """
    rows = docs.select(
        column(docs, id_col).cast("long").alias("doc_id"), F.coalesce(column(docs, part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(column(docs, text_col).cast("string"), F.lit("")).alias("text"))
    masks = stored(rows.mapInArrow(_text_masks, "doc_id long, part string, digest binary, mask int"))

    def bit(fails: F.Column, place: int) -> F.Column:
        return F.when(fails, F.lit(1 << place)).otherwise(F.lit(0))

    # A text's smallest id is met by (text, id), which no two documents share: groups of copies never meet in one task.
    firsts = masks.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = masks.join(firsts, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    # Rows without id match no label; they are dealt out by their texts instead of to one task.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    coded = known.select("doc_id", "part", (F.col("mask") + bit(copy, 4)).alias("mask"), salt.alias("salt"))
    marks = labels.select(column(labels, "doc_id").cast("long").alias("doc_id"), column(labels, "quality").alias("quality"), column(labels, "toxic").alias("toxic"))
    marked = marks.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(bit(F.col("quality") == 1, 5)).alias("good"), F.max(bit(F.col("toxic") == 1, 6)).alias("bad")).withColumn("salt", F.lit(0).cast("long"))
    return coded.join(marked, ["doc_id", "salt"], "left").select(
        "part", (F.col("mask") + F.coalesce("good", F.lit(0)) + F.coalesce("bad", F.lit(0))).cast("int").alias("code"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_codes(docs, labels))


def oracle() -> str:
    """The same rows in DuckDB, with every document group taken through every order."""
    return r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), facts AS (
  SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT part,
    CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN facts.doc_id > first_id THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM facts LEFT JOIN marks ON facts.doc_id = marks.doc_id
), grouped AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM failing GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders
), placed AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM steps
), outcomes AS (
  SELECT part, filter_order, step, f, n, good, toxic, fails, contains(fails, f) AS failing,
    length(translate(before, fails, '')) < length(before) AS gone
  FROM grouped, placed
), summed AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN NOT gone AND failing AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN NOT gone AND failing AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM outcomes GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""
