"""Mixing sources to target weights by Pareto order sampling.

Every document is expected in e copies: the ratio r of its source's target to its source's size,
tilted a little towards longer documents so that the expected words stay exactly the target. The
whole copies floor(e) are certain. The rest, pi = e - floor(e), is an inclusion probability:
documents are ranked by random odds over inclusion odds, u / (1 - u) : pi / (1 - pi), and the
first ones are taken until the words still due are reached as nearly as whole documents allow.
The size is thus fixed, in words, and inclusion is unequal.

The cut through the ranking is found with a histogram of ranks per source and then inside the
one bin that holds it, so no source is ever gathered in one task. Random numbers are hashes of
ids and all sums are of whole numbers: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from . import kernels as K
from .tables import column, stored

#: Rank bins per source for the first look; the second look is at one bin of each source.
BINS = 1 << 12
_SCALE = 1 << 20


def word_counts(docs: DataFrame, text_col: str, name: str, keep_text: bool = True) -> DataFrame:
    """The rows with the number of words of the text added as ``name``; null has none."""
    at = docs.columns.index(text_col)
    fields = [f for i, f in enumerate(docs.schema.fields) if keep_text or i != at]
    schema = StructType(fields).add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [K.words(data, offsets)[2] for _, _, data, offsets in K.text_slices(batch.column(at), K.SMALL_SLICE_BYTES)]
            sizes = pa.concat_arrays([pa.array(c, pa.int64()) for c in counts] or [pa.array([], pa.int64())])
            kept = [i for i in range(batch.num_columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [sizes], names=[batch.schema.field(i).name for i in kept] + [name])

    return docs.mapInArrow(run, schema)


def _source_key(source: F.Column) -> F.Column:
    """Orders by code point, null last, and joins null with null."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source.cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """key, source_size, target, typical (words a document, 1 at least) of every source, from
    (key, words, docs) with one row a source.

    Water filling in closed form: sources in order of cap per weight are capped as long as the
    share that is left for them reaches their cap; the others share the rest by weight.
    """
    order = W.orderBy("key")
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    rows = sizes.select("key", "docs", F.col("words").cast("double").alias("words"), weight.alias("weight"), (F.col("words") * float(most)).alias("cap"))
    everything = W.partitionBy(F.lit(1))
    before = W.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.sum("words").over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    levels = rows.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    share = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "key", "level"))).over(everything)
    typical = F.floor(F.sum("words").over(everything) / F.sum("docs").over(everything))
    return levels.select(
        "key", F.greatest(typical, F.lit(1)).cast("long").alias("typical"), F.col("words").cast("long").alias("source_size"),
        F.when(F.col("full"), F.col("cap")).otherwise(share["level"] * F.col("weight")).alias("target"))


class Mix:
    """What decides every document's copies: a row for each source, found from all documents."""

    def __init__(self, sizes: DataFrame, weights: tuple[int, ...], most: int, seed: int):
        """sizes: (key, doc_id, size) of all documents; read several times, so stored."""
        self.most, self.seed = most, seed
        sizes = stored(sizes)
        facts = sizes.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        targets = stored(source_targets(facts, weights, most))
        tilted = sizes.join(targets, "key").groupBy("key").agg(
            F.sum((self._tilt() * F.col("size")).cast("decimal(38,0)")).alias("tilts"))
        ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        self.sources = stored(targets.join(tilted, "key").select(
            "key", "source_size", "target", "typical", ratio.alias("ratio"),
            F.when(F.col("source_size") > 0, F.col("tilts").cast("double") / F.col("source_size")).otherwise(0.0).alias("middle")))
        ranked = sizes.join(self.sources, "key").select("key", "doc_id", "size", self._whole().alias("whole"), self._rank().alias("rank"))
        bins = stored(ranked.groupBy("key", F.floor(F.coalesce("rank", F.lit(2.0)) * BINS).alias("bin")).agg(
            F.sum(F.col("whole") * F.col("size")).alias("sure"), F.sum(F.when(F.col("rank").isNotNull(), F.col("size")).otherwise(0)).alias("words")))
        due = self.sources.join(bins.groupBy("key").agg(F.sum("sure").alias("sure")), "key").select(
            "key", F.greatest(F.lit(0.0), F.col("target") - F.col("sure")).alias("due"))
        up_to = W.partitionBy("key").orderBy("bin")
        crossed = (
            bins.withColumn("upto", F.sum("words").over(up_to)).join(due, "key")
            .filter((F.col("upto") >= F.col("due")) & (F.col("bin") <= BINS))
            .groupBy("key").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("below"), "due")).alias("x"))
            .select("key", F.col("x.bin").alias("bin"), F.col("x.below").alias("below"), F.col("x.due").alias("due"))
        )
        # inside the bin: the last document taken is the one after which the words are nearest
        line = W.partitionBy("key").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size")
        inside = (
            ranked.filter("rank IS NOT NULL").withColumn("bin", F.floor(F.col("rank") * BINS)).join(crossed, ["key", "bin"])
            .withColumn("upto", F.col("below") + F.sum("size").over(line.rowsBetween(W.unboundedPreceding, 0)))
            .filter(F.abs(F.col("upto") - F.col("due")) <= F.abs(F.col("upto") - F.col("size") - F.col("due")))
            .groupBy("key").agg(F.max(F.struct("rank", "doc_id", "size")).alias("last"))
        )
        starts = crossed.join(inside, "key", "left").select("key", (F.col("bin") / BINS).alias("from"), "last")
        self.plan = stored(self.sources.join(starts, "key", "left"))

    def _tilt(self) -> F.Column:
        """Between 0 and 2**20, half of that for a document of typical size."""
        return F.floor(F.col("size") * F.lit(_SCALE) / (F.col("size") + F.col("typical")))

    def _expected(self) -> F.Column:
        room = F.least(F.col("ratio"), F.lit(float(self.most)) - F.col("ratio")) / 2
        copies = F.col("ratio") + room * (self._tilt() - F.col("middle")) / _SCALE
        return F.when(F.col("size") > 0, F.greatest(F.lit(0.0), F.least(copies, F.lit(float(self.most))))).otherwise(0.0)

    def _whole(self) -> F.Column:
        return F.floor(self._expected()).cast("long")

    def _rank(self) -> F.Column:
        """u(1-pi) / (u(1-pi) + pi(1-u)): rises with the ratio of the odds and lies between 0 and 1."""
        part = self._expected() - F.floor(self._expected())
        u = (F.pmod(F.xxhash64(F.lit(self.seed), F.col("doc_id"), F.col("size")), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
        return F.when(part > 0, u * (1 - part) / (u * (1 - part) + part * (1 - u)))

    def copies(self, sized: DataFrame) -> DataFrame:
        """Adds source_size, target and copies to rows that have key, doc_id and size."""
        rows = sized.join(self.plan, "key", "left")
        here = F.struct(self._rank().alias("rank"), F.col("doc_id"), F.col("size"))
        taken = (
            F.when(self._rank().isNull(), False).when(F.col("from").isNull(), F.col("target") > 0)  # all of them are due
            .when(F.col("last").isNull(), self._rank() < F.col("from")).otherwise(here <= F.col("last"))
        )
        return rows.withColumn("copies", self._whole() + F.coalesce(taken, F.lit(False)).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row.

    Sources by code point, null last, weigh ``weights`` in turn; targets share all words and stop
    at ``most`` times a source's words. A null or wordless text has size 0 and is not taken. Rows
    that repeat in id and size are alike and ranked next to each other. An empty table gives an
    empty result; a corpus without words has targets of 0. Other columns are not read.
    """
    source = docs.select(
        column(docs, id_col).cast("long").alias("doc_id"), _source_key(column(docs, source_col)).alias("key"),
        column(docs, text_col).alias("text"))
    sized = stored(word_counts(source, "text", "size", keep_text=False))
    mix = Mix(sized, weights, most, seed)
    return mix.copies(sized).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, each as often as it is taken."""
    source = docs.select(
        column(docs, id_col).cast("long").alias("doc_id"), _source_key(column(docs, source_col)).alias("key"),
        column(docs, text_col).alias("text"))
    mix = Mix(word_counts(source, "text", "size", keep_text=False), weights, most, seed)
    row = F.struct(*[column(docs, c) for c in docs.columns]).alias("row")
    packed = docs.select(
        row, column(docs, id_col).cast("long").alias("doc_id"), _source_key(column(docs, source_col)).alias("key"),
        column(docs, text_col).alias("text"))
    sized = word_counts(packed, "text", "size", keep_text=False)
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mix.copies(sized).filter("copies > 0").select("row", again.alias("copy")).select("row.*")
