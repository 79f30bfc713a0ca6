"""Ranked lexical search with bit-sliced Bloom signatures.

1. One pass over the texts makes the index. Documents with about as many distinct terms form a
   block; a block is a matrix of bits with one column per document and as many rows as the band of
   sizes asks for. A term sets a few rows of its document's column, once for being there and once more for
   each level of frequency that it reaches (2, 3, 4, 6, 9 times and so on). Stored by rows, a query
   term needs only its own rows: their AND is a bitmap of the documents that may hold it so often.
   Bitmaps overestimate and never miss. The pass also counts documents per term, for terms that
   some item may hold.
2. For an item, the weights of its terms are summed over the bitmaps of each level. What a level is
   worth at most depends on the length of the document and its most frequent term, so the sums give
   an upper bound of the score. Every task keeps each item's documents with
   the highest bounds; the best of all are scored from their texts. The k-th score found so is a
   safe cutoff.
3. All documents whose bound reaches the cutoff are scored from their texts. What stays behind is
   proven to score less.

Items come in chunks of bounded size, which is what tasks get to see at once; the index is made once
for all chunks. Terms are compared by 64-bit hashes. Scores are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import kernels as K
from .tables import column, stored

# Fixed values of the score.
LENGTH_SHARE = 75
TF_SCALE = 1_000_000_000
#: The least count of a term on a level of the signature is by this much above that of the level before, and by 1 at least.
LEVEL_STEP = 1.5
#: Rows of bits per term of the largest document of a band, and rows that one term sets.
BITS_PER_TERM = 20
HASHES = 8
#: A band's documents have at most this many times the terms of its smallest one.
BAND = 1.3
BLOCK = 1024
BLOCK_TERMS = 1 << 19
#: Distinct terms per item, summed, that one chunk of items holds at most (or one item, if it has more).
CHUNK_TERMS = 1 << 18
MAP_BITS = 1 << 22
#: Tasks that share the ranking of one item.
DEALS = 32
SLICE = 1 << 20

_INDEX = ("ids binary, keys binary, lengths binary, most binary, rows int, width int, bits binary, held long, words long, "
          "terms binary, counts binary")


def _separators() -> np.ndarray:
    """Bytes outside terms: all of ASCII but digits and letters."""
    byte = np.arange(256)
    digit, letter = (byte >= 48) & (byte <= 57), ((byte | 32) >= 97) & ((byte | 32) <= 122)
    return (byte < 128) & ~(digit | letter)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term hash and count of each distinct term of each text, by text and hash; and all terms per text."""
    starts, ends, lengths = K.words(data, offsets, _separators())
    hashes = K.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), lengths)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(fresh)
    return doc[at], hashes[at], np.diff(np.append(at, len(doc))), lengths


def signature_rows(hashes: np.ndarray, level: int, rows: int) -> np.ndarray:
    """The rows that each term sets at a level."""
    h = K.mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    spread = [((low + np.uint64(i) * high) & np.uint64(0xFFFFFFFF)) * np.uint64(rows) >> np.uint64(32) for i in range(HASHES)]
    return np.stack(spread, axis=1).astype(np.int64)


def levels(most: int) -> list[int]:
    """Least counts of all levels that a term can reach which is there ``most`` times."""
    out = [1]
    while (after := max(out[-1] + 1, int(out[-1] * LEVEL_STEP))) <= most:
        out.append(after)
    return out


def band_rows(terms: int) -> tuple[int, int]:
    """Band of a document with so many entries, and rows of bits of the band's blocks."""
    band = max(0, math.ceil(math.log(max(terms, 1)) / math.log(BAND) - 1e-9))
    return band, max(64, math.ceil(BITS_PER_TERM * BAND**band))


@dataclass
class _Block:
    """Documents of one band that wait for their block to be full."""

    rows: int
    ids: list
    keys: list
    lengths: list
    most: list
    terms: list
    counts: list
    size: int = 0

    def row(self) -> dict:
        n = len(self.ids)
        doc = np.repeat(np.arange(n), [len(t) for t in self.terms])
        terms, counts = np.concatenate(self.terms), np.concatenate(self.counts)
        cells = np.zeros((self.rows, n), bool)
        for level, least in enumerate(levels(max(self.most))):
            here = counts >= least
            cells[signature_rows(terms[here], level, self.rows), doc[here, None]] = True
        known = np.array([i is not None for i in self.ids])
        ids = np.where(known, [i or 0 for i in self.ids], 0).astype(np.int64)
        return {"ids": ids.tobytes(), "keys": np.array(self.keys, np.int64).tobytes(), "lengths": np.array(self.lengths, np.int64).tobytes(),
                "most": np.array(self.most, np.int64).tobytes(), "rows": self.rows, "width": n, "bits": np.packbits(cells, axis=1).tobytes(),
                "held": n, "words": int(np.sum(self.lengths))}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}
    fields = [f.split() for f in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _build(wanted: np.ndarray):
    """Blocks of documents; and in other rows, how many documents hold each term of the bit map."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, steps = wanted.value, np.array(levels(1 << 40))
        open_blocks: dict[int, _Block] = {}
        waiting = 0
        found: list[np.ndarray] = []
        found_size = 0

        def frequencies() -> pa.RecordBatch:
            terms, counts = np.unique(np.concatenate(found), return_counts=True)
            return _batch([{"terms": terms.tobytes(), "counts": counts.astype(np.int64).tobytes()}])

        for batch in batches:
            for a, b, data, offsets in K.text_slices(batch.column(2), SLICE):
                ids, keys = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                doc, terms, counts, lengths = term_counts(data, offsets)
                some = terms[bits[(terms % np.uint64(MAP_BITS)).astype(np.int64)]]
                found.append(some)
                found_size += len(some)
                bounds = np.searchsorted(doc, np.arange(b - a + 1))
                for i in np.flatnonzero(lengths).tolist():
                    own = slice(bounds[i], bounds[i + 1])
                    tf = counts[own]
                    entries = int(np.searchsorted(steps, tf, side="right").sum())
                    band, rows = band_rows(entries)
                    block = open_blocks.setdefault(band, _Block(rows, [], [], [], [], [], []))
                    for held, value in zip((block.ids, block.keys, block.lengths, block.most, block.terms, block.counts),
                                           (ids[i], keys[i], int(lengths[i]), int(tf.max()), terms[own], tf)):
                        held.append(value)
                    block.size += len(tf)
                    waiting += len(tf)
                    if len(block.ids) >= BLOCK or block.size >= BLOCK_TERMS:
                        waiting -= block.size
                        yield _batch([open_blocks.pop(band).row()])
                    elif waiting >= 4 * BLOCK_TERMS:  # many half-full bands: the fullest goes
                        fullest = max(open_blocks, key=lambda x: open_blocks[x].size)
                        waiting -= open_blocks[fullest].size
                        yield _batch([open_blocks.pop(fullest).row()])
                if found_size > 1 << 20:
                    yield frequencies()
                    found, found_size = [], 0
        for block in open_blocks.values():
            yield _batch([block.row()])
        if found_size:
            yield frequencies()
    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.text_slices(batch.column(1), SLICE):
            doc, terms, counts, _ = term_counts(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(terms.view(np.int64)), pa.array(counts.astype(np.int64))],
                names=["item", "term", "times"])


def _frequency_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(counts, np.int64))], names=["term", "df"])


def _bit_map(terms: DataFrame) -> np.ndarray:
    """Which remainders of term hashes occur: a map of fixed size, however many terms there are."""
    # Remainders of unsigned hashes: MAP_BITS is a power of two, so they are the low bits.
    place = F.col("term").bitwiseAND(F.lit(MAP_BITS - 1).cast("long")) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(MAP_BITS, bool)
    for row in rows:
        bits = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        at = (row.part - 1) * len(bits)
        out[at:at + len(bits)] = bits[:MAP_BITS - at]
    return out


@dataclass(frozen=True)
class Scoring:
    """Statistics of the whole corpus and what follows from them."""

    documents: int
    words: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def length_factor(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * lengths * self.documents // self.words

    @staticmethod
    def share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return TF_SCALE * tf // (1000 * tf + 8 * m)


@dataclass(frozen=True)
class Chunk:
    """Some items: their distinct terms ascending, and per item a run of (term place, weight times count)."""

    items: np.ndarray
    terms: np.ndarray
    begins: np.ndarray
    places: np.ndarray
    weights: np.ndarray


def make_chunk(rows: list, scoring: Scoring) -> Chunk:
    """From rows (item, term, times, df). Terms that no document holds, or of weight 0, score nothing and go."""
    kept = sorted((r.item, r.term, r.times * w) for r in rows if r.df and (w := scoring.weight(r.df)))
    items = np.unique(np.array([k[0] for k in kept], np.int64))
    hashes = np.array([k[1] for k in kept], np.int64).view(np.uint64)
    terms, places = np.unique(hashes, return_inverse=True)
    begins = np.searchsorted(np.array([k[0] for k in kept], np.int64), items)
    return Chunk(items, terms, begins, places, np.array([k[2] for k in kept], np.int64))


def upper_bounds(chunk: Chunk, scoring: Scoring, block: dict) -> np.ndarray:
    """bounds[item, document]: no score of the block's documents is above its bound."""
    width, rows = block["width"], block["rows"]
    bits = np.frombuffer(block["bits"], np.uint8).reshape(rows, -1)
    lengths, most = np.frombuffer(block["lengths"], np.int64), np.frombuffer(block["most"], np.int64)
    m = scoring.length_factor(lengths)
    steps = levels(int(most.max()))
    # At most this often a term stands in a document that is on a level and on none above it.
    tops = [np.minimum(most, after - 1) for after in steps[1:]] + [most]
    out = np.zeros((len(chunk.items), width), np.int64)
    places, weights, begins = chunk.places, chunk.weights, chunk.begins
    alive, worth = np.arange(len(chunk.terms)), 0
    present = np.full((len(alive), bits.shape[1]), 255, np.uint8)
    item_of = np.repeat(np.arange(len(chunk.items)), np.diff(np.append(begins, len(places))))
    for level, top in enumerate(tops):
        at = signature_rows(chunk.terms[alive], level, rows)
        present &= np.bitwise_and.reduce(bits[at], axis=1)  # more often is also once
        kept = present.any(axis=1)
        new_place = np.cumsum(kept) - 1
        on = kept[places]
        places, weights, item_of = new_place[places[on]], weights[on], item_of[on]
        alive, present = alive[kept], present[kept]
        if not len(places):
            break
        share = scoring.share(np.maximum(top, 1), m)
        flags = np.unpackbits(present, axis=1, count=width)
        sums = np.zeros_like(out)
        for a in range(0, len(places), step := max(1, (1 << 22) // width)):
            own = item_of[a:a + step]
            heads = np.flatnonzero(np.diff(own, prepend=-1))
            sums[own[heads]] += np.add.reduceat(flags[places[a:a + step]] * weights[a:a + step, None], heads, axis=0)
        out += sums * (share - worth)
        worth = share
    return out


def _highest(sent, k: int):
    """Per task the k documents with the highest bounds of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, scoring = Chunk(*sent.value[0]), Scoring(*sent.value[1])
        n = len(chunk.items)
        keys, bounds = np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                new = upper_bounds(chunk, scoring, block)
                if new.shape[1] > k:
                    at = np.argpartition(-new, k - 1, axis=1)[:, :k]
                else:
                    at = np.tile(np.arange(new.shape[1]), (n, 1))
                keys = np.hstack((keys, np.frombuffer(block["keys"], np.int64)[at]))
                bounds = np.hstack((bounds, np.take_along_axis(new, at, axis=1)))
                if bounds.shape[1] > k:
                    at = np.argpartition(-bounds, k - 1, axis=1)[:, :k]
                    keys, bounds = np.take_along_axis(keys, at, axis=1), np.take_along_axis(bounds, at, axis=1)
        row, place = np.nonzero(bounds > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.items[row]), pa.array(keys[row, place]), pa.array(bounds[row, place])], names=["item", "key", "bound"])
    return run


def _reaching(sent):
    """(item, key) of every document whose bound reaches the item's cutoff."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, scoring, cutoffs = Chunk(*sent.value[0]), Scoring(*sent.value[1]), sent.value[2]
        for batch in batches:
            for block in batch.to_pylist():
                row, place = np.nonzero(upper_bounds(chunk, scoring, block) >= cutoffs[:, None])
                keys = np.frombuffer(block["keys"], np.int64)[place]
                yield pa.RecordBatch.from_arrays([pa.array(chunk.items[row]), pa.array(keys)], names=["item", "key"])
    return run


def _exact(sent):
    """(item, doc_id, score) from whole texts, for the items listed with each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, scoring = Chunk(*sent.value[0]), Scoring(*sent.value[1])
        ends = np.append(chunk.begins[1:], len(chunk.places))
        for batch in batches:
            for a, b, data, offsets in K.text_slices(batch.column(1), SLICE):
                doc, terms, counts, lengths = term_counts(data, offsets)
                bounds = np.searchsorted(doc, np.arange(b - a + 1))
                for i, items in enumerate(batch.column(2).slice(a, b - a)):
                    own, tf = terms[bounds[i]:bounds[i + 1]], counts[bounds[i]:bounds[i + 1]]
                    places = np.searchsorted(chunk.items, np.sort(np.array(items.as_py(), np.int64)))
                    if not len(own):
                        continue
                    at = np.minimum(np.searchsorted(own, chunk.terms), len(own) - 1)
                    share = np.where(own[at] == chunk.terms, scoring.share(tf[at], scoring.length_factor(lengths[i:i + 1])), 0)
                    runs = [slice(chunk.begins[p], ends[p]) for p in places]
                    scores = np.array([(chunk.weights[r] * share[chunk.places[r]]).sum() for r in runs], np.int64)
                    some = scores > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(chunk.items[places[some]]), pa.array([batch.column(0)[a + i].as_py()] * int(some.sum()), pa.int64()), pa.array(scores[some])],
                        names=["item", "doc_id", "score"])
    return run


def _scored(texts: DataFrame, pairs: DataFrame, sent) -> DataFrame:
    """Exact scores of candidate pairs (item, key). Only texts of candidates leave the scan."""
    asked = stored(pairs.groupBy("key").agg(F.collect_set("item").alias("items")))  # as many as a chunk has items at most
    joined = texts.join(asked, "key").select("doc_id", "text", "items")
    return joined.mapInArrow(_exact(sent), "item long, doc_id long, score long")


def _leading(rows: DataFrame, k: int, *order: F.Column) -> DataFrame:
    """The k first rows of every item and their rank. The rows of an item are dealt to several tasks
    first, so that the last one reads k rows from each of them and not from every task before."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "item"]), F.lit(DEALS)))
    some = dealt.withColumn("rank", F.row_number().over(W.partitionBy("item", "deal").orderBy(*order))).filter(F.col("rank") <= k)
    return some.drop("deal").withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    return _leading(scores, k, F.desc("score"), F.asc_nulls_last("doc_id"))


def _search_chunk(spark: SparkSession, index: DataFrame, texts: DataFrame, rows: list, scoring: Scoring, k: int) -> DataFrame | None:
    chunk = make_chunk(rows, scoring)
    if not len(chunk.items):
        return None
    # As large as one chunk of items; plain values, since executors need not have this package.
    plain = (tuple(vars(chunk).values()), tuple(vars(scoring).values()))
    sent = spark.sparkContext.broadcast(plain)
    blocks = index.filter("width IS NOT NULL").select("keys", "lengths", "most", "rows", "width", "bits")
    highest = blocks.mapInArrow(_highest(sent, k), "item long, key long, bound long")
    first = _leading(highest, k, F.desc("bound"), F.col("key")).select("item", "key").distinct()
    reached = _ranked(_scored(texts, first, sent), k).filter(F.col("rank") == k).select("item", "score").collect()  # one row per item of the chunk
    cutoffs = np.ones(len(chunk.items), np.int64)
    cutoffs[np.searchsorted(chunk.items, [r.item for r in reached])] = [r.score for r in reached]
    again = spark.sparkContext.broadcast((*plain, cutoffs))
    left = blocks.mapInArrow(_reaching(again), "item long, key long").distinct()
    out = stored(_ranked(_scored(texts, left, sent), k))
    again.unpersist()
    sent.unpersist()
    return out


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", chunk_terms: int = CHUNK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item with scores above 0, all if there are fewer.

    Equal scores go by ascending id, null ids last. Null texts and texts without terms hold nothing
    and are not counted. Rows that repeat an id are documents of their own, and so are repeated rows.
    Items that repeat id and text are one item; an id with several texts is ranked for each of them.
    Empty tables give an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(column(docs, doc_col).cast("long").alias("doc_id"), column(docs, text_col).cast("string").alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    named = items.select(column(items, item_col).cast("long").alias("item_id"), column(items, item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    named = stored(named.distinct().withColumn("item", F.xxhash64("item_id", "text")))
    terms = stored(named.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"))
    wanted = spark.sparkContext.broadcast(_bit_map(terms))
    index = stored(texts.select("doc_id", "key", "text").mapInArrow(_build(wanted), _INDEX))
    wanted.unpersist()
    total = index.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not total.n:
        return empty
    scoring = Scoring(total.n, total.words)
    df = index.filter("width IS NULL").select("terms", "counts").mapInArrow(_frequency_rows, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    chunks = max(1, -(-terms.count() // chunk_terms))
    queries = stored(terms.join(df, "term").withColumn("chunk", F.pmod("item", F.lit(chunks))))
    found = [
        part for i in range(chunks)
        if (part := _search_chunk(spark, index, texts, queries.filter(F.col("chunk") == i).collect(), scoring, k)) is not None]
    if not found:
        return empty
    ranked = found[0]
    for part in found[1:]:
        ranked = ranked.union(part)
    return ranked.join(named.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def oracle() -> str:
    """The same rows in DuckDB, scored term by term."""
    return r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), held AS (
  SELECT doc_id, ts, len(ts)::BIGINT AS n FROM docs WHERE len(ts) > 0
), totals AS (
  SELECT count(*)::BIGINT AS cn, sum(n)::BIGINT AS cl FROM held
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), times AS (
  SELECT item_id, term, count(*)::BIGINT AS q FROM asked GROUP BY ALL
), vocabulary AS (
  SELECT DISTINCT term FROM times
), words AS (
  SELECT doc_id, n, unnest(ts) AS term FROM held
), postings AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM words SEMI JOIN vocabulary USING (term) GROUP BY ALL
), weighted AS (
  SELECT term, floor(1000 * ln((2 * any_value(cn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term
), scored AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * cn) // cl))))::BIGINT AS score
  FROM times JOIN postings USING (term) JOIN weighted USING (term), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
