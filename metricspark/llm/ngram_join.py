"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is its set of distinct five-word shingles. Two documents link when
``100 * |intersection| >= percent * |union|``.

1. One pass over the texts gives each document the size and a key of its set, and counts all
   shingles in a sketch of fixed size. Documents with equal sets form one class, and only
   classes are compared, so copies cost nothing.
2. All shingles get one order: rare ones first, as the sketch estimates. A class of size n whose
   partners share at least t = ceil(n * percent / 100) shingles with it must share ``need`` of
   its first n - t + need. ``need`` is 1, and grows with the postings that the sketch expects for
   the shortest prefix: classes made of common passages read a little further and are compared
   only where that many shingles agree. A pair must reach the smaller need of the two.
3. Prefix shingles meet in one shuffle; those of a single class go. Two classes that agree on c
   prefix shingles have at most c plus the longer rest behind a prefix in common: up to the
   smaller of their last prefix shingles, each has all it shares in its prefix. That bound and
   the sizes prune pairs, first with all shingles a class shares with anyone in place of c.
4. Each class is compared with the most central class it meets (the one with the largest part
   of its prefix shared). Links found so join whole groups of near copies in linear work. Then
   the pairs that are not yet in one group are counted against their need and compared exactly.
   No candidate is dropped, so components are exact.

Sets are compared by 64-bit shingle hashes. Results do not depend on the sketch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import kernels as K
from .components import connected_components, follow_parents
from .tables import column, partitions, scratch, stored

#: Counters of the sketch, and the pieces in which they are merged.
COUNTERS = 1 << 20
CHUNKS = 16
#: Tasks merge their sketches in this many groups before the groups merge.
SLOTS = 32
#: Prefixes grow by up to this part of the set per doubling of the expected cost, five times.
GROWTH = 0.02
#: A prefix shingle of more open classes than this is common.
COMMON = 16
#: Sizes whose ratio is below this are in the same or neighbouring bands.
BAND = 1.05

_SIGNATURES = "doc_id long, key long, n long, class long, bits array<long>, chunk int, slot int, counts binary"
_POSTINGS = "token long, class long, size long"
#: A class's ``size`` is its n and, in the lower bits, its need.
NEED_BITS = 24
#: A word of 64 places, in the map of a set that rules candidates out before sets travel, for so many hashes at most.
PER_WORD = 32
#: Places per shingle of the longest prefix in the map that rules pairs out where common shingles meet.
LIST_PLACES = 4
#: Bits of the map that keeps classes without candidates out of the comparison of sets.
MAP_BITS = 1 << 22
#: Places, by id and text, of the two maps that tell which rows go without a join of rows.
ROW_PLACES = 1 << 25
#: Bits of a part of a map, as Spark's bitmap functions cut them.
PART_BITS = 1 << 15
#: What a place of the maps says of the rows there, by the number of the map.
STAYS, GOES, DOUBTFUL = 0, 1, 2


def _class_key(one: np.ndarray) -> int:
    """Key of an ascending set of hashes; equal sets have equal keys."""
    terms = K.mix(one + np.uint64(7))
    return int(K.mix(terms.sum(keepdims=True) + np.uint64(len(one)))[0].view(np.int64))


def _bit_words(hashes: np.ndarray, words: int) -> np.ndarray:
    """A map, in words of 64 places, of the places that hashes fall on."""
    flags = np.zeros(64 * words, bool)
    flags[(hashes % np.uint64(64 * words)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").view("<i8")


def _set_bits(one: np.ndarray) -> np.ndarray:
    """A map of a set that grows with it, to a power of two of words, so that halves laid together make the smaller map."""
    return _bit_words(one >> np.uint64(32), 1 << (max(1, -(-len(one) // PER_WORD)) - 1).bit_length())


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], pa.int64()))


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def _signature_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen, waiting, held = np.zeros(COUNTERS, np.int64), set(), [], 0
        for batch in batches:
            ns, keys, bits = [], [], []
            for one in K.shingle_sets(batch.column(1), size):
                ns.append(len(one))
                bits.append(_set_bits(one))
                keys.append(_class_key(one) if len(one) else None)
                if len(one) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    waiting.append(one)
                    held += len(one)
                if held > 1 << 19:
                    counters += np.bincount(_buckets(np.concatenate(waiting)), minlength=COUNTERS)
                    waiting, held = [], 0
            empty = [None] * len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), _lists(bits),
                 pa.array(empty, pa.int32()), pa.array(empty, pa.int32()), pa.array(empty, pa.binary())],
                names=["doc_id", "key", "n", "class", "bits", "chunk", "slot", "counts"])
        if waiting:
            counters += np.bincount(_buckets(np.concatenate(waiting)), minlength=COUNTERS)
        if counters.any():
            slot = TaskContext.get().partitionId() % SLOTS
            pieces = [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in np.split(counters, CHUNKS)]
            empty = [None] * CHUNKS
            yield pa.RecordBatch.from_arrays(
                [pa.array(empty, pa.int64())] * 4 + [pa.array(empty, pa.list_(pa.int64()))]
                + [pa.array(range(CHUNKS), pa.int32()), pa.array([slot] * CHUNKS, pa.int32()), pa.array(pieces, pa.binary())],
                names=["doc_id", "key", "n", "class", "bits", "chunk", "slot", "counts"])
    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // CHUNKS, np.int64)
    for piece in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(piece), np.int64)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].astype("int32"), "counts": [zlib.compress(total.tobytes(), 1)]})


def _sketch(rows: DataFrame) -> np.ndarray:
    """The merged sketch: 8 MB, however large the corpus is."""
    schema = "chunk int, counts binary"
    once = rows.groupBy("chunk", "slot").applyInPandas(_merge, schema)
    counters = np.zeros(COUNTERS, np.int64)
    width = COUNTERS // CHUNKS
    for row in once.groupBy("chunk").applyInPandas(_merge, schema).collect():
        counters[row.chunk * width:(row.chunk + 1) * width] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    return counters


def _posting_rows(spark, sketch: np.ndarray, size: int, percent: int):
    mean = sketch.mean()
    over = np.maximum(0, sketch - mean - 4 * np.sqrt(mean))
    shared_sketch = spark.sparkContext.broadcast((
        np.where(over > 0, 1 + np.floor(np.log2(np.maximum(over, 1))), 0).clip(0, 63).astype(np.uint8),
        over.astype(np.float32),
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, excess = shared_sketch.value
        seen: set[int] = set()
        out: list[tuple[np.ndarray, int, int]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(t) for t, _, _ in out]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([t for t, _, _ in out]).view(np.int64)),
                 pa.array(np.repeat(np.array([k for _, k, _ in out], np.int64), lengths)),
                 pa.array(np.repeat(np.array([x for _, _, x in out], np.int64), lengths))],
                names=["token", "class", "size"])

        for batch in batches:
            for one in K.shingle_sets(batch.column(0), size):
                n = len(one)
                if not n or (key := _class_key(one)) in seen:
                    continue
                seen.add(key)
                bucket = _buckets(one)
                ordered = np.sort((level[bucket].astype(np.uint64) << np.uint64(58)) | (one >> np.uint64(6)))
                shortest = n - -(-n * percent // 100) + 1
                # The order is by level, so the cost of the shortest prefix is that of the lowest excesses.
                cost = float(np.sort(excess[bucket])[:shortest].sum())
                need = min((1 << NEED_BITS) - 1, 1 + int(n * GROWTH * min(5.0, np.log2(1 + cost / n))))
                prefix = ordered[:shortest + need - 1]
                out.append((prefix, key, n << NEED_BITS | need))
                held += len(prefix)
                if held > 1 << 18:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()
    return run


def _set_rows(spark, wanted: np.ndarray, size: int):
    bits = spark.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, offsets, values = [], [0], []
        for batch in batches:
            for one in K.shingle_sets(batch.column(0), size):
                if not len(one) or (key := _class_key(one)) in seen or not _is_on(bits.value, key % MAP_BITS):
                    continue
                seen.add(key)
                keys.append(key)
                values.append(one.view(np.int64))
                offsets.append(offsets[-1] + len(one))
                if offsets[-1] > 1 << 19:
                    yield _sets(keys, offsets, values)
                    keys, offsets, values = [], [0], []
        if keys:
            yield _sets(keys, offsets, values)
    return run


def _maps(places: DataFrame, size: int, *kinds: str) -> list[np.ndarray]:
    """For each kind, a flag of the places, which of ``size`` places have it: packed, eight to a byte."""
    at, bit = F.bitmap_bucket_number(F.col("place") + 1), F.bitmap_bit_position(F.col("place") + 1)
    rows = places.groupBy(at.alias("part")).agg(*[F.bitmap_construct_agg(F.when(F.col(kind), bit)).alias(kind) for kind in kinds]).collect()
    out = {kind: np.zeros((-(-size // PART_BITS), PART_BITS // 8), np.uint8) for kind in kinds}
    for row in rows:
        for kind in kinds:
            out[kind][row.part - 1] = np.frombuffer(row[kind], np.uint8)
    return [out[kind].ravel() for kind in kinds]


def _is_on(bits: np.ndarray, place):
    return (bits[place >> 3] >> (place & 7)) & 1


def _class_place() -> F.Column:
    return F.pmod("class", F.lit(MAP_BITS))


def _bit_map(classes: DataFrame) -> np.ndarray:
    """Which remainders of class keys occur."""
    return _maps(classes.select(_class_place().alias("place"), F.lit(True).alias("used")), MAP_BITS, "used")[0]


def _kinds(spark, *maps: np.ndarray):
    """A function of a column of places: 0, or the number of the map, from 1, that has the place."""
    sent = spark.sparkContext.broadcast(maps)

    @F.pandas_udf("int")
    def kind(place: pd.Series) -> pd.Series:
        at = place.to_numpy()
        return pd.Series(sum(i * _is_on(bits, at) for i, bits in enumerate(sent.value, 1)))
    return kind


def _sets(keys: list, offsets: list, values: list) -> pa.RecordBatch:
    tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values)))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), tokens], names=["class", "tokens"])


def _verified(pairs: DataFrame, signatures: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the threshold, by the sets themselves.

    A place that one set's map has and the other's lacks is a hash they do not share, so the maps
    bound what a pair can share; pairs that cannot reach the threshold go. For the others the sets
    are made again where the texts are read, and only those of classes in pairs travel.
    """
    with scratch() as scope:
        return scope.keep(stored(_linked(stored(_possible(stored(pairs), signatures, percent)), texts, size, percent)))


def _possible(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    used = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    # the map keeps most of the others where they are
    few = signatures.filter(_kinds(signatures.sparkSession, _bit_map(used))(_class_place()) > 0)
    maps = few.join(used, "class", "left_semi").dropDuplicates(["class"])
    left, right = (maps.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")

    words = F.least(F.size("bits_a"), F.size("bits_b"))
    met = pairs.join(left, "a").join(right, "b").withColumns({f"bits_{x}": _folded(F.col(f"bits_{x}"), words) for x in "ab"})
    most = F.least(F.col("na") - _alone("bits_a", "bits_b"), F.col("nb") - _alone("bits_b", "bits_a"))
    return met.filter(most * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _alone(x: str, y: str) -> F.Column:
    """How many places x's map has and y's lacks: so many hashes at least are in x alone."""
    alone = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
    return F.aggregate(alone, F.lit(0), lambda total, n: total + n)


def _folded(bits: F.Column, words: F.Column) -> F.Column:
    """A set's map as it is with fewer words."""
    parts = F.sequence(F.lit(1), F.floor(F.size(bits) / words).cast("int") - 1)
    return F.when(F.size(bits) == words, bits).otherwise(F.aggregate(
        parts, F.slice(bits, F.lit(1), words), lambda low, i: F.zip_with(low, F.slice(bits, i * words + 1, words), lambda p, q: p.bitwiseOR(q))))


def _linked(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    used = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    made = texts.select("text").mapInArrow(_set_rows(texts.sparkSession, _bit_map(used), size), "class long, tokens array<long>")
    sets = stored(made.dropDuplicates(["class"]))
    left = sets.select(F.col("class").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("class").alias("b"), F.col("tokens").alias("tb"))
    common = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(left, "a").join(right, "b")
        .filter(common * (100 + percent) >= percent * (F.size("ta") + F.size("tb")))
        .select("a", "b")
    )


class _Rule:
    """What two classes, their columns marked by prefixes, must have in common."""

    def __init__(self, percent: int):
        self.percent = percent

    def n(self, x: str) -> F.Column:
        return F.shiftright(x + "size", NEED_BITS)

    def need(self, x: str) -> F.Column:
        return F.col(x + "size").bitwiseAND(F.lit((1 << NEED_BITS) - 1).cast("long"))

    def rest(self, x: str) -> F.Column:
        """How much of a set lies behind its prefix."""
        return F.floor((self.n(x) * self.percent + 99) / 100) - self.need(x)

    def band(self, x: str) -> F.Column:
        return F.floor(F.log(self.n(x).cast("double")) / float(np.log(BAND))).cast("int")

    def must(self, x: str, y: str) -> F.Column:
        """The least number of prefix shingles that a linked pair has in common."""
        whole = F.ceil((self.n(x) + self.n(y)) * self.percent / (100 + self.percent))
        return F.greatest(F.least(self.need(x), self.need(y)), whole - F.greatest(self.rest(x), self.rest(y)))

    def fit(self, x: str, y: str) -> F.Column:
        nx, ny = self.n(x), self.n(y)
        return F.least(nx, ny) * 100 >= F.greatest(nx, ny) * self.percent

    def may(self, x: str, y: str) -> F.Column:
        return self.fit(x, y) & (F.least(x + "hits", y + "hits") >= self.must(x, y))

    def must_near(self, x: str) -> F.Column:
        """No fewer than this many are shared with any class of the same or a neighbouring band."""
        share, wide = self.percent / (100 + self.percent), BAND**2

        def least(ny: F.Column) -> F.Column:
            return share * (self.n(x) + ny) - F.greatest(self.rest(x).cast("double"), ny * self.percent / 100)

        n = self.n(x)
        return F.greatest(F.lit(1), F.ceil(F.least(least(n / wide), least(n * wide)) - 1e-6)).cast("int")


def _counted(meetings: DataFrame) -> DataFrame:
    """Pairs (a, b) that meet as often as they must, from one row (a, b, must) per meeting."""
    return meetings.groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"), F.first("must").alias("must")).filter("both >= must")


def _marked(rows: DataFrame, mark: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(mark + c) for c in rows.columns if c not in keys])


def _list_words(band: int, percent: int) -> int:
    """Words of the maps that classes of a band are compared by, in proportion to the longest prefix there."""
    return max(1, int(np.ceil((1 - percent / 100 + 5 * GROWTH) * BAND ** (band + 1) * LIST_PLACES / 64)))


def _mapped_rows(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("tokens")
            tokens = [np.asarray(x.values).view(np.uint64) >> np.uint64(20) for x in batch.column(at)]
            bands = batch.column(batch.schema.names.index("band")).to_pylist()
            maps = [_lists([_bit_words(t, _list_words(b - step, percent)) for t, b in zip(tokens, bands)]) for step in (0, 1)]
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in others] + maps, names=[batch.schema.names[i] for i in others] + ["own", "below"])
    return run


def _near_pairs(common: DataFrame, rule: _Rule) -> DataFrame:
    """Candidate pairs (a, b) in the same or neighbouring bands of size that agree only on common shingles.

    Classes of like size must agree on so many prefix shingles that the first of those they have
    in common stands early in either list: only such beginnings are joined. A row has no list, only its
    place and a map of its list: what lies behind the place, and the places that one map has and
    the other lacks, bound what a pair can share. So a pair comes through where it first meets at least, and
    large groups of like documents leave rows for candidates only.
    """
    lists = common.groupBy("class", "root", "size").agg(F.array_sort(F.collect_list(F.struct("token", "minor"))).alias("list"))
    early = lists.select("class", "root", "size", rule.band("").alias("band"), F.size("list").alias("length"),
                         (F.size("list") - rule.must_near("") + 1).alias("many"), "list").filter("many > 0")
    mapped = stored(early.select("class", "root", "size", "band", "length", F.slice("list", F.lit(1), F.col("many")).alias("first"), F.col("list.token").alias("tokens")).mapInArrow(
        _mapped_rows(rule.percent),
        "class long, root long, size long, band int, length int, first array<struct<token: long, minor: boolean>>, own array<long>, below array<long>"))

    def side(step: int) -> DataFrame:
        """Rows as they meet those of the band that is ``step`` below."""
        rows = mapped.select("class", "root", "size", "length", (F.col("band") - step).alias("band"),
                             F.col("below" if step else "own").alias("map"), F.posexplode("first").alias("place", "at"))
        return rows.select("at.token", "band", "class", "root", "size", "length", (F.col("length") - F.col("place")).alias("left"), "at.minor", "map")

    def met(left: DataFrame, right: DataFrame, once: F.Column) -> DataFrame:
        must = rule.must("x_", "y_")
        pairs = _marked(left, "x_", "token", "band").join(_marked(right, "y_", "token", "band"), ["token", "band"])
        return pairs.filter(
            once & (F.col("x_root") != F.col("y_root")) & rule.fit("x_", "y_") & (F.least("x_left", "y_left") >= must)
            & (F.col("x_length") - _alone("x_map", "y_map") >= must) & (F.col("y_length") - _alone("y_map", "x_map") >= must)
        ).select(F.col("x_class").alias("a"), F.col("y_class").alias("b"))

    # of two classes in different groups one at least is outside the token's largest group
    same = met(side(0).filter("minor"), side(0), ~F.col("y_minor") | (F.col("x_class") < F.col("y_class")))
    return same.union(met(side(0), side(1), F.lit(True)))


def _meetings(left: DataFrame, right: DataFrame, keys: list[str], once: F.Column, rule: _Rule, spare: F.Column) -> DataFrame:
    """(a, b, must) for each meeting of two classes of different groups; ``spare`` is shared elsewhere at most."""
    met = _marked(left, "x_", *keys).join(_marked(right, "y_", *keys), keys)
    return met.filter(once & (F.col("x_root") != F.col("y_root")) & rule.may("x_", "y_")).select(
        F.col("x_class").alias("a"), F.col("y_class").alias("b"), (rule.must("x_", "y_") - spare).alias("must"))


def _far_pairs(common: DataFrame, rule: _Rule) -> DataFrame:
    """Candidates whose sizes are two bands apart or more, by common shingles; the smaller one first."""
    steps = range(2, int(np.log(100 / rule.percent) / np.log(BAND)) + 2)  # sizes that can still link
    band = rule.band("")
    larger = common.withColumn("band", F.explode(F.array(*[band - i for i in steps])))
    return _counted(_meetings(common.withColumn("band", band), larger, ["token", "band"], F.lit(True), rule, F.lit(0)))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     size: int = K.SHINGLE, percent: int = 75, groups: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable by links) of every row.

    With ``groups`` also text_key (xxhash64 of the text) and group, a number that all linked texts
    have in common and no others; both are null where a text has no shingles or the id is null.

    A null or wordless text has no shingles and is its own component. Rows with one id and several
    texts are judged text by text: links of one text do not pass on to the other. A null id stays alone: its component is null.
    An empty table gives an empty result. Other columns are not read.
    """
    texts = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    with scratch() as scope:
        found = scope.keep(stored(_components(scope, texts, size, percent)))
    return found if groups else found.select("doc_id", "n_shingles", "component_id")


def _components(scope, texts: DataFrame, size: int, percent: int) -> DataFrame:
    docs = texts
    rows = stored(texts.withColumn("key", F.xxhash64("text")).mapInArrow(_signature_rows(size), _SIGNATURES))
    members = rows.filter("chunk IS NULL").select("doc_id", "key", "n", "class")
    signatures = rows.filter("class IS NOT NULL AND doc_id IS NOT NULL").select("class", "n", "bits")
    sketch = _sketch(rows.filter("chunk IS NOT NULL").select("chunk", "slot", "counts"))
    classes = stored(
        members.filter("class IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    )
    known = texts.filter("doc_id IS NOT NULL")

    postings = known.select("text").mapInArrow(_posting_rows(docs.sparkSession, sketch, size, percent), _POSTINGS)
    per_token, rule = W.partitionBy("token"), _Rule(percent)
    by_size = per_token.orderBy("size", "class")
    smaller, larger = F.shiftright(F.lag("size").over(by_size), NEED_BITS), F.shiftright(F.lead("size").over(by_size), NEED_BITS)
    shared = stored(
        postings.repartition(partitions(docs.sparkSession), "token").dropDuplicates(["token", "class"])
        .withColumn("fits", (smaller * 100 >= rule.n("") * percent) | (rule.n("") * 100 >= larger * percent))
        .filter("fits").drop("fits")  # others meet nobody of a size that can link
    )
    hits = shared.groupBy("class").agg(F.count(F.lit(1)).alias("hits"))
    meets = stored(shared.join(hits, "class"))
    scope.drop(shared)
    centre = F.col("hits") / (rule.n("") - rule.rest(""))
    hub = F.max(F.struct(centre.alias("centre"), "class", "size", "hits")).over(per_token)
    starred = meets.select(
        *[F.col(c).alias("x_" + c) for c in meets.columns], hub.alias("hub")).select(
        "*", *[F.col(f"hub.{c}").alias("y_" + c) for c in ("class", "size", "hits")])
    starred = starred.filter((F.col("x_class") != F.col("y_class")) & rule.may("x_", "y_")).select(
        F.col("x_class").alias("a"), F.col("y_class").alias("b"), rule.must("x_", "y_").alias("must"))
    stars = _counted(starred).groupBy("a").agg(F.max(F.struct("both", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    stars = _verified(stars, signatures, known, size, percent)
    roots = follow_parents(
        stars.select(F.col("a").alias("node"), F.col("b").alias("parent"))
        .union(stars.join(stars.select(F.col("a").alias("seen")), F.col("b") == F.col("seen"), "left_anti").select("b", "b").distinct())
    )
    grouped = meets.drop("hits").join(roots, meets["class"] == roots.node, "left").select("token", "class", "size", F.coalesce("root", "class").alias("root"))
    of_root = W.partitionBy("token", "root")
    unsettled = stored(
        grouped.withColumn("low", F.min("root").over(per_token)).withColumn("high", F.max("root").over(per_token))
        .filter("low <> high").withColumn("heads", F.count(F.lit(1)).over(of_root))
        .withColumn("largest", F.max(F.struct("heads", "root")).over(per_token))
        .select("token", "class", "size", "root", (F.col("root") != F.col("largest.root")).alias("minor"),
                (F.count(F.lit(1)).over(per_token) > COMMON).alias("common"))
    )
    scope.drop(meets, roots)
    counts = unsettled.groupBy("class").agg(F.count(F.lit(1)).alias("hits"), F.count_if("common").alias("commons"))
    known_open, unsettled = unsettled, stored(unsettled.join(counts, "class"))
    scope.drop(known_open)
    common = unsettled.filter("common").drop("common", "commons")
    # at rare shingles pairs are few: they are listed, and common shingles they may share count in full
    rare = unsettled.filter("NOT common").drop("common", "minor")
    listed = _meetings(rare, rare, ["token"], F.col("x_class") < F.col("y_class"), rule, F.least("x_commons", "y_commons"))
    found = _counted(listed).select("a", "b").union(_far_pairs(common, rule).select("a", "b")).union(_near_pairs(common, rule))
    rest = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(_verified(rest, signatures, known, size, percent).union(stars))
    scope.drop(unsettled, stars)
    linked = connected_components(links)
    named = linked.join(classes, linked.node == classes["class"])
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    moved = stored(named.join(smallest, "component").select(F.col("node").alias("of"), "component_id", "component"))
    of_class = stored(
        classes.join(moved, classes["class"] == moved.of, "left")
        .select(F.col("class").alias("of"), F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "class").alias("group"))
    )
    return members.join(of_class, members["class"] == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("class").isNotNull() & F.col("doc_id").isNotNull(), F.col("key")).alias("text_key"),
        F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))


def _apart(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, stays) of texts that go, and of those that stay but are there several times."""
    counted = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("times"))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*", F.lit(True).alias("stays"))
    # A group's first text is met by its id and text, so the rows of a large group do not meet in one task.
    marked = counted.join(first, ["doc_id", "text_key"], "left").withColumn("stays", F.coalesce("stays", F.lit(False)))
    return marked.filter("NOT stays OR times > 1").select("doc_id", "text_key", "stays")


def _fate(keys: DataFrame, apart: DataFrame) -> F.Column:
    """STAYS, GOES or DOUBTFUL of a row by the place of its id and text; at a place that is doubtful rows differ or repeat."""
    place = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(ROW_PLACES))
    met = keys.distinct().join(apart, ["doc_id", "text_key"], "left").groupBy(place.alias("place")).agg(
        F.bool_and(F.col("stays").isNotNull() & ~F.col("stays")).alias("goes"), F.count("stays").alias("apart")).filter("apart > 0")
    return _kinds(keys.sparkSession, *_maps(met.withColumn("doubtful", ~F.col("goes")), ROW_PLACES, "goes", "doubtful"))(place)


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                            size: int = K.SHINGLE, percent: int = 75) -> DataFrame:
    """Of each group of linked documents the row with the smallest id; all columns stay.

    Linked are texts, not ids: a row goes only if a row with a linked text stays. An id with several
    texts is judged text by text. Null ids take part and come after all others. Of rows that repeat
    id and text, and of texts of one id that are linked with each other, one stays. Texts without
    shingles are linked with nothing and all stay.
    """
    last = F.lit(2**63 - 1)
    source = docs.select(F.coalesce(column(docs, id_col).cast("long"), last).alias("doc_id"), column(docs, text_col).alias("text"))
    with scratch() as scope:
        apart = scope.keep(stored(_apart(ngram_components(source, size=size, percent=percent, groups=True).filter("group IS NOT NULL"))))
    rows = docs.select(F.struct(*[column(docs, c) for c in docs.columns]).alias("row"),
                       F.coalesce(column(docs, id_col).cast("long"), last).alias("doc_id"), F.xxhash64(column(docs, text_col)).alias("text_key"))
    rows = rows.withColumn("fate", _fate(rows.select("doc_id", "text_key"), apart))
    untouched, doubtful = rows.filter(F.col("fate") == STAYS), rows.filter(F.col("fate") == DOUBTFUL)
    one_of_each = doubtful.join(apart.filter("stays").drop("stays"), ["doc_id", "text_key"], "left_semi").groupBy("doc_id", "text_key").agg(
        F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    others = doubtful.join(apart.drop("stays"), ["doc_id", "text_key"], "left_anti")
    return untouched.select("row.*").union(others.select("row.*")).union(one_of_each.select("row.*"))
