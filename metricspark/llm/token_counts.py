"""Token counts through an exact histogram of encoded lengths.

Documents are encoded where they are read and only the counts of their lengths travel. Suffix sums
over the histogram then answer, for every context limit: how many documents are longer, how many
tokens there are, and how many remain when each document is cut at the limit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .tables import column, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabularies cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts encoded at a time, in characters.
_CHUNK = 1 << 20
#: Lengths are summed in blocks first, so no window spans all of them.
BLOCK = 1024


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def token_lengths(docs: DataFrame, text_col: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs) as each task counts them: one row per length and task."""
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(path))  # a vocabulary, of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        counts = np.zeros(0, np.int64)
        for batch in batches:
            lengths = [len(encoder.encode_ordinary(t.as_py() or "")) for t in batch.column(0)]
            seen = np.bincount(lengths) if lengths else np.zeros(0, np.int64)
            if len(seen) > len(counts):
                counts, seen = seen, counts
            counts[:len(seen)] += seen
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["n_tokens", "docs"])

    return docs.select(column(docs, text_col).alias("text")).mapInArrow(run, "n_tokens long, docs long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per encoded length, with suffix sums and what a limit of that length leaves.

    ``docs_at_least`` and ``tokens_at_least`` are over documents of this length or more,
    ``tokens_within`` is the total when every document is cut to this length, ``quantile`` the
    part of documents that are no longer.
    """
    hist = stored(
        lengths.groupBy("n_tokens").agg(F.sum("docs").alias("docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK)))
    tokens = F.col("docs") * F.col("n_tokens")
    blocks = hist.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(tokens).alias("t"))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    zero = F.lit(0)
    carried = blocks.select(
        "block", F.coalesce(F.sum("d").over(after), zero).alias("docs_behind"), F.coalesce(F.sum("t").over(after), zero).alias("tokens_behind"),
        F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    rows = hist.join(carried, "block").select(
        "n_tokens", "docs", (F.col("docs_behind") + F.sum("docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_behind") + F.sum(tokens).over(inside)).alias("tokens_at_least"), "docs_total", "tokens_total")
    return rows.select(
        "n_tokens", "docs", "docs_at_least", "tokens_at_least",
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("tokens_within"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("docs")) / F.col("docs_total")).alias("quantile"),
        "docs_total", "tokens_total")


def token_counts(docs: DataFrame, text_col: str = "text", path: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """The histogram of a table of texts. A null text has no tokens; repeated rows count again;
    an empty table gives an empty histogram; other columns are not read."""
    return length_histogram(token_lengths(docs, text_col, path, pattern))


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: longer documents and the tokens that remain when cut there."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    # the next length at or above a limit carries the sums that hold there
    next_length = histogram.join(F.broadcast(wanted), F.col("n_tokens") >= F.col("context_limit")).groupBy("context_limit").agg(
        F.min(F.struct("n_tokens", "docs", "docs_at_least", "tokens_at_least")).alias("x"))
    total = histogram.agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total")).first()
    whole = F.lit(total.tokens_total or 0)
    at_least, tokens = F.coalesce("x.docs_at_least", F.lit(0)), F.coalesce("x.tokens_at_least", F.lit(0))
    equal = F.when(F.col("x.n_tokens") == F.col("context_limit"), F.col("x.docs")).otherwise(0)
    return wanted.join(next_length, "context_limit", "left").select(
        "context_limit", (at_least - equal).alias("docs_longer"), (whole - tokens + F.col("context_limit") * at_least).alias("tokens_within"),
        whole.alias("tokens_total"))


def length_quantile(histogram: DataFrame, q: float) -> int | None:
    """The smallest length that at least this part of the documents does not exceed."""
    row = histogram.filter(F.col("quantile") >= q - 1e-12).agg(F.min("n_tokens").alias("n")).first()
    return row.n
