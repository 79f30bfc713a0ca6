"""Quality classifier: a factorisation machine over hashed words, structure and size.

The score is a logistic curve over w0 + <w, x> + the sum over pairs i < j of <v_i, v_j> x_i x_j.
The pairs cost no more than the features: their sum is half of, for every factor, the square of
the sum of v_i x_i less the sum of the squares. The machine is trained on a bounded sample of
labelled documents; only the text of a document is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import kernels as K
from .tables import column
from .training import fold, labelled_sample

#: Labelled documents the machine is trained on, at most.
SAMPLE_ROWS = 8192
HASHED = 1024
FACTORS = 8
EPOCHS = 24
_SYMBOLS = "#$%&*+<=>@[\\]^_`{|}~"
_PUNCTUATION = "!\"'(),-./:;?"


@dataclass(frozen=True)
class Machine:
    middle: np.ndarray  # of the structure statistics
    spread: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = self.scaled(x)
        pairs = 0.5 * ((x @ self.factors) ** 2 - (x**2) @ self.factors**2).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.linear + pairs, -30, 30)))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        out = x.astype(np.float64)
        out[:, HASHED:] = np.clip((x[:, HASHED:] - self.middle) / self.spread, -4, 4)
        return out


def _byte_sets() -> np.ndarray:
    sets = np.zeros((5, 256), bool)
    for row, letters in enumerate((_SYMBOLS, _PUNCTUATION, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n")):
        sets[row, [ord(ch) for ch in letters]] = True
    return sets


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: hashed words (log counts of unit length), then structure and size."""
    n = len(offsets) - 1
    starts, ends, counts = K.words(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), counts)
    out = np.zeros((n, HASHED + 11), np.float32)
    cell = doc * HASHED + (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    cells, times = np.unique(cell, return_counts=True)
    hashed = np.zeros(n * HASHED, np.float32)
    hashed[cells] = np.log1p(times)
    hashed = hashed.reshape(n, HASHED)
    out[:, :HASHED] = hashed / np.maximum(1e-9, np.sqrt((hashed**2).sum(axis=1, keepdims=True)))

    words = np.maximum(counts, 1)
    _, first, times = np.unique(K.mix(hashes + K.mix(doc.astype(np.uint64))), return_index=True, return_counts=True)
    distinct = np.bincount(doc[first], minlength=n)[:n] if len(first) else np.zeros(n)
    commonest = np.zeros(n)
    np.maximum.at(commonest, doc[first], times)
    at = np.flatnonzero(doc[:-1] == doc[1:])  # words that the next one of their text follows
    _, first = np.unique(K.mix(hashes[at] * np.uint64(3) + hashes[at + 1] + K.mix(doc[at].astype(np.uint64))), return_index=True)
    distinct_pairs = np.bincount(doc[at[first]], minlength=n)[:n] if len(first) else np.zeros(n)
    chars = np.maximum(K.char_counts(data, offsets), 1)
    parts = []
    for members in _byte_sets():
        running = np.concatenate(([0], np.cumsum(members[data])))
        parts.append(np.diff(running[offsets]))
    symbols, marks, upper, digits, lines = parts
    letters = np.bincount(doc, weights=ends - starts, minlength=n)[:n] if len(doc) else np.zeros(n)
    stats = (
        np.log1p(counts), distinct / words, commonest / words, distinct_pairs / words, symbols / chars, marks / chars,
        upper / chars, digits / chars, lines / chars, letters / words, np.log1p(chars))
    for i, s in enumerate(stats):
        out[:, HASHED + i] = s
    return out


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in K.text_slices(batch.column(0)):
            rows = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)],
                names=["x", "label", "place"])


def fit_machine(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, ridge: float = 1e-4) -> Machine:
    """Adam on the logistic loss in small batches, in a fixed order."""
    stats = x[:, HASHED:].astype(np.float64)
    middle = stats.mean(axis=0) if len(x) else np.zeros(x.shape[1] - HASHED)
    spread = np.maximum(stats.std(axis=0) if len(x) else np.zeros(len(middle)), 1e-3)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    chance = np.random.default_rng(11)
    width = x.shape[1]
    bias = np.array([np.log(rate / (1 - rate))])
    linear, pairs = np.zeros(width), chance.normal(0, 0.02, (width, factors))
    machine = Machine(middle, spread, float(bias[0]), linear, pairs)
    if len(set(y.tolist())) < 2:
        return Machine(middle, spread, float(bias[0]), linear, np.zeros_like(pairs))
    z = machine.scaled(x)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, linear, pairs)]
    turn = 0
    for _ in range(epochs):
        order = chance.permutation(len(z))
        for at in range(0, len(z), 256):
            part, want = z[order[at:at + 256]], y[order[at:at + 256]]
            sums = part @ pairs
            value = bias[0] + part @ linear + 0.5 * (sums**2 - (part**2) @ pairs**2).sum(axis=1)
            miss = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - want) / len(part)
            slopes = (
                np.array([miss.sum()]), part.T @ miss + ridge * linear,
                part.T @ (miss[:, None] * sums) - ((part**2).T @ miss)[:, None] * pairs + ridge * pairs)
            turn += 1
            for p, g, (m, v) in zip((bias, linear, pairs), slopes, state):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= 0.01 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Machine(middle, spread, float(bias[0]), linear, pairs)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", of: int = 5, held: int = 0, bound: int = SAMPLE_ROWS) -> Machine:
    sample = labelled_sample(docs, labels, label_col, of, held, bound)
    rows = (
        sample.select("text", "label", F.xxhash64("text").alias("place"))
        .mapInArrow(_feature_rows, "x binary, label int, place long").toPandas().sort_values(["place", "label"])
    )
    x = np.frombuffer(b"".join(rows["x"]), np.float32).reshape(-1, HASHED + 11)
    return fit_machine(x, rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows with their score added; null counts as empty text and gets the score of such texts.
    Repeated rows get equal scores; an empty table gives an empty result."""
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    schema = StructType(list(docs.schema.fields)).add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.text_slices(batch.column(at)):
                part = batch.slice(a, b - a)
                scores = sent.value.scores(text_features(data, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, name])

    return docs.mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, of: int = 5, held: int = 0, threshold: float = 0.3, bound: int = SAMPLE_ROWS) -> DataFrame:
    machine = train(docs, labels, "quality", of, held, bound)
    source = docs.select(column(docs, "doc_id").cast("long").alias("doc_id"), column(docs, "text").alias("text"))
    scored = score_quality(source, machine).select("doc_id", "score")
    return scored.select(
        "doc_id", (fold("doc_id", of) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
