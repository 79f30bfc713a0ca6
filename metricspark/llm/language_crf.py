"""Language identification of code-switched text by a linear-chain conditional random field.

Words are runs of letters; the labels of the chain are the languages. A word's features are its
affixes and inner n-grams, hashed into buckets, and its place in a lexicon of the training sample.
Their weights and those of the transitions between neighbouring words are learnt together, by
gradients of the conditional likelihood that forward-backward gives.

Documents are labelled as a whole. Training sequences are spliced from stretches of documents in
several languages, so that the transitions learn how often text switches and the features learn to
tell words apart without their neighbours.

For prediction the chain of a document is cut into pieces of equal length. The product of the steps
of a piece is a small matrix, made for all pieces of a slice of texts at once; only these products
are followed one after the other. Forward and backward messages inside the pieces are again made
for all at once, so a very long text costs no more per word than a short one. A document's language
is the one with the largest sum of word posteriors; maximal runs of words with one most likely
language are reported as spans.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import column, stored
from .training import fold

UNKNOWN = "und"
#: Bounds of the training sample: documents, and stretches of words cut from them.
SAMPLE_ROWS = 4096
SAMPLE_STRETCHES = 24_000
#: Words of a stretch, at least and at most, and of a training sequence.
STRETCH = (4, 24)
SEQUENCE = 48
BUCKETS = 1 << 16
#: Lengths of n-grams over a word and a mark at either end; those that hold a mark are its affixes.
GRAMS = (2, 3, 4, 5)
#: A word of the sample enters the lexicon if so many of its stretches hold it.
LEXICON_LEAST = 3
EPOCHS = 5
BATCH = 256
#: Words of a piece of a chain.
PIECE = 64
SLICE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPANS = "array<struct<start:int,end:int,lang:string,score:double>>"


class Letters:
    """What code points are: 0 for separators, 1 for marks that stay inside words, 2 for letters; and their lower case."""

    def __init__(self) -> None:
        self.kind = np.full(0x110000, -1, np.int8)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[self.kind[codes] < 0]).tolist():
            ch = chr(code)
            self.kind[code] = 2 if ch.isalpha() else int(unicodedata.category(ch)[0] == "M")
            if len(low := ch.lower()) == 1:
                self.lower[code] = ord(low)


@dataclass(frozen=True)
class Words:
    """The words of some texts: code points (lower case), starts, lengths, words per text, and starts of the texts."""

    codes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray

    def hashes(self) -> np.ndarray:
        values = K.mix(self.codes.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * K._powers(K._BASE, len(values)), out=sums[1:])
        shift = K._powers(K._BASE_INVERSE, len(values))[self.starts]
        return K.mix((sums[self.starts + self.lengths] - sums[self.starts]) * shift + self.lengths.astype(np.uint64))


def text_words(texts: list[str], letters: Letters) -> Words:
    codes = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters.learn(codes)
    kind = letters.kind[codes]
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    inside = np.concatenate(([0], (kind > 0).astype(np.int8), [0]))
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    spelled = np.concatenate(([0], np.cumsum(kind == 2)))
    real = spelled[ends] > spelled[starts]
    starts, ends = starts[real], ends[real]
    return Words(letters.lower[codes], starts, ends - starts, np.diff(np.searchsorted(starts, firsts)), firsts[:-1])


def _take(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, … of each run, one run after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - count), count)


def gram_features(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word, one word after the other, and how many each word has."""
    wide = lengths + 2
    begin = np.cumsum(wide) - wide
    flat = np.zeros(int(wide.sum()), np.uint64)  # 0 marks both ends
    flat[_take(begin + 1, lengths)] = codes[_take(starts, lengths)].astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(wide)), wide)
    left = np.repeat(begin + wide, wide) - np.arange(len(flat))  # places up to the word's end
    parts, owners = [], []
    h = flat.copy()
    for n in range(2, max(GRAMS) + 1):
        h = h[:len(flat) - n + 1] * _STEP + flat[n - 1:]
        if n in GRAMS:
            at = np.flatnonzero(left[:len(h)] >= n)
            parts.append((K.mix(h[at] + np.uint64(n)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32))
            owners.append(word[at])
    owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.bincount(owner, minlength=len(wide))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    lexicon: np.ndarray
    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def features(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of each distinct word: its n-grams, and its row of the lexicon or the row of other words."""
        return _with_lexicon(self.lexicon, hashes, codes, starts, lengths)

    def emissions(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ids, counts = self.features(hashes, codes, starts, lengths)
        return _emissions(self.weights, ids, counts)


def _with_lexicon(lexicon, hashes, codes, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = gram_features(codes, starts, lengths)
    at = np.searchsorted(lexicon, hashes)
    known = np.zeros(len(hashes), bool)
    inside = at < len(lexicon)
    known[inside] = lexicon[at[inside]] == hashes[inside]
    own = BUCKETS + np.where(known, at, len(lexicon))
    out = np.insert(ids, np.cumsum(counts) - counts, own.astype(np.int32)) if len(counts) else ids
    return out, counts + 1


def _emissions(weights: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(counts):
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[ids], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]


def _unit(x: np.ndarray, axes: int | tuple[int, ...] = -1) -> np.ndarray:
    return x / np.maximum(x.max(axis=axes, keepdims=True), 1e-300)


def chain_posteriors(odds: np.ndarray, counts: np.ndarray, transitions: np.ndarray, start: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Posterior of every label for every word, by forward-backward over each text's words.

    ``odds`` are exp(emission); ``counts`` the words per text; ``transitions`` and ``start`` are
    exponentiated weights.
    """
    n, labels = odds.shape
    if not n:
        return np.zeros((0, labels))
    pieces = -(-counts // piece)
    doc = np.repeat(np.arange(len(counts)), pieces)
    first_piece = np.cumsum(pieces) - pieces
    place = np.arange(len(doc)) - first_piece[doc]
    size = np.minimum(piece, counts[doc] - place * piece)
    cells = _take(np.arange(len(doc)) * piece, size)
    p = np.ones((len(doc) * piece, labels))
    p[cells] = odds
    p = p.reshape(len(doc), piece, labels)
    step = np.broadcast_to(transitions, (len(doc), labels, labels))
    head = np.where((place == 0)[:, None, None], np.eye(labels), transitions)
    total = head * p[:, 0, None, :]
    for t in range(1, int(size.max())):
        total = np.where((t < size)[:, None, None], _unit(total @ transitions * p[:, t, None, :], (1, 2)), total)
    enter, leave = np.zeros((len(doc), labels)), np.ones((len(doc), labels))
    most = int(pieces.max())
    order = np.argsort(-pieces, kind="stable")
    here = np.tile(start, (len(counts), 1))
    longer = np.searchsorted(-pieces[order], -np.arange(most), side="left")  # texts with more than r pieces come first
    for r in range(most):
        some = order[:longer[r]]
        at = first_piece[some] + r
        enter[at] = here[some]
        here[some] = _unit((here[some, None, :] @ total[at])[:, 0])
    here = np.ones((len(counts), labels))
    for r in range(most - 1, -1, -1):
        some = order[:longer[r]]
        at = first_piece[some] + r
        leave[at] = here[some]
        here[some] = _unit((total[at] @ here[some, :, None])[:, :, 0])
    forward = np.empty_like(p)
    forward[:, 0] = _unit((enter[:, None, :] @ head)[:, 0] * p[:, 0])
    for t in range(1, piece):
        forward[:, t] = _unit(forward[:, t - 1] @ transitions * p[:, t])
    back = leave
    for t in range(piece - 1, -1, -1):
        if t < piece - 1:
            back = np.where((t + 1 < size)[:, None], _unit((p[:, t + 1] * back) @ transitions.T), leave)
        forward[:, t] *= back
    both = forward.reshape(-1, labels)[cells]
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)


def _expected(p: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label posteriors of whole sequences (sequence, place, label), and expected transitions."""
    many, length, labels = p.shape
    a = np.empty_like(p)
    a[:, 0] = _unit(start * p[:, 0])
    for t in range(1, length):
        a[:, t] = _unit(a[:, t - 1] @ transitions * p[:, t])
    b = np.ones((many, labels))
    pairs = np.zeros((labels, labels))
    gamma = np.empty_like(p)
    gamma[:, -1] = a[:, -1]
    for t in range(length - 2, -1, -1):
        ahead = p[:, t + 1] * b
        both = a[:, t, :, None] * transitions * ahead[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = _unit(ahead @ transitions.T)
        gamma[:, t] = a[:, t] * b
    return gamma / gamma.sum(axis=2, keepdims=True), pairs


def fit(stretches: list[tuple[str, str]], epochs: int = EPOCHS, ridge: float = 1e-6) -> Model:
    """Adam on the conditional likelihood of sequences spliced from (lang, words) in the order given."""
    langs = tuple(sorted({lang for lang, _ in stretches}))
    labels = len(langs)
    words = text_words([text for _, text in stretches], Letters())
    hashes = words.hashes()
    distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    source = np.repeat(np.arange(len(stretches)), words.counts)
    spread = np.unique(which * max(1, len(stretches)) + source) // max(1, len(stretches))
    lexicon = distinct[np.bincount(spread, minlength=len(distinct)) >= LEXICON_LEAST]
    weights = np.zeros((BUCKETS + len(lexicon) + 1, labels))
    transitions, start = np.zeros((labels, labels)), np.zeros(labels)
    if labels > 1 and len(which):
        gold = np.array([langs.index(lang) for lang, _ in stretches])[source]
        ids, counts = _with_lexicon(lexicon, distinct, words.codes, words.starts[first], words.lengths[first])
        begin = np.cumsum(counts) - counts
        length = min(SEQUENCE, len(which))
        many = len(which) // length
        tokens, truth = which[:many * length].reshape(many, length), gold[:many * length].reshape(many, length)
        chance = np.random.default_rng(3)
        params, state, turn = (weights, transitions, start), [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, transitions, start)], 0
        for _ in range(epochs):
            order = chance.permutation(many)
            for at in range(0, many, BATCH):
                rows = order[at:at + BATCH]
                used, place = np.unique(tokens[rows], return_inverse=True)
                place = place.reshape(len(rows), length)
                own, count = ids[_take(begin[used], counts[used])], counts[used]
                e = _emissions(weights, own, count)[place]
                gamma, pairs = _expected(np.exp(e - e.max(axis=2, keepdims=True)), np.exp(transitions), np.exp(start))
                right = np.eye(labels)[truth[rows]]
                miss = gamma - right
                per_word = np.stack([np.bincount(place.ravel(), miss[:, :, j].ravel(), len(used)) for j in range(labels)], axis=1)
                per_feature = np.repeat(per_word / np.sqrt(count)[:, None], count, axis=0)
                slopes = (
                    np.stack([np.bincount(own, per_feature[:, j], len(weights)) for j in range(labels)], axis=1) / len(rows) + ridge * weights,
                    (pairs - np.einsum("bti,btj->ij", right[:, :-1], right[:, 1:])) / len(rows) + 1e-4 * transitions,
                    miss[:, 0].mean(axis=0) + 1e-4 * start)
                turn += 1
                for x, g, (m, v) in zip(params, slopes, state):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    x -= 0.05 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return Model(langs, lexicon, weights.astype(np.float32), transitions, start)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of words of the sampled documents, with a number that shuffles them."""
    letters = Letters()
    for batch in batches:
        for text, lang, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = text_words([text], letters)
            n = len(words.starts)
            sizes = np.random.default_rng(key & (2**63 - 1)).integers(STRETCH[0], STRETCH[1] + 1, n // STRETCH[0] + 1)
            stops = np.minimum(np.cumsum(sizes), n)
            parts = [text[words.starts[b - s]:words.starts[b - 1] + words.lengths[b - 1]] for s, b in zip(sizes, stops) if b - s >= 0 and s]
            order = K.mix(np.arange(len(parts), dtype=np.uint64) + np.uint64(key & (2**64 - 1))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(parts), pa.string()), pa.array(parts, pa.string()), pa.array(order)], names=["lang", "words", "place"])


def train(docs: DataFrame, of: int = 4, held: int = 2, bound: int = SAMPLE_ROWS, stretches: int = SAMPLE_STRETCHES,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from at most ``bound`` documents outside the held-out fold, those with the smallest
    hashes of their ids, and at most ``stretches`` stretches of their words. Texts that repeat in the
    sample count once."""
    named = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"), column(docs, lang_col).alias("lang"))
    picked = (
        named.filter((fold("doc_id", of) != held) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    found = named.join(F.broadcast(picked.distinct()), "doc_id").filter("text IS NOT NULL AND lang IS NOT NULL")  # ``bound`` ids
    sample = found.select("text", "lang", F.xxhash64("text", "lang").alias("key")).dropDuplicates(["key"])
    cut = stored(sample.mapInArrow(_stretches, "lang string, words string, place long"))
    rows = cut.orderBy("place", "lang", "words").limit(stretches).collect()
    return fit([(r.lang, r.words) for r in rows])


def tag_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and spans (start, end, lang, score; code points, end exclusive) of every row.

    ``score`` is the mean posterior of the predicted language over the words. Null texts, texts
    without a letter, and all texts if nothing was learnt, give ``und``, score 0 and no spans. Equal
    sums go to the language that sorts first. Repeated rows give equal results, an empty table an
    empty one; other columns are not read.
    """
    # Buckets and sampled lexicon: of bounded size. Plain values, since executors need not have this package.
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = Model(*sent.value), Letters()
        names = np.array([*model.langs, UNKNOWN], object)
        transitions, start = np.exp(model.transitions), np.exp(model.start)
        for batch in batches:
            for a, b, _, _ in K.text_slices(batch.column(1), SLICE):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                words = text_words(texts, letters)
                counts = words.counts if model.langs else np.zeros_like(words.counts)
                lang, score = np.full(b - a, len(model.langs)), np.zeros(b - a)
                heads, stops, best, sure = (np.empty(0, np.int64) for _ in range(4))
                bounds = np.zeros(b - a + 1, np.int32)
                if counts.any():
                    distinct, first, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
                    e = model.emissions(distinct, words.codes, words.starts[first], words.lengths[first])
                    odds = np.exp(e - e.max(axis=1, keepdims=True))
                    doc = np.repeat(np.arange(b - a), counts)
                    post = chain_posteriors(odds[which], counts, transitions, start)
                    sums = np.stack([np.bincount(doc, post[:, j], b - a) for j in range(post.shape[1])], axis=1)
                    some = counts > 0
                    lang[some] = sums[some].argmax(axis=1)
                    score[some] = np.clip(sums[some].max(axis=1) / counts[some], 0, 1)
                    label = post.argmax(axis=1)
                    fresh = np.ones(len(label), bool)
                    fresh[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    at = np.flatnonzero(fresh)
                    last = np.append(at[1:], len(label)) - 1
                    base = words.firsts[doc[at]]
                    heads, stops, best = words.starts[at] - base, words.starts[last] + words.lengths[last] - base, label[at]
                    sure = np.clip(np.add.reduceat(post[np.arange(len(label)), label], at) / (last - at + 1), 0, 1)
                    bounds = np.searchsorted(doc[at], np.arange(b - a + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(heads, pa.int32()), pa.array(stops, pa.int32()), pa.array(names[best.astype(int)], pa.string()), pa.array(sure, pa.float64())], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(names[lang], pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds), spans)],
                    names=["doc_id", "lang_pred", "score", "spans"])

    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id long, lang_pred string, score double, spans {_SPANS}")


def languages(docs: DataFrame, of: int = 4, held: int = 2, bound: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learnt from the other folds."""
    tagged = tag_languages(docs, train(docs, of, held, bound))
    return tagged.select("doc_id", (fold("doc_id", of) == held).alias("held_out"), "lang_pred", "score")
