"""Toxicity by a lexicon, misspellings and context.

The lexicon is a trie of terms: whole words, and beginnings of words. A Levenshtein automaton of
one edit is intersected with the trie: the states are sets of (trie node, edits so far), made
deterministic once on the driver. Every word of a text then walks the table, all words of a slice
of texts at once; nearly all of them leave it after a few letters.

Each hit is scored in a window of its text. Quotation marks around it and words of reporting take
weight from it, words of address and further hits add to it. A logistic curve over the sums gives
the score. Lexicon and curve are learnt from a bounded sample of labelled documents.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tables import column
from .training import fit_logistic, fold, labelled_sample

#: Labelled documents that lexicon and curve are learnt from, at most. All terms that they support are kept.
SAMPLE_ROWS = 16_384
#: Terms from this length on are also matched with one edit: by default of the automaton, and in the
#: lexicon that is learnt, where the harmless words guard the short ones.
FUZZY_LENGTH, LEARNT_FUZZY_LENGTH = 5, 4
#: Beginnings of words that may become terms.
STEMS = (4, 5, 6)
#: A term is kept if it is this much more frequent (log odds) in labelled documents, and occurs in
#: so many of them: a number, or a part if that is more.
LEAST_ODDS, LEAST_DOCS, LEAST_PART = 3.0, 4, 0.005
FUZZY_WEIGHT = 0.7
WINDOW = 48  # characters on either side of a hit

# Words of address and of reporting in the four languages, quotation marks, separators.
ADDRESS = frozenset("you your yours u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
REPORTING = frozenset("said says called wrote quote quoted quotes sagte nannte schrieb zitat dit disait écrit citation dijo llamó escribió cita".split())
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
SEPARATORS = "“”„«»‘’‚–—…¡¿·•    　"

_TABLE = 0x110000  # all code points


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool = False  # the beginning of a word


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    harmless: frozenset[str]  # words one edit from a term that ordinary documents use more often
    weights: tuple[float, ...]


class Automaton:
    """Deterministic intersection of the lexicon trie with one-edit Levenshtein automata."""

    def __init__(self, terms: tuple[Term, ...], fuzzy_length: int = FUZZY_LENGTH):
        children: list[dict[str, int]] = [{}, {}]
        ends: list[str] = ["", ""]
        for term in terms:  # root 0: exact only, root 1: with edits
            fuzzy = not term.stem and len(term.text) >= fuzzy_length
            node = 1 if fuzzy else 0
            for ch in term.text:
                if ch not in children[node]:
                    children[node][ch] = len(children)
                    children.append({})
                    ends.append("")
                node = children[node][ch]
            if ends[node] != "stem":
                ends[node] = "stem" if term.stem else "fuzzy" if fuzzy else "word"
        letters = sorted({ch for t in terms for ch in t.text})
        self.classes = np.zeros(_TABLE, np.int32)  # class 0: letters that no term has
        for i, ch in enumerate(letters, 1):
            self.classes[ord(ch)] = i

        def skip(states: frozenset) -> frozenset:
            """With the states that leave out the next letter of a term."""
            return states | {(child, 1) for node, edits in states if edits == 0 and node >= 0 for child in children[node].values()}

        def step(states: frozenset, ch: str) -> frozenset:
            after = set()
            for node, edits in states:
                if node == -1:
                    after.add((-1, 0))
                    continue
                down = children[node].get(ch)
                if down is not None:
                    after.add((-1 if ends[down] == "stem" else down, 0 if ends[down] == "stem" else edits))
                if edits == 0:
                    after |= {(child, 1) for child in children[node].values()}
                    after.add((node, 1))
            return frozenset({(-1, 0)}) if (-1, 0) in after else skip(frozenset(after))

        # edits == 2 marks the exact trie, where none are allowed
        start = skip(frozenset({(0, 2), (1, 0)}))
        numbers, queue, table, kinds = {frozenset(): 0, start: 1}, [start], {0: [0] * (len(letters) + 1)}, {0: 0}
        while queue:
            states = queue.pop()
            row = []
            for ch in ["\0", *letters]:
                after = step(states, ch)
                if after not in numbers:
                    numbers[after] = len(numbers)
                    queue.append(after)
                row.append(numbers[after])
            table[numbers[states]] = row
            exact = any(n == -1 or (e != 1 and ends[n]) for n, e in states)
            kinds[numbers[states]] = 1 if exact else 2 if any(e == 1 and ends[n] == "fuzzy" for n, e in states if n >= 0) else 0
        self.table = np.array([table[i] for i in range(len(table))], np.int32)
        self.kinds = np.array([kinds[i] for i in range(len(kinds))], np.int8)

    def match(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words that match, and how: 1 as they are, 2 with one edit."""
        classes = self.classes[codes]
        words, at, state = np.arange(len(starts)), starts.copy(), np.ones(len(starts), np.int32)
        hits, kinds = [], []
        while len(words):
            ended = at >= ends[words]
            kind = self.kinds[state]
            done = ended & (kind > 0)
            hits.append(words[done])
            kinds.append(kind[done])
            go = ~ended
            words, at, state = words[go], at[go], state[go]
            state = self.table[state, classes[at]]
            at = at + 1
            alive = state > 0
            words, at, state = words[alive], at[alive], state[alive]
        if not hits:
            return np.empty(0, np.int64), np.empty(0, np.int8)
        hits, kinds = np.concatenate(hits), np.concatenate(kinds)
        order = np.argsort(hits)
        return hits[order], kinds[order]


@cache
def _inside_table() -> np.ndarray:
    """Which code points are part of words: from U+3000 on letters, marks and numbers."""
    inside = np.ones(_TABLE, bool)
    inside[:128] = False
    inside[0x3000:] = [unicodedata.category(chr(c))[0] in "LMN" for c in range(0x3000, _TABLE)]
    for ch in "abcdefghijklmnopqrstuvwxyz0123456789":
        inside[ord(ch)] = True
    for ch in SEPARATORS:
        inside[ord(ch)] = False
    return inside


def lower_words(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts in lower case, joined by line ends; code points, word starts and ends, text starts."""
    low = [t.lower() for t in texts]
    joined = "\n".join(low) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _inside_table()[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8)))))
    firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low])))
    return joined, codes, edges[::2], edges[1::2], firsts


def _context(before: str, after: str, others: int) -> tuple[float, bool]:
    """Weight of a hit, and whether it is quoted, from its window."""
    words = set("".join(ch if ch.isalnum() else " " for ch in before + " " + after).split())
    left, right = before.split("\n")[-1], after.split("\n")[0]
    opened = max(left.rfind(ch) for ch in OPENING)
    quoted = opened >= 0 and left[opened:].count(left[opened]) % 2 == 1 and any(ch in right for ch in CLOSING)
    weight = 0.35 if quoted else 1.0
    if words & REPORTING:
        weight *= 0.7
    if words & ADDRESS:
        weight *= 1.3
    return weight * (1 + 0.1 * min(others, 5)), quoted


def hit_sums(texts: list[str], automaton: Automaton, harmless: frozenset[str]) -> np.ndarray:
    """For each text: weighted hits, hits with an edit, quoted hits, words."""
    joined, codes, starts, ends, firsts = lower_words(texts)
    out = np.zeros((len(texts), 4))
    doc = np.searchsorted(firsts, starts, side="right") - 1
    out[:, 3] = np.bincount(doc, minlength=len(texts))[:len(texts)]
    hits, kinds = automaton.match(codes, starts, ends)
    kept = [(h, k) for h, k in zip(hits.tolist(), kinds.tolist()) if k == 1 or joined[starts[h]:ends[h]] not in harmless]
    places = np.array([starts[h] for h, _ in kept], np.int64)
    for h, kind in kept:
        a, b, d = int(starts[h]), int(ends[h]), int(doc[h])
        lo, hi = max(int(firsts[d]), a - WINDOW), min(int(firsts[d + 1]), b + WINDOW)
        others = int(np.searchsorted(places, hi) - np.searchsorted(places, lo)) - 1
        weight, quoted = _context(joined[lo:a], joined[b:hi], others)
        out[d, 0] += weight * (1 if kind == 1 else FUZZY_WEIGHT)
        out[d, 1] += kind == 2
        out[d, 2] += quoted
    return out


def _features(sums: np.ndarray) -> np.ndarray:
    hits, words = sums[:, 0], np.maximum(sums[:, 3], 1)
    return np.column_stack([np.minimum(hits, 0.5) * 2, np.log1p(hits), np.log1p(100 * hits / words)])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic, clean): how many documents have the word or the beginning."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            joined, _, starts, ends, _ = lower_words([text or ""])
            found = {joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())}
            stems = {w[:n] for w in found for n in STEMS if len(w) > n}
            counts[label].update([(w, False) for w in found if len(w) > 2])
            counts[label].update([(s, True) for s in stems])
    terms = list(counts[0].keys() | counts[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array([t for t, _ in terms], pa.string()), pa.array([s for _, s in terms], pa.bool_()),
         pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())],
        names=["term", "stem", "toxic", "clean"])


def learn_lexicon(sample: DataFrame) -> tuple[Term, ...]:
    """Terms that mark labelled documents. A beginning is taken where it stands for several words;
    these stay in the lexicon, as only whole words are matched with an edit."""
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    rows = (
        sample.select("text", "label").mapInArrow(_count_terms, "term string, stem boolean, toxic long, clean long")
        .groupBy("term", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter((F.col("toxic") >= max(LEAST_DOCS, LEAST_PART * toxic)) & (odds >= LEAST_ODDS))
        .orderBy(F.desc("toxic"), "term", "stem").collect()
    )  # of a bounded sample, and each supported by a part of it
    words = {r.term: r.toxic for r in rows if not r.stem}
    stems: list[Term] = []
    for r in sorted((r for r in rows if r.stem), key=lambda r: (len(r.term), -r.toxic, r.term)):
        widest = max((n for w, n in words.items() if w.startswith(r.term)), default=0)
        if r.toxic >= 1.3 * widest and not any(r.term.startswith(s.text) for s in stems):
            stems.append(Term(r.term, True))
    return tuple(stems + [Term(w) for w in words])


def train(docs: DataFrame, labels: DataFrame, label_col: str, of: int, held: int, bound: int = SAMPLE_ROWS) -> Model:
    sample = labelled_sample(docs, labels, label_col, of, held, bound)
    terms = learn_lexicon(sample)
    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(Automaton(terms, LEARNT_FUZZY_LENGTH))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            joined, codes, starts, ends, firsts = lower_words([t or "" for t in batch.column(0).to_pylist()])
            hits, kinds = automaton.value.match(codes, starts, ends)
            hits = hits[kinds == 2]
            doc = np.searchsorted(firsts, starts[hits], side="right") - 1
            labels = batch.column(1).to_pylist()
            for d, word in {(d, joined[starts[h]:ends[h]]) for d, h in zip(doc.tolist(), hits.tolist())}:
                found[labels[d]][word] += 1
        words = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([found[k][w] for w in words], pa.int64()) for k in (1, 0))],
            names=["word", "toxic", "clean"])

    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean = (
        sample.select("text", "label").mapInArrow(near, "word string, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .filter(F.col("clean") * F.lit(totals.get(1, 0)) > F.col("toxic") * F.lit(totals.get(0, 0)))
    )
    # In a sample with no labelled document there are no terms, and so no words near them.
    harmless = frozenset(r.word for r in clean.collect())  # of a bounded sample

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = hit_sums([t or "" for t in batch.column(0).to_pylist()], automaton.value, harmless)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in got.T), batch.column(1)], names=["a", "b", "c", "d", "label"])

    rows = sample.select("text", "label").mapInArrow(sums, "a double, b double, c double, d double, label int").toPandas()
    weights = fit_logistic(_features(rows[["a", "b", "c", "d"]].to_numpy()), rows["label"].to_numpy(float))
    return Model(terms, harmless, tuple(weights))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and what it rests on, for every row; only the text is used.

    A null or empty text has no hits and gets the score of such texts. Repeated rows get equal
    scores; an empty table gives an empty result; other columns are not read.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(model.terms, LEARNT_FUZZY_LENGTH))
    harmless, weights = model.harmless, np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b, _, _ in K.text_slices(texts):
                got = hit_sums([t or "" for t in texts.slice(a, b - a).to_pylist()], automaton.value, harmless)
                score = 1 / (1 + np.exp(-np.clip(weights[0] + _features(got) @ weights[1:], -30, 30)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(score), pa.array(got[:, 0]), pa.array(got[:, 1].astype(np.int64)), pa.array(got[:, 2].astype(np.int64))],
                    names=["doc_id", "score", "weighted_hits", "edited_hits", "quoted_hits"])

    source = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, weighted_hits double, edited_hits long, quoted_hits long")


def toxicity(docs: DataFrame, labels: DataFrame, of: int = 4, held: int = 2, threshold: float = 0.3, bound: int = SAMPLE_ROWS) -> DataFrame:
    scores = score_toxicity(docs, train(docs, labels, "toxic", of, held, bound))
    return scores.select(
        "doc_id", (fold("doc_id", of) == held).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "weighted_hits", "edited_hits", "quoted_hits")
