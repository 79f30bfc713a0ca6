"""Ranked lexical search: bounds hold, results equal brute force, edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from metricspark.llm import kernels as K
from metricspark.llm import ranked_search as rs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, Counter(ts)) for i, t in docs if (ts := terms_of(t))]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=str):
        asked = Counter(terms_of(text))
        found = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n // words
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank, None if none else i, -score) for rank, (score, none, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def sample_texts(rng, n):
    pool = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(400)] + ["Straße", "niño", "don't", "x_y", "ÉA", "日本 語"]
    return [" ".join(rng.choice(pool) for _ in range(rng.choice([1, 5, 40, 200]))) for _ in range(n)]


def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = sample_texts(rng, 250)
    docs = [(i, t) for i, t in enumerate(texts)] + [(300, None), (301, ""), (302, " -_!\t"), (None, texts[3]), (7, texts[9]), (7, texts[9]), (305, texts[3]), (306, " ".join(texts) * 2)]
    items = [(i, t[:150]) for i, t in enumerate(rng.sample(texts, 20))] + [(50, "w1 w1 w1 w2"), (51, None), (52, ""), (53, "unheard-of"), (50, "w1 w1 w1 w2"), (50, "w3"), (None, "w2 w4"), (54, " ".join(texts[:40]))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS key", "'y' AS item", "1 AS rank", "2 AS score").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'z' AS item", "0 AS term")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in rs.ranked_search(frame, asked).collect()), key=str) == want
    monkeypatch.setattr(rs, "BLOCK", 16)  # many blocks, several chunks of items
    assert sorted((tuple(r) for r in rs.ranked_search(frame, asked, chunk_terms=300).collect()), key=str) == want


def test_edge_tables(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the er"), (2, None)], "item_id long, text string")
    assert rs.ranked_search(no_docs, items).count() == 0
    assert rs.ranked_search(edge_docs, items.limit(0)).count() == 0
    assert rs.ranked_search(edge_docs.filter("text IS NULL OR text = ''"), items).count() == 0
    got = [tuple(r) for r in rs.ranked_search(edge_docs, items).collect()]
    assert sorted(got, key=str) == brute([(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()], [(1, "the er")])


def test_bounds_are_never_below_scores():
    rng = random.Random(4)
    texts = sample_texts(rng, 64)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    doc, terms, counts, lengths = rs.term_counts(data, offsets)
    assert [sum(Counter(terms_of(t)).values()) for t in texts] == lengths.tolist()
    scoring = rs.Scoring(64, int(lengths.sum()))
    df = Counter(terms.tolist())
    rows = [type("Row", (), {"item": i, "term": int(np.uint64(t).astype(np.int64)), "times": 1, "df": df[t]}) for i in range(5) for t in rng.sample(sorted(df), 12)]
    chunk = rs.make_chunk(rows, scoring)
    size = max(Counter(doc.tolist()).values())
    bounds = np.searchsorted(doc, np.arange(65))
    block = rs._Block(max(64, size * 4), list(range(64)), list(range(64)), lengths.tolist(), [int(counts[a:b].max()) for a, b in zip(bounds, bounds[1:])],
                      [terms[a:b] for a, b in zip(bounds, bounds[1:])], [counts[a:b] for a, b in zip(bounds, bounds[1:])])
    upper = rs.upper_bounds(chunk, scoring, block.row())
    for d in range(64):
        tf = dict(zip(terms[bounds[d]:bounds[d + 1]].tolist(), counts[bounds[d]:bounds[d + 1]].tolist()))
        for i in range(len(chunk.items)):
            run = slice(chunk.begins[i], chunk.begins[i + 1] if i + 1 < len(chunk.items) else None)
            exact = sum(int(w) * int(rs.Scoring.share(np.array([n]), scoring.length_factor(lengths[d:d + 1]))[0])
                        for p, w in zip(chunk.places[run], chunk.weights[run]) if (n := tf.get(int(chunk.terms[p]), 0)))
            assert upper[i, d] >= exact
    assert (upper > 0).any() and K.SHINGLE == 5
