"""Near-duplicate join and components against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from metricspark.llm import components, kernels, ngram_join

from .conftest import make_text


def shingle_set(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


def test_shingles_against_words():
    rng = random.Random(1)
    letters = ["a", "B", "é", " ", "\n", "\x1c", "\x85", " ", "ſ", "\x0b"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", None]
    got = [len(s) for s in kernels.shingle_sets(pa.array(texts, pa.string()))]
    assert got == [len(shingle_set(t)) for t in texts]
    assert [len(s) for s in kernels.shingle_sets(pa.array(texts, pa.string()).slice(7, 50))] == got[7:57]
    assert [len(next(kernels.shingle_sets(pa.array([t])))) for t in texts[:300]] == got[:300]


def test_join_on_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert result(ngram_join.ngram_components(edge_docs)) == brute(rows)
    assert ngram_join.ngram_components(no_docs).count() == 0


@pytest.mark.parametrize("common", [2, 16])
def test_join_against_brute_force(spark, monkeypatch, common):
    """Groups of near copies, edits at every rate, passages and lines that many share."""
    monkeypatch.setattr(ngram_join, "COMMON", common)
    rng = random.Random(common)
    passage, line = make_text(rng, 50), make_text(rng, 7)
    originals = [make_text(rng, rng.choice([6, 30, 90, 91, 92, 150])) for _ in range(8)]
    rows = []
    for k in range(260):
        words = originals[k % 8].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 400)}"
        if rng.random() < 0.3:
            words = words[:rng.randint(len(words) // 2, len(words))]
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join([make_text(rng, rng.randint(1, 70)), passage, line][:rng.randint(1, 3)])) for k in range(80)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(ngram_join.ngram_components(df)) == brute(rows)


def test_maps_of_long_sets_rule_pairs_out(spark):
    """Sets of 4,000 shingles and more: unlike pairs go before sets travel, linked pairs of maps of other sizes stay."""
    def text(first, last):
        return " ".join(f"w{i}" for i in range(first, last))

    texts = [text(0, 4004), text(50_000, 54_004), text(800, 5300), text(0, 4400), text(0, 3600)]
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key long").repartition(2)
    signatures = rows.mapInArrow(ngram_join._signature_rows(5), ngram_join._SIGNATURES).filter("chunk IS NULL").cache()
    keys = {r.doc_id: r["class"] for r in signatures.collect()}
    pairs = spark.createDataFrame([(keys[a], keys[b]) for a, b in itertools.combinations(keys, 2)], "a long, b long")
    kept = {frozenset((r.a, r.b)) for r in ngram_join._possible(pairs, signatures.select("class", "n", "bits"), 75).collect()}
    sets = {i: shingle_set(t) for i, t in enumerate(texts)}
    linked = {frozenset((keys[a], keys[b])) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len({len(r.bits) for r in signatures.collect()}) > 1
    assert linked <= kept and frozenset((keys[0], keys[3])) in linked
    assert not [p for p in kept if keys[1] in p or p == frozenset((keys[0], keys[2]))]


def test_common_shingles_meet_without_their_lists(spark, monkeypatch):
    """All pairs that share as much as they must come through; what is stored for the join is far smaller than the lists."""
    rng = np.random.default_rng(4)
    pool, n, need = rng.integers(0, 2**62, 300), 400, 21
    lists = []
    for k in range(40):
        base = pool[(k % 4) * 70:][:90]
        lists.append(set(np.concatenate([base[:rng.integers(50, 91)], rng.choice(pool, 30)]).tolist()))
    common = spark.createDataFrame([(t, k, k, (n + k % 15) << ngram_join.NEED_BITS | need, len(one), True) for k, one in enumerate(lists) for t in one],
                                   "token long, class long, root long, size long, hits long, minor boolean")
    held = []

    def noted(df):
        out = stored(df)
        held.extend(sum(len(x) for x in r if isinstance(x, list)) for r in out.collect())
        return out

    stored = ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", noted)
    rule = ngram_join._Rule(75)
    got = {frozenset((r.a, r.b)) for r in ngram_join._near_pairs(common, rule).collect()}
    facts = spark.createDataFrame([(x, y, (n + x % 15) << ngram_join.NEED_BITS | need, (n + y % 15) << ngram_join.NEED_BITS | need) for x, y in itertools.combinations(range(40), 2)],
                                  "x long, y long, x_size long, y_size long")
    must = {(r.x, r.y): r.must for r in facts.select("x", "y", rule.must("x_", "y_").alias("must")).collect()}
    want = {frozenset(p) for p, least in must.items() if len(lists[p[0]] & lists[p[1]]) >= least}
    assert want and want <= got and len(got) < len(must)
    assert sum(held) < sum(len(one) for one in lists)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(12)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if e[0] != e[1] for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and parent[a] != parent[b]:
                parent[a] = parent[b] = min(parent[a], parent[b])
                changed = True
    assert got == parent
    forest = spark.createDataFrame([(i, max(0, i - 1)) for i in range(9)], "node long, parent long")
    assert {r.root for r in components.follow_parents(forest).collect()} == {0}
    assert np.all(kernels.mix(np.arange(4, dtype=np.uint64)) == kernels.mix(np.arange(4, dtype=np.uint64)))
