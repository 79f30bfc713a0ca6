"""Removal of near duplicates: exactly the rows that must stay, with repeated and null ids."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from metricspark.llm import ngram_join

from .conftest import make_text
from .test_pairs import shingle_set


def expected_rows(rows):
    """(id, text) of the rows that stay, null ids as the largest number; a group keeps one of its smallest id."""
    last = 2**63 - 1
    plain = [(last if i is None else i, t, frozenset(shingle_set(t))) for i, t in rows]
    sets = list({s for _, _, s in plain if s})
    parent = {s: s for s in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            parent[root(b)] = root(a)
    best = {}
    for i, t, s in plain:
        if s:
            best[root(s)] = min(best.get(root(s), last), i)
    return [(i, t) for i, t, s in plain if not s] + [(i, None) for i in best.values()]


def staying(df):
    return df.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "text").collect()


def compare(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit("x")).withColumn("group", F.lit("y")).withColumn("row", F.lit("z"))
    out = ngram_join.without_near_duplicates(frame.repartition(3))
    assert out.columns == frame.columns
    got = staying(out)
    want = expected_rows(rows)
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in want)
    assert len(expected_rows([(r.doc_id, r.text) for r in got])) == len(got)  # nothing that stays is linked
    assert {(r.doc_id, r.text) for r in got} <= {(2**63 - 1 if i is None else i, t) for i, t in rows}
    return got


def test_repeated_ids(spark):
    a, b, c = (make_text(random.Random(i), 40) for i in range(3))
    assert sorted((r.doc_id, r.text) for r in compare(spark, [(1, a), (2, a), (2, b), (3, c), (3, c)])) == [(1, a), (2, b), (3, c)]
    got = compare(spark, [(None, a), (None, a), (None, b), (4, b + " more"), (5, None), (5, None), (None, ""), (6, c), (6, c + " x"), (7, "one two"), (7, "One  two")])
    assert len(got) == 7
    assert [tuple(r) for r in compare(spark, [(9, a)] * 40 + [(8, b)])] and len(compare(spark, [(None, a)] * 5)) == 1


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    assert Counter(r.doc_id for r in staying(ngram_join.without_near_duplicates(edge_docs))) == Counter(i for i, _ in expected_rows(rows))
    assert ngram_join.without_near_duplicates(no_docs).count() == 0


def test_random_groups(spark):
    rng = random.Random(12)
    texts = [make_text(rng, 60) for _ in range(12)]
    rows = []
    for _ in range(150):
        words = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 0, 1, 6])):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 40)}"
        rows.append((rng.choice([None, *range(90)]), " ".join(words)))
    compare(spark, rows + rows[:20])


def shuffled_rows(df, name):
    """How many rows that hold a column went through a shuffle of its own when this plan ran."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.nodeName()
        if kind == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStage"):
            plans.append(plan.plan())
        elif kind == "Exchange" and name in plan.schema().fieldNames():
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture
def large_sides(spark):
    """Joins as at sizes where no side is small enough to be sent to all tasks."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_without_copies_are_not_shuffled(spark, large_sides):
    rng = random.Random(8)
    texts = [make_text(rng, 40) for _ in range(150)]
    rows = [*enumerate(texts), *[(200 + i, t + " more") for i, t in enumerate(texts[:30])], (3, texts[3]), (None, texts[4]), (500, None), (501, "")]
    out = ngram_join.without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = [2**63 - 1 if r.doc_id is None else r.doc_id for r in out.collect()]
    assert Counter(got) == Counter(i for i, _ in expected_rows(rows))
    assert shuffled_rows(out, "row") <= 10  # the repeated one, and any that share a place


def test_signatures_outside_pairs_are_not_shuffled(spark, large_sides):
    signatures = spark.createDataFrame([(k, 10, [k]) for k in range(1, 301)], "class long, n long, bits array<long>")
    pairs = spark.createDataFrame([(1, 1 + 2**30), (3, 7)], "a long, b long")
    out = ngram_join._possible(pairs, signatures, 75)
    assert [tuple(r) for r in out.collect()] == [(3, 7)]
    assert shuffled_rows(out, "bits") <= 10


@pytest.mark.parametrize("places", [4, 64])
def test_places_that_rows_share(spark, monkeypatch, places):
    """Rows that go and rows that stay at one place of the maps."""
    monkeypatch.setattr(ngram_join, "ROW_PLACES", places)
    monkeypatch.setattr(ngram_join, "MAP_BITS", places)
    rng = random.Random(places)
    texts = [make_text(rng, 50) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t + " x") for i, t in enumerate(texts[::3])] + [(None, texts[0]), (5, texts[5]), (5, texts[6]), (7, ""), (8, None)]
    compare(spark, rows + rows[:3])
