"""Depths and closures of long chains, trees and cycles in few rounds."""

from __future__ import annotations

import random

import pytest

from metricspark.operators import graph

EDGE = "metric_id string, dep_metric_id string"


@pytest.fixture
def cuts(monkeypatch):
    made = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: made.append(1) or cut(df))
    return made


def depths(edges):
    deps, nodes = {}, set()
    for v, u in edges:
        deps.setdefault(v, set()).add(u)
        nodes |= {v, u}
    depth = {}
    while True:
        ready = [v for v in nodes if v not in depth and all(u in depth for u in deps.get(v, ()))]
        if not ready:
            return {v: depth.get(v) for v in nodes}
        for v in ready:
            depth[v] = max((depth[u] + 1 for u in deps.get(v, ())), default=0)


def hops(edges, sources):
    found, last, n = {s: 0 for s in sources}, set(sources), 0
    while last:
        n += 1
        last = {v for v, u in edges if u in last and v not in found}
        found |= dict.fromkeys(last, n)
    return found


def test_long_chain(spark, cuts):
    size = 10_000
    chain = spark.range(1, size).selectExpr("'n' || id AS metric_id", "'n' || (id - 1) AS dep_metric_id")
    got = {r.metric_id: r.depth for r in graph.dag_depth(chain).collect()}
    assert got == {f"n{i}": i for i in range(size)}
    assert len(cuts) < 2 + 3 * 20
    cuts.clear()
    reached = graph.dag_closure(chain, spark.createDataFrame([("n3",)], "metric_id string")).collect()
    assert {r.metric_id: r.hops for r in reached} == {f"n{i}": i - 3 for i in range(3, size)}
    assert len(cuts) - 3 < 20  # edges, sources and the start of the contraction are cut once


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(str(v), str(rng.randrange(max(0, v - 6), v))) for v in range(1, 60) for _ in range(rng.choice([1, 1, 1, 2]))]
    edges += [(str(200 + i), str(rng.randrange(60))) for i in range(10)] + edges[:5]
    if seed % 2:  # cycles, one node on itself, and what lies behind
        edges += [("90", "91"), ("91", "92"), ("92", "90"), ("93", "92"), ("94", "94"), ("95", "93"), ("95", "40"), ("20", "50")]
    df = spark.createDataFrame(edges, EDGE)
    assert {r.metric_id: r.depth for r in graph.dag_depth(df).collect()} == depths(edges)
    sources = [str(rng.randrange(30)) for _ in range(3)] + ["nowhere", "91"]
    got = {r.metric_id: r.hops for r in graph.dag_closure(df, spark.createDataFrame([(s,) for s in sources], "metric_id string")).collect()}
    assert got == hops(edges, sources)
