"""Mixing, WARC derivatives, top-k search, the pipeline and the registry."""

from __future__ import annotations

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from metricspark.llm import mixing, quality, queries, secrets, topk, warc
from metricspark.llm.sentencepiece import Decoder, Pieces

from .conftest import make_text
from .test_near_duplicates import expected_rows
from .test_pairs import brute


def water_fill(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left, shares = total - sum(capped.values()), sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / shares > most * sizes[s]]
        if not over:
            return capped | {s: left * w[s] / shares for s in free}
        capped |= {s: most * sizes[s] for s in over}


def test_mix(spark, edge_docs, no_docs):
    rng = random.Random(21)
    rows = [(i, make_text(rng, rng.randint(0, 60)), rng.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"])) for i in range(900)]
    rows += [(2000 + i, "w " * 3, "tiny") for i in range(3)] + [(3000, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df.repartition(4)).collect()
    size = {i: len((t or "").encode().split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals = Counter()
    for i, s in source.items():
        totals[s] += size[i]
    targets, taken = water_fill(totals, (5, 2, 1), 3), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == totals[s] and r.target == pytest.approx(targets[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 60 for s in targets)  # half of the longest document, and rounding
    assert sorted(got) == sorted(mixing.mix_sources(df).collect())
    chances = [r.taken / r.size for r in got if source[r.doc_id] == "hot" and r.size]
    assert len(set(chances)) > 1
    assert mixing.mix_sources(edge_docs).count() == edge_docs.count() and mixing.mix_sources(no_docs).count() == 0
    copies = Counter(r.doc_id for r in mixing.mixed_documents(df).collect())
    assert copies == Counter({r.doc_id: r.taken // r.size for r in got if r.taken})
    assert mixing.mixed_documents(edge_docs).columns == edge_docs.columns


def test_warc(spark, tmp_path):
    html = "<!DOCTYPE html><html><head><title>A &amp;\n B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- x -->" \
           "<p>One<br>two <b>three</b>&nbsp;</p><a class='k' href=\"/u?a=1\">link</a><ul><li>$1 \\ &lt;i&gt;</li></ul></body></html>"
    pages = spark.createDataFrame([(1, "http://a/ b", html, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "a < b > c", "x"), (None, "u", html * 300, "x"),
                                   (1, "http://a/ b", html, "x")], "page_id long, url string, html string, block string")
    got = warc.derivatives(warc.responses(pages))
    rows = got.collect()
    assert len(rows) == 12 and len({r.record_id for r in rows}) == 10
    source = {(r.page_id, r.record_id): r for r in warc.responses(pages).collect()}
    assert {(r.page_id, r.refers_to) for r in rows} == set(source)
    text = next(r for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text.block == "A &\nB\nOne\ntwo three\nlink\n$1 \\ <i>"
    fields = next(r for r in rows if r.page_id == 1 and r.record_type == "metadata").block
    assert "title: A &amp; B\r\n" in fields and "outlink: /u?a=1\r\n" in fields and "http-header: Content-Type: text/html" in fields
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(warc.oracle()).fetchall()
    names = [d[0] for d in con.description]
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want)
    warc.write_warc(got, str(tmp_path / "out"))
    import gzip
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("*.gz")))
    seen = Counter()
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        length = int(head.rsplit(b"Content-Length: ", 1)[1])
        assert data[length:length + 4] == b"\r\n\r\n"
        seen[data[:length].decode()] += 1
        data = data[length + 4:]
    assert seen == Counter(r.block for r in rows)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


@pytest.mark.parametrize("candidates", [16, 4096])
def test_top_k(spark, monkeypatch, candidates):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", candidates)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(7)
    vectors = [rng.normal(size=12).astype(np.float32).tolist() for _ in range(700)]
    vectors[300:600] = [vectors[0]] * 300  # many equal ones
    vectors[5], vectors[6], vectors[7], vectors[8] = None, [1.0, None], [float("nan")] * 12, [float("inf")] + [0.0] * 11
    vectors[9], vectors[10] = [2.5, -1.0], []
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, vectors[1], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()}
    whole = {}
    for i, v in enumerate(vectors):
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole[i] = np.zeros(12, np.int64)
            whole[i][:len(v)] = np.floor(1024 * np.array(v, np.float64))
    want = set()
    for q in (i for i in whole if i % 100 == 0):
        order = sorted(((-int(whole[q] @ whole[i]), i) for i in whole if i != q))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(order)}
    assert got == want
    few = topk.top_k(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 100 == 0)
    assert few.count() == 2
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("held", [50, 1 << 20])
def test_copies_of_queries_are_not_broadcast(spark, monkeypatch, held):
    """What the driver takes in does not grow with folds times queries; a task reports k pairs a query, however many blocks it met."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 8)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "QUERY_GROUP", 2, raising=False)
    monkeypatch.setattr(topk, "HELD", held, raising=False)
    plans, tasks, meet = [], [], topk._meet

    def noted(*sides):
        out = meet(*sides)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        found = out.mapInArrow(topk._gather(3, 2), "query_id long, vec_id long, score long").withColumn("task", F.spark_partition_id()).cache()
        tasks.append((found.count(), found.select("task", "query_id").distinct().count()))
        return out

    monkeypatch.setattr(topk, "_meet", noted)
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(400, 6)) * np.where(np.arange(400) % 7 == 0, 900, 1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(2)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=3).collect()}
    whole = np.floor(1024 * vectors).astype(np.int64)
    want = set()
    for q in range(0, 400, 10):
        order = sorted((-int(whole[q] @ whole[i]), i) for i in range(400) if i != q)[:3]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(order)}
    assert got == want
    assert len(plans) == 2 and all("SortMergeJoin [fold" in p for p in plans)
    assert "Broadcast" not in plans[0]
    rows, asked = tasks[0]
    assert rows <= 3 * asked if held > 50 else rows > 3 * asked


def test_top_k_of_repeated_ids(spark):
    """The whole table twice, and ids with two vectors: every id counts once, with its best score."""
    rng = np.random.default_rng(8)
    rows = [(i % 200, rng.normal(size=6).tolist()) for i in range(260)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df.union(df), F.col("vec_id") % 20 == 0, k=5).collect()}
    whole = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows]
    best = {}
    for q, a in whole:
        for i, b in whole:
            if q % 20 == 0 and i != q:
                best[q, i] = max(best.get((q, i), -1 << 60), int(a @ b))
    want = set()
    for q in range(0, 200, 20):
        order = sorted((-s, i) for (x, i), s in best.items() if x == q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(order)}
    assert got == want


@pytest.mark.parametrize("groups", [1, 3, 8, 40])
def test_threshold_finds_all_and_scores_less(groups):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 32))
    c = np.floor(1024 * (centres[rng.integers(0, 40, 2000)] + rng.normal(scale=0.2, size=(2000, 32)))).astype(np.int64)
    q = c[:50]
    scores = q @ c.T
    for cutoffs in (np.sort(scores, axis=1)[:, -10], np.full(50, topk.NO_CUTOFF), np.full(50, 0)):
        i, j, score, work = topk._resolve(q, c, cutoffs, groups)
        want = np.nonzero(scores >= cutoffs[:, None])
        order = np.lexsort((j, i))
        assert (i[order] == want[0]).all() and (j[order] == want[1]).all()
        assert (score == scores[i, j]).all()
        if groups == 8 and cutoffs[0] > 0:
            assert work < 0.6 * scores.size * 32  # brute force multiplies every coordinate of every pair


def test_large_components_stay_exact():
    q, c = np.array([[2**40, 3]], np.int64), np.array([[2**20, -5], [1, 1]], np.int64)
    assert sum(topk._local_scores(q, c, 2)).tolist() == [[2**60 - 15, 2**40 + 3]]
    i, j, score, _ = topk._resolve(q, c, np.array([2**60 - 15]), 2)
    assert (i.tolist(), j.tolist(), score.tolist()) == ([0], [0], [2**60 - 15])


def test_pipeline_stages_against_brute_force(spark, tmp_path, edge_docs):
    rng = random.Random(31)
    base = [make_text(rng, rng.randint(20, 90)) for _ in range(60)]
    rows = [(i, t, rng.choice("abc"), "en") for i, t in enumerate(base)]
    rows += [(100 + i, base[i] + " more", "a", "en") for i in range(15)] + [(200 + i, base[i].upper().replace(" ", "!! "), "b", "en") for i in range(25)]
    rows += [(300, base[0] + " password=hunter2222", "c", None), (301, None, None, None), (302, "", "c", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("n_chars", F.length("text").cast("long"))
    labels = spark.createDataFrame([(r[0], int(not 200 <= r[0] < 300)) for r in rows], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, current, str(tmp_path)).write.parquet(path)
        before, current = current, spark.read.parquet(path)
        steps[name] = (before.collect(), current.collect())
        assert name == names[-1] or current.columns == docs.columns
    before, after = steps["quality_classifier"]
    scores = quality.score_quality(docs, quality.train(docs, labels), name="s").collect()
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in scores if r.s >= 0.3)
    assert not any(200 <= r.doc_id < 300 for r in after) and {r.doc_id for r in after} >= set(range(60))
    before, after = steps["ngram_jaccard_join"]
    groups = brute([(r.doc_id, r.text) for r in before])
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, c in groups if i == c)
    before, after = steps["secret_scan"]
    scanner = secrets.Scanner(secrets.SecretRules())
    assert len(before) == len(after) and all(not scanner.spans(r.text or "", True) for r in after)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in after)
    before, after = steps["source_mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(Counter(r.doc_id for r in after).values()) <= 3
    before, after = steps["sentencepiece"]
    decoder = Decoder(Pieces.load())
    assert Counter((r.doc_id, decoder.decode(r.ids)) for r in after) == Counter((r.doc_id, r.text or "") for r in before)
    assert queries.QUERIES["pipeline"](spark, str(tmp_path)).count() == len(after)
    sizes = {"ngram_jaccard_join": len(expected_rows([tuple(r) for r in edge_docs.select("doc_id", "text").collect()]))}
    for name, stage in corpus_pipeline.STAGES[1:]:  # nulls, repeats and clashing columns
        rows = stage(spark, edge_docs, str(tmp_path)).count()
        assert rows == sizes.get(name, edge_docs.count()) if name != "source_mixing" else rows > 0
        assert stage(spark, edge_docs.limit(0), str(tmp_path)).count() == 0


def test_registry():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(queries.ORACLES) <= set(names)
