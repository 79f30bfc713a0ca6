"""Catalogs as tables: equal to the compiled catalog, to its definition, and never collected."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from metricspark.functions import criteria
from metricspark.operators import catalog_counts as cc
from metricspark.operators import metrics
from metricspark.sources import catalog


def as_tables(spark, terms):
    """Term and predicate tables of a list of terms."""
    numbers, rows, preds = {}, [], []
    for t in terms:
        n = numbers[t.metric_id] = numbers.get(t.metric_id, 0) + 1
        rows.append((t.metric_id, n, t.sign))
        for i, (col, raw) in enumerate(t.predicates):
            op = re.match("(<>|<=|>=|<|>|=|)", raw)[1]
            preds.append((t.metric_id, n, i, col, op, raw[len(op):]))
    return spark.createDataFrame(rows, catalog.TERM_SCHEMA), spark.createDataFrame(preds, catalog.PREDICATE_SCHEMA)


def counted(df):
    return {(r["period"], r["metric_id"]): r["value"] for r in df.collect()}


def test_against_the_compiled_catalog(spark):
    rng = random.Random(7)
    records = [(rng.choice(["a", "b", None]), rng.choice(["F", "f", "M", None, "", "*x"]), rng.choice([None, 0, 5, 17, 18, 40]), rng.choice([0.5, -3.0, 1e9, float("nan"), None]),
                rng.choice(["x", "y|z", "y", "18", " 5 ", "a.b", "a~b", "aXb"]), rng.random() < 0.5) for _ in range(400)]
    df = spark.createDataFrame(records, "period string, sex string, age int, score double, kind string, flag boolean")
    T = metrics.Term
    terms = [T("all"), T("none", (("age", ">100"),)), T("never", (("sex", "F"), ("sex", "M"))), T("diff", (("sex", "F"),)), T("diff", (("sex", "M"), ("age", ">=18")), -1),
             T("blank", (("sex", ""),)), T("eq", (("age", "18"), ("kind", "Y|Z"))), T("minus_all", (), -1), T("wild", (("kind", "*"),)), T("stems", (("kind", "y?z"),)),
             T("literal", (("sex", "~*x"),)), T("dots", (("kind", "a.*"),)), T("tilde", (("kind", "a~~b"),)), T("negations", (("sex", "<>F"), ("kind", "<>y*"), ("kind", "<>x"))),
             T("not_wild", (("kind", "<>?"),)), T("between", (("age", ">5"), ("age", "<=18"))), T("not_number", (("age", "<>18"),)), T("scores", (("score", ">-3"), ("flag", "true"))),
             T("text_number", (("kind", "18"),)), T("five", (("kind", "<=5"),)), T("on_flag", (("flag", "1"),)), T("mixed", (("sex", "<>f"), ("age", "<18"), ("kind", "<>*b")))]
    terms += [T(f"g{i}", (("sex", s), ("age", a), ("kind", k))) for i, (s, a, k) in enumerate(itertools.product(["F", "<>F"], ["<5", ">=5", "<>18", "=40"], ["x", "<>y", "<>*b"]))]
    got = counted(cc.metric_counts_from_tables(df, *as_tables(spark, terms)))
    assert got == counted(metrics.metric_counts(df, terms)) and len(got) == 3 * len({t.metric_id for t in terms})


def test_patterns_and_nodes(spark):
    rng = random.Random(1)
    bodies = ["".join(rng.choice("aB*?~.[\\é1 ") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    frame = spark.createDataFrame([(b,) for b in bodies], "body string")
    for body, pattern in frame.select("body", cc.wildcard_pattern(F.col("body"))).collect():
        want = re.compile(criteria.wildcard_regex(body).replace(r"\z", r"\Z"))
        texts = [body.lower(), body.lower().replace("~", ""), "a", "a1", "é", "b.é", ""] + ["".join(rng.choice("ab*?~.é1") for _ in range(3)) for _ in range(20)]
        mine = re.compile(pattern.replace(r"\z", r"\Z"))
        assert [bool(want.match(t)) for t in texts] == [bool(mine.match(t)) for t in texts], body
    spans = [(a, b) for a in range(0, 34, 3) for b in range(a - 2, 40, 5)]
    for a, b, nodes in spark.createDataFrame(spans, "a int, b int").select("a", "b", cc._nodes(F.col("a"), F.col("b"))).collect():
        covered = [x for node in nodes for j, i in [map(int, node.split(":"))] for x in range(i << j, (i + 1) << j)]
        assert sorted(covered) == list(range(a, b + 1))


def test_a_catalog_that_does_not_fit_is_refused(spark):
    df = spark.createDataFrame([("a", "F", 3)], "period string, sex string, age int")
    T = metrics.Term
    terms, preds = as_tables(spark, [T("a", (("sex", "F"),)), T("b", (("age", ">1"),))])
    assert counted(cc.metric_counts_from_tables(df, terms, preds)) == {("a", "a"): 1, ("a", "b"): 1}
    assert cc.metric_counts_from_tables(df.limit(0), terms, preds).count() == 0
    assert counted(cc.metric_counts_from_tables(df, terms, preds.limit(0))) == {("a", "a"): 1, ("a", "b"): 1}
    with pytest.raises(catalog.CatalogError):
        cc.metric_counts_from_tables(df, terms.union(terms), preds)
    with pytest.raises(catalog.CatalogError):
        cc.metric_counts_from_tables(df, terms.filter("metric_id = 'a'"), preds)
    with pytest.raises(catalog.CatalogError):
        cc.metric_counts_from_tables(df.drop("age"), terms, preds)
    with pytest.raises(criteria.UnsupportedCriterion):
        cc.metric_counts_from_tables(df, *as_tables(spark, [T("a", (("sex", "<F"),))]))


def test_terms_never_reach_the_driver(spark, monkeypatch):
    """What is collected does not grow with the catalog."""
    collected = []
    kind = type(spark.range(1))
    whole = kind.collect

    def noted(self):
        out = whole(self)
        collected.append(len(out))
        return out

    monkeypatch.setattr(kind, "collect", noted)
    df = spark.range(500).selectExpr("'p' AS period", "CAST(id % 50 AS INT) AS age", "concat('k', id % 9) AS kind")
    sizes = []
    for n in (40, 400):
        terms = spark.range(n).selectExpr("concat('m', id) AS metric_id", "1 AS term_no", "1 AS sign")
        preds = spark.range(n).selectExpr("concat('m', id) AS metric_id", "1 AS term_no", "1 AS pred_no", "'age' AS col", "'>' AS op", "CAST(id % 60 AS STRING) AS value")
        collected.clear()
        frame = cc.metric_counts_from_tables(df, terms, preds)
        sizes.append(sum(collected))
        got = {r["metric_id"]: r["value"] for r in frame.toLocalIterator()}
        assert got == {f"m{i}": 10 * max(0, 49 - i % 60) for i in range(n)}
    assert sizes[0] == sizes[1]


def test_terms_that_ask_the_same_are_one_body(spark):
    """Terms with the same predicates, in any order, are filed once and keep their own signs."""
    terms = spark.createDataFrame([*[(f"m{i}", 1, 1 if i % 2 else -1) for i in range(40)], ("n", 1, 1), ("n", 2, 1), ("all", 1, 2)],
                                  "metric_id string, term_no int, sign int")
    both = [("sex", "", "F"), ("age", ">", "3")]
    preds = [(f"m{i}", 1, no, *p) for i in range(40) for no, p in enumerate(both if i % 3 else both[::-1])]
    preds += [("n", 1, 1, "sex", "<>", "F"), ("n", 2, 1, "sex", "", "F")]
    table = spark.createDataFrame(preds, "metric_id string, term_no int, pred_no int, col string, op string, value string")
    members, bodies, asked = cc.term_bodies(terms, cc.parsed_predicates(table))
    assert (members.count(), bodies.count(), asked.count()) == (43, 4, 4)
    df = spark.createDataFrame([("p", "F", 2), ("p", "F", 5), ("p", "F", 9), ("p", "M", 9)], "period string, sex string, age int")
    got = {r.metric_id: r.value for r in cc.metric_counts_from_tables(df, terms, table).collect()}
    assert got == {**{f"m{i}": 2 if i % 2 else -2 for i in range(40)}, "n": 4, "all": 8}
