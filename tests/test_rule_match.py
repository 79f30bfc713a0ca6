"""Rules that are tables, against a loop over all rules and records."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from metricspark.operators import classify, rule_match

RULE = "rule_id string, condition_no int, field string, op string, value string"
REGEXES = ["#1[0-9]$", "^AB", "A.C", "AB+C?", "A|B", "(AB)C", r"\bCA", "AB*C", "[A-C]{2}BA", "CAB", "", "B{2}", "A]B", "AC$"]


def holds(text, op, value):
    if op == "regex":
        return re.search(value, text) is not None
    return {"eq": text == value, "contains": value in text, "starts_with": text.startswith(value)}[op]


def test_against_all_pairs(spark):
    rng = random.Random(4)

    def word(most):
        return "".join(rng.choice("ABC") for _ in range(rng.randint(0, most)))

    records = [(i, word(9) if rng.random() < 0.95 else None, word(3).lower(), word(30), "x") for i in range(100)]
    records += records[:20]
    rules = []
    for r in range(10_000):
        for no in range(rng.randint(1, 3)):
            field = rng.choice(["a", "b", "c"])
            for _ in range(rng.choice([1, 1, 3])):
                op = rng.choice(rule_match.OPERATORS)
                rules.append((f"r{r:05d}", no, field, op, rng.choice(REGEXES) if op == "regex" else word(6)))
    rules += rules[:50]
    df = spark.createDataFrame(records, "id int, a string, b string, c string, rule_id string").repartition(3)
    got = rule_match.strict_classify_from_tables(
        df, spark.createDataFrame(rules, RULE), spark.createDataFrame([("r00003", "n", "v")], "rule_id string, name string, value string"))
    texts = {"a": 1, "b": 2, "c": 3}
    grouped = {}
    for rule, no, field, op, value in rules:
        grouped.setdefault(rule, {}).setdefault(no, []).append((field, op, value))
    want = []
    for record in records:
        text = {f: (record[i] or "").upper() for f, i in texts.items()}
        hit = [rule for rule, all_of in grouped.items() if all(any(holds(text[f], op, v) for f, op, v in any_of) for any_of in all_of.values())]
        want.append((record[0], tuple(sorted(hit))))
    rows = got.collect()
    assert sorted((r.id, tuple(r.rule_ids)) for r in rows) == sorted(want)
    assert {r.rule_status for r in rows} <= {"OK", "UNKNOWN", "AMBIGUOUS"}
    assert all(r["rule_id"] == "x" for r in rows)


def test_edges(spark):
    df = spark.createDataFrame([(1, "Ñu  x"), (2, None)], "id int, a string")
    none = spark.createDataFrame([], "rule_id string, name string, value string")
    assert [r.rule_status for r in rule_match.strict_classify_from_tables(df, spark.createDataFrame([], RULE), none).collect()] == ["UNKNOWN"] * 2
    rules = spark.createDataFrame([("r", 1, "a", "eq", " nú X "), ("q", 1, "a", "contains", None)], RULE)
    got = {r.id: r.rule_ids for r in rule_match.strict_classify_from_tables(df, rules, none).collect()}
    assert got == {1: ["q", "r"], 2: ["q"]}
    assert rule_match.strict_classify_from_tables(df.limit(0), rules, none).count() == 0
    with pytest.raises(classify.UnknownOperator):
        rule_match.strict_classify_from_tables(df, rules.withColumn("op", F.lit("like")), none)
    with pytest.raises(ValueError):
        rule_match.strict_classify_from_tables(df, rules.withColumn("field", F.lit("zz")), none)
    codes = spark.createDataFrame([("k", "a", "contains", "ñU"), ("e", "a", "equals", ""), ("m", "a", "equals", "nu  x")], "code string, field string, operator string, value string")
    assert {r.id: r.codes for r in rule_match.multi_classify_from_tables(df, codes).collect()} == {1: ["k"], 2: []}


def test_literals(spark):
    rows = [("#1[0-9]$", "#1"), ("ABC+D", "ABC"), ("AB?CDE", "CDE"), ("AB{2}", "A"), ("A|B", ""), (r"\d+A", ""), ("[^]A]BC", "BC"), (".*", "")]
    df = spark.createDataFrame(rows, "p string, want string").withColumn("got", rule_match.required_literal(F.col("p")))
    assert [(r.p, r.got) for r in df.collect()] == [(p, w) for p, w in rows]


def test_rules_that_ask_the_same_are_one_body(spark):
    """Copies of a rule, in any order of rows, are worked out once; a condition nobody can meet keeps a rule apart."""
    rules = [(f"r{i:03}", no, field, "contains", value) for i in range(200) for no, field, value in ((1, "a", "oak"), (2, "b", "red"))]
    rules += [("s", 2, "b", "contains", "red"), ("s", 1, "a", "contains", "oak"), ("one", 1, "a", "eq", "elm"), ("two", 1, "a", "eq", "")]
    df = spark.createDataFrame([(1, "oak tree", "red"), (2, "elm", "x"), (3, "oak", "blue"), (4, "", "red")], "id int, a string, b string")
    table = spark.createDataFrame(rules, RULE)
    classes, hits, members = rule_match.rule_hits(df, table)
    assert (hits.count(), members.select("body").distinct().count(), members.count()) == (3, 3, 203)
    results = spark.createDataFrame([("one", "n", "v"), ("r001", "n", "w")], "rule_id string, name string, value string")
    got = {r.id: (len(r.rule_ids), r.rule_status, r.result) for r in rule_match.strict_classify_from_tables(df, table, results).collect()}
    assert got == {1: (201, "AMBIGUOUS", None), 2: (1, "OK", {"n": "v"}), 3: (0, "UNKNOWN", None), 4: (1, "OK", None)}
    dropped = rule_match.rule_hits(df, table, empty=False)
    assert dropped[1].count() == 2


def shuffled_bytes(df):
    """The size of all rows that went through shuffles when this plan ran."""
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        kind = plan.nodeName()
        if kind == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif kind.endswith("QueryStage"):
            plans.append(plan.plan())
        elif kind == "Exchange":
            total += plan.metrics().apply("dataSize").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


def test_lists_are_not_shuffled_for_every_combination(spark):
    """300 combinations meet 400 rules: what is shuffled has no room for a number per pair, and every record has its whole list."""
    rules = [(f"r{i:03}", 1, "a", "contains", "oak" if i % 2 else "tree") for i in range(400)] + [("x", 1, "a", "eq", "none")]
    df = spark.createDataFrame([(i, f"oak tree {i}", {"k": i}) for i in range(300)] + [(300, "none", None), (301, "elm", None), (302, "Oak", None)],
                               "id int, a string, result map<string,int>").withColumnRenamed("result", "body")
    none = spark.createDataFrame([("x", "n", "v")], "rule_id string, name string, value string")
    got = rule_match.strict_classify_from_tables(df, spark.createDataFrame(rules, RULE), none)
    rows = {r.id: r for r in got.collect()}
    every = sorted(f"r{i:03}" for i in range(400))
    assert len(rows) == 303 and all(rows[i].rule_ids == every and rows[i].body == {"k": i} for i in range(300))
    assert (rows[300].rule_ids, rows[300].result, rows[301].rule_ids, rows[302].rule_ids) == (["x"], {"n": "v"}, [], every[1::2])
    assert 0 < shuffled_bytes(got) < 300 * 400 * 8


@pytest.fixture
def eight_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_common_combination_is_dealt_over_places(spark, monkeypatch, eight_partitions):
    monkeypatch.setattr(rule_match, "CLASS_RECORDS", 1000)
    monkeypatch.setattr(rule_match, "CLASS_BLOCK", 5)
    monkeypatch.setattr(rule_match, "BODY_LIST", 2)
    rules = [(f"r{i}", no, field, "contains", value) for i in range(9) for no, field, value in ((1, "a", "oak"), (2, "b", "red"[: i % 3 + 1]), (3, "a", "oa"))]
    df = spark.createDataFrame([(i, "oak", "red" if i < 60 else "r") for i in range(90)], "id int, a string, b string")
    got = rule_match.strict_classify_from_tables(df, spark.createDataFrame(rules, RULE), spark.createDataFrame([], "rule_id string, name string, value string"))
    marked = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.id, r.rule_ids) for r in marked) == [(i, [f"r{k}" for k in range(9) if i < 60 or k % 3 == 0]) for i in range(90)]
    assert len({r.task for r in marked}) > 1
