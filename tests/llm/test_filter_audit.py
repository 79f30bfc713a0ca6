"""Filter interaction audit: packed integers against a simulation of every order, and edge cases."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from metricspark.llm import filter_audit as fa


def simulate(fails: set[str], order: str) -> list[tuple[int, int, int, int]]:
    out, alive = [], True
    for f in order:
        here, again = alive and f in fails, not alive and f in fails
        alive = alive and not here
        out.append((int(alive), int(here), int(again), int(fails == {f})))
    return out


def test_integers_hold_every_outcome():
    for code in range(128):
        fails = {f for i, f in enumerate("ABCDE") if code >> i & 1}
        counts = fa.unpack(fa.mask_integer(code))
        for k, order in enumerate(fa.filter_orders()):
            for step, want in enumerate(simulate(fails, order)):
                row = counts[k * 5 + step].tolist()
                assert tuple(row[:4]) == want and row[4] == want[1] * (code >> 5 & 1) and row[5] == want[1] * (code >> 6 & 1)


def test_sums_do_not_overflow():
    code, many = 0b1100011, (1 << 63) - 1
    assert (fa.unpack(many * fa.mask_integer(code)) == many * fa.unpack(fa.mask_integer(code))).all()
    narrow = 3 * fa.mask_integer(5, "ABC", 0, 4) + 12 * fa.mask_integer(1, "ABC", 0, 4)
    assert (fa.unpack(narrow, "ABC", 0, 4) == 3 * fa.unpack(fa.mask_integer(5, "ABC", 0), "ABC", 0) + 12 * fa.unpack(fa.mask_integer(1, "ABC", 0), "ABC", 0)).all()
    with pytest.raises(OverflowError):
        fa.unpack(1 << (600 * 6 * 64))


def brute(rows, labels):
    texts = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""].append(i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, t in labels if t == 1 and i is not None}
    out = defaultdict(lambda: [0] * 6)
    removed = defaultdict(int)
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and min(texts[t]) < i:
            fails.add("E")
        for order in fa.filter_orders():
            for step, (kept, here, again, only) in enumerate(simulate(fails, order), 1):
                cell = out[s or "", order, step]
                for k, v in enumerate((kept, here, again, only, here and i in good, here and i in bad)):
                    cell[k] += int(v)
                removed[s or "", order[step - 1]] += here
    return {(*key, *cell, removed[key[0], key[1][key[2] - 1]]) for key, cell in out.items()}


def test_audit_against_brute_force(spark, edge_docs, no_docs):
    rng = random.Random(3)
    pool = ["w%d" % i for i in range(70)] + ["BIG", "Big", "a#b", "ñ x"]
    rows = [(1, None, None), (2, "", ""), (3, "", "a"), (None, "same", "a"), (None, "same", "b"), (4, "same", "b"), (5, "same", "b"), (5, "same", "b"), (5, "other", "hot")]
    rows += [(10 + i, " ".join(rng.choice(pool) for _ in range(rng.choice([3, 49, 50, 51, 80]))), rng.choice(["hot", "hot", "a", None])) for i in range(60)]
    rows += [(100 + i, rows[20 + i][1], "copy") for i in range(20)] + [(900, " ".join(pool) * 3000, "long")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 110)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnsRenamed({}).selectExpr("*", "1 AS code", "2 AS part", "3 AS digest", "4 AS salt", "5 AS n")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS good", "'y' AS salt")
    got = fa.filter_audit(docs, frame)
    assert {tuple(r) for r in got.collect()} == brute(rows, labels)
    assert fa.filter_audit(no_docs, frame).count() == 0
    assert fa.filter_audit(edge_docs, frame.limit(0)).count() == 600 * len({r.source or "" for r in edge_docs.select("source").collect()})


def test_other_filters(spark):
    codes = spark.createDataFrame([("p", 1), ("p", 3), ("p", 3), ("q", 0), ("q", None)], "part string, code int")
    got = {(r.part, r.filter_order, r.step): r for r in fa.audit(codes, "XY", []).collect()}
    assert len(got) == 8 and got["p", "XY", 1].removed == 3 and got["p", "XY", 2].redundant == 2 and got["p", "YX", 2].removed == 1
    assert got["p", "XY", 1].unique_fails == 1 and got["p", "XY", 1].shapley == 4 and got["q", "YX", 2].kept == 1
