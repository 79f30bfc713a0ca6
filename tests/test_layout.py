"""Label grids with merged ranges against a walk over every cell of a small sheet."""

from __future__ import annotations

import random
import re

import pytest

from metricspark import fixed_values as fixed
from metricspark.operators import layout

GRID = "sheet string, row_no int, col_no int, text string, number double, bold boolean"
RANGES = "sheet string, r1 int, c1 int, r2 int, c2 int"


def walk(cells, merges, targets):
    """(section, row, column labels) of each target, cell by cell."""
    filled = {(r, c): (t, n, b) for _, r, c, t, n, b in cells}
    corner = {(r, c): (m[1], m[2]) for m in merges for r in range(m[1], m[3] + 1) for c in range(m[2], m[4] + 1)}
    last = max(r for r, _ in filled)

    def at(r, c):
        return filled.get(corner.get((r, c), (r, c)), (None, None, False))

    def row_texts(r):
        found = [(c, at(r, c)[0]) for c in range(1, 40)]
        return [(c, t) for i, (c, t) in enumerate(found) if t and (i == 0 or found[i - 1][1] != t)]

    wide, titled, keyword = set(), {}, set()
    for r in range(1, last + 1):
        texts = row_texts(r)
        if texts and (len(texts) >= 4 or texts[-1][0] - texts[0][0] >= 15):
            wide.add(r)
        elif texts and texts[0][0] <= 4 and len({t for _, t in texts}) <= 2 and at(r, texts[0][0])[2]:
            is_key = bool(re.search("(?i)" + fixed.SECTION_KEYWORD, texts[0][1]))
            keyword |= {r} if is_key else set()
            if is_key or (texts[0][0] >= 2 and len(texts[0][1]) >= 4):
                titled[r] = texts[0][1]
    sections = keyword or set(titled)
    groups = set(titled) - sections
    out = {}
    for r, c in targets:
        inner = max((s for s in sections if s < r), default=0)
        outer = max((s for s in sections if s < inner), default=0)
        section = ([titled[outer]] if outer and inner - outer <= 2 else []) + ([titled[inner]] if inner else [])
        leaf, number_seen, noted = [], False, False
        for cc in range(1, c):
            t, n, _ = at(r, cc)
            if t:
                noted |= number_seen
                leaf += [t] if leaf[-1:] != [t] else []
            elif n is not None and leaf:
                number_seen = True
        group = []
        if r not in titled:
            column = next((cc for cc in range(1, c) if at(r, cc)[0]), 2)
            for rr in range(r - 1, inner, -1):
                if rr in groups:
                    group = [titled[rr]]
                elif rr not in wide and at(rr, column)[0] and re.search("(?i)" + fixed.GROUP_HEADER, at(rr, column)[0]):
                    group = [at(rr, column)[0]]
                if group:
                    break
        band = []
        for rr in range(r - 1, inner, -1):
            t, n, _ = at(rr, c)
            if t:
                band = [t, *band] if band[:1] != [t] else band
            elif band:
                noted |= n is None and bool(at(rr, c + 1)[0] or (c > 1 and at(rr, c - 1)[0]))
                break
        labels = (section, group + leaf, band)
        status = "NO_CONTEXT" if not any(labels) else "AMBIGUOUS" if noted else "COMPLETE" if labels[1] and labels[2] else "PARTIAL"
        out[r, c] = (*labels, status)
    return out


def labels(spark, cells, merges, targets):
    found = layout.cell_labels(
        spark.createDataFrame(cells, GRID), spark.createDataFrame([("S", r, c) for r, c in targets], "sheet string, row_no int, col_no int"),
        merges=spark.createDataFrame(merges, RANGES) if merges else None)
    return {(r.row_no, r.col_no): (r.section_labels, r.row_labels, r.column_labels, r.context_status) for r in found.collect()}


def test_merged_headers_reach_every_column(spark):
    cells = [("S", 1, 3, "AGE GROUP", None, False), ("S", 2, 3, "20 TO 24", None, False), ("S", 3, 3, "Men", None, False), ("S", 3, 4, "Women", None, False),
             ("S", 5, 2, "Activity", None, False), ("S", 5, 3, None, 1.0, False), ("S", 5, 4, None, 2.0, False)]
    got = labels(spark, cells, [("S", 1, 3, 1, 6), ("S", 2, 3, 2, 4)], [(5, 3), (5, 4), (5, 5)])
    assert got[5, 3] == ([], ["Activity"], ["AGE GROUP", "20 TO 24", "Men"], "COMPLETE")
    assert got[5, 4] == ([], ["Activity"], ["AGE GROUP", "20 TO 24", "Women"], "COMPLETE")
    assert got[5, 5][2] == ["AGE GROUP"]
    sections = [("S", 1, 2, "FIRST PART", None, True), ("S", 2, 2, "SECOND PART", None, True), ("S", 4, 2, "0601", None, False), ("S", 4, 4, None, 3.0, False)]
    assert labels(spark, sections, [("S", 1, 2, 1, 3), ("S", 2, 2, 2, 3)], [(4, 4)])[4, 4][0] == ["FIRST PART", "SECOND PART"]
    wide = [("S", 4, 2, "Ward", None, False), ("S", 4, 4, None, 5.0, False), ("S", 4, 3, "hidden", None, False)]
    assert labels(spark, wide, [("S", 4, 2, 4, 3)], [(4, 4)])[4, 4][1] == ["Ward"]


@pytest.mark.parametrize("seed", [1, 2])
def test_grids_against_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(layout, "BLOCK_ROWS", 7)
    rng = random.Random(seed)
    texts = ["SECCIÓN A: x", "A.1. group", "B.2. other", "Men", "Women", "obs", "long title", "abc"]
    taken, merges = set(), []
    for _ in range(25):
        r, c = rng.randint(1, 55), rng.randint(1, 7)
        r2, c2 = r + rng.choice([0, 0, 1, 3]), c + rng.choice([0, 1, 2, 4])
        area = {(x, y) for x in range(r, r2 + 1) for y in range(c, c2 + 1)}
        if not area & taken:
            taken |= area
            merges.append(("S", r, c, r2, c2))
    cells = []
    for r in range(1, 60):
        for c in range(1, 11):
            x = rng.random()
            if x < 0.35:
                cells.append(("S", r, c, rng.choice(texts if seed == 1 else texts[1:]), None, rng.random() < 0.5))
            elif x < 0.6:
                cells.append(("S", r, c, None, 1.0, False))
    targets = [(r, c) for r in range(1, 62) for c in range(1, 13)]
    assert labels(spark, cells, merges, targets) == walk(cells, merges, targets)
    assert labels(spark, cells, [], targets) == walk(cells, [], targets)


def test_blank_corners_and_empty_grids(spark):
    cells = spark.createDataFrame([("S", 1, 1, "a", None, False), ("S", 2, 2, "b", None, True), ("S", 9, 9, None, 1.0, False)], GRID)
    merges = spark.createDataFrame([("S", 2, 1, 2, 3), ("S", 20, 1, 22, 4)], RANGES)
    assert sorted((r.row_no, r.col_no) for r in layout.spread_merges(cells, merges).collect()) == [(1, 1), (9, 9)]
    assert layout.spread_merges(cells, merges.limit(0)).count() == 3
    assert layout.header_rows(cells.limit(0), merges).count() == 0
    assert layout.cell_labels(cells.limit(0), cells.limit(0), merges=merges).count() == 0
    assert layout.cell_labels(cells, cells.filter("number > 0"), merges=merges).first().context_status == "NO_CONTEXT"
