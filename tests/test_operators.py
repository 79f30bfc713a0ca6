from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from metricspark.functions import criteria
from metricspark.operators import (
    align, checks, classify, decide, diff, graph, layout, manifest, metrics, reconcile, scope, summary,
)
from metricspark.sources import catalog, publish, scan


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)


def brute_counts(records, terms):
    """The catalog by definition: every term over every record."""
    def holds(raw, value):
        c = criteria.parse_criterion(raw)
        if c.number is not None:
            try:
                n = float(value)
            except (TypeError, ValueError):
                return False
            return {"": n == c.number, "=": n == c.number, "<>": n != c.number, "<": n < c.number,
                    "<=": n <= c.number, ">": n > c.number, ">=": n >= c.number}[c.op]
        same = str("" if value is None else value).lower() == c.text
        return not same if c.op == "<>" else same

    out = {}
    for period in {r["period"] for r in records}:
        for t in terms:
            n = sum(all(holds(raw, r[c]) for c, raw in t.predicates)
                    for r in records if r["period"] == period)
            out[period, t.metric_id] = out.get((period, t.metric_id), 0) + t.sign * n
    return out


def test_metric_counts_against_brute_force(spark):
    rng = random.Random(7)
    records = [{"period": rng.choice("ab"), "sex": rng.choice(["F", "f", "M", None, ""]),
                "age": rng.choice([None, 0, 5, 17, 18, 40]), "kind": rng.choice(["x", "y|z", "y"])} for _ in range(300)]
    terms = [metrics.Term("all"), metrics.Term("none", (("age", ">100"),)), metrics.Term("never", (("sex", "F"), ("sex", "M"))),
             metrics.Term("diff", (("sex", "F"),)), metrics.Term("diff", (("sex", "M"), ("age", ">=18")), -1),
             metrics.Term("blank", (("sex", ""),)), metrics.Term("eq", (("age", "18"), ("kind", "Y|Z")))]
    terms += [metrics.Term(f"g{i}", (("sex", s), ("age", a), ("kind", k))) for i, (s, a, k) in enumerate(
        itertools.product(["F", "<>F"], ["<5", ">=5", "<>18", "=40"], ["x", "<>y"]))]
    df = spark.createDataFrame(records, "period string, sex string, age int, kind string")
    got = {(r["period"], r["metric_id"]): r["value"] for r in metrics.metric_counts(df, terms).collect()}
    assert got == brute_counts(records, terms)


def test_catalog_tables(spark):
    terms = spark.createDataFrame([("f", 1, 1), ("t", 1, 1), ("t", 2, 1)], catalog.TERM_SCHEMA)
    preds = spark.createDataFrame([("f", 1, 1, "sex", "", "F"), ("t", 2, 1, "sex", "<>", "F")], catalog.PREDICATE_SCHEMA)
    loaded = catalog.load_terms(terms, preds)
    assert [(t.metric_id, t.predicates) for t in loaded] == [("f", (("sex", "F"),)), ("t", ()), ("t", (("sex", "<>F"),))]
    with pytest.raises(catalog.CatalogError):
        catalog.load_terms(terms.unionAll(terms), preds)
    with pytest.raises(catalog.CatalogError):
        catalog.load_terms(terms.filter("metric_id = 'f'"), preds)


def test_catalog_header_is_exact(spark, tmp_path):
    (tmp_path / "m.csv").write_text("instruction_id,metric_id,sheet,target,expected_value_type,version\ni,m,s,t,NUMERIC,v\n")
    (tmp_path / "bad.csv").write_text("metric_id,instruction_id\nm,i\n")
    assert catalog.read_catalog(spark, str(tmp_path / "m.csv"), catalog.MANIFEST_SCHEMA).count() == 1
    with pytest.raises(catalog.CatalogError):
        catalog.read_catalog(spark, str(tmp_path / "bad.csv"), catalog.MANIFEST_SCHEMA)


def test_harmonised_scan(spark):
    headers = ["Fecha Cita", "Fecha de Nacimiento", "sexo", "Sucursal", "Especialidad", "Tipo Cita", "Prestación",
               "Dia cita", "RUT"]
    df = spark.createDataFrame([tuple("abcdefghi")], headers)
    found = scan.harmonise(df)
    assert found.df.columns[0] == "DIA_CITA" and found.df.first()["DIA_CITA"] == "a"
    assert "RUT" not in found.df.columns and found.missing_optional == ("ESTADO", "MODALIDAD", "PRESTACION_REALIZADA")
    with pytest.raises(scan.MissingFields, match="SEXO.*PRESTACION"):
        scan.harmonise(df.drop("sexo", "Prestación"))
    decoy = spark.createDataFrame([(1,)], ["x"])
    assert scan.best_candidate([decoy, df]) is df


def detail(spark, records):
    fields = ("DIA_CITA", "FECHA_NACIMIENTO", "SEXO", "TIPO_DE_CITA", "ESTADO")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(records)], "id int, " + ", ".join(f"{f} string" for f in fields))
    layout_ = scope.RecordLayout(fields=fields)
    return scope.scope_flags(scan.typed(df, fields, keep=["id"]), layout_), layout_


def test_scope_and_diagnostics(spark):
    flags, lay = detail(spark, [
        ("10/07/2026", "01/01/1990", "Mujer", "C", "Atendido"), ("11/07/2026", "", "Hombre", "C", " atendido "),
        ("12/07/2026", "x", "Hombre", "C", "Cancelado"), ("no", "", " ", "C", None), ("01/06/2026", "", "", "C", "Atendido"),
        ("01/08/2026", "02/08/2026", "Mujer", "C", None), (None, " ", "", "nan", None)])
    diag = {str(r["period"]): r for r in scope.invalid_diagnostics(flags, lay).collect()}
    july = diag["2026-07-01"]
    assert (july["valid_records"], july["invalid_records"], july["unassigned_records"]) == (2, 2, 1)
    assert july["dia_cita_invalid"] == 1 and july["sexo_empty"] == 1 and july["blocked"]
    assert diag["2026-06-01"]["invalid_records"] == 2
    totals = scope.scope_counts(flags, lay, "2026-07-01", "2026-08-01", F.lit(True)).first()
    assert totals["structural_empty_rows"] == 1 and totals["total_records"] == 6 and totals["consistent"]
    kept = scope.status_filter(flags.filter("valid"), "ESTADO", scope.StatusRule())
    assert rows(kept, "id") == [(0,), (1,)]
    assert scope.status_filter(flags, "ESTADO", scope.StatusRule(confirmed=False)).count() == 7
    listed = scope.row_problems(flags, lay, "id", limit=3)
    assert [r["truncated"] for r in listed.collect()] == [True] * 3
    assert [str(r[0]) for r in scope.detect_periods(flags).collect()] == ["2026-07-01", "2026-08-01"]


def test_strict_and_derived(spark):
    rules = [classify.StrictRule("a", {"f": {"eq": "niño"}}, {"k": "1"}), classify.StrictRule("b", {"f": {"starts_with": "NI"}}, {"k": "2"})]
    df = spark.createDataFrame([("Niño ",), ("nieto",), ("otro",)], "f string")
    assert rows(classify.strict_classify(df, rules), "rule_status") == [("AMBIGUOUS",), ("OK",), ("UNKNOWN",)]
    with pytest.raises(classify.UnknownOperator):
        classify.condition(F.col("f"), {"like": "x"})
    rec = spark.createDataFrame([("CONTROL PERIODONCIA", "S", "F", "E", "Control Splint y control aparato fijo", None, None)],
                                "TIPO_DE_CITA string, SUCURSAL string, SEXO string, ESPECIALIDAD string, PRESTACION string, "
                                "DIA_CITA date, FECHA_NACIMIENTO date")
    out = classify.derived_columns(rec).first()
    assert (out["AC"], out["AG"], out["AH"], out["AJ"], out["AK"], out["AF"]) == (
        "CONTROL PERIODONCIAS", "#N/A", "control odon espF", "2F", "0F", None)


def test_graph_cycles_missing_and_provenance(spark):
    edges = spark.createDataFrame([("t", "a", 1), ("t", "b", 1), ("u", "t", 1), ("u", "a", -1), ("m", "zz", 1), ("x", "y", 1), ("y", "x", 1),
                                   ("z", "x", 1)], "metric_id string, dep_metric_id string, sign int")
    base = spark.createDataFrame([("a", 2), ("b", None)], "metric_id string, value int")
    depth = {r["metric_id"]: (r["depth"], r["cyclic"]) for r in graph.dag_depth(edges).collect()}
    assert depth["u"] == (2, False) and depth["z"] == (None, True) and depth["a"] == (0, False)
    values = {r["metric_id"]: (r["value"], r["available"]) for r in graph.derived_metrics(base, edges).collect()}
    assert values["t"] == (2.0, True) and values["u"] == (0.0, True)
    assert values["m"] == (None, False) and values["z"] == (None, False)
    src = spark.createDataFrame([("a",)], "metric_id string")
    assert rows(graph.dag_closure(edges, src)) == [("a", 0), ("t", 1), ("u", 1)]
    direct = spark.createDataFrame([("a", "S", "OK", False), ("b", "E", "OK", False)],
                                   "metric_id string, source string, status string, needs_review boolean")
    derived = spark.createDataFrame([("t",), ("u",), ("q",)], "metric_id string")
    got = {r["metric_id"]: (r["source"], r["needs_review"]) for r in graph.provenance(direct, derived, edges).collect()}
    assert got == {"a": ("S", False), "b": ("E", False), "t": ("MIXED_DERIVED", False), "u": ("MIXED_DERIVED", True),
                   "q": ("UNKNOWN_PENDING", True)}


def test_multiset_excess_on_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    other = df.filter("k = 'hot'").limit(700).select("k")
    got = [r[0] for r in reconcile.multiset_excess(df, other, F.col("k"), "id").filter("k = 'hot'").orderBy("id").collect()]
    assert got == [3 * i for i in range(700, 1667)]
    check = reconcile.multiset_check(other, df, F.col("k")).first()
    assert (check["matched"], check["unmatched"], check["excess"]) == (700, 0, 4300)


def test_range_edges_against_brute_force(spark):
    rng = random.Random(3)
    cells = sorted({(rng.choice("AB"), rng.randint(1, 5000), rng.randint(1, 5)) for _ in range(300)})
    ranges = []
    for i in range(60):
        lo = rng.randint(1, 5000)
        ranges.append(("A", 9000 + i, 1, 0, rng.choice("AB"), lo, lo + rng.choice([0, 1, 7, 300, 4000]), 1, rng.randint(1, 5)))
    ranges.append(("A", 9999, 1, 0, "B", 1, 1_048_576, 2, 2))
    df = diff.range_edges(
        spark.createDataFrame(cells, "sheet string, row_no int, col_no int"),
        spark.createDataFrame(ranges, "target_sheet string, target_row int, target_col int, ref_no int, ref_sheet string, "
                                      "row_start int, row_end int, col_start int, col_end int"))
    want = {(c, r[1]) for c in cells for r in ranges if c[0] == r[4] and r[5] <= c[1] <= r[6] and r[7] <= c[2] <= r[8]}
    assert {((r["sheet"], r["row_no"], r["col_no"]), r["target_row"]) for r in df.collect()} == want


def test_nearest_above_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK_ROWS", 10)
    marks = [3, 4, 41, 99]
    points = spark.createDataFrame([("s", r) for r in range(1, 120)], "sheet string, row_no int")
    m = spark.createDataFrame([("s", r) for r in marks], "sheet string, row_no int").withColumn("payload", F.col("row_no"))
    got = {r["row_no"]: r["up"] for r in layout.nearest_above(points, m, ["sheet"], "up").collect()}
    assert got == {r: max((x for x in marks if x < r), default=None) for r in range(1, 120)}


def test_publish_refuses_and_never_overwrites(spark, tmp_path):
    ddl = "target string, value double, instruction_id string, metric_id string, expected_value_type string, day string"
    good = [("t1", 1.0, "i1", "a", "NUMBER", "x"), ("t2", 2.0, "i2", "b", "NUMBER", "y")]
    values = spark.createDataFrame([("a",), ("b",)], "metric_id string")

    def put(data, name, **more):
        return publish.publish(spark.createDataFrame(data, ddl), more.pop("values", values), str(tmp_path / name), **more)

    assert rows(put(good, "out", partition_by=["day"]), "target", "status") == [("t1", "OK"), ("t2", "OK")]
    assert {p.name for p in (tmp_path / "out").iterdir()} >= {"_VERIFIED", "day=x", "day=y"} and not list(tmp_path.glob("*staged*"))
    with pytest.raises(Exception, match="exists"):
        put(good, "out")
    one, two = good
    bad = {"DUPLICATE_TARGET": [one, ("t1", *two[1:])], "DUPLICATE_INSTRUCTION": [one, (*two[:2], "i1", *two[3:])],
           "NEGATIVE_VALUE": [one, ("t2", -1.0, *two[2:])], "NULL_VALUE": [one, ("t2", None, *two[2:])], "ORPHAN_INSTRUCTION": [one],
           "MISSING_INSTRUCTION": [*good, ("t3", 1.0, "i3", "c", "NUMBER", "x")]}
    for name, data in bad.items():
        with pytest.raises(publish.PublishRefused, match=name):
            put(data, "other")
    with pytest.raises(publish.PublishRefused, match="violation"):
        put(good, "other", violations=[spark.createDataFrame([("s", "ALTERED")], "sheet string, violation string")])
    assert not (tmp_path / "other").exists()
    doubled = publish.verify_readback(spark.createDataFrame([one], ddl), spark.createDataFrame([one, one], ddl))
    assert rows(doubled, "target", "status") == [("t1", "VALUE_MISMATCH")]


def test_nothing_is_cut(spark):
    """Ranges of any length, all positions, all changes, all problems."""
    cells = spark.createDataFrame([("s", 1, 1), ("s", 2**40, 1), ("s", 2**40, 2**33)], "sheet string, row_no long, col_no long")
    for last in (2**31 - 1, 2**31, 2**62):
        ranges = spark.createDataFrame([("t", 1, 1, 0, "s", 1, last, 1, 2**34)],
                                       "target_sheet string, target_row long, target_col long, ref_no int, ref_sheet string, row_start long, row_end long, "
                                       "col_start long, col_end long")
        assert diff.range_edges(cells, ranges).count() == (3 if last > 2**40 else 1)
    keys = spark.range(2500).select((F.col("id") * 7919 % 2500).alias("k"), (F.col("id") % 3).alias("j"))
    assert {(r.k, r.position) for r in summary.ordered_positions(keys, ["k"]).collect()} == {(i, i + 1) for i in range(2500)}
    grid = "sheet string, row_no int, col_no int, value_num double"
    before = spark.createDataFrame([("s", i, 1, 1.0) for i in range(120)], grid)
    after = spark.createDataFrame([("s", i, 1, 1.0 + i) for i in range(120)], grid)
    assert [r.row_no for r in diff.ordered_changes(before, after).collect()] == list(range(119, -1, -1))
    assert diff.ordered_changes(before, after, 5).count() == 5
    lay = scope.RecordLayout(fields=("DIA_CITA", "FECHA_NACIMIENTO", "SEXO", "TIPO_DE_CITA"))
    flags = spark.range(700).selectExpr("id", "false AS birth_after", "false AS service_bad", "false AS birth_bad", "true AS SEXO_empty", "false AS TIPO_DE_CITA_empty")
    assert scope.row_problems(flags, lay, "id").count() == 700 and scope.row_problems(flags, lay, "id", limit=5).count() == 5


def test_derived_metrics_take_all_kinds(spark):
    """Own counts with dependencies, literals alone, whole results."""
    base = spark.createDataFrame([("a", 2), ("m", 3)], "metric_id string, value int")
    edges = spark.createDataFrame([("m", "a", 1), ("n", "m", -1)], "metric_id string, dep_metric_id string, sign int")
    literals = spark.createDataFrame([("m", 5), ("k", 7)], "metric_id string, value int")
    got = [(r.metric_id, r.value) for r in graph.derived_metrics(base, edges, literals).collect()]
    assert sorted(got) == [("a", 2), ("k", 7), ("m", 10), ("n", -10)] and all(isinstance(v, int) for _, v in got)


def test_covered_cells_read_their_corner(spark):
    cells = spark.createDataFrame([("s", 1, 3, 5.0, "Mujer"), ("s", 9, 9, 1.0, None)], "sheet string, row_no int, col_no int, value_num double, value_txt string")
    merges = spark.createDataFrame([("s", 1, 3, 1, 4)], "sheet string, r1 int, c1 int, r2 int, c2 int")
    targets = spark.createDataFrame([("s", 1, 3), ("s", 1, 4), ("s", 2, 4)], "sheet string, row_no int, col_no int")
    got = rows(diff.merge_anchor(cells, merges, targets), "row_no", "col_no", "anchor_col", "value_txt")
    assert got == [(1, 3, 3, "Mujer"), (1, 4, 3, "Mujer"), (2, 4, 4, None)]


def test_age_bounds_from_predicates(spark):
    metrics_in = spark.createDataFrame([("a",), ("b",)], "metric_id string")
    predicates = spark.createDataFrame([("a", ">=", 18.0), ("a", ">", 19.0), ("a", "<", 65.0)], "metric_id string, op string, number double")
    got = {r.metric_id: r.formula_age for r in decide.with_formula_age(metrics_in, predicates).collect()}
    assert tuple(got["a"]) == (20, 64) and got["b"] is None


def test_provenance_on_a_cycle_uses_what_is_known(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "a"), ("p", "q"), ("q", "p")], "metric_id string, dep_metric_id string")
    direct = spark.createDataFrame([("a", "S", "OK", False)], "metric_id string, source string, status string, needs_review boolean")
    derived = spark.createDataFrame([("x",), ("y",), ("p",), ("q",)], "metric_id string")
    got = {r.metric_id: (r.source, r.needs_review) for r in graph.provenance(direct, derived, edges).collect()}
    assert got == {"a": ("S", False), "x": ("S", False), "y": ("UNKNOWN_PENDING", True), "p": ("UNKNOWN_PENDING", True), "q": ("UNKNOWN_PENDING", True)}


def test_null_dependency_counts_as_independent(spark):
    rows_in = [("f", "REAL_MISMATCH", 1.0, 1.0, None), ("f", "EXACT_MATCH", 0.0, 1.0, None)]
    df = spark.createDataFrame(rows_in, "form string, status string, delta double, reference double, age boolean")
    stats = reconcile.mismatch_stats(df, "form", F.col("age")).filter("form = 'f'").first()
    assert (stats.independent_compared, stats.dependent_compared) == (2, 0)


def test_completeness_and_collisions(spark):
    values = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "metric_id string, value int")
    wanted = spark.createDataFrame([("a", "t1", "i1"), ("b", "t1", "i2")], "metric_id string, target string, instruction_id string")
    assert rows(manifest.completeness(values, wanted)) == [("duplicate", "a"), ("missing", "b"), ("orphan", "c")]
    assert rows(manifest.block_collisions(wanted), "metric_id", "blocked") == [("a", True), ("b", True)]


def test_nested_checks(spark):
    values = spark.createDataFrame([("m", "5")], "metric_id string, value string")
    ddl = ("check_id string, left_kind string, left_ref string, op string, right_kind string, right_ref string, then_kind string, "
           "then_ref string, otherwise_kind string, otherwise_ref string")
    table = spark.createDataFrame([
        ("a", "METRIC", "m", ">", "NUM", "3", "CHECK", "b", "STR", "no"), ("b", "METRIC", "m", "=", "STR", "5", "STR", "yes", "NUM", "0"),
        ("c", "METRIC", "gone", "=", "NUM", "1", "STR", "x", "STR", "y"), ("d", "STR", "abc", "<", "NUM", "1", "STR", "x", "STR", "y"),
        ("e", "NUM", "1", "=", "NUM", "1", "CHECK", "f", "STR", "y"), ("f", "NUM", "1", "=", "NUM", "1", "CHECK", "e", "STR", "y")], ddl)
    assert rows(checks.metric_checks(table, values)) == [
        ("a", True, "yes"), ("b", True, "yes"), ("c", False, None), ("d", False, None), ("e", False, None), ("f", False, None)]


def test_alignment_outcomes(spark):
    ddl = ("form string, section array<string>, row_path array<string>, column_path array<string>, sex string, sex_status string, "
           "age_lo int, age_hi int, age_status string, scope string, code string")
    def source(i, row, sex="MALE", section=("S",)):
        return (i, "F", list(section), [row], ["C"], sex, "CONFIRMED", 1, 4, "CONFIRMED", "DETAIL", "")
    def target(cell, row, sex="MALE"):
        return (cell, "DIRECT_INPUT_TARGET", "NATIVE", "F", ["S"], [row], ["C"], sex, "CONFIRMED", 1, 4, "CONFIRMED", "DETAIL", "")
    sources = spark.createDataFrame([source("exact", "r1"), source("twin", "r2"), source("clash", "r3"), source("near", "zz"),
                                     source("lost", "r1", section=("Q",)), source("none", "q", section=("Q",))], "metric_id string, " + ddl)
    targets = spark.createDataFrame([target("A1", "r1"), target("B1", "r2"), target("B2", "r2"), target("C1", "r3", "FEMALE"),
                                     target("C2", "r3", "FEMALE")], "target_cell string, target_kind string, expectation string, " + ddl)
    got = {r["metric_id"]: (r["outcome"], r["target_cell"]) for r in align.best_matches(sources, targets).collect()}
    assert got["exact"] == ("EXACT_SEMANTIC_MATCH", "A1")
    assert got["twin"] == ("AMBIGUOUS", "B1")
    assert got["none"] == ("NO_TARGET", None)
    assert got["near"][0] == "AMBIGUOUS" and got["lost"] == ("STRONG_MATCH", "A1")


def test_summaries(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 3 + [("c",)] * 2 + [(None,)], "k string")
    top = summary.top_n_other(df, summary.clean_label(F.col("k")), 2, "rest")
    assert rows(top) == [("a", 5, 1), ("b", 3, 2), ("rest", 3, 3)]
    assert rows(summary.distribution(df, F.col("k")), "n", "percent") == [(1, 9.09), (2, 18.18), (3, 27.27), (5, 45.45)]
    assert rows(summary.aggregate_long(df.limit(0), ["k"])) == []
    with pytest.raises(summary.MissingDimension):
        summary.aggregate_long(df, ["zz"])


@pytest.mark.parametrize("block", [3, 2048])
def test_a_common_label_is_dealt_over_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(align, "LABEL_BLOCK", block)
    cells = spark.createDataFrame([(f"c{i:02}", "Total mes") for i in range(20)] + [("z", "Other")], "cell string, label string")
    sources = spark.createDataFrame([(f"s{i:02}", "Total mes") for i in range(20)] + [("t", "other.")], "id string, label string")
    for limit, want in ((None, 20), (7, 7)):
        found = align.label_cascade(sources, cells, limit=limit).withColumn("task", F.spark_partition_id())
        got = sorted((r["id"], r["cell"]) for r in found.collect())
        assert got == sorted([(f"s{i:02}", f"c{k:02}") for i in range(20) for k in range(want)] + [("t", "z")])
        if block == 3:
            assert len({r["task"] for r in found.collect() if r["cell"] != "z"}) > 1


def test_labels_are_read_once_and_joined_by_blocks(spark, monkeypatch):
    """Rows are not normalised one by one, and joins make a row per block of cells, not per cell."""
    monkeypatch.setattr(align, "LABEL_BLOCK", 10)
    texts = ("Total  mes", "TOTAL MES.", None, "4567 - 4567", "zz")
    cells = spark.createDataFrame([(f"c{i:03}", texts[i % 5]) for i in range(250)], "cell string, label string")
    sources = spark.createDataFrame([(f"s{i:03}", ("total mes", "Total  mes", "4567", None, "zz")[i % 5]) for i in range(250)], "id string, label string")
    found = align.label_cascade(sources, cells)
    got = sorted((r.id, r.cell, r.match_type, r.total_hits) for r in found.collect())
    by = {k: [f"c{i:03}" for i in range(250) if i % 5 in k] for k in ((0,), (0, 1), (3,))}
    want = [(f"s{i:03}", c, "ambiguous", n) for i in range(250) for c, n in {
        0: [(c, 100) for c in by[0, 1]], 1: [(c, 50) for c in by[0,]], 2: [(c, 100) for c in by[3,] * 2]}.get(i % 5, [])]
    assert got == sorted(want)
    most, plans = 0, [found._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "AdaptiveSparkPlan":
            plans.append(plan.executedPlan())
        elif plan.nodeName().endswith("QueryStage"):
            plans.append(plan.plan())
        if "Join" in plan.nodeName():
            most = max(most, plan.metrics().apply("numOutputRows").value())
        assert "regexp" not in plan.simpleString(1 << 20)
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    assert 0 < most < len(want) / 2


def test_defaults_cut_nothing(spark):
    cells = spark.createDataFrame([(f"c{i:02}", "Total mes") for i in range(9)], "cell string, label string")
    sources = spark.createDataFrame([("a", "Total mes"), ("b", "TOTAL MES.")], "id string, label string")
    found = rows(align.label_cascade(sources, cells), "id", "cell", "total_hits")
    assert found == [(i, f"c{k:02}", 9) for i in "ab" for k in range(9)]
    assert align.label_cascade(sources, cells, limit=6).count() == 12

    wide = spark.range(50).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("f"), F.lit(False).alias("f_blank"))
    profile = rows(summary.column_profile(wide.unionByName(wide.filter("f = 'v07'")), ["f"]), "rank", "value", "n", "distinct_values")
    order = ["v07"] + [f"v{i:02}" for i in range(50) if i != 7]
    assert sorted(profile) == [(k + 1, v, 2 if k == 0 else 1, 50) for k, v in enumerate(order)]

    born = spark.sql("SELECT * FROM VALUES (DATE'2000-01-01'), (DATE'2030-01-01'), (NULL) AS t(b)").withColumn("s", F.lit("2024-06-01").cast("date"))
    ages = rows(summary.age_bands(born, "b", "s", bands=[("adult", 18, 99)]), "label", "n", "position")
    assert ages == [("(fuera de rango)", 1, 3), ("(sin dato)", 1, 2), ("adult", 1, 1)]

    from metricspark.functions import labels as L
    ends = spark.sql("SELECT 250 AS a, CAST(NULL AS INT) AS b, 240 AS c, CAST(NULL AS INT) AS d, 'CONFIRMED' AS s")
    assert ends.select(L.age_evidence(*[F.col(x) for x in "absc"], F.col("d")) == L.PARTIAL).first()[0]

    grid = [("S", r, 5, f"level {r}", None, False) for r in range(1, 6)] + [("S", 6, c, f"row {c}", None, False) for c in range(1, 5)] + [("S", 6, 5, None, 1.0, False)]
    grid = spark.createDataFrame(grid, "sheet string, row_no int, col_no int, text string, number double, bold boolean")
    got = layout.cell_labels(grid, grid.filter("number IS NOT NULL")).first()
    assert got.row_labels == [f"row {c}" for c in range(1, 5)] and got.column_labels == [f"level {r}" for r in range(1, 6)]
