"""Scans, scoping, diagnostics and summaries of detail records."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.dates import period_label
from metricspark.operators import classify, scope, summary
from metricspark.plans import views as v
from metricspark.plans.registry import ORACLES, query
from metricspark.sources import scan

LAYOUT = scope.RecordLayout(fields=v.DETAIL_FIELDS)
START, END = "1997-03-01", "1997-04-01"
_HEADERS = {
    "DIA_CITA": "  Fecha  Cita ", "FECHA_NACIMIENTO": "Fecha de Nacimiento", "SEXO": "Sexo",
    "SUCURSAL": "SUCURSAL", "ESPECIALIDAD": "Especialidad", "TIPO_DE_CITA": "Tipo cita",
    "PRESTACION": "Prestación", "ESTADO": "Estado (cita)", "MODALIDAD": "modalidad",
}
_INCLUDED = ", ".join(f"'{s.lower()}'" for s in fixed.INCLUDED_STATES)
_STATUS_SQL = f"coalesce(lower({v.trim_sql('ESTADO')}) IN ({_INCLUDED}), false)"
_IN = f"DIA_CITA >= DATE '{START}' AND DIA_CITA < DATE '{END}'"


def raw_export(t):
    """The export as delivered: untidy headers and columns nobody asked for."""
    return t.sql(v.RAW_DETAIL).withColumnsRenamed(_HEADERS)


def typed(t):
    found = scan.harmonise(raw_export(t), keep=["id"])
    return scan.typed(found.df, found.detected, keep=["id"], moments=True)


def flags(t):
    return scope.scope_flags(typed(t), LAYOUT)


def label_sql(x):
    return f"coalesce(nullif({v.trim_sql(x)}, ''), '{fixed.MISSING_LABEL}')"


def _quoted(values):
    return ", ".join("'" + x.lower() + "'" for x in values)


def category_sql(code):
    _, field, op, _, values = next(c for c in fixed.CATEGORIES if c[0] == code)
    if op == "equals":
        return f"lower({field}) IN ({_quoted(values)})"
    return "(" + " OR ".join(f"contains(lower({field}), '{x.lower()}')" for x in values) + ")"


_CODES = [c[0] for c in fixed.CATEGORIES]
_ANY_CATEGORY = "(" + " OR ".join(category_sql(c) for c in _CODES) + ")"


@query("scan_harmonised", f"WITH raw AS ({v.plain(v.RAW_DETAIL)}) "
       f"SELECT id, {', '.join(v.DETAIL_FIELDS)} FROM raw")
def scan_harmonised(t):
    return scan.harmonise(raw_export(t), keep=["id"]).df


@query("scan_typed", f"WITH {v.DETAIL_CTE} SELECT id, {', '.join(v.DETAIL_FIELDS)}, "
       f"{', '.join(f + '_blank' for f in v.DETAIL_FIELDS)}, {', '.join(f'CAST({f} AS TIMESTAMP) AS {f}_at' for f in v.DATES)} FROM typed")
def scan_typed(t):
    return typed(t)


@query("blank_profile", f"WITH {v.DETAIL_CTE} " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f}_blank) AS blank, "
    f"count(*) FILTER (WHERE NOT {f}_blank) AS filled, count(*) AS total FROM typed"
    for f in v.DETAIL_FIELDS))
def blank_profile(t):
    return scope.blank_profile(typed(t), v.DETAIL_FIELDS)


@query("scope_counts", f"""WITH {v.DETAIL_CTE},
scoped AS (SELECT *, valid AND {_IN} AS inside, {_ANY_CATEGORY} AS labelled FROM flags)
SELECT count(*) AS physical_rows, count(*) FILTER (WHERE NOT active) AS structural_empty_rows,
  count(*) FILTER (WHERE valid) AS valid_records, count(*) FILTER (WHERE invalid) AS invalid_records,
  count(*) FILTER (WHERE inside) AS scope_records,
  count(*) FILTER (WHERE inside AND labelled) AS labelled_records,
  count(*) FILTER (WHERE inside AND NOT labelled) AS unlabelled_records,
  count(*) FILTER (WHERE inside AND FECHA_NACIMIENTO <= DIA_CITA) AS age_computed,
  count(*) FILTER (WHERE inside AND FECHA_NACIMIENTO > DIA_CITA) AS age_zero,
  count(*) FILTER (WHERE inside AND FECHA_NACIMIENTO IS NULL) AS age_missing,
  min(DIA_CITA) FILTER (WHERE valid) AS first_date, max(DIA_CITA) FILTER (WHERE valid) AS last_date,
  count(*) FILTER (WHERE active) AS total_records,
  count(*) FILTER (WHERE valid AND NOT inside) AS out_of_period_records, true AS consistent
FROM scoped""")
def scope_counts(t):
    labelled = F.size(classify.category_codes()) > 0
    return scope.scope_counts(flags(t), LAYOUT, START, END, labelled)


@query("period_scope", f"WITH {v.DETAIL_CTE} SELECT id, DIA_CITA, FECHA_NACIMIENTO, SEXO, "
       f"TIPO_DE_CITA, ESTADO FROM flags WHERE valid AND {_IN}")
def period_scope(t):
    return scope.period_scope(flags(t), LAYOUT, START, END).select(
        "id", "DIA_CITA", "FECHA_NACIMIENTO", "SEXO", "TIPO_DE_CITA", "ESTADO")


@query("period_breakdown", f"""WITH {v.DETAIL_CTE}
SELECT count(*) AS physical_records, count(*) FILTER (WHERE valid) AS structurally_valid_records,
  count(*) FILTER (WHERE NOT valid) AS structurally_invalid_records,
  count(*) FILTER (WHERE valid AND {_IN}) AS in_period_records,
  count(*) FILTER (WHERE valid AND NOT ({_IN})) AS out_of_period_records FROM flags""")
def period_breakdown(t):
    return scope.period_breakdown(flags(t), LAYOUT, START, END)


@query("detect_periods", f"WITH {v.DETAIL_CTE} SELECT DISTINCT period FROM flags WHERE valid")
def detect_periods(t):
    return scope.detect_periods(flags(t))


_DIAGNOSTICS = f"""{v.DETAIL_CTE},
loose AS (SELECT count(*) FILTER (WHERE invalid) AS n, count(*) FILTER (WHERE service_bad) AS s,
  count(*) FILTER (WHERE birth_bad) AS b, count(*) FILTER (WHERE sex_empty) AS x,
  count(*) FILTER (WHERE kind_empty) AS k FROM flags WHERE period IS NULL),
own AS (SELECT period, count(*) FILTER (WHERE valid) AS valid_records,
  count(*) FILTER (WHERE invalid) AS n, count(*) FILTER (WHERE service_bad) AS s,
  count(*) FILTER (WHERE birth_bad) AS b, count(*) FILTER (WHERE sex_empty) AS x,
  count(*) FILTER (WHERE kind_empty) AS k FROM flags WHERE period IS NOT NULL GROUP BY period),
diag AS (SELECT period, valid_records, own.n + loose.n AS invalid_records,
  loose.n AS unassigned_records, own.s + loose.s AS dia_cita_invalid,
  own.b + loose.b AS fecha_nacimiento_invalid, own.x + loose.x AS sexo_empty,
  own.k + loose.k AS tipo_de_cita_empty, valid_records + own.n + loose.n AS period_scope_records,
  own.n + loose.n > 0 AS blocked FROM own, loose)"""


@query("invalid_diagnostics", f"WITH {_DIAGNOSTICS} SELECT * FROM diag")
def invalid_diagnostics(t):
    return scope.invalid_diagnostics(flags(t), LAYOUT)


@query("problem_counts", f"""WITH {_DIAGNOSTICS} SELECT period, upper(code) AS code, records FROM (
  UNPIVOT diag ON dia_cita_invalid, fecha_nacimiento_invalid, sexo_empty, tipo_de_cita_empty
  INTO NAME code VALUE records) WHERE records > 0""")
def problem_counts(t):
    return scope.problem_counts(scope.invalid_diagnostics(flags(t), LAYOUT), LAYOUT)


@query("status_filter", f"WITH {v.DETAIL_CTE} SELECT period, ESTADO, count(*) AS n FROM flags "
       f"WHERE valid AND {_STATUS_SQL} GROUP BY period, ESTADO")
def status_filter(t):
    kept = scope.status_filter(flags(t).filter("valid"), "ESTADO", scope.StatusRule())
    return kept.groupBy("period", "ESTADO").agg(F.count(F.lit(1)).alias("n"))


@query("row_problems", f"""WITH {v.DETAIL_CTE},
listed AS (
  SELECT id, 0 AS p, 'DIA_CITA' AS field, 'DIA_CITA_INVALID' AS code FROM flags WHERE service_bad
  UNION ALL SELECT id, 1, 'FECHA_NACIMIENTO', 'FECHA_NACIMIENTO_INVALID' FROM flags WHERE birth_bad
  UNION ALL SELECT id, 2, 'SEXO', 'SEXO_EMPTY' FROM flags WHERE sex_empty
  UNION ALL SELECT id, 3, 'TIPO_DE_CITA', 'TIPO_DE_CITA_EMPTY' FROM flags WHERE kind_empty
  UNION ALL SELECT id, 4, 'FECHA_NACIMIENTO', 'BIRTH_AFTER_SERVICE' FROM flags WHERE birth_after)
SELECT id, field, code FROM listed""")
def row_problems(t):
    return scope.row_problems(flags(t), LAYOUT, "id")


def _derived_sql(code):
    _, field, op, literal, values = next(c for c in fixed.CATEGORIES if c[0] == code)
    if op == "equals":
        return f"CASE WHEN {category_sql(code)} THEN '{literal}' || SEXO ELSE '#N/A' END AS {code}"
    found = " + ".join(f"CAST(contains(lower({field}), '{x.lower()}') AS INT)" for x in values)
    return f"CAST({found} AS STRING) || SEXO AS {code}"


@query("derived_columns", f"""WITH {v.DETAIL_CTE} SELECT id, TIPO_DE_CITA || SUCURSAL AS AC,
  TIPO_DE_CITA || SEXO AS AD, PRESTACION || ESPECIALIDAD || SEXO AS AE,
  CAST({v.AGE_SQL} AS INT) AS AF, {', '.join(_derived_sql(c) for c in _CODES)} FROM typed""")
def derived_columns(t):
    return classify.derived_columns(typed(t)).select(
        "id", "AC", "AD", "AE", "AF", *[c.code for c in classify.CATEGORIES])


@query("multi_classify", f"""WITH {v.DETAIL_CTE},
hit AS (SELECT id, list_filter([{', '.join(f"CASE WHEN {category_sql(c)} THEN '{c}' END" for c in _CODES)}],
  lambda x: x IS NOT NULL) AS codes FROM flags WHERE valid)
SELECT array_to_string(codes, ',') AS codes, count(*) AS n FROM hit GROUP BY 1""")
def multi_classify(t):
    return (
        classify.multi_classify(flags(t).filter("valid"))
        .groupBy(F.array_join("codes", ",").alias("codes")).agg(F.count(F.lit(1)).alias("n"))
    )


@query("category_counts", f"WITH {v.DETAIL_CTE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS code, count(*) AS records FROM flags WHERE valid AND {category_sql(c)}"
    for c in _CODES) + f" UNION ALL SELECT 'NONE', count(*) FROM flags WHERE valid AND NOT {_ANY_CATEGORY}")
def category_counts(t):
    return classify.category_counts(flags(t).filter("valid"))


_RULES = (
    classify.StrictRule("R1", {"p_type": {"eq": "economy"}, "p_name": {"contains": " bolt"}},
                        {"group": "fasteners", "tier": "low"}),
    classify.StrictRule("R2", {"p_type": {"in": ["Stándard", "small"]},
                               "p_name": {"starts_with": "rèd"}}, {"group": "red"}),
    classify.StrictRule("R3", {"p_brand": {"regex": "#1[0-9]$"}, "p_type": {"in": ["LARGE", "PROMO"]}},
                        {"group": "teens", "tier": "high"}),
    classify.StrictRule("R4", {"p_name": {"contains": "widget"}}, {"group": "widgets"}),
    classify.StrictRule("R5", {"p_type": "Economy", "p_size": {"eq": 11}}, {"group": "eleven"}),
)
_N = {c: v.norm_sql(f"CAST({c} AS STRING)") for c in ("p_type", "p_name", "p_brand", "p_size")}
_RULE_SQL = {
    "R1": f"{_N['p_type']} = 'ECONOMY' AND contains({_N['p_name']}, 'BOLT')",
    "R2": f"{_N['p_type']} IN ('STANDARD', 'SMALL') AND starts_with({_N['p_name']}, 'RED')",
    "R3": f"regexp_matches({_N['p_brand']}, '#1[0-9]$') AND {_N['p_type']} IN ('LARGE', 'PROMO')",
    "R4": f"contains({_N['p_name']}, 'WIDGET')",
    "R5": f"{_N['p_type']} = 'ECONOMY' AND {_N['p_size']} = '11'",
}


@query("rule_conditions", "SELECT p_partkey, " + ", ".join(
    f"{sql} AS {rule.lower()}" for rule, sql in _RULE_SQL.items()) + " FROM part")
def rule_conditions(t):
    return t.part.select("p_partkey", *[r.matches().alias(r.id.lower()) for r in _RULES])


@query("strict_classify", f"""WITH hit AS (SELECT p_partkey, list_filter([{', '.join(
    f"CASE WHEN {sql} THEN '{rule}' END" for rule, sql in _RULE_SQL.items())}],
  lambda x: x IS NOT NULL) AS ids FROM part)
SELECT p_partkey, array_to_string(ids, ',') AS rule_ids,
  CASE len(ids) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS rule_status,
  CASE WHEN len(ids) = 1 THEN CASE ids[1] WHEN 'R1' THEN 'fasteners' WHEN 'R2' THEN 'red'
    WHEN 'R3' THEN 'teens' WHEN 'R4' THEN 'widgets' ELSE 'eleven' END END AS result_group,
  CASE WHEN len(ids) = 1 THEN CASE ids[1] WHEN 'R1' THEN 'low' WHEN 'R3' THEN 'high' END END AS result_tier
FROM hit""")
def strict_classify(t):
    done = classify.strict_classify(t.part, _RULES)
    return done.select(
        "p_partkey", F.array_join("rule_ids", ",").alias("rule_ids"), "rule_status",
        F.try_element_at("result", F.lit("group")).alias("result_group"),
        F.try_element_at("result", F.lit("tier")).alias("result_tier"),
    )


@query("aggregate_long", "SELECT l_returnflag, CAST(nullif(l_linenumber, 7) AS INT) AS line, "
       "sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def aggregate_long(t):
    rows = t.lineitem.select("l_returnflag", F.nullif("l_linenumber", F.lit(7)).alias("line"),
                             "l_quantity")
    return summary.aggregate_long(rows, ["l_returnflag", "line"], "l_quantity")


_SCOPED = f"{v.DETAIL_CTE}, scoped AS (SELECT *, {_STATUS_SQL} AS included FROM flags WHERE valid)"


@query("distribution", f"""WITH {_SCOPED}, c AS (SELECT {label_sql('ESPECIALIDAD')} AS label,
  count(*) AS n FROM scoped GROUP BY 1)
SELECT label, n, round(100.0::DOUBLE * n / (SELECT sum(n) FROM c), 2) AS percent FROM c""")
def distribution(t):
    return summary.distribution(flags(t).filter("valid"), summary.clean_label(F.col("ESPECIALIDAD")))


@query("topn_other", f"""WITH {_SCOPED}, c AS (SELECT {label_sql('ESPECIALIDAD')} AS label,
  count(*) AS n FROM scoped GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rank FROM c)
SELECT label, n, CAST(rank AS INT) AS rank FROM r WHERE rank <= {fixed.TOP_N}
UNION ALL SELECT '{fixed.OTHER_LABEL}', CAST(sum(n) AS BIGINT), {fixed.TOP_N + 1} FROM r
WHERE rank > {fixed.TOP_N} HAVING sum(n) > 0""")
def topn_other(t):
    return summary.top_n_other(flags(t).filter("valid"), summary.clean_label(F.col("ESPECIALIDAD")))


def _band_sql(x):
    return "CASE " + " ".join(
        f"WHEN {x} >= {lo} AND {x} < {hi} THEN '{label}'" for label, lo, hi in fixed.AGE_BANDS
    ) + f" ELSE '{fixed.MISSING_LABEL}' END"


_ORDER = "CASE label " + " ".join(
    f"WHEN '{b[0]}' THEN {i + 1}" for i, b in enumerate(fixed.AGE_BANDS)
) + f" ELSE {len(fixed.AGE_BANDS) + 1} END"


@query("age_bands", f"""WITH {_SCOPED}, a AS (SELECT period, {v.AGE_SQL} AS age FROM scoped),
b AS (SELECT period, {_band_sql('age')} AS label FROM a)
SELECT period, label, count(*) AS n, CAST({_ORDER} AS INT) AS position FROM b GROUP BY period, label""")
def age_bands(t):
    return summary.age_bands(flags(t).filter("valid"), "FECHA_NACIMIENTO", "DIA_CITA", keys=["period"])


_PROFILED = ("SEXO", "SUCURSAL", "ESPECIALIDAD", "TIPO_DE_CITA", "PRESTACION", "ESTADO",
             "FECHA_NACIMIENTO")


@query("column_profile_cut", f"""WITH {v.DETAIL_CTE}, cells AS ({' UNION ALL '.join(
    f"SELECT '{f}' AS field, CAST({f} AS STRING) AS value FROM typed WHERE NOT {f}_blank"
    for f in _PROFILED)}),
c AS (SELECT field, value, count(*) AS n FROM cells GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY field) AS non_blank,
  count(*) OVER (PARTITION BY field) AS distinct_values,
  row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
SELECT field, CAST(non_blank AS BIGINT) AS non_blank, distinct_values,
  CAST(CASE WHEN distinct_values <= 40 THEN rank END AS INT) AS rank,
  CASE WHEN distinct_values <= 40 THEN value END AS value,
  CASE WHEN distinct_values <= 40 THEN n END AS n
FROM r WHERE rank <= 15 AND (distinct_values <= 40 OR rank = 1)""")
def column_profile_cut(t):
    return summary.column_profile(
        typed(t), _PROFILED, max_unique=fixed.MAX_CATEGORICAL_UNIQUE, top=fixed.MAX_DISTRIBUTION)


@query("column_profile", f"""{ORACLES['column_profile_cut'].partition('SELECT field, CAST(non_blank')[0]}
SELECT field, CAST(non_blank AS BIGINT) AS non_blank, distinct_values, CAST(rank AS INT) AS rank, value, n FROM r""")
def column_profile(t):
    return summary.column_profile(typed(t), _PROFILED)


@query("monthly_summary", f"""WITH {_DIAGNOSTICS},
scoped AS (SELECT *, {_STATUS_SQL} AS included FROM flags WHERE valid),
kept AS (SELECT period, count(*) FILTER (WHERE included) AS included_records FROM scoped GROUP BY 1),
head AS (SELECT d.period, d.period_scope_records, d.valid_records, d.invalid_records,
    coalesce(k.included_records, 0) AS included_records FROM diag d LEFT JOIN kept k USING (period)),
dist AS (
  SELECT period, 'status' AS axis, {label_sql('ESTADO')} AS label, included, count(*) AS n
    FROM scoped GROUP BY ALL
  UNION ALL SELECT period, 'sex', {label_sql('SEXO')}, true, count(*) FROM scoped WHERE included GROUP BY ALL
  UNION ALL SELECT period, 'age', {_band_sql('(' + v.AGE_SQL + ')')}, true, count(*) FROM scoped
    WHERE included GROUP BY ALL),
service AS (SELECT period, {label_sql('ESPECIALIDAD')} AS label, count(*) AS n FROM scoped
  WHERE included GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, label) AS r FROM service),
long AS (SELECT * FROM dist UNION ALL
  SELECT period, 'service', CASE WHEN r <= 8 THEN label ELSE '{fixed.OTHER_LABEL}' END, true,
    CAST(sum(n) AS BIGINT) FROM ranked GROUP BY 1, 3
  UNION ALL SELECT period, 'total', m, true, n FROM (
    UNPIVOT (SELECT period, period_scope_records, valid_records, invalid_records, included_records,
      valid_records - included_records AS excluded_records FROM head)
    ON period_scope_records, valid_records, invalid_records, included_records, excluded_records
    INTO NAME m VALUE n))
SELECT period, ['Enero','Febrero','Marzo','Abril','Mayo','Junio','Julio','Agosto','Septiembre',
    'Octubre','Noviembre','Diciembre'][month(period)] || ' ' || year(period) AS period_label,
  axis, label, included, n, CASE WHEN label = 'included_records' AND axis = 'total' THEN
    CASE WHEN period_scope_records = 0 THEN 0.0::DOUBLE
    ELSE round(100.0::DOUBLE * included_records / period_scope_records, 1) END END AS percent
FROM long JOIN head USING (period)""")
def monthly_summary(t):
    return (
        summary.monthly_summary(flags(t), LAYOUT, scope.StatusRule(), sex="SEXO",
                                service="ESPECIALIDAD")
        .withColumn("period_label", period_label(F.col("period")))
    )


@query("pii_scan", " UNION ALL ".join(
    f"""SELECT '{table}' AS field, '{name}' AS pattern,
  CAST(coalesce(sum(len(regexp_extract_all({col}, '{regex}'))), 0) AS BIGINT) AS hits,
  count(*) FILTER (WHERE regexp_matches({col}, '{regex}')) AS rows FROM {table}"""
    for table, col in (("documents", "text"), ("conversations", "text"), ("pages", "html"))
    for name, regex in ((n, p.replace(r"\w", r"\p{L}\p{N}_")) for n, p in fixed.PERSONAL_DATA)))
def pii_scan(t):
    found = [
        summary.pii_scan(df, {name: F.col(col)})
        for name, df, col in (("documents", t.documents, "text"),
                              ("conversations", t.conversations, "text"), ("pages", t.pages, "html"))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])
