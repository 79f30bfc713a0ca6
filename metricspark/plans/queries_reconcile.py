"""Reconciliation of detail records and of computed values with references."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions import criteria as C
from metricspark.functions.dates import age_years
from metricspark.operators import checks, classify, metrics, reconcile, scope
from metricspark.plans import queries_metrics as qm
from metricspark.plans import queries_scope as qs
from metricspark.plans import views as v
from metricspark.plans.registry import plain, query

_FIELDS = list(v.DETAIL_FIELDS)
_DATES = ["DIA_CITA", "FECHA_NACIMIENTO"]


def _fp_sql(fields):
    def part(f):
        if f in _DATES:
            return f"coalesce(strftime({f}, '%Y-%m-%d'), '')"
        return f"CASE WHEN lower({v.trim_sql(f)}) IN ('', 'nan', 'nat', 'none', '<na>') THEN '' ELSE {v.trim_sql(f)} END"

    return " || '|' || ".join(part(f) for f in fields)


# Copies are what makes it a multiset: the fingerprint of few columns repeats a lot.
_FEW = ["SEXO", "SUCURSAL", "TIPO_DE_CITA", "ESTADO"]
_FEW_SQL = _fp_sql(_FEW)
_EARLIER_SQL = "id % 7 <> 3"
_MULTISET = f"""{v.DETAIL_CTE},
sup AS (SELECT {_FEW_SQL} AS fp, count(*) AS n FROM flags WHERE valid GROUP BY 1),
sub AS (SELECT {_FEW_SQL} AS fp, count(*) AS n FROM (
  SELECT * REPLACE (CASE WHEN id % 500 = 1 THEN 'Otra' ELSE SUCURSAL END AS SUCURSAL) FROM flags
  WHERE valid AND {_EARLIER_SQL}) GROUP BY 1),
j AS (SELECT coalesce(sub.n, 0) AS a, coalesce(sup.n, 0) AS b FROM sub FULL JOIN sup ON sub.fp = sup.fp)"""


def _earlier(t):
    """What the earlier process kept: some records dropped, a few filed elsewhere."""
    rows = qs.flags(t).filter("valid").filter(_EARLIER_SQL)
    moved = F.when(F.col("id") % 500 == 1, "Otra").otherwise(F.col("SUCURSAL"))
    return rows.withColumn("SUCURSAL", moved)


@query("multiset_check", f"""WITH {_MULTISET}
SELECT CAST(sum(a) AS BIGINT) AS subset_records, CAST(sum(b) AS BIGINT) AS superset_records,
  CAST(sum(least(a, b)) AS BIGINT) AS matched, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS unmatched,
  CAST(sum(greatest(b - a, 0)) AS BIGINT) AS excess, sum(greatest(a - b, 0)) = 0 AS is_exact_subset FROM j""")
def multiset_check(t):
    return reconcile.multiset_check(_earlier(t), qs.flags(t).filter("valid"), reconcile.fingerprint(_FEW, _DATES))


@query("multiset_excess", f"""WITH {_MULTISET},
r AS (SELECT id, {_FEW_SQL} AS fp, row_number() OVER (PARTITION BY {_FEW_SQL} ORDER BY id) AS k
  FROM flags WHERE valid)
SELECT id FROM r LEFT JOIN sub USING (fp) WHERE k > coalesce(n, 0)""")
def multiset_excess(t):
    return reconcile.multiset_excess(
        qs.flags(t).filter("valid"), _earlier(t), reconcile.fingerprint(_FEW, _DATES), "id").select("id")


_NO_STATUS = [f for f in _FIELDS if f != "ESTADO"]


def _sides_sql(name, fields):
    fp = _fp_sql(fields)
    return f"""{name}_d AS (SELECT {fp} AS fp, count(*) AS n FROM direct GROUP BY 1),
{name}_e AS (SELECT {fp} AS fp, count(*) AS n FROM earlier GROUP BY 1),
{name} AS (SELECT coalesce(e.n, 0) AS a, coalesce(d.n, 0) AS b FROM {name}_e e FULL JOIN {name}_d d ON e.fp = d.fp),
{name}_rows AS (SELECT unnest(['subset_records', 'superset_records', 'matched', 'unmatched', 'excess']) AS label,
  unnest([sum(a), sum(b), sum(least(a, b)), sum(greatest(a - b, 0)), sum(greatest(b - a, 0))]) AS n FROM {name})"""


_DESCRIBE = ["ESTADO", "TIPO_DE_CITA", "SUCURSAL", "MODALIDAD", "ESPECIALIDAD"]


def _label_clean(f):
    return f"CASE WHEN lower({v.trim_sql(f)}) IN ('', 'nan', 'nat', 'none', '<na>') THEN '{fixed.EMPTY_LABEL}' ELSE {v.trim_sql(f)} END"


@query("reconcile", f"""WITH {v.DETAIL_CTE}, direct AS (SELECT * FROM flags WHERE valid AND {qs._IN}),
earlier AS (SELECT * REPLACE (CASE WHEN id % 50 = 1 THEN 'Atendido' ELSE ESTADO END AS ESTADO)
  FROM flags WHERE valid AND {qs._IN} AND {qs._STATUS_SQL}),
{_sides_sql('w', _FIELDS)}, {_sides_sql('o', _NO_STATUS)},
ex AS (SELECT d.* FROM (SELECT *, {_fp_sql(_NO_STATUS)} AS fp,
  row_number() OVER (PARTITION BY {_fp_sql(_NO_STATUS)} ORDER BY id) AS k FROM direct) d
  LEFT JOIN o_e ON o_e.fp = d.fp WHERE k > coalesce(o_e.n, 0))
SELECT 'with_status' AS section, '' AS field, label, CAST(n AS BIGINT) AS n FROM w_rows
UNION ALL SELECT 'without_status', '', label, CAST(n AS BIGINT) FROM o_rows
UNION ALL SELECT 'status_rule', '', 'kept', count(*) FILTER (WHERE {qs._STATUS_SQL}) FROM direct
UNION ALL SELECT 'status_rule', '', 'dropped', count(*) FILTER (WHERE NOT {qs._STATUS_SQL}) FROM direct
{' '.join(f"UNION ALL SELECT 'excess', '{f}', {_label_clean(f)}, count(*) FROM ex GROUP BY 3" for f in _DESCRIBE)}""")
def reconcile_report(t):
    rule = scope.StatusRule()
    direct = scope.period_scope(qs.flags(t), qs.LAYOUT, qs.START, qs.END)
    earlier = direct.filter(rule.keeps(F.col("ESTADO"))).withColumn(
        "ESTADO", F.when(F.col("id") % 50 == 1, "Atendido").otherwise(F.col("ESTADO")))
    return reconcile.reconcile(
        direct, earlier, fields=_FIELDS, status="ESTADO", dates=_DATES, row_id="id",
        kept=rule.keeps(F.col("ESTADO")), describe=_DESCRIBE)


@query("result_symdiff", """WITH a AS (SELECT event_type, user_id, CAST(floor(value) AS BIGINT) AS v FROM events),
b AS (SELECT event_type, user_id, CAST(round(value) AS BIGINT) AS v FROM events)
SELECT *, 'LEFT' AS side, count(*) AS copies FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT *, 'RIGHT', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""")
def result_symdiff(t):
    e = t.events
    a = e.select("event_type", "user_id", F.floor("value").cast("bigint").alias("v"))
    b = e.select("event_type", "user_id", F.round("value").cast("bigint").alias("v"))
    return reconcile.symmetric_difference(a, b)


# Counts of large line items per month, form and line, and an earlier report of them.
_COMPUTED = """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
  l_returnflag || l_linestatus AS form, l_linenumber AS line,
  CASE WHEN l_linenumber < 4 THEN 'BASE' ELSE 'DERIVED' END AS kind, l_linenumber % 2 = 0 AS on_age,
  l_linenumber > 5 AS on_status, sum(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END) AS calculated
FROM {lineitem} GROUP BY 1, 2, 3, 4, 5, 6"""
_REFERENCE = f"""SELECT period, form, line, CASE WHEN (calculated + 7 * line + month(period)) % 11 = 0 THEN calculated + 1
  WHEN (calculated + 5 * line + month(period)) % 9 = 0 THEN NULL
  WHEN (calculated + line + year(period)) % 17 = 0 THEN calculated - 1 ELSE calculated END AS reference
FROM ({_COMPUTED}) c WHERE line <> 7 OR form <> 'NF'"""
# A month is comparable if its invariants hold, here: no line item without a quantity
# and records of every form; two years of reports are not readable.
_PERIODS = """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
  max(year(l_shipdate)) NOT IN (1996, 2000) AS available,
  min(l_quantity) > 0 AND max(day(l_shipdate)) > 27 AND max(month(l_shipdate)) <> 5 AS ok
FROM {lineitem} GROUP BY 1"""
_COMPARED = f"""c AS ({plain(_COMPUTED)}), f AS ({plain(_REFERENCE)}), p AS ({plain(_PERIODS)}),
j AS (SELECT c.*, available, CASE WHEN available THEN reference END AS reference
  FROM c JOIN p USING (period) LEFT JOIN f USING (period, form, line) WHERE ok),
compared AS (SELECT period, form, line, kind, on_age, on_status, CAST(calculated AS BIGINT) AS calculated,
  CAST(reference AS BIGINT) AS reference, available, CASE WHEN NOT available THEN 'REFERENCE_UNAVAILABLE'
    WHEN reference IS NULL AND calculated = 0 THEN 'ZERO_VS_BLANK_EQUIVALENT' WHEN reference IS NULL THEN 'REAL_MISMATCH'
    WHEN reference = calculated THEN 'EXACT_MATCH' ELSE 'REAL_MISMATCH' END AS status,
  CAST(reference - calculated AS BIGINT) AS delta FROM j)"""


def compared(t):
    return reconcile.reference_compare(
        t.sql(_COMPUTED), t.sql(_REFERENCE), t.sql(_PERIODS), key=["form", "line"])


@query("reference_compare", f"WITH {_COMPARED} SELECT * FROM compared")
def reference_compare(t):
    return compared(t)


_COUNTS = """count(*) AS compared, count(*) FILTER (WHERE status = 'EXACT_MATCH') AS exact_match,
  count(*) FILTER (WHERE status = 'ZERO_VS_BLANK_EQUIVALENT') AS zero_vs_blank,
  count(*) FILTER (WHERE status = 'REAL_MISMATCH') AS real_mismatch,
  count(*) FILTER (WHERE status = 'REFERENCE_UNAVAILABLE') AS unavailable,
  round(count(*) FILTER (WHERE status IN ('EXACT_MATCH', 'ZERO_VS_BLANK_EQUIVALENT'))::DOUBLE / count(*), 4)
    AS equivalence_rate"""


@query("multi_axis_summary", f"""WITH {_COMPARED}
SELECT 'TOTAL' AS group_type, 'ALL' AS group_key, {_COUNTS} FROM compared
{' '.join(f"UNION ALL SELECT '{n}', CAST({c} AS STRING), {_COUNTS} FROM compared GROUP BY {c}"
          for n, c in (('FORM', 'form'), ('KIND', 'kind'), ('ON_AGE', 'on_age'), ('ON_STATUS', 'on_status')))}""")
def multi_axis_summary(t):
    return reconcile.multi_axis_summary(compared(t), {
        "FORM": F.col("form"), "KIND": F.col("kind"), "ON_AGE": F.col("on_age"),
        "ON_STATUS": F.col("on_status")})


@query("period_summary", f"WITH {_COMPARED} SELECT period, {_COUNTS} FROM compared GROUP BY period")
def period_summary(t):
    return reconcile.period_summary(compared(t))


def _stats_sql(key, group):
    return f"""SELECT {key} AS form, count(*) FILTER (WHERE wrong) AS real_mismatch,
  count(*) FILTER (WHERE wrong AND on_age) AS dependent_mismatch, count(*) FILTER (WHERE on_age) AS dependent_compared,
  count(*) FILTER (WHERE NOT on_age) AS independent_compared, count(delta) FILTER (WHERE wrong) AS delta_count,
  count(*) FILTER (WHERE wrong AND reference IS NULL) AS blank_reference,
  min(delta) FILTER (WHERE wrong) AS delta_min, max(delta) FILTER (WHERE wrong) AS delta_max,
  round(avg(delta) FILTER (WHERE wrong), 4) AS delta_mean, count(*) FILTER (WHERE wrong AND delta > 0) AS reference_greater,
  count(*) FILTER (WHERE wrong AND delta < 0) AS reference_less,
  round(count(*) FILTER (WHERE wrong AND on_age)::DOUBLE / nullif(count(*) FILTER (WHERE on_age), 0), 4) AS rate_dependent,
  round(count(*) FILTER (WHERE wrong AND NOT on_age)::DOUBLE / nullif(count(*) FILTER (WHERE NOT on_age), 0), 4)
    AS rate_independent FROM s {group}"""


@query("mismatch_stats", f"""WITH {_COMPARED}, s AS (SELECT *, status = 'REAL_MISMATCH' AS wrong FROM compared
  WHERE status <> 'REFERENCE_UNAVAILABLE')
{_stats_sql('form', 'GROUP BY form')} UNION ALL {_stats_sql("'ALL'", '')}""")
def mismatch_stats(t):
    stats = reconcile.mismatch_stats(compared(t), "form", F.col("on_age"))
    return stats.withColumns({c: F.round(c, 4) for c in ("delta_mean", "rate_dependent", "rate_independent")})


@query("mismatch_axes", f"""WITH {_COMPARED}, s AS (SELECT * FROM compared WHERE status = 'REAL_MISMATCH')
SELECT 'TOTAL' AS axis, count(*) AS mismatches FROM s UNION ALL SELECT 'AGE', count(*) FILTER (WHERE on_age) FROM s
UNION ALL SELECT 'STATUS', count(*) FILTER (WHERE on_status) FROM s""")
def mismatch_axes(t):
    return reconcile.mismatch_axes(compared(t), {"AGE": F.col("on_age"), "STATUS": F.col("on_status")})


# The same values against form slots, where a slot may be absent or the source missing.
_SLOTS = f"""SELECT c.period, c.form, c.line, c.kind,
  CASE WHEN c.line = 6 AND month(c.period) = 4 THEN NULL ELSE c.calculated END AS source, f.reference AS target,
  f.reference IS NOT NULL AS present
FROM ({_COMPUTED}) c LEFT JOIN ({_REFERENCE}) f ON f.period = c.period AND f.form = c.form AND f.line = c.line"""
_EQUIVALENCE = f"""s AS ({plain(_SLOTS)}), eq AS (SELECT *, CASE WHEN source IS NULL THEN 'SOURCE_UNAVAILABLE'
  WHEN NOT present THEN CASE WHEN source = 0 THEN 'ZERO_VS_BLANK_EQUIVALENT' ELSE 'TARGET_UNAVAILABLE' END
  WHEN source = target THEN 'MATCH' ELSE 'MISMATCH' END AS status,
  CASE WHEN source IS NULL OR source <> 0 THEN 'NOT_APPLICABLE' WHEN NOT present THEN 'SOURCE_ZERO_TARGET_BLANK'
    WHEN target = 0 THEN 'SOURCE_ZERO_TARGET_ZERO' ELSE 'SOURCE_ZERO_TARGET_OTHER' END AS zero_semantics FROM s)"""


def equivalence(t):
    return reconcile.equivalence(t.sql(_SLOTS))


@query("compare_status", f"""WITH {_EQUIVALENCE} SELECT period, form, line, CAST(source AS BIGINT) AS source,
  CAST(target AS BIGINT) AS target, present, status, zero_semantics FROM eq""")
def compare_status(t):
    return equivalence(t).drop("kind")


_SLOT = "form || '!' || line || '@' || period"


@query("mismatch_clusters", f"""WITH {_EQUIVALENCE}
SELECT form, kind, status, zero_semantics, count(*) AS n, CAST(min(target - source) AS BIGINT) AS delta_min,
  CAST(max(target - source) AS BIGINT) AS delta_max, min({_SLOT}) AS example
FROM eq WHERE status NOT IN ('MATCH', 'ZERO_VS_BLANK_EQUIVALENT') GROUP BY 1, 2, 3, 4""")
def mismatch_clusters(t):
    rows = equivalence(t).withColumn("slot", F.expr(_SLOT))
    return reconcile.mismatch_clusters(rows, ["form", "kind", "status", "zero_semantics"], "slot")


@query("evidence_policy", f"""WITH {_EQUIVALENCE},
z AS (SELECT form, count(*) AS cases, count(*) FILTER (WHERE zero_semantics = 'SOURCE_ZERO_TARGET_ZERO') AS target_zero,
  count(*) FILTER (WHERE zero_semantics = 'SOURCE_ZERO_TARGET_BLANK') AS target_blank,
  count(*) FILTER (WHERE zero_semantics = 'SOURCE_ZERO_TARGET_OTHER') AS target_other
  FROM eq WHERE zero_semantics <> 'NOT_APPLICABLE' GROUP BY form),
d AS (SELECT *, CASE WHEN cases >= 30 AND target_zero + target_blank > 0 THEN
    CASE WHEN target_blank = 0 THEN 'WRITE_ZERO' WHEN target_zero = 0 THEN 'PRESERVE_BLANK_FOR_ZERO' ELSE 'UNRESOLVED' END
    ELSE 'UNRESOLVED' END AS resolution FROM z)
SELECT *, resolution = 'WRITE_ZERO' AS matches_declared FROM d""")
def evidence_policy(t):
    return reconcile.zero_policy(equivalence(t), ["form"], declared="WRITE_ZERO")


@query("equivalence_pivot", f"""WITH {_EQUIVALENCE}
SELECT coalesce(form, 'ALL') AS form, count(*) FILTER (WHERE status = 'MATCH') AS match,
  count(*) FILTER (WHERE status = 'ZERO_VS_BLANK_EQUIVALENT') AS zero_vs_blank,
  count(*) FILTER (WHERE status = 'MISMATCH') AS mismatch,
  count(*) FILTER (WHERE status LIKE '%UNAVAILABLE') AS unavailable, count(*) AS total FROM eq GROUP BY ROLLUP (form)""")
def equivalence_pivot(t):
    return reconcile.equivalence_pivot(equivalence(t), "form")


_CRITERIA = ("atendido", "*atenci?n", "<>", "<>Cancelado", "*~**", ">=30", "<>30", "<18", "=45", "", "=", "??")


def _crit_text(raw):
    return {
        "atendido": "lower(ESTADO) = 'atendido'", "*atenci?n": "lower(ESTADO) LIKE '%atenci_n'",
        "<>": "ESTADO <> ''", "<>Cancelado": "lower(ESTADO) <> 'cancelado'", "*~**": "contains(ESTADO, '*')",
        "": "ESTADO = ''", "=": "ESTADO = ''", "??": "length(ESTADO) = 2",
    }.get(raw, "false")


def _crit_number(raw):
    return {">=30": "age >= 30", "<>30": "age <> 30", "<18": "age < 18", "=45": "age = 45",
            "": "age IS NULL", "=": "age IS NULL", "<>": "age IS NOT NULL", "??": "length(CAST(age AS STRING)) = 2",
            "<>Cancelado": "true"}.get(raw, "false")


@query("criterion_matrix", f"""WITH {v.DETAIL_CTE}, a AS (SELECT ESTADO, {v.AGE_SQL} AS age FROM flags WHERE active)
{' UNION ALL '.join(f'''SELECT '{raw}' AS criterion, count(*) FILTER (WHERE {_crit_text(raw)}) AS on_text,
  count(*) FILTER (WHERE coalesce({_crit_number(raw)}, false)) AS on_number FROM a''' for raw in _CRITERIA)}""")
def criterion_matrix(t):
    rows = qs.flags(t).filter("not structurally_empty").select(
        "ESTADO", age_years(F.col("FECHA_NACIMIENTO"), F.col("DIA_CITA")).alias("age"))
    counted = rows.agg(*[
        F.count_if(C.matches(C.parse_criterion(raw), F.col(c), dtype)).alias(f"{side}{i}")
        for i, raw in enumerate(_CRITERIA) for side, c, dtype in (("t", "ESTADO", "string"), ("n", "age", "int"))
    ])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(raw).alias("criterion"), F.col(f"t{i}").alias("on_text"), F.col(f"n{i}").alias("on_number"))
        for i, raw in enumerate(_CRITERIA)])))


_PADDING_TERMS = [
    metrics.Term("any"), metrics.Term("women", (("SEXO", "Mujer"),)),
    metrics.Term("not_done", (("ESTADO", "<>Atendido"),)), metrics.Term("no_map", (("AG", "#N/A"),)),
    metrics.Term("zero_pattern", (("AJ", "0"),)), metrics.Term("adults", (("AF", ">=18"),)),
    metrics.Term("not_young", (("AF", "<>5"),)), metrics.Term("blank_branch", (("SUCURSAL", ""),)),
]


@query("padding_sensitivity", f"""WITH {v.DETAIL_CTE}, e AS (SELECT count(*) AS n FROM flags WHERE NOT active)
SELECT unnest(['any', 'not_done', 'no_map', 'zero_pattern', 'blank_branch']) AS metric_id, n AS padded_count FROM e""")
def padding_sensitivity(t):
    rows = classify.derived_columns(qs.flags(t))
    return checks.padding_sensitivity(rows, F.col("structurally_empty"), _PADDING_TERMS)


@query("population_impact", f"""WITH a AS ({qm.catalog_sql(wide=False)}),
b AS ({qm.catalog_sql(wide=False, extra=" AND l_tax > 0.02 AND l_discount < 0.09")})
SELECT a.period, a.metric_id, a.value AS value_a, b.value AS value_b, a.value - b.value AS delta,
  a.value <> 0 AND b.value = 0 AS went_to_zero FROM a JOIN b USING (period, metric_id) WHERE a.value <> b.value""")
def population_impact(t):
    facts = t.lineitem.select(
        F.trunc("l_shipdate", "month").alias("period"), "l_returnflag", "l_linestatus", "l_quantity",
        "l_tax", "l_discount")
    kept = (F.col("l_tax") > 0.02) & (F.col("l_discount") < 0.09)
    return checks.population_impact(facts, qm.catalog(wide=False), kept)


@query("impact_summary", f"""WITH a AS ({qm.catalog_sql(wide=False)}),
b AS ({qm.catalog_sql(wide=False, extra=" AND l_tax > 0.02")}),
d AS (SELECT split_part(metric_id, '_', 1) AS sheet, a.value AS x, b.value AS y FROM a JOIN b USING (period, metric_id)
  WHERE a.value <> b.value)
SELECT sheet, count(*) AS metrics_changed, CAST(sum(abs(x - y)) AS BIGINT) AS sum_abs_delta,
  count(*) FILTER (WHERE x <> 0 AND y = 0) AS went_to_zero FROM d GROUP BY sheet""")
def impact_summary(t):
    facts = t.lineitem.select(
        F.trunc("l_shipdate", "month").alias("period"), "l_returnflag", "l_linestatus", "l_quantity", "l_tax")
    impact = checks.population_impact(facts, qm.catalog(wide=False), F.col("l_tax") > 0.02)
    return checks.impact_summary(impact, {"sheet": F.split_part("metric_id", F.lit("_"), F.lit(1))})


# Derived columns as an earlier tool stored them: stale zeros, lost cells, errors, case.
_TEXT_COLUMNS = ["AC", "AD", "AG", "AJ"]


def _supplied(derived):
    i = F.col("id")
    return derived.select(
        "id",
        F.when(i % 19 == 0, None).otherwise(F.when(i % 23 == 0, F.lower("AC")).otherwise(F.col("AC"))).alias("AC"),
        F.when(i % 29 == 0, F.lit("otro")).otherwise(F.col("AD")).alias("AD"),
        F.col("AG"), F.when(i % 31 == 0, F.lit("9Mujer")).otherwise(F.col("AJ")).alias("AJ"),
        F.when(i % 37 == 0, "#VALUE!").when(i % 41 == 0, "0").when(i % 43 == 0, None)
        .when(i % 47 == 0, "7").otherwise(F.col("AF").cast("string")).alias("AF"),
    )


def _verdict_sql(c):
    return f"""CASE WHEN s.{c} IS NULL THEN 'UNAVAILABLE:CACHE_MISSING' WHEN d.{c} = s.{c} THEN 'EXACT:'
  WHEN {v.norm_sql('d.' + c)} = {v.norm_sql('s.' + c)} THEN 'MISMATCH:SEMANTIC_MISMATCH' ELSE 'MISMATCH:VALUE_MISMATCH' END"""


@query("column_equivalence", f"""WITH {v.DETAIL_CTE}, d AS (SELECT id, TIPO_DE_CITA || SUCURSAL AS AC,
  TIPO_DE_CITA || SEXO AS AD, {', '.join(qs._derived_sql(c) for c in ('AG', 'AJ'))}, CAST({v.AGE_SQL} AS INT) AS AF
  FROM flags WHERE active),
s AS (SELECT id, CASE WHEN id % 19 = 0 THEN NULL WHEN id % 23 = 0 THEN lower(AC) ELSE AC END AS AC,
  CASE WHEN id % 29 = 0 THEN 'otro' ELSE AD END AS AD, AG, CASE WHEN id % 31 = 0 THEN '9Mujer' ELSE AJ END AS AJ,
  CASE WHEN id % 37 = 0 THEN '#VALUE!' WHEN id % 41 = 0 THEN '0' WHEN id % 43 = 0 THEN NULL WHEN id % 47 = 0 THEN '7'
    ELSE CAST(AF AS STRING) END AS AF FROM d),
x AS ({' UNION ALL '.join(f"SELECT '{c}' AS c, {_verdict_sql(c)} AS r FROM d JOIN s USING (id)" for c in _TEXT_COLUMNS)}
  UNION ALL SELECT 'AF', CASE WHEN s.AF IS NULL THEN 'UNAVAILABLE:CACHE_MISSING'
    WHEN TRY_CAST(s.AF AS DOUBLE) = d.AF THEN 'EXACT:' WHEN s.AF = '0' AND d.AF > 0 THEN 'UNAVAILABLE:STALE_CACHE_SUSPECTED'
    WHEN d.AF IS NOT NULL AND TRY_CAST(s.AF AS DOUBLE) IS NOT NULL THEN 'MISMATCH:VALUE_MISMATCH'
    WHEN d.AF IS NULL THEN 'MISMATCH:PY_NONE' WHEN starts_with(s.AF, '#') THEN 'UNAVAILABLE:LEGACY_ERROR'
    ELSE 'MISMATCH:VALUE_MISMATCH' END FROM d JOIN s USING (id))
SELECT c AS column, split_part(r, ':', 1) AS status, split_part(r, ':', 2) AS mismatch_type, count(*) AS n
FROM x GROUP BY ALL""")
def column_equivalence(t):
    derived = classify.derived_columns(qs.flags(t).filter("not structurally_empty"))
    return reconcile.column_equivalence(derived, _supplied(derived), "id", [*_TEXT_COLUMNS, "AF"], numeric=["AF"])


_SHIFTED = "CASE WHEN day(DIA_CITA) = 31 THEN NULL WHEN day(FECHA_NACIMIENTO) = 13 THEN age + 1 ELSE age END"


@query("distinct_pair_audit", f"""WITH {v.DETAIL_CTE},
d AS (SELECT DISTINCT FECHA_NACIMIENTO, DIA_CITA, {v.AGE_SQL} AS age FROM flags
  WHERE valid AND FECHA_NACIMIENTO IS NOT NULL), s AS (SELECT *, {_SHIFTED} AS supplied FROM d)
SELECT count(*) AS pairs, count(*) FILTER (WHERE supplied = age) AS match,
  count(*) FILTER (WHERE supplied <> age) AS mismatch, count(*) FILTER (WHERE supplied IS NULL) AS errors FROM s""")
def distinct_pair_audit(t):
    rows = qs.flags(t).filter("valid")
    keys = ["FECHA_NACIMIENTO", "DIA_CITA"]
    age = age_years(F.col(keys[0]), F.col(keys[1]))
    supplied = rows.select(*keys).dropna().distinct().withColumn("age", age).select(
        *keys, F.expr(_SHIFTED).alias("supplied"))
    return reconcile.distinct_pair_audit(rows, keys, age, supplied)


_INVARIANT = """SELECT o_orderkey, CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_custkey + 1 END AS derived_a,
  o_totalprice * 2 AS derived_b, CASE WHEN o_orderstatus = 'P' THEN '=A' || o_custkey ELSE '=B' || o_custkey END AS derived_c
FROM {orders}"""


@query("column_invariants", f"""WITH o AS ({plain(_INVARIANT)})
SELECT 'derived_a' AS column, 'filled_vs_data_rows' AS check_name, count(derived_a) AS found, count(*) AS expected FROM o
UNION ALL SELECT 'derived_a', 'gaps', count(*) - count(derived_a), 0 FROM o
UNION ALL SELECT 'derived_c', 'pattern_count', count(DISTINCT regexp_replace(derived_c, '[0-9]+', 'N', 'g')), 1 FROM o""")
def column_invariants(t):
    df = t.sql(_INVARIANT)
    return reconcile.column_invariants(
        df, ["derived_a", "derived_b", "derived_c"], F.col("o_orderkey").isNotNull(),
        {"derived_a": F.lit("n"), "derived_b": F.lit("n"),
         "derived_c": F.regexp_replace("derived_c", "[0-9]+", "N")})
