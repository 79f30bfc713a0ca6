"""Alignment of a perturbed part vocabulary with the part list, and decisions on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions import labels as L
from metricspark.operators import align, decide, summary
from metricspark.plans import views as v
from metricspark.plans.registry import ORACLES, plain, query
from metricspark.session import cut_lineage

_FOREIGN = ("SURGERY",)
_FLAT = ("PROMO",)
_CODE = "CASE WHEN p_type = 'PROMO' THEN '' || CAST(1000000 + floor(p_partkey / 3) AS BIGINT) ELSE '' END"
# Target slots: noun as section, brand (or code) as row, size tier as column.
_TARGETS = f"""SELECT 'c' || lpad('' || p_partkey, 9, '0') AS target_cell,
  CASE p_size WHEN 13 THEN 'FORMULA_TARGET' WHEN 14 THEN 'STRUCTURAL' WHEN 15 THEN 'VALIDATION' WHEN 16 THEN 'UNKNOWN'
    ELSE 'DIRECT_INPUT_TARGET' END AS target_kind,
  CASE WHEN p_brand = 'Brand#3' THEN 'SURGERY' WHEN p_brand IN ('Brand#4', 'Brand#5') THEN 'UNKNOWN' ELSE 'NATIVE' END AS expectation,
  p_type AS form, CASE WHEN p_size % 9 = 0 THEN 'Bloque;' ELSE '' END || split_part(p_name, ' ', 2) AS section_raw,
  CASE WHEN p_type = 'PROMO' THEN {_CODE} WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 1) || ';' || p_brand ELSE p_brand END AS row_raw,
  'Tramo ' || p_size % 3 || CASE WHEN p_size % 5 = 0 THEN ';20 a 24 años' ELSE '' END AS column_raw,
  CASE p_partkey % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'BOTH' ELSE '' END AS sex,
  CASE WHEN p_size % 10 = 0 THEN NULL ELSE 5 * (p_size % 4) END AS age_lo,
  CASE WHEN p_size % 10 = 0 OR p_size % 4 = 3 THEN NULL ELSE 5 * (p_size % 4) + 4 END AS age_hi,
  CASE WHEN p_size = 20 THEN 'TOTAL' ELSE 'DETAIL' END AS scope, {_CODE} AS code FROM {{part}}"""
# Sources: the same labels as another system writes them, with real disagreements.
_SOURCES = f"""SELECT 'm' || lpad('' || p_partkey, 9, '0') AS metric_id,
  CASE WHEN p_size = 45 THEN 'OTHER' ELSE 'NATIVE' END AS source,
  CASE p_size WHEN 46 THEN 'BLOCKED_CONFLICT' WHEN 47 THEN 'REVIEW_REQUIRED' WHEN 48 THEN 'NOT_APPLICABLE' WHEN 49 THEN NULL
    ELSE 'AUTO_READY' END AS readiness_status,
  p_type AS form, CASE WHEN p_partkey % 23 = 0 THEN 'Otra sección' WHEN p_partkey % 7 = 0 THEN ' ' || upper(split_part(p_name, ' ', 2)) || '  '
    ELSE split_part(p_name, ' ', 2) END AS section_raw,
  CASE WHEN p_type = 'PROMO' THEN {_CODE} || ';' || p_name WHEN p_partkey % 29 = 0 THEN 'Brand#99'
    WHEN p_size % 4 = 0 AND p_partkey % 3 = 0 THEN p_brand WHEN p_size % 4 = 0 THEN split_part(p_name, ' ', 1) || ';' || lower(p_brand)
    ELSE p_brand END AS row_raw,
  CASE WHEN p_partkey % 19 = 0 THEN 'Tramo 9;Mujeres' ELSE 'tramo  ' || p_size % 3 || ';Mujer' END AS column_raw,
  CASE WHEN p_partkey % 11 = 0 THEN 'MALE' ELSE CASE p_partkey % 4 WHEN 0 THEN 'MALE' WHEN 1 THEN 'FEMALE' WHEN 2 THEN 'BOTH'
    ELSE '' END END AS sex,
  CASE WHEN p_size % 17 = 0 THEN 'CONFLICT' WHEN p_size % 3 = 0 THEN 'LABEL_ONLY' ELSE 'CONFIRMED' END AS sex_status,
  CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 5 * (p_size % 4) + 1 ELSE 5 * (p_size % 4) END AS age_lo,
  CASE WHEN p_size % 10 = 0 OR p_size % 4 = 3 THEN NULL ELSE 5 * (p_size % 4) + 4 END AS age_hi,
  CASE WHEN p_size = 21 THEN 'UNRESOLVED' ELSE 'CONFIRMED' END AS age_status,
  CASE WHEN p_size = 20 THEN 'TOTAL' ELSE 'DETAIL' END AS scope, {_CODE} AS code FROM {{part}}"""


def _paths(df):
    """Label paths as normalised arrays; sex and age labels leave the column path."""
    path = lambda c: L.normal_path(F.split(c, ";"))
    return df.withColumns({
        "section": path("section_raw"), "row_path": path("row_raw"),
        "column_path": L.strip_sex_age(path("column_raw")),
    }).drop("section_raw", "row_raw", "column_raw")


def targets(t):
    return _paths(t.sql(_TARGETS))


def all_sources(t):
    return align.eligibility(_paths(t.sql(_SOURCES)), "NATIVE")


def sources(t):
    return all_sources(t).filter("exclusion is null")


def pair_counts(t):
    src = align.source_signatures(align.comparable(sources(t), _FLAT, sources=True))
    tgt = align.target_signatures(align.comparable(targets(t), _FLAT, sources=False))
    return align.evidence_counts(src, tgt, _FLAT)


def _path_sql(c):
    return f"list_filter(list_transform(split({c}, ';'), lambda x: {v.norm_sql('x')}), lambda x: x <> '')"


_AGES = "|".join(f"(?:{p})" for p, _, _ in fixed.AGE_LABELS)
_SEXES = ", ".join(f"'{s}'" for s in fixed.SEX_LABELS)


def _paths_sql(raw):
    return f"""SELECT * EXCLUDE (section_raw, row_raw, column_raw), {_path_sql('section_raw')} AS section,
  {_path_sql('row_raw')} AS row_path, list_filter({_path_sql('column_raw')},
    lambda x: x NOT IN ({_SEXES}) AND NOT regexp_matches(x, '{_AGES}')) AS column_path FROM ({plain(raw)})"""


def _path_ev(a, b):
    return f"""CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 'NOT_APPLICABLE' WHEN len({a}) = 0 OR len({b}) = 0 THEN 'MISSING'
  WHEN {a} = {b} OR ({a}[-1] = {b}[-1] AND (list_has_all({a}, {b}) OR list_has_all({b}, {a}))) THEN 'MATCH'
  WHEN {a}[-1] = {b}[-1] OR list_has_any({a}, {b}) THEN 'PARTIAL' ELSE 'MISMATCH' END"""


_FLAT_SQL = "s.form = 'PROMO'"
_ROW_EV = _path_ev("s.row_path", "t.row_path")
_EV_SQL = f"""{_path_ev('s.section', 't.section')} AS ev_section,
  CASE WHEN s.code <> '' AND s.code = t.code AND list_contains(s.row_path, s.code) AND list_contains(t.row_path, s.code)
    AND {_ROW_EV} IN ('MISMATCH', 'PARTIAL') THEN 'MATCH' ELSE {_ROW_EV} END AS ev_row_path,
  CASE WHEN {_FLAT_SQL} THEN 'NOT_APPLICABLE' ELSE {_path_ev('s.column_path', 't.column_path')} END AS ev_column_path,
  CASE WHEN {_FLAT_SQL} THEN 'NOT_APPLICABLE' WHEN s.sex_status = 'CONFLICT' OR s.sex = '' OR t.sex = '' THEN 'MISSING'
    WHEN s.sex = t.sex THEN 'MATCH' WHEN s.sex = 'BOTH' OR t.sex = 'BOTH' THEN 'PARTIAL' ELSE 'MISMATCH' END AS ev_sex,
  CASE WHEN {_FLAT_SQL} THEN 'NOT_APPLICABLE' WHEN s.age_status <> 'CONFIRMED' OR coalesce(s.age_lo, s.age_hi) IS NULL
      OR coalesce(t.age_lo, t.age_hi) IS NULL THEN 'MISSING'
    WHEN s.age_lo IS NOT DISTINCT FROM t.age_lo AND s.age_hi IS NOT DISTINCT FROM t.age_hi THEN 'MATCH'
    WHEN greatest(coalesce(s.age_lo, 0), coalesce(t.age_lo, 0)) <= least(coalesce(s.age_hi, 200), coalesce(t.age_hi, 200))
    THEN 'PARTIAL' ELSE 'MISMATCH' END AS ev_age,
  CASE WHEN s.scope = t.scope THEN 'MATCH' ELSE 'MISMATCH' END AS ev_aggregation_scope,
  CASE WHEN s.code = '' AND t.code = '' THEN 'NOT_APPLICABLE' WHEN s.code = '' OR t.code = '' THEN 'MISSING'
    WHEN s.code = t.code THEN 'MATCH' ELSE 'MISMATCH' END AS ev_procedure_code"""
_NAMES = {d: f"ev_{d.lower()}" for d in align.EVIDENCE}
_DEN = " + ".join(f"CASE WHEN {n} IN ('MATCH', 'PARTIAL', 'MISMATCH') THEN {fixed.WEIGHTS[d]} ELSE 0 END" for d, n in _NAMES.items())
_NUM = " + ".join(f"CASE {n} WHEN 'MATCH' THEN {fixed.WEIGHTS[d]}.0::DOUBLE WHEN 'PARTIAL' THEN {fixed.WEIGHTS[d]} * 0.5::DOUBLE ELSE 0 END"
                  for d, n in _NAMES.items())
_PAIRS = f"""tg AS ({_paths_sql(_TARGETS)}), src AS ({_paths_sql(_SOURCES)}),
el AS (SELECT * FROM src WHERE source = 'NATIVE' AND readiness_status = 'AUTO_READY'),
pr AS (SELECT s.metric_id, s.form, t.target_cell, t.expectation, {_EV_SQL}
  FROM el s JOIN tg t ON s.form = t.form AND t.target_kind IN ('DIRECT_INPUT_TARGET', 'FORMULA_TARGET')
  AND (s.row_path[-1] = t.row_path[-1] OR list_has_any(s.section, t.section) OR (s.code <> '' AND s.code = t.code))),
sc AS (SELECT *, CASE WHEN {_DEN} = 0 THEN 0.0 ELSE round(({_NUM}) / ({_DEN}), 4) END AS score,
  ev_sex = 'MISMATCH' OR ev_age = 'MISMATCH' OR ev_procedure_code = 'MISMATCH' AS conflict FROM pr)"""


@query("align_candidates", f"WITH {_PAIRS} SELECT form, count(*) AS pairs FROM sc GROUP BY form")
def align_candidates(t):
    """Candidate pairs per form; pairs are counted as products of multiplicities."""
    return pair_counts(t).groupBy("form").agg(F.sum("pairs").alias("pairs"))


_EV_LIST = ", ".join(_NAMES.values())


@query("align_scores", f"""WITH {_PAIRS}
SELECT form, score, conflict, {_EV_LIST}, count(*) AS pairs FROM sc GROUP BY ALL""")
def align_scores(t):
    """How often each combination of evidence occurs, with its score."""
    return align.scores(pair_counts(t)).drop("evidence")


_BEST = f"""{_PAIRS},
rb AS (SELECT metric_id, max(score) FILTER (WHERE NOT conflict) AS real_best, count(*) AS n FROM sc GROUP BY 1),
nr AS (SELECT sc.metric_id, count(*) AS n_near FROM sc JOIN rb USING (metric_id)
  WHERE NOT conflict AND real_best - score <= {fixed.TIE_MARGIN} + 1e-9 GROUP BY 1),
pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY conflict, -score, target_cell) AS k FROM sc) WHERE k = 1),
oc AS (SELECT el.metric_id, el.form, pk.score, pk.target_cell, nr.n_near, real_best, pk.expectation, {', '.join('pk.' + n for n in _NAMES.values())},
  CASE WHEN pk.metric_id IS NULL THEN 'NO_TARGET' WHEN real_best IS NULL THEN 'CONFLICT'
    WHEN pk.score < {fixed.STRONG_THRESHOLD} THEN 'CONTEXT_INSUFFICIENT' WHEN pk.expectation = 'SURGERY' THEN 'TARGET_SOURCE_NOT_NATIVE'
    WHEN n_near > 1 THEN 'AMBIGUOUS'
    WHEN pk.score >= 1 AND ev_row_path = 'MATCH' AND ev_column_path IN ('MATCH', 'NOT_APPLICABLE') AND ev_sex IN ('MATCH', 'NOT_APPLICABLE')
      AND ev_age IN ('MATCH', 'NOT_APPLICABLE') THEN 'EXACT_SEMANTIC_MATCH' ELSE 'STRONG_MATCH' END AS outcome
  FROM el LEFT JOIN pk USING (metric_id) LEFT JOIN rb USING (metric_id) LEFT JOIN nr USING (metric_id)),
best AS (SELECT metric_id, form, outcome, score, CASE WHEN hit THEN target_cell END AS target_cell,
  CASE WHEN real_best IS NOT NULL THEN n_near END AS n_near, {', '.join(f'CASE WHEN hit THEN {n} END AS {n}' for n in _NAMES.values())}
  FROM (SELECT *, outcome IN ('EXACT_SEMANTIC_MATCH', 'STRONG_MATCH', 'AMBIGUOUS', 'CONFLICT') AS hit FROM oc))"""


def matches(t):
    return align.best_matches(sources(t), targets(t), foreign=_FOREIGN, flat_forms=_FLAT)


@query("align_best", f"WITH {_BEST} SELECT * FROM best")
def align_best(t):
    return matches(t)


@query("align_unmatched", f"""WITH {_BEST}
SELECT 'source' AS side, metric_id AS id, CASE WHEN readiness_status IS NULL THEN 'NO_READINESS'
    WHEN source <> 'NATIVE' THEN 'SOURCE_NOT_NATIVE' WHEN readiness_status = 'NOT_APPLICABLE' THEN 'ROLLUP_NOT_INPUT'
    ELSE readiness_status END AS reason FROM src
  WHERE readiness_status IS NULL OR source <> 'NATIVE' OR readiness_status <> 'AUTO_READY'
UNION ALL SELECT 'source', metric_id, outcome FROM best
  WHERE outcome IN ('CONFLICT', 'NO_TARGET', 'CONTEXT_INSUFFICIENT', 'TARGET_SOURCE_NOT_NATIVE')
UNION ALL SELECT 'target', target_cell, CASE target_kind WHEN 'STRUCTURAL' THEN 'STRUCTURAL_NOT_ALIGNMENT_TARGET'
    WHEN 'VALIDATION' THEN 'VALIDATION_NOT_ALIGNMENT_TARGET' WHEN 'FORMULA_TARGET' THEN 'DERIVED_TARGET_NOT_INPUT'
    WHEN 'UNKNOWN' THEN 'UNKNOWN_SOURCE' ELSE CASE expectation WHEN 'SURGERY' THEN 'NON_NATIVE_REGION'
      WHEN 'NATIVE' THEN 'NO_NATIVE_SOURCE_FOUND' ELSE 'UNKNOWN_SOURCE' END END
  FROM tg WHERE target_cell NOT IN (SELECT target_cell FROM best WHERE outcome IN ('EXACT_SEMANTIC_MATCH', 'STRONG_MATCH'))""")
def align_unmatched(t):
    best = cut_lineage(matches(t).select("metric_id", "outcome", "target_cell"))
    side = lambda df, name, key: df.select(F.lit(name).alias("side"), F.col(key).alias("id"), "reason")
    excluded = all_sources(t).filter("exclusion is not null").withColumn("reason", F.col("exclusion"))
    lost = best.filter(F.col("outcome").isin(
        "CONFLICT", "NO_TARGET", "CONTEXT_INSUFFICIENT", "TARGET_SOURCE_NOT_NATIVE")).withColumn("reason", F.col("outcome"))
    left = align.unmatched_targets(targets(t), best, foreign=_FOREIGN)
    return side(excluded, "source", "metric_id").unionByName(side(lost, "source", "metric_id")).unionByName(
        side(left, "target", "target_cell"))


_SLOTS = """SELECT 'c' || lpad('' || p_partkey, 9, '0') AS target_cell,
  CASE WHEN p_size = 22 THEN 'STRUCTURAL' ELSE 'INPUT_TARGET' END AS target_role,
  CASE WHEN p_size = 23 THEN true WHEN p_size = 24 THEN NULL ELSE false END AS locked,
  CASE WHEN p_size = 25 THEN 'texto' WHEN p_size = 26 THEN '' END AS target_txt FROM {part}"""
_STRONG = {"PROMO": ("ROW_PATH", "PROCEDURE_CODE"), "LARGE": ("SECTION", "ROW_PATH", "COLUMN_PATH", "SEX", "AGE")}


def _lacking_sql(dims):
    return "list_filter([" + ", ".join(
        f"CASE WHEN {_NAMES[d]} NOT IN ('MATCH', 'NOT_APPLICABLE') THEN '{d}' END" for d in dims
    ) + "], lambda x: x IS NOT NULL)"


_MISM_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN {n} = 'MISMATCH' THEN '{d}' END" for d, n in _NAMES.items()) + "], lambda x: x IS NOT NULL)"


@query("write_readiness", f"""WITH {_BEST}, sl AS ({plain(_SLOTS)}),
w AS (SELECT b.*, 'AUTO_READY' AS readiness_status, tg.target_kind, tg.expectation, target_role, locked, target_txt,
  {_MISM_SQL} AS mism, CASE b.form WHEN 'PROMO' THEN {_lacking_sql(_STRONG['PROMO'])} WHEN 'LARGE' THEN {_lacking_sql(_STRONG['LARGE'])}
    ELSE {_lacking_sql(('SECTION', 'ROW_PATH', 'COLUMN_PATH'))} END AS lack
  FROM best b JOIN tg USING (target_cell) JOIN sl USING (target_cell)),
d AS (SELECT *, CASE WHEN outcome = 'AMBIGUOUS' THEN 'WRITE_BLOCKED:MATCH_AMBIGUOUS' WHEN outcome = 'CONFLICT' THEN 'WRITE_BLOCKED:DIMENSION_CONFLICT'
  WHEN target_kind = 'FORMULA_TARGET' THEN 'NOT_WRITABLE:TARGET_IS_FORMULA' WHEN target_role <> 'INPUT_TARGET' THEN 'NOT_WRITABLE:TARGET_ROLE_NOT_INPUT'
  WHEN coalesce(locked, true) THEN 'WRITE_BLOCKED:TARGET_LOCKED' WHEN expectation = 'SURGERY' THEN 'WRITE_BLOCKED:TARGET_SOURCE_NOT_NATIVE'
  WHEN expectation <> 'NATIVE' THEN 'WRITE_REVIEW_REQUIRED:TARGET_SOURCE_EXPECTATION_UNKNOWN'
  WHEN coalesce(target_txt, '') <> '' THEN 'WRITE_REVIEW_REQUIRED:EXPECTED_VALUE_TYPE_INCOMPATIBLE'
  WHEN outcome = 'EXACT_SEMANTIC_MATCH' THEN 'WRITE_READY:EXACT_ALL_DIMENSIONS_MATCH'
  WHEN len(mism) > 0 THEN 'WRITE_REVIEW_REQUIRED:STRONG_DIMENSION_MISMATCH'
  WHEN len(lack) > 0 THEN 'WRITE_REVIEW_REQUIRED:STRONG_MISSING_REQUIRED_DIMENSION' ELSE 'WRITE_READY:STRONG_REQUIRED_DIMENSIONS_MATCH' END AS g FROM w),
cand AS (SELECT target_cell FROM d WHERE g LIKE 'WRITE_READY%' OR g LIKE 'WRITE_REVIEW%' GROUP BY 1 HAVING count(DISTINCT metric_id) > 1),
z AS (SELECT *, (g LIKE 'WRITE_READY%' OR g LIKE 'WRITE_REVIEW%') AND target_cell IN (SELECT target_cell FROM cand) AS clash FROM d)
SELECT metric_id, target_cell, CASE WHEN clash THEN 'WRITE_BLOCKED' ELSE split_part(g, ':', 1) END AS write_status,
  CASE WHEN clash THEN 'WRITE_COLLISION' ELSE split_part(g, ':', 2) END AS write_reason,
  array_to_string(CASE WHEN g LIKE '%DIMENSION_MISMATCH' THEN mism WHEN g LIKE '%MISSING_REQUIRED_DIMENSION' THEN lack ELSE [] END, ',')
    AS missing_evidence FROM z""")
def write_readiness(t):
    tg = targets(t).select("target_cell", "target_kind", "expectation").join(t.sql(_SLOTS), "target_cell")
    rows = matches(t).filter("target_cell is not null").join(tg, "target_cell").withColumn(
        "readiness_status", F.lit("AUTO_READY"))
    policy = decide.WritePolicy(foreign=_FOREIGN, strong_by_form=_STRONG)
    judged = cut_lineage(decide.write_readiness(rows, policy))
    return decide.apply_collisions(judged).select(
        "metric_id", "target_cell", "write_status", "write_reason",
        F.array_join("missing_evidence", ",").alias("missing_evidence"))


_LABELS = """SELECT 'd' || p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN upper(p_name) || ' ' || p_brand WHEN 1 THEN p_name || '.' || p_brand
  WHEN 2 THEN '' || (5000000 + p_size) WHEN 3 THEN '' || p_size WHEN 4 THEN 'ab' WHEN 5 THEN ' ' || p_name || '  ' || p_brand
  WHEN 6 THEN p_name ELSE p_name || ' ' || p_brand END AS label FROM {part}"""
_TEMPLATES = """SELECT 'c' || lpad('' || p_partkey, 9, '0') AS cell, CASE WHEN p_size % 10 = 0 THEN (5000000 + p_size) || ' - ' || p_name
  WHEN p_size % 10 = 1 THEN p_name || ': ' || p_brand ELSE p_name || ' ' || p_brand END AS label FROM {part}"""
_KEY = f"trim(regexp_replace({v.norm_sql('label')}, '[^0-9A-Z ]+', '', 'g'))"


@query("label_cascade_cut", f"""WITH l AS (SELECT *, {_KEY} AS norm, regexp_full_match(trim(label), '[0-9]{{4,9}}') AS is_code FROM ({plain(_LABELS)})),
t AS (SELECT *, {_KEY} AS norm, regexp_extract_all(label, '[0-9]{{4,9}}') AS codes FROM ({plain(_TEMPLATES)})),
u AS (SELECT * FROM l WHERE is_code OR (length(norm) >= 3 AND NOT regexp_full_match(norm, '[0-9]+'))),
h AS (SELECT u.id, u.label, 1 AS tier, cell FROM u JOIN t ON t.label = u.label
  UNION ALL SELECT u.id, u.label, 2, cell FROM u JOIN t ON t.norm = u.norm AND u.norm <> ''
  UNION ALL SELECT u.id, u.label, 3, cell FROM u JOIN (SELECT cell, unnest(codes) AS code FROM t) c ON is_code AND c.code = u.label),
m AS (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM h),
r AS (SELECT *, count(*) OVER (PARTITION BY id) AS total_hits, row_number() OVER (PARTITION BY id ORDER BY cell) AS k FROM m WHERE tier = best)
SELECT id, label, CASE WHEN total_hits > 1 THEN 'ambiguous' ELSE ['exact_label', 'normalized_label', 'contextual'][tier] END AS match_type,
  CAST(CASE WHEN total_hits > 1 THEN CASE WHEN tier < 3 THEN 0.4 ELSE 0.35 END ELSE [1.0, 0.85, 0.7][tier] END AS DOUBLE) AS confidence,
  total_hits, cell FROM r WHERE k <= 6""")
def label_cascade_cut(t):
    return align.label_cascade(t.sql(_LABELS), t.sql(_TEMPLATES), limit=fixed.MAX_AMBIGUOUS_PER_LABEL)


@query("label_cascade", ORACLES["label_cascade_cut"].removesuffix(" WHERE k <= 6"))
def label_cascade(t):
    return align.label_cascade(t.sql(_LABELS), t.sql(_TEMPLATES))


_REGIONS = (
    {"id": "R1", "source": "SURGERY", "sheet": "brand#1", "row_min": 100, "row_max": 900},
    {"id": "R2", "source": "EXPORT", "sheet": "BRAND#1", "section_contains": ("ring", "Bólt")},
    {"id": "R3", "source": "NATIVE", "sheet": "Brand#1"},
    {"id": "R4", "source": "SURGERY", "sheet": "Brand#2", "row_min": 1200},
    {"id": "R5", "source": "NATIVE", "sheet": "Brand#2", "section_contains": ("gizmo",)},
    {"id": "R6", "source": "NATIVE", "sheet": "Brand#7"},
)


@query("region_lookup", """WITH r AS (SELECT p_partkey, CASE
  WHEN p_brand = 'Brand#1' AND p_partkey BETWEEN 100 AND 900 THEN 'R1'
  WHEN p_brand = 'Brand#1' AND (p_name LIKE '%ring%' OR p_name LIKE '%bolt%') THEN 'R2' WHEN p_brand = 'Brand#1' THEN 'R3'
  WHEN p_brand = 'Brand#2' AND p_partkey >= 1200 THEN 'R4' WHEN p_brand = 'Brand#2' AND p_name LIKE '%gizmo%' THEN 'R5'
  WHEN p_brand = 'Brand#7' THEN 'R6' END AS region_id FROM part)
SELECT p_partkey, region_id, CASE WHEN region_id IN ('R1', 'R4') THEN 'SURGERY' WHEN region_id = 'R2' THEN 'EXPORT'
  WHEN region_id IS NULL THEN 'UNKNOWN' ELSE 'NATIVE' END AS expectation FROM r""")
def region_lookup(t):
    cells = t.part.select("p_partkey", F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row_no"),
                          L.normal_path(F.array("p_name")).alias("section"))
    return align.region_lookup(cells, _REGIONS).select("p_partkey", "region_id", "expectation")


# Metrics whose labels and criteria agree, disagree or are silent.
_METRICS = """SELECT 'm' || lpad('' || p_partkey, 9, '0') AS metric_id, CASE WHEN p_size = 44 THEN '' ELSE p_type END AS form,
  CASE p_size % 12 WHEN 0 THEN 'Grupo de edad;20 A 24 AÑOS;Hombres' WHEN 1 THEN '20 a 24 años;Mujer' WHEN 2 THEN '75 y más años;Ambos sexos'
    WHEN 3 THEN 'TOTAL' WHEN 4 THEN 'Hombre;Mujeres' WHEN 5 THEN 'Menos de 1 año - 1 año;Mujeres' WHEN 6 THEN 'Menor de 15 años'
    WHEN 7 THEN '15 - 19;Hombre' WHEN 8 THEN 'Sin rótulo' WHEN 9 THEN '5 años;Mujer' WHEN 10 THEN '' ELSE 'Total;Hombres' END AS column_raw,
  CASE p_partkey % 5 WHEN 0 THEN '*Hombre*' WHEN 1 THEN '*mujer*;x' WHEN 2 THEN '' WHEN 3 THEN 'otro' ELSE '*hombre*;*Mujer*' END AS criteria_raw,
  CASE p_size % 7 WHEN 0 THEN 'A.1. Grupo' WHEN 1 THEN '5010009 - VIDRIO;x' WHEN 2 THEN 'Actividad;0101316;123456;Consulta'
    WHEN 3 THEN '12345' WHEN 4 THEN '' WHEN 5 THEN '99 - corto;' || p_name ELSE p_name END AS row_raw,
  p_partkey % 2 = 0 AS has_age, CASE p_partkey % 6 WHEN 0 THEN 20 WHEN 2 THEN 0 END AS f_lo,
  CASE p_partkey % 10 WHEN 0 THEN 24 WHEN 4 THEN 4 END AS f_hi,
  CASE WHEN p_size % 8 = 0 THEN 'AMBIGUOUS' ELSE 'COMPLETE' END AS context_status, p_size = 50 AS own_header FROM {part}"""


_READ = ["form", "column_raw", "criteria_raw", "row_raw", "has_age", "f_lo", "f_hi", "context_status", "own_header"]


def metric_inputs(t):
    return _split(t.sql(_METRICS))


def _split(metrics):
    raw = lambda c: F.filter(F.split(c, ";"), lambda x: x != "")
    return metrics.withColumns({
        "column_path": raw("column_raw"), "criteria": raw("criteria_raw"), "row_path": raw("row_raw"),
        "formula_age": F.when(F.col("has_age"), F.struct(F.col("f_lo").alias("lo"), F.col("f_hi").alias("hi"))),
    })


def mapped(t):
    return decide.map_metrics(metric_inputs(t))


def _bound_sql(pattern, spec):
    if spec is None:
        return "NULL"
    if not spec.startswith("g"):
        return spec
    value = f"TRY_CAST(regexp_extract(x, '{pattern}', {spec[1]}) AS INT)"
    return value + " - 1" if spec.endswith("-1") else value


def _age_case(side):
    return "CASE " + " ".join(
        f"WHEN regexp_matches(x, '{p}') THEN {_bound_sql(p, b[side])}" for p, *b in fixed.AGE_LABELS) + " END"


_SEX_MAP = "CASE " + " ".join(f"WHEN {v.norm_sql('x')} = '{k}' THEN '{s}'" for k, s in fixed.SEX_LABELS.items()) + " END"
_INLINE, _BARE = r"^([0-9]{4,8})\s*-\s*(.+)$", r"^[0-9]{4,8}$"
_MAPPED = f"""i AS (SELECT *, list_filter(split(column_raw, ';'), lambda x: x <> '') AS cp,
  list_filter(split(criteria_raw, ';'), lambda x: x <> '') AS cr, list_filter(split(row_raw, ';'), lambda x: x <> '') AS rp FROM ({plain(_METRICS)})),
a AS (SELECT *, list_distinct(list_filter(list_transform(cp, lambda x: {_SEX_MAP}), lambda x: x IS NOT NULL)) AS sl,
  list_filter([CASE WHEN len(list_filter(cr, lambda x: contains(lower(x), 'hombre'))) > 0 THEN 'MALE' END,
    CASE WHEN len(list_filter(cr, lambda x: contains(lower(x), 'mujer'))) > 0 THEN 'FEMALE' END], lambda x: x IS NOT NULL) AS sc,
  list_filter(list_transform(list_transform(cp, lambda x: {v.norm_sql('x')}),
    lambda x: {{'hit': regexp_matches(x, '{_AGES}'), 'lo': {_age_case(0)}, 'hi': {_age_case(1)}}}), lambda x: x.hit)[1] AS la,
  list_position(list_transform(rp, lambda x: regexp_matches(trim(x), '{_INLINE}|{_BARE}')), true) AS pp FROM i),
b AS (SELECT *, trim(rp[pp]) AS pl, la IS NOT NULL AS hl,
  NOT (coalesce(la.lo > f_hi, false) OR coalesce(f_lo > la.hi, false)) AS ov FROM a),
c AS (SELECT *, CASE WHEN len(sl) > 1 THEN 'CONFLICT' WHEN len(sl) = 1 AND len(sc) = 1 THEN CASE WHEN sl[1] = sc[1] THEN 'CONFIRMED' ELSE 'CONFLICT' END
    WHEN len(sl) = 1 THEN 'LABEL_ONLY' WHEN len(sc) = 1 THEN 'FORMULA_ONLY' WHEN len(sc) > 1 THEN 'UNRESOLVED' ELSE 'NOT_APPLICABLE' END AS sex_status,
  CASE WHEN len(sl) > 1 THEN '' WHEN len(sl) = 1 THEN sl[1] WHEN len(sc) = 1 THEN sc[1] ELSE '' END AS sex_value,
  CASE WHEN len(sl) > 1 THEN 'SEX_LABELS_DISAGREE' WHEN len(sl) = 1 AND len(sc) = 1 AND sl[1] <> sc[1] THEN 'SEX_LABEL_FORMULA_MISMATCH' END AS sex_conflict,
  CASE WHEN hl AND has_age THEN CASE WHEN ov THEN 'CONFIRMED' ELSE 'CONFLICT' END WHEN hl THEN 'LABEL_ONLY' WHEN has_age THEN 'FORMULA_ONLY'
    WHEN context_status = 'AMBIGUOUS' THEN 'UNRESOLVED' ELSE 'NOT_APPLICABLE' END AS age_status,
  CASE WHEN hl AND has_age AND NOT ov THEN 'AGE_LABEL_FORMULA_DISJOINT' END AS age_conflict,
  CAST(CASE WHEN hl THEN la.lo WHEN has_age THEN f_lo END AS INT) AS age_lo, CAST(CASE WHEN hl THEN la.hi WHEN has_age THEN f_hi END AS INT) AS age_hi,
  coalesce(regexp_extract(pl, '^([0-9]+)', 1), '') AS procedure_code,
  CASE WHEN pl IS NULL THEN '' WHEN regexp_matches(pl, '{_INLINE}') THEN trim(regexp_extract(pl, '{_INLINE}', 2))
    ELSE coalesce(list_filter(list_transform(rp[CAST(pp + 1 AS INT):], lambda x: trim(x)), lambda x: NOT regexp_matches(x, '{_INLINE}|{_BARE}'))[1], '') END AS procedure_label FROM b),
d AS (SELECT *, len(list_filter(cp, lambda x: {v.norm_sql('x')} = 'TOTAL')) > 0 AS tot,
  own_header OR (len(rp) = 1 AND regexp_matches(rp[1], '(?i){fixed.GROUP_HEADER}')) AS hdr FROM c),
e AS (SELECT *, CASE WHEN tot THEN 'TOTAL' WHEN hdr THEN 'SUBTOTAL' ELSE 'DETAIL' END AS aggregation_scope,
  CASE WHEN tot OR hdr OR sex_status IN ('CONFIRMED', 'LABEL_ONLY', 'FORMULA_ONLY') OR age_status IN ('CONFIRMED', 'LABEL_ONLY', 'FORMULA_ONLY')
    OR procedure_code <> '' THEN 'CONFIRMED' ELSE 'UNRESOLVED' END AS scope_status FROM d),
mp AS (SELECT metric_id, form, rp, sex_value, sex_status, sex_conflict, age_lo, age_hi, age_status, age_conflict, aggregation_scope, scope_status,
  procedure_code, procedure_label, CASE WHEN procedure_code <> '' THEN 'EXPLICIT' WHEN aggregation_scope <> 'DETAIL' THEN 'NOT_APPLICABLE'
    ELSE 'UNRESOLVED' END AS procedure_status,
  CASE WHEN sex_conflict IS NOT NULL OR age_conflict IS NOT NULL THEN 'CONFLICT'
    WHEN sex_status IN ('CONFIRMED', 'NOT_APPLICABLE') AND age_status IN ('CONFIRMED', 'NOT_APPLICABLE') AND scope_status = 'CONFIRMED'
    THEN 'CONFIRMED' ELSE 'PARTIAL' END AS mapping_status FROM e)"""


@query("infer_two_source", f"WITH {_MAPPED} SELECT metric_id, sex_value, sex_status, sex_conflict FROM mp")
def infer_two_source(t):
    return mapped(t).select("metric_id", "sex_value", "sex_status", "sex_conflict")


@query("infer_interval", f"WITH {_MAPPED} SELECT metric_id, age_lo, age_hi, age_status, age_conflict FROM mp")
def infer_interval(t):
    return mapped(t).select("metric_id", "age_lo", "age_hi", "age_status", "age_conflict")


@query("mapping_status", f"""WITH {_MAPPED} SELECT metric_id, aggregation_scope, scope_status, procedure_code, procedure_label,
  procedure_status, mapping_status FROM mp""")
def mapping_status(t):
    return mapped(t).select("metric_id", "aggregation_scope", "scope_status", "procedure_code",
                            "procedure_label", "procedure_status", "mapping_status")


_POLICY = decide.ReadinessPolicy(by_form={
    "LARGE": ("form", "row_path", "aggregation_scope", "sex", "age"),
    "PROMO": ("form", "row_path", "aggregation_scope", "procedure"),
}, overrides=("m000000004", "m000000150"))


def _required_sql(d):
    base = d in _POLICY.default
    special = " ".join(f"WHEN form = '{f}' THEN {str(d in dims).lower()}" for f, dims in _POLICY.by_form.items())
    return f"CASE WHEN aggregation_scope <> 'DETAIL' THEN {str(base).lower()} {special} ELSE {str(base).lower()} END"


_DIM_SQL = {
    "form": "CASE WHEN form <> '' THEN 'RESOLVED' ELSE 'MISSING' END",
    "row_path": "CASE WHEN len(rp) > 0 THEN 'RESOLVED' ELSE 'MISSING' END", "aggregation_scope": "scope_status",
    "sex": "sex_status", "age": "age_status", "procedure": "procedure_status",
}
_ISSUES = f"""{_MAPPED}, iss AS (
  SELECT metric_id, form, 'SEX' AS dimension, sex_conflict AS issue_type, 'BLOCKING' AS severity FROM mp WHERE sex_conflict IS NOT NULL
  UNION ALL SELECT metric_id, form, 'AGE', age_conflict, 'BLOCKING' FROM mp WHERE age_conflict IS NOT NULL
  {' '.join(f"UNION ALL SELECT metric_id, form, '{d.upper()}', '{d.upper()}_' || {s}, CASE WHEN {_required_sql(d)} THEN 'REVIEW' ELSE 'INFO' END FROM mp WHERE {s} IN ('LABEL_ONLY', 'FORMULA_ONLY', 'UNRESOLVED', 'MISSING')" for d, s in _DIM_SQL.items())}),
rd AS (SELECT mp.*, CASE WHEN bool_or(severity = 'BLOCKING') THEN 'BLOCKED_CONFLICT' WHEN any_value(aggregation_scope) <> 'DETAIL' THEN 'NOT_APPLICABLE'
    WHEN bool_or(severity = 'REVIEW') THEN 'REVIEW_REQUIRED' ELSE 'AUTO_READY' END AS readiness_status,
  coalesce(array_to_string(list_sort(list_distinct(list(issue_type) FILTER (WHERE severity <> 'INFO'))), '|'), '') AS review_reasons
  FROM mp LEFT JOIN iss USING (metric_id) GROUP BY ALL)"""


def ready(t):
    return decide.readiness(mapped(t), _POLICY)


@query("readiness", f"""WITH {_ISSUES} SELECT metric_id, readiness_status, review_reasons,
  metric_id IN ('m000000004', 'm000000150') AS override_matched FROM rd""")
def readiness(t):
    return ready(t).select("metric_id", "readiness_status", "review_reasons", "override_matched")


def issues(t):
    """Issues of all metrics, worked out once for those that read the same."""
    metrics = t.sql(_METRICS).withColumn("read", F.sha2(F.to_json(F.struct(*_READ)), 256))
    return issues_by_reading(metrics)


def issues_by_reading(metrics):
    one = metrics.groupBy("read").agg(*[F.first(c).alias(c) for c in _READ])
    # map_metrics carries an id through; here it is the reading, which stands for all metrics that have it.
    ready_once = decide.readiness(decide.map_metrics(_split(one.withColumnRenamed("read", "metric_id"))), _POLICY)
    found = cut_lineage(ready_once.select(F.col("metric_id").alias("read"), "form", F.inline("issues")))
    return metrics.select("read", "metric_id").join(found, "read").drop("read")


@query("issue_reasons", f"""WITH {_ISSUES} SELECT issue_type, dimension, severity, count(*) AS n FROM iss GROUP BY ALL""")
def issue_reasons(t):
    return issues(t).groupBy("issue_type", "dimension", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("review_clusters", f"""WITH {_ISSUES} SELECT form, dimension, issue_type, severity, count(*) AS members,
  array_to_string(list_slice(list_sort(list(metric_id)), 1, 5), ',') AS examples FROM iss GROUP BY ALL""")
def review_clusters(t):
    found = summary.review_clusters(issues(t), ["form", "dimension", "issue_type", "severity"], "metric_id")
    return found.withColumn("examples", F.array_join("examples", ","))


_STATUSES = ("AUTO_READY", "REVIEW_REQUIRED", "BLOCKED_CONFLICT", "NOT_APPLICABLE")


@query("coverage_grid", f"""WITH {_ISSUES} SELECT CASE WHEN grouping(form) = 0 THEN form ELSE 'TOTAL' END AS form,
  CASE WHEN grouping(form) = 0 THEN aggregation_scope ELSE 'TOTAL' END AS aggregation_scope, count(*) AS total,
  {', '.join(f"count(*) FILTER (WHERE readiness_status = '{s}') AS {s.lower()}" for s in _STATUSES)}
FROM rd GROUP BY GROUPING SETS ((form, aggregation_scope), ())""")
def coverage_grid(t):
    return summary.coverage_grid(ready(t), ["form", "aggregation_scope"], "readiness_status", _STATUSES)


@query("stratified_sample", f"""WITH {_MAPPED}, bk AS (
  SELECT metric_id, 'large' AS bucket FROM mp WHERE form = 'LARGE' UNION ALL SELECT metric_id, 'promo' FROM mp WHERE form = 'PROMO'
  UNION ALL SELECT metric_id, 'male' FROM mp WHERE sex_value = 'MALE' UNION ALL SELECT metric_id, 'code' FROM mp WHERE procedure_code <> ''
  UNION ALL SELECT metric_id, 'open' FROM mp WHERE age_lo IS NOT NULL AND age_hi IS NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY metric_id) AS k FROM bk)
SELECT metric_id FROM rk WHERE k <= CASE WHEN bucket = 'code' THEN 5 ELSE 3 END
UNION SELECT metric_id FROM mp WHERE mapping_status = 'CONFLICT'""")
def stratified_sample(t):
    c = F.col
    return summary.stratified_sample(mapped(t), "metric_id", {
        "large": (c("form") == "LARGE", 3), "promo": (c("form") == "PROMO", 3), "male": (c("sex_value") == "MALE", 3),
        "code": (c("procedure_code") != "", 5), "open": (c("age_lo").isNotNull() & c("age_hi").isNull(), 3),
        "conflicts": (c("mapping_status") == "CONFLICT", None)})


_STEPS = ((r'"(?:[^"]|"")*"', "<STR>"), (r"[A-Z]{1,3}[0-9]+:[A-Z]{1,3}[0-9]+", "<RANGE>"),
          (r"[A-Z]{1,3}[0-9]+", "<CELL>"), (r"\b[0-9]+(?:\.[0-9]+)?", "<NUM>"), (r"\s+", ""))
_FORMULAS = """SELECT '=COUNTIFS(A2:A' || l_orderkey || ',"' || l_returnflag || '",B2:B' || l_orderkey || ', ' || CASE l_linenumber % 3
  WHEN 0 THEN '"F"' WHEN 1 THEN '' || l_quantity ELSE 'C' || l_suppkey END || ')' AS formula FROM {lineitem}"""


def _family_sql():
    out = "trim(formula)"
    for pattern, mark in _STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{mark}', 'g')"
    return out


@query("template_families", f"""SELECT {_family_sql()} AS family, count(*) AS n, min(formula) AS example
FROM ({plain(_FORMULAS)}) GROUP BY 1""")
def template_families(t):
    return summary.template_families(t.sql(_FORMULAS), F.col("formula"), _STEPS)


@query("structural_fingerprint", """WITH k AS (SELECT DISTINCT l_returnflag AS sheet, l_orderkey || ':' || l_linenumber AS key FROM lineitem),
d AS (SELECT *, sha256(key) AS h FROM k)
SELECT sheet, count(*) AS n_keys, sha256(count(*) || ':' || sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) || ':' ||
  sum(CAST('0x' || substr(h, 16, 15) AS BIGINT))) AS fingerprint FROM d GROUP BY sheet""")
def structural_fingerprint(t):
    rows = t.lineitem.withColumnRenamed("l_returnflag", "sheet")
    return summary.structural_fingerprint(rows, "sheet", F.concat_ws(":", "l_orderkey", "l_linenumber"))


@query("cross_foot", """WITH s AS (SELECT sum(l_quantity) AS q, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)
    + sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity ELSE 0 END) AS p, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS o,
    sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f FROM lineitem)
SELECT 'quantity_by_flag' AS check_name, CAST(q AS DOUBLE) AS left_value, CAST(p AS DOUBLE) AS right_value, CAST(q - p AS DOUBLE) AS difference,
  CASE WHEN q = p THEN 'CONSISTENT' ELSE 'REVIEW' END AS status FROM s
UNION ALL SELECT 'open_vs_final', CAST(o AS DOUBLE), CAST(f AS DOUBLE), CAST(o - f AS DOUBLE), CASE WHEN o = f THEN 'CONSISTENT' ELSE 'REVIEW' END FROM s""")
def cross_foot(t):
    q, flag, state = F.col("l_quantity"), F.col("l_returnflag"), F.col("l_linestatus")
    parts = F.when(flag == "A", q).otherwise(0) + F.when(flag != "A", q).otherwise(0)
    return summary.cross_foot(t.lineitem, {
        "quantity_by_flag": (q, parts),
        "open_vs_final": (F.when(state == "O", 1).otherwise(0), F.when(state == "F", 1).otherwise(0))})
