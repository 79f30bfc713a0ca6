"""Metric graphs: customers feed nations, nations regions, regions the world."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark.operators import checks, graph
from metricspark.plans.registry import plain, query

# Edges with signs, one dependency that does not exist, a difference at the top.
EDGES = """
SELECT 'N:' || c_nationkey AS metric_id, 'C:' || c_custkey AS dep_metric_id, 1 AS sign FROM {customer}
UNION ALL SELECT 'R:' || n_regionkey, 'N:' || n_nationkey,
  CASE WHEN n_nationkey % 6 = 5 THEN -1 ELSE 1 END FROM {nation}
UNION ALL SELECT 'N:' || n_nationkey, 'C:missing', 1 FROM {nation} WHERE n_name = 'NATION_7'
UNION ALL SELECT 'W', 'R:' || r_regionkey, 1 FROM {region}
UNION ALL SELECT 'NET', 'W', 1 FROM {region} WHERE r_name = 'ASIA'
UNION ALL SELECT 'PAIR', 'R:' || r_regionkey, CASE WHEN r_name = 'ASIA' THEN 1 ELSE -1 END
  FROM {region} WHERE r_name IN ('ASIA', 'EUROPE')"""
# The same with two nations that depend on their own region.
CYCLIC_EDGES = EDGES + """
UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 1 FROM {nation}
  WHERE n_name IN ('NATION_4', 'NATION_15')"""
# Orders per customer; customers without a balance sheet report a blank.
BASE = """SELECT 'C:' || c_custkey AS metric_id,
  CASE WHEN c_acctbal BETWEEN 0 AND 300 THEN NULL ELSE coalesce(n, 0) END AS value
FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) o
  ON o_custkey = c_custkey"""
_LITERALS = "SELECT 'NET' AS metric_id, 5.0 AS value FROM {region} WHERE r_name = 'ASIA' " \
            "UNION ALL SELECT 'PAIR', -2.5 FROM {region} WHERE r_name = 'ASIA'"


@query("dag_closure", f"""WITH RECURSIVE e AS ({plain(CYCLIC_EDGES)}),
reach(metric_id, hops) AS (
  SELECT 'C:' || c_custkey, 0 FROM customer WHERE c_acctbal < 0
  UNION SELECT e.metric_id, hops + 1 FROM reach JOIN e ON dep_metric_id = reach.metric_id WHERE hops < 8)
SELECT metric_id, CAST(min(hops) AS INT) AS hops FROM reach GROUP BY metric_id""")
def dag_closure(t):
    sources = t.sql("SELECT 'C:' || c_custkey AS metric_id FROM {customer} WHERE c_acctbal < 0")
    return graph.dag_closure(t.sql(CYCLIC_EDGES), sources)


@query("dag_depth", f"""WITH RECURSIVE e AS ({plain(CYCLIC_EDGES)}),
upper_e AS (SELECT * FROM e WHERE dep_metric_id NOT LIKE 'C:%'),
closure(m, d) AS (SELECT metric_id, dep_metric_id FROM upper_e
  UNION SELECT closure.m, upper_e.dep_metric_id FROM closure JOIN upper_e ON closure.d = upper_e.metric_id),
looped AS (SELECT m FROM closure WHERE m = d),
stuck AS (SELECT m FROM looped UNION SELECT m FROM closure WHERE d IN (SELECT m FROM looped)),
node AS (SELECT metric_id AS m FROM e UNION SELECT dep_metric_id FROM e),
path(m, depth) AS (
  SELECT m, 0 FROM node WHERE m NOT IN (SELECT metric_id FROM e)
  UNION SELECT e.metric_id, depth + 1 FROM path JOIN e ON dep_metric_id = path.m
    WHERE e.metric_id NOT IN (SELECT m FROM stuck))
SELECT m AS metric_id, CAST(max(depth) AS INT) AS depth, false AS cyclic FROM path
  WHERE m NOT IN (SELECT m FROM stuck) GROUP BY m
UNION ALL SELECT m, NULL, true FROM stuck""")
def dag_depth(t):
    return graph.dag_depth(t.sql(CYCLIC_EDGES))


# Own counts of a metric that also has dependencies, a literal without any, a dependency
# that does not exist, and two metrics that wait for each other.
_OWN = BASE + """ UNION ALL SELECT 'R:' || r_regionkey, 7 FROM {region} WHERE r_name IN ('ASIA', 'AFRICA')"""
_DERIVED_EDGES = EDGES + """ UNION ALL SELECT 'LOOP', 'POOL', 1 FROM {region} WHERE r_name = 'ASIA'
UNION ALL SELECT 'POOL', 'LOOP', 1 FROM {region} WHERE r_name = 'ASIA'"""
_CONSTANTS = _LITERALS + " UNION ALL SELECT 'K', 7.0 FROM {region} WHERE r_name = 'ASIA'"


@query("derived_metrics", f"""WITH e AS ({plain(EDGES)}),
own AS (SELECT metric_id, sum(value) AS value FROM (SELECT metric_id, CAST(value AS DOUBLE) AS value FROM ({plain(_OWN)})
  UNION ALL SELECT metric_id, CAST(value AS DOUBLE) FROM ({plain(_CONSTANTS)})) GROUP BY 1),
v0 AS (SELECT metric_id, value, true AS available FROM own WHERE metric_id NOT IN (SELECT metric_id FROM e)),
{''.join(f"""l{i} AS (SELECT e.metric_id, sum(sign * coalesce(v.value, 0)) + coalesce(any_value(own.value), 0) AS s,
  bool_and(coalesce(v.available, false)) AS a FROM e LEFT JOIN v{i - 1} v ON v.metric_id = dep_metric_id
  LEFT JOIN own ON own.metric_id = e.metric_id WHERE {cond} GROUP BY e.metric_id),
v{i} AS (SELECT * FROM v{i - 1} UNION ALL SELECT metric_id, CAST(CASE WHEN a THEN s END AS DOUBLE), a FROM l{i}),
""" for i, cond in ((1, "e.metric_id LIKE 'N:%'"), (2, "e.metric_id LIKE 'R:%'"),
                    (3, "e.metric_id IN ('W', 'PAIR')"), (4, "e.metric_id = 'NET'")))}
done AS (SELECT * FROM v4 UNION ALL SELECT 'LOOP', NULL, false UNION ALL SELECT 'POOL', NULL, false) SELECT * FROM done""")
def derived_metrics(t):
    return graph.derived_metrics(t.sql(_OWN), t.sql(_DERIVED_EDGES), t.sql(_CONSTANTS))


@query("lineage_columns", f"""WITH e AS ({plain(CYCLIC_EDGES)}),
c AS (SELECT DISTINCT 'C:' || o_custkey AS metric_id, o_orderstatus || '/' || o_orderpriority AS col FROM orders),
n AS (SELECT DISTINCT e.metric_id, col FROM e JOIN c ON dep_metric_id = c.metric_id),
r AS (SELECT DISTINCT e.metric_id, col FROM e JOIN n ON dep_metric_id = n.metric_id WHERE e.metric_id LIKE 'R:%'),
n2 AS (SELECT * FROM n UNION SELECT e.metric_id, col FROM e JOIN r ON dep_metric_id = r.metric_id
  WHERE e.metric_id LIKE 'N:%'),
r2 AS (SELECT DISTINCT e.metric_id, col FROM e JOIN n2 ON dep_metric_id = n2.metric_id WHERE e.metric_id LIKE 'R:%'),
w AS (SELECT DISTINCT e.metric_id, col FROM e JOIN r2 ON dep_metric_id = r2.metric_id
  WHERE e.metric_id IN ('W', 'PAIR')),
net AS (SELECT DISTINCT e.metric_id, col FROM e JOIN w ON dep_metric_id = w.metric_id WHERE e.metric_id = 'NET'),
u AS (SELECT * FROM c UNION SELECT * FROM n2 UNION SELECT * FROM r2 UNION SELECT * FROM w UNION SELECT * FROM net)
SELECT metric_id, array_to_string(list_sort(list(col)), ',') AS columns FROM u GROUP BY metric_id""")
def lineage_columns(t):
    local = t.sql("SELECT DISTINCT 'C:' || o_custkey AS metric_id, "
                  "o_orderstatus || '/' || o_orderpriority AS column FROM {orders}")
    return graph.lineage_columns(t.sql(CYCLIC_EDGES), local).withColumn(
        "columns", F.array_join("columns", ","))


_DIRECT = """SELECT 'C:' || c_custkey AS metric_id,
  CASE WHEN c_nationkey IN (1, 2, 3) THEN 'SURGERY' WHEN c_nationkey IN (8, 13) THEN 'EXPORT'
    WHEN c_nationkey = 20 THEN 'UNKNOWN_PENDING'
    WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'SURGERY' ELSE 'EXPORT' END AS source,
  CASE WHEN c_nationkey = 20 THEN 'UNKNOWN' ELSE 'CLIENT_CONFIRMED' END AS status,
  c_nationkey = 20 OR c_nationkey = 2 AS needs_review
FROM {customer} WHERE c_acctbal < 9000"""
_DERIVED = """SELECT 'N:' || n_nationkey AS metric_id FROM {nation}
UNION ALL SELECT 'R:' || r_regionkey FROM {region}
UNION ALL SELECT 'W' FROM {region} WHERE r_name = 'ASIA'
UNION ALL SELECT 'LOST' FROM {region} WHERE r_name = 'ASIA'"""


def _combine_sql(i, previous, condition):
    return f"""u{i} AS (SELECT e.metric_id, list_sort(list_distinct(flatten(list(p.sources)))) AS sources,
  bool_or(p.mixed) AS am, bool_or(p.needs_review) AS ar
  FROM e JOIN {previous} p ON p.metric_id = e.dep_metric_id WHERE {condition} GROUP BY e.metric_id),
p{i} AS (SELECT * FROM {previous} UNION ALL SELECT metric_id, sources, am OR len(sources) > 1,
  am OR ar OR list_contains(sources, 'UNKNOWN_PENDING'), 'DERIVED_FROM_DEPENDENCIES' FROM u{i}),
"""


@query("provenance", f"""WITH e AS (SELECT DISTINCT metric_id, dep_metric_id FROM ({plain(EDGES)})),
direct AS ({plain(_DIRECT)}), derived AS ({plain(_DERIVED)}),
p0 AS (SELECT metric_id, [source] AS sources, false AS mixed, needs_review, status FROM direct
  UNION ALL SELECT 'LOST', ['UNKNOWN_PENDING'], false, true, 'UNKNOWN'),
{_combine_sql(1, 'p0', "e.metric_id LIKE 'N:%'")}{_combine_sql(2, 'p1', "e.metric_id LIKE 'R:%'")}
{_combine_sql(3, 'p2', "e.metric_id = 'W'")}
done AS (SELECT * FROM p3)
SELECT metric_id, CASE WHEN mixed THEN 'MIXED_DERIVED' ELSE sources[1] END AS source, status,
  needs_review, array_to_string(sources, ', ') AS base_sources FROM done""")
def provenance(t):
    return graph.provenance(t.sql(_DIRECT), t.sql(_DERIVED), t.sql(EDGES))


# Parts as directly entered cells; the rules ask for a sheet, labels and codes.
_ENTERED = """SELECT p_partkey, p_brand AS sheet, p_type AS section, p_name AS label, p_size % 4 = 0 AS has_code,
  CASE WHEN p_size = 50 THEN true WHEN p_size = 49 THEN NULL ELSE false END AS expression_changed FROM {part}"""
_RULES = (
    graph.SourceRule("CONTROL", "STRUCTURAL", sheet=" brand#11 "),
    graph.SourceRule("SURGERY", "CLIENT_CONFIRMED", section="^PROMO", coded=True),
    graph.SourceRule("TABLE", "STRUCTURAL", True, section="^(PROMO|ECONOMY)", column="[0-4]$"),
    graph.SourceRule("EXPORT", "CLIENT_CONFIRMED", section="^(LARGE|SMALL)", coded=False),
)


@query("classify_direct", f"""WITH c AS ({plain(_ENTERED)}),
d AS (SELECT *, CASE WHEN coalesce(expression_changed, false) THEN 0 WHEN sheet = 'Brand#11' THEN 1
  WHEN section LIKE 'PROMO%' AND has_code THEN 2
  WHEN (section LIKE 'PROMO%' OR section LIKE 'ECONOMY%') AND regexp_matches(label, '[0-4]$') THEN 3
  WHEN (section LIKE 'LARGE%' OR section LIKE 'SMALL%') AND NOT has_code THEN 4 ELSE 0 END AS rule FROM c)
SELECT p_partkey, ['UNKNOWN_PENDING', 'CONTROL', 'SURGERY', 'TABLE', 'EXPORT'][rule + 1] AS source,
  ['UNKNOWN', 'STRUCTURAL', 'CLIENT_CONFIRMED', 'STRUCTURAL', 'CLIENT_CONFIRMED'][rule + 1] AS status,
  rule IN (0, 3) AS needs_review FROM d""")
def classify_direct(t):
    cells = t.sql(_ENTERED).select(
        "p_partkey", "sheet", F.array("section").alias("section_path"), F.array("label").alias("column_path"),
        F.when(F.col("has_code"), "1302008").otherwise("").alias("procedure_code"), "expression_changed")
    return graph.classify_direct(cells, _RULES).select("p_partkey", "source", "status", "needs_review")


@query("edge_rollups", f"""WITH e AS (SELECT DISTINCT metric_id, dep_metric_id FROM ({plain(CYCLIC_EDGES)})),
i AS (SELECT metric_id AS m, count(*) AS n FROM e GROUP BY 1),
o AS (SELECT dep_metric_id AS m, count(*) AS n FROM e GROUP BY 1)
SELECT coalesce(i.m, o.m) AS metric_id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out
FROM i FULL JOIN o ON i.m = o.m""")
def edge_rollups(t):
    return graph.edge_degrees(t.sql(CYCLIC_EDGES))


@query("edge_group_rollups", f"""WITH e AS ({plain(CYCLIC_EDGES)})
SELECT split_part(metric_id, ':', 1) AS group_id, split_part(dep_metric_id, ':', 1) AS dep_group,
  count(*) AS edges, count(DISTINCT metric_id) AS metrics FROM e GROUP BY 1, 2""")
def edge_group_rollups(t):
    return graph.group_dependencies(
        t.sql(CYCLIC_EDGES), lambda c: F.split_part(c, F.lit(":"), F.lit(1)))


# One rule per customer over its order count; every third row is nested into the rule of
# its nation, and some compare text or point nowhere.
_CHECKS = """
SELECT 'c' || c_custkey AS check_id, 'METRIC' AS left_kind,
  CASE WHEN c_custkey % 41 = 0 THEN 'C:none' ELSE 'C:' || c_custkey END AS left_ref,
  CASE c_custkey % 6 WHEN 0 THEN '=' WHEN 1 THEN '<>' WHEN 2 THEN '<' WHEN 3 THEN '<=' WHEN 4 THEN '>'
    ELSE '>=' END AS op,
  CASE WHEN c_custkey % 7 = 0 THEN 'STR' WHEN c_custkey % 5 = 0 THEN 'METRIC' ELSE 'NUM' END AS right_kind,
  CASE WHEN c_custkey % 7 = 0 THEN 'Abc' WHEN c_custkey % 5 = 0 THEN 'C:' || (c_custkey + 1)
    ELSE '' || (c_custkey % 20) END AS right_ref,
  'STR' AS then_kind, 'OK' AS then_ref,
  CASE WHEN c_custkey % 3 = 0 THEN 'CHECK' WHEN c_custkey % 3 = 1 THEN 'METRIC' ELSE 'NUM' END AS otherwise_kind,
  CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'C:' || c_custkey
    ELSE '0' END AS otherwise_ref
FROM {customer}
UNION ALL SELECT 'n' || n_nationkey, 'NUM', '' || n_nationkey, '>', 'NUM', '12', 'STR', 'HIGH', 'CHECK',
  'r' || n_regionkey FROM {nation}
UNION ALL SELECT 'r' || r_regionkey, 'STR', lower(r_name), '=', 'STR', 'ASIA', 'STR', 'asia', 'NUM', '-1' FROM {region}"""


@query("metric_checks", f"""WITH c AS ({plain(_CHECKS)}), b AS ({plain(BASE)}),
x AS (SELECT c.*, CASE WHEN left_kind = 'METRIC' THEN CAST(l.value AS STRING) ELSE left_ref END AS lv,
  CASE WHEN right_kind = 'METRIC' THEN CAST(r.value AS STRING) ELSE right_ref END AS rv,
  (left_kind <> 'METRIC' OR l.metric_id IS NOT NULL) AND (right_kind <> 'METRIC' OR r.metric_id IS NOT NULL) AS ok
  FROM c LEFT JOIN b l ON left_kind = 'METRIC' AND l.metric_id = left_ref
  LEFT JOIN b r ON right_kind = 'METRIC' AND r.metric_id = right_ref),
y AS (SELECT *, TRY_CAST(lv AS DOUBLE) AS ln, TRY_CAST(rv AS DOUBLE) AS rn,
  op IN ('=', '<>') AND (left_kind = 'STR' OR right_kind = 'STR') AS txt FROM x),
h AS (SELECT *, CASE WHEN NOT ok THEN NULL
  WHEN txt THEN (lower(coalesce(lv, '')) = lower(coalesce(rv, ''))) = (op = '=')
  WHEN ln IS NULL OR rn IS NULL THEN NULL
  ELSE CASE op WHEN '=' THEN ln = rn WHEN '<>' THEN ln <> rn WHEN '<' THEN ln < rn WHEN '<=' THEN ln <= rn
    WHEN '>' THEN ln > rn ELSE ln >= rn END END AS holds FROM y),
f AS (SELECT check_id, holds, CASE WHEN holds THEN then_kind WHEN NOT holds THEN otherwise_kind END AS k,
  CASE WHEN holds THEN then_ref WHEN NOT holds THEN otherwise_ref END AS ref FROM h),
r0 AS (SELECT f.check_id, k, ref, CASE WHEN holds IS NULL THEN false WHEN k = 'METRIC' THEN b.metric_id IS NOT NULL
    ELSE true END AS supported, CASE WHEN k = 'METRIC' THEN CAST(b.value AS STRING) ELSE ref END AS result
  FROM f LEFT JOIN b ON k = 'METRIC' AND b.metric_id = ref),
r1 AS (SELECT a.check_id, coalesce(n.k, a.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.ref ELSE a.ref END AS ref,
  CASE WHEN a.k = 'CHECK' THEN n.supported ELSE a.supported END AS supported,
  CASE WHEN a.k = 'CHECK' THEN n.result ELSE a.result END AS result
  FROM r0 a LEFT JOIN r0 n ON a.k = 'CHECK' AND n.check_id = a.ref),
r2 AS (SELECT a.check_id, CASE WHEN a.k = 'CHECK' THEN n.supported ELSE a.supported END AS supported,
  CASE WHEN a.k = 'CHECK' THEN n.result ELSE a.result END AS result
  FROM r1 a LEFT JOIN r0 n ON a.k = 'CHECK' AND n.check_id = a.ref)
SELECT check_id, supported, CASE WHEN supported THEN result END AS result FROM r2""")
def metric_checks(t):
    return checks.metric_checks(t.sql(_CHECKS), t.sql(BASE))
