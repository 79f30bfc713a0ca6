"""Metric values per part against a manifest derived from the part list."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark.functions.compare import value_type_gate
from metricspark.functions.text import instruction_id
from metricspark.operators import manifest
from metricspark.plans.registry import ORACLES, plain, query
from metricspark.session import config_table
from metricspark.sources import publish

# Line items per part; some parts report a second value.
VALUES = """SELECT 'p' || l_partkey AS metric_id, count(*) AS value FROM {lineitem} GROUP BY l_partkey
UNION ALL SELECT 'p' || p_partkey, CAST(p_size AS BIGINT) FROM {part} WHERE p_retailprice >= 1050 AND p_size = 9"""
# One instruction per part and, for some, a second one. Injected faults: parts left out,
# ids that no metric has, targets and instruction ids used twice, a foreign version.
MANIFEST = """SELECT 'i' || CASE WHEN p_partkey % 83 = 0 THEN p_partkey + 1 ELSE p_partkey END AS instruction_id,
  CASE WHEN p_partkey % 47 = 0 THEN 'x' ELSE 'p' END || p_partkey AS metric_id, p_brand AS sheet,
  p_brand || '!' || CASE WHEN p_partkey % 29 = 0 THEN p_partkey + 1 ELSE p_partkey END AS target,
  CASE p_type WHEN 'ECONOMY' THEN 'NUMERIC' WHEN 'PROMO' THEN 'TEXT' ELSE 'INTEGER_COUNT' END AS expected_value_type,
  CASE WHEN p_partkey = 17 THEN 'v2' ELSE 'v1' END AS version
FROM {part} WHERE p_size <> 41
UNION ALL SELECT 'j' || p_partkey, 'p' || p_partkey, p_brand, p_brand || '!b' || p_partkey, 'INTEGER_COUNT', 'v1'
FROM {part} WHERE p_size = 43"""
_WRITES = f"""SELECT m.*, v.value FROM ({MANIFEST}) m
  LEFT JOIN (SELECT metric_id, count(*) AS n, min(value) AS value FROM ({VALUES}) x GROUP BY metric_id) v
  ON v.metric_id = m.metric_id AND v.n = 1"""


@query("manifest_join", f"""WITH m AS ({plain(MANIFEST)}), v AS ({plain(VALUES)}),
s AS (SELECT metric_id, count(*) AS n, min(value) AS value FROM v GROUP BY 1)
SELECT m.*, CASE WHEN n = 1 THEN value END AS value,
  CASE WHEN n = 1 THEN 'OK' ELSE 'DUPLICATE_VALUE' END AS value_status FROM m JOIN s USING (metric_id)""")
def manifest_join(t):
    return manifest.manifest_join(t.sql(VALUES), t.sql(MANIFEST))


@query("completeness", f"""WITH m AS (SELECT DISTINCT metric_id FROM ({plain(MANIFEST)})),
v AS ({plain(VALUES)})
SELECT 'missing' AS kind, metric_id FROM m WHERE metric_id NOT IN (SELECT metric_id FROM v)
UNION ALL SELECT 'duplicate', metric_id FROM v GROUP BY metric_id HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'orphan', metric_id FROM v WHERE metric_id NOT IN (SELECT metric_id FROM m)""")
def completeness(t):
    return manifest.completeness(t.sql(VALUES), t.sql(MANIFEST))


_EDGES = """SELECT 'p' || p_partkey AS metric_id, 'p' || (p_partkey + 1) AS dep_metric_id FROM {part}"""


@query("catalog_violations", f"""WITH m AS ({plain(MANIFEST)}), e AS ({plain(_EDGES)})
SELECT 'DUPLICATE_ID' AS check_name, instruction_id AS key, CAST(count(*) AS STRING) AS detail
  FROM m GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_TARGET', target, CAST(count(*) AS STRING) FROM m GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'VERSION_FINGERPRINT', '*', CAST(count(DISTINCT version) AS STRING) FROM m
  HAVING count(DISTINCT version) <> 1
UNION ALL SELECT 'ROW_COUNT', '*', CAST(count(*) AS STRING) FROM m HAVING count(*) <> 1122
UNION ALL SELECT DISTINCT 'DEPENDENCY_NOT_COVERED', dep_metric_id, '' FROM e
  WHERE metric_id IN (SELECT metric_id FROM m) AND dep_metric_id NOT IN (SELECT metric_id FROM m)
UNION ALL SELECT 'ALLOW_DENY_OVERLAP', 'B', ''""")
def catalog_violations(t):
    return manifest.catalog_violations(
        t.sql(MANIFEST), edges=t.sql(_EDGES), expected_rows=1122, allowed=("A", "B"), denied=("B", "C"))


@query("preflight_checks", f"""WITH w AS ({plain(_WRITES)}), v AS ({plain(VALUES)})
SELECT 'NULL_VALUE' AS check_name, count(*) FILTER (WHERE value IS NULL) AS failures FROM w
UNION ALL SELECT 'NEGATIVE_VALUE', count(*) FILTER (WHERE value < 0) FROM w
UNION ALL SELECT 'VALUE_TYPE', count(*) FILTER (WHERE value < 0 AND expected_value_type = 'INTEGER_COUNT') FROM w
UNION ALL SELECT 'DUPLICATE_INSTRUCTION', count(*) FROM (SELECT instruction_id FROM w GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'DUPLICATE_TARGET', count(*) FROM (SELECT target FROM w GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'MISSING_INSTRUCTION', count(DISTINCT metric_id) FROM w
  WHERE metric_id NOT IN (SELECT metric_id FROM v)
UNION ALL SELECT 'ORPHAN_INSTRUCTION', count(DISTINCT metric_id) FROM v
  WHERE metric_id NOT IN (SELECT metric_id FROM w)""")
def preflight_checks(t):
    return publish.preflight_checks(t.sql(_WRITES), t.sql(VALUES))


_EXPECTED = "SELECT o_orderkey AS target, o_totalprice AS value FROM {orders}"
# What a faulty writer left behind: lost rows and values off by a little or a lot.
_READ_BACK = """SELECT o_orderkey AS target, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 0.5
  WHEN o_orderkey % 31 = 0 THEN o_totalprice + 1e-11 ELSE o_totalprice END AS value
FROM {orders} WHERE o_orderkey % 101 <> 0"""


@query("verify_readback", f"""WITH e AS ({plain(_EXPECTED)}), a AS ({plain(_READ_BACK)})
SELECT target, e.value AS expected, a.value AS actual, CASE WHEN a.value IS NULL THEN 'MISSING'
  WHEN abs(e.value - a.value) <= 1e-9 THEN 'OK' ELSE 'VALUE_MISMATCH' END AS status
FROM e LEFT JOIN a USING (target)""")
def verify_readback(t):
    return publish.verify_readback(t.sql(_EXPECTED), t.sql(_READ_BACK))


_GATED = f"""SELECT m.instruction_id, m.expected_value_type, v.value FROM ({MANIFEST}) m JOIN (
  SELECT 'p' || l_partkey AS metric_id, CASE l_partkey % 6 WHEN 0 THEN avg(l_quantity)
    WHEN 1 THEN sum(l_quantity) WHEN 2 THEN -1.0 * count(*) WHEN 3 THEN CAST('NaN' AS DOUBLE)
    WHEN 4 THEN NULL ELSE CAST('Infinity' AS DOUBLE) END AS value
  FROM {{lineitem}} GROUP BY l_partkey) v ON v.metric_id = m.metric_id"""


@query("value_type_gate", f"""WITH g AS ({plain(_GATED)}),
r AS (SELECT *, value IS NOT NULL AND isfinite(value) AS fin FROM g),
s AS (SELECT *, CASE
  WHEN expected_value_type = 'INTEGER_COUNT' THEN CASE WHEN value IS NULL THEN 'NON_NUMERIC'
    WHEN NOT fin THEN 'NON_FINITE_FLOAT' WHEN value <> floor(value) THEN 'NON_INTEGER_FLOAT'
    WHEN value < 0 THEN 'NEGATIVE_COUNT' ELSE 'COERCED_EXACT_FLOAT' END
  WHEN expected_value_type = 'NUMERIC' AND NOT fin THEN 'NON_NUMERIC' ELSE 'OK' END AS reason FROM r)
SELECT instruction_id, expected_value_type, reason,
  CASE WHEN reason IN ('OK', 'COERCED_EXACT_FLOAT') THEN value END AS coerced FROM s""")
def gate(t):
    rows = t.sql(_GATED).withColumn("value", F.col("value").cast("double"))
    coerced, reason = value_type_gate(F.col("value"), "double", F.col("expected_value_type"))
    return rows.select("instruction_id", "expected_value_type", reason.alias("reason"),
                       coerced.alias("coerced"))


@query("collisions", f"""WITH m AS ({plain(MANIFEST)}), p AS (SELECT DISTINCT metric_id, target FROM m)
SELECT 'MULTIPLE_SOURCES_SAME_TARGET' AS collision_type, target AS key, count(*) AS parties FROM p
  GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'SAME_SOURCE_MULTIPLE_TARGETS', metric_id, count(*) FROM p GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'DUPLICATE_INSTRUCTION_IDENTITY', instruction_id, count(*) FROM m GROUP BY 2 HAVING count(*) > 1""")
def collisions(t):
    return manifest.collisions(t.sql(MANIFEST))


@query("collisions_blocked", f"""WITH m AS ({plain(MANIFEST)}), p AS (SELECT DISTINCT metric_id, target FROM m),
bad AS (SELECT metric_id FROM m WHERE target IN (SELECT target FROM p GROUP BY 1 HAVING count(*) > 1)
  OR metric_id IN (SELECT metric_id FROM p GROUP BY 1 HAVING count(*) > 1)
  OR instruction_id IN (SELECT instruction_id FROM m GROUP BY 1 HAVING count(*) > 1))
SELECT instruction_id, metric_id, target, metric_id IN (SELECT metric_id FROM bad) AS blocked FROM m""")
def collisions_blocked(t):
    return manifest.block_collisions(t.sql(MANIFEST)).select(
        "instruction_id", "metric_id", "target", "blocked")


@query("duplicate_keys", """SELECT p_name, p_type, p_size, count(*) AS n FROM part GROUP BY ALL
  HAVING count(*) > 1""")
def duplicates(t):
    from metricspark.operators.summary import duplicate_keys

    return duplicate_keys(t.part, ["p_name", "p_type", "p_size"])


@query("instruction_ids", """SELECT p_partkey,
  'wi:' || substr(sha256(p_brand || chr(31) || p_type || chr(31) || p_partkey), 1, 20) AS instruction_id FROM part""")
def instruction_ids(t):
    return t.part.select("p_partkey", instruction_id(F.col("p_brand"), F.col("p_type"), F.col("p_partkey"))
                         .alias("instruction_id"))


@query("content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(t):
    return publish.content_hashes(t.documents, "doc_id", F.col("text"))


@query("run_audit", """SELECT count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS errors,
  count(*) FILTER (WHERE value > 10) AS large,
  array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE value < 0) > 0 THEN 'NEGATIVE_VALUES' END,
    CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'ERROR_EVENTS' END],
    lambda x: x IS NOT NULL), ',') AS warnings,
  sha256(CAST(sum(CAST(('0x' || substr(sha256(event_id || '|' || event_type), 1, 15)) AS BIGINT)) AS STRING)) AS input_hash
FROM events""")
def run_audit(t):
    return publish.run_audit(t.events, *_audited())


def _audited():
    """Counters, warnings and hashed columns of the audit."""
    return (
        {"errors": F.col("event_type") == "error", "large": F.col("value") > 10},
        {"NEGATIVE_VALUES": F.col("value") < 0, "ERROR_EVENTS": F.col("event_type") == "error"},
        [F.col("event_id"), F.col("event_type")],
    )


@query("run_audit_observed", ORACLES["run_audit"])
def run_audit_observed(t):
    """The audit of a run that counts its events by type, taken while it does so."""
    events, seen = publish.observed_audit(t.events, "run", *_audited())
    events.groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    return config_table(t.spark, [tuple(seen.get.values())], "records bigint, errors bigint, large bigint, warnings string, input_hash string")


_CONTROLS = """SELECT p_brand AS form, p_type AS module,
  CASE WHEN p_brand = 'Brand#7' THEN NULL WHEN p_brand IN ('Brand#3', 'Brand#4') THEN 0
    WHEN p_size > 45 THEN 1 ELSE 0 END AS errors, p_type = 'PROMO' AS pending_module FROM {part}"""


@query("control_rollup", f"""WITH c AS ({plain(_CONTROLS)})
SELECT form, CAST(sum(errors) AS BIGINT) AS total_errors,
  CAST(coalesce(sum(errors) FILTER (WHERE pending_module), 0) AS BIGINT) AS pending_errors,
  CASE WHEN sum(errors) IS NULL THEN 'UNAVAILABLE' WHEN sum(errors) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM c GROUP BY form""")
def control_rollup(t):
    from metricspark.operators.checks import control_rollup as rollup

    return rollup(t.sql(_CONTROLS), ["form"])
