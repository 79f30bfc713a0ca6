"""Rules and categories that are tables, as many as there are suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.operators import rule_match
from metricspark.plans import queries_scope as scope_queries
from metricspark.plans import views as v
from metricspark.plans.registry import ORACLES, plain, query
from metricspark.session import config_table

# One rule per supplier over the customers: a piece of the name, the beginning of the segment and,
# for every other one, two nations; one per nation with a regular expression. Case and accents vary.
_CONDITIONS = """
SELECT 'S' || s_suppkey AS rule_id, 1 AS condition_no, 'c_name' AS field, 'contains' AS op, substr(s_name, 16, 3) AS value FROM {supplier}
UNION ALL SELECT 'S' || s_suppkey, 2, 'c_mktsegment', 'starts_with',
  CASE s_suppkey % 5 WHEN 0 THEN 'bui' WHEN 1 THEN 'Autó' WHEN 2 THEN ' m' WHEN 3 THEN 'household' ELSE '' END FROM {supplier}
UNION ALL SELECT 'S' || s_suppkey, 3, 'c_nationkey', 'eq', CAST(s_nationkey AS STRING) FROM {supplier} WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'S' || s_suppkey, 3, 'c_nationkey', 'eq', CAST(s_nationkey + 1 AS STRING) FROM {supplier} WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'N' || n_nationkey, 1, 'c_nationkey', 'eq', CAST(n_nationkey AS STRING) FROM {nation}
UNION ALL SELECT 'N' || n_nationkey, 2, 'c_name', 'regex', 'MER#[0-9]*' || n_nationkey || '$' FROM {nation}"""
_RESULTS = """
SELECT 'S' || s_suppkey AS rule_id, 'group' AS name, 'nation ' || s_nationkey AS value FROM {supplier}
UNION ALL SELECT 'N' || n_nationkey, 'group', 'nation ' || n_nationkey FROM {nation}"""
_TEXT = "CASE field WHEN 'c_name' THEN n_name WHEN 'c_mktsegment' THEN n_segment ELSE n_nation END"


@query("strict_classify_from_tables", f"""WITH c AS ({plain(_CONDITIONS)}), r AS ({plain(_RESULTS)}),
w AS (SELECT *, CASE WHEN op = 'regex' THEN value ELSE {v.norm_sql('value')} END AS wanted FROM c),
d AS (SELECT c_custkey, {v.norm_sql('c_name')} AS n_name, {v.norm_sql('c_mktsegment')} AS n_segment,
  {v.norm_sql('CAST(c_nationkey AS VARCHAR)')} AS n_nation FROM customer),
t AS (SELECT c_custkey, rule_id, condition_no, bool_or(CASE op WHEN 'eq' THEN {_TEXT} = wanted
    WHEN 'contains' THEN contains({_TEXT}, wanted) WHEN 'starts_with' THEN starts_with({_TEXT}, wanted)
    ELSE regexp_matches({_TEXT}, wanted) END) AS holds FROM d, w GROUP BY 1, 2, 3),
h AS (SELECT c_custkey, rule_id FROM t GROUP BY 1, 2 HAVING bool_and(holds)),
g AS (SELECT c_custkey, list_sort(list(rule_id)) AS ids FROM h GROUP BY 1)
SELECT d.c_custkey, coalesce(array_to_string(ids, ','), '') AS rule_ids,
  CASE coalesce(len(ids), 0) WHEN 0 THEN 'UNKNOWN' WHEN 1 THEN 'OK' ELSE 'AMBIGUOUS' END AS rule_status,
  CASE WHEN len(ids) = 1 THEN r.value END AS result_group
FROM d LEFT JOIN g USING (c_custkey) LEFT JOIN r ON r.rule_id = ids[1]""")
def strict_classify_from_tables(t):
    done = rule_match.strict_classify_from_tables(t.customer, t.sql(_CONDITIONS), t.sql(_RESULTS))
    return done.select("c_custkey", F.array_join("rule_ids", ",").alias("rule_ids"), "rule_status",
                       F.try_element_at("result", F.lit("group")).alias("result_group"))


@query("multi_classify_from_tables", f"""SELECT array_to_string(list_sort(string_split(codes, ',')), ',') AS codes, n
FROM ({ORACLES['multi_classify']})""")
def multi_classify_from_tables(t):
    values = [(code, field, op, value) for code, field, op, _, wanted in fixed.CATEGORIES for value in wanted]
    categories = config_table(t.spark, values, "code string, field string, operator string, value string")
    records = scope_queries.flags(t).filter("valid")
    done = rule_match.multi_classify_from_tables(records, categories)
    return done.groupBy(F.array_join("codes", ",").alias("codes")).agg(F.count(F.lit(1)).alias("n"))
