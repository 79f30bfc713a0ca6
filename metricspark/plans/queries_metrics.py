"""Metric catalogs over the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark.operators.catalog_counts import metric_counts_from_tables
from metricspark.operators.metrics import Term, metric_counts
from metricspark.plans.registry import plain, query

_FLAGS = ("A", "N", "R")
_STATES = ("O", "F")
_QUANTITIES = ((">=1", "<=10"), (">10", "<=20"), (">20", "<=35"), (">35", "<50"), ("=50", "<>0"))


def catalog(wide: bool) -> list[Term]:
    """Counting catalog: a grid of cells, totals, a difference and wildcard rows."""
    terms = [
        Term("all"),
        Term("returned", (("l_returnflag", "r"),)),
        Term("not_returned", (("l_returnflag", "<>R"),)),
        Term("flag_wild", (("l_returnflag", "?"), ("l_linestatus", "o*"))),
        Term("open_minus_final", (("l_linestatus", "O"),), 1),
        Term("open_minus_final", (("l_linestatus", "F"),), -1),
        Term("never", (("l_quantity", ">1000"),)),
        Term("text_on_number", (("l_quantity", "abc"),)),
    ]
    for flag in _FLAGS:
        for state in _STATES:
            for i, (low, high) in enumerate(_QUANTITIES):
                terms.append(Term(f"cell_{flag}{state}_{i}", (
                    ("l_returnflag", flag), ("l_linestatus", state),
                    ("l_quantity", low), ("l_quantity", high),
                )))
    if wide:
        for line in range(1, 8):
            for flag in _FLAGS:
                for low in range(0, 50, 5):
                    terms.append(Term(f"grid_{line}_{flag}_{low}", (
                        ("l_linenumber", str(line)), ("l_returnflag", flag),
                        ("l_quantity", f">{low}"), ("l_quantity", f"<={low + 5}"),
                    )))
    return terms


_SQL_TESTS = {
    ("l_returnflag", "r"): "lower(l_returnflag) = 'r'",
    ("l_returnflag", "<>R"): "coalesce(lower(l_returnflag), '') <> 'r'",
    ("l_returnflag", "?"): "length(l_returnflag) = 1",
    ("l_linestatus", "o*"): "lower(l_linestatus) LIKE 'o%'",
    ("l_quantity", "abc"): "false",
}


def _sql_test(column: str, raw: str) -> str:
    if (column, raw) in _SQL_TESTS:
        return _SQL_TESTS[column, raw]
    if column in ("l_returnflag", "l_linestatus"):
        return f"{column} = '{raw}'"
    return f"{column} {raw}" if raw[0] in "<>=" else f"{column} = {raw}"


def catalog_sql(wide: bool, extra: str = "") -> str:
    """The same catalog as one conditional sum per metric, unpivoted by union."""
    by_metric: dict[str, list[Term]] = {}
    for term in catalog(wide):
        by_metric.setdefault(term.metric_id, []).append(term)
    sums = []
    for i, own in enumerate(by_metric.values()):
        parts = [
            f"{t.sign} * count(*) FILTER (WHERE "
            + (" AND ".join(_sql_test(c, r) for c, r in t.predicates) or "true")
            + f"{extra})"
            for t in own
        ]
        sums.append(f"CAST({' + '.join(parts)} AS BIGINT) AS m{i}")
    names = "[" + ", ".join(f"'{m}'" for m in by_metric) + "]"
    values = "[" + ", ".join(f"m{i}" for i in range(len(by_metric))) + "]"
    return f"""
    WITH wide AS (
      SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, {', '.join(sums)}
      FROM lineitem GROUP BY 1)
    SELECT period, unnest({names}) AS metric_id, unnest({values}) AS value FROM wide"""


def facts(t):
    return t.lineitem.select(
        F.trunc("l_shipdate", "month").alias("period"),
        "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber", "l_shipdate",
    )


@query("metric_counts", catalog_sql(wide=False))
def counts(t):
    return metric_counts(facts(t).drop("l_linenumber"), catalog(wide=False))


@query("metric_counts_large_catalog", catalog_sql(wide=True))
def counts_large(t):
    return metric_counts(facts(t), catalog(wide=True))


# A catalog held as tables: every part defines a metric. Most are cells of a grid with an open range;
# some have a range, a wildcard or negations only, or count all records with the sign turned.
_TERMS = """SELECT 'm' || CAST(p_partkey AS STRING) AS metric_id, 1 AS term_no, CASE WHEN p_size = 5 THEN -1 ELSE 1 END AS sign FROM {part}
UNION ALL SELECT 'm' || CAST(p_partkey AS STRING), 2, -1 FROM {part} WHERE p_size = 6"""


def _part_predicate(term, number, column, op, value, where):
    return (f"SELECT 'm' || CAST(p_partkey AS STRING) AS metric_id, {term} AS term_no, {number} AS pred_no, '{column}' AS col, "
            f"'{op}' AS op, {value} AS value FROM {{part}} WHERE {where}")


_PREDICATES = " UNION ALL ".join([
    _part_predicate(1, 1, "l_linenumber", "", "CAST(p_partkey % 7 + 1 AS STRING)", "p_size > 6"),
    _part_predicate(1, 2, "l_returnflag", "", "CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'N' ELSE 'R' END", "p_size > 6 AND p_size % 2 = 0"),
    _part_predicate(1, 3, "l_quantity", ">", "CAST(p_size AS STRING)", "p_size > 6 AND p_size % 3 <> 0"),
    _part_predicate(1, 1, "l_quantity", ">=", "CAST(p_partkey % 50 AS STRING)", "p_size = 1"),
    _part_predicate(1, 2, "l_quantity", "<", "CAST(p_partkey % 50 + 9 AS STRING)", "p_size = 1"),
    _part_predicate(1, 1, "l_returnflag", "<>", "'r'", "p_size = 2"),
    _part_predicate(1, 2, "l_linestatus", "<>", "'o*'", "p_size = 2"),
    _part_predicate(1, 1, "l_linestatus", "", "'?'", "p_size = 3"),
    _part_predicate(1, 2, "l_quantity", "<>", "CAST(p_partkey % 50 + 1 AS STRING)", "p_size IN (3, 4)"),
    _part_predicate(2, 1, "l_returnflag", "", "'A'", "p_size = 6"),
])


@query("metric_counts_from_tables", f"""WITH facts AS (
  SELECT CAST(date_trunc('year', l_shipdate) AS DATE) AS period, lower(l_returnflag) AS f, lower(l_linestatus) AS s, l_quantity AS q, l_linenumber AS l, count(*) AS n
  FROM lineitem GROUP BY ALL
), periods AS (SELECT DISTINCT period FROM facts), terms AS ({plain(_TERMS)}),
hits AS (SELECT period, metric_id, sum(sign * n) AS v FROM terms JOIN part ON metric_id = 'm' || CAST(p_partkey AS STRING) JOIN facts ON CASE
    WHEN p_size > 6 THEN l = p_partkey % 7 + 1 AND (p_size % 2 = 1 OR f = CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'n' ELSE 'r' END) AND (p_size % 3 = 0 OR q > p_size)
    WHEN p_size = 1 THEN q >= p_partkey % 50 AND q < p_partkey % 50 + 9
    WHEN p_size = 2 THEN f <> 'r' AND s NOT LIKE 'o%'
    WHEN p_size = 3 THEN length(s) = 1 AND q <> p_partkey % 50 + 1
    WHEN p_size = 4 THEN q <> p_partkey % 50 + 1
    WHEN p_size = 6 THEN term_no = 1 OR f = 'a' ELSE true END
  GROUP BY ALL)
SELECT period, metric_id, CAST(coalesce(v, 0) AS BIGINT) AS value FROM periods CROSS JOIN (SELECT DISTINCT metric_id FROM terms) LEFT JOIN hits USING (period, metric_id)""")
def counts_from_tables(t):
    facts_by_year = t.lineitem.select(F.trunc("l_shipdate", "year").alias("period"), "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber")
    return metric_counts_from_tables(facts_by_year, t.sql(_TERMS), t.sql(_PREDICATES))
