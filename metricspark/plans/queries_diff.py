"""Snapshots of orders as cell grids: values, expressions, structure, ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark.operators import diff
from metricspark.operators.summary import ordered_positions
from metricspark.plans.registry import ORACLES, plain, query

# Orders as cells: sheet = priority, row = order, one value and sometimes an expression.
BEFORE = """SELECT o_orderpriority AS sheet, o_orderkey AS row_no, 1 AS col_no,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice END AS value_num,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN '' WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 2
    THEN 'pending' END AS value_txt,
  CASE WHEN o_orderkey % 10 = 0 THEN '=SUM(A' || o_custkey || ',"Mixed Case")' END AS formula FROM {orders}"""
# The later snapshot: prices moved, rows lost and added, expressions rewritten, noise
# below the tolerance, blanks of another kind, one sheet renamed.
AFTER = """SELECT CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN '3-MED'
    ELSE o_orderpriority END AS sheet,
  CASE WHEN o_orderkey % 103 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS row_no, 1 AS col_no,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1
    WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1e-11 ELSE o_totalprice END AS value_num,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 2
    THEN CASE WHEN o_orderkey % 13 = 0 THEN 'done' ELSE 'pending' END END AS value_txt,
  CASE WHEN o_orderkey % 130 = 0 THEN '=sum(a' || o_custkey || ',"Mixed Case")'
    WHEN o_orderkey % 170 = 0 THEN '=SUM(A' || o_custkey || ',"mixed case")'
    WHEN o_orderkey % 190 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN '=A1'
    WHEN o_orderkey % 10 = 0 THEN '=SUM(A' || o_custkey || ',"Mixed Case")' END AS formula
FROM {orders} WHERE o_orderkey % 101 <> 0"""
_PAIR = f"b AS ({plain(BEFORE)}), a AS ({plain(AFTER)}), " \
        "common AS (SELECT DISTINCT sheet FROM b WHERE sheet IN (SELECT sheet FROM a))"


@query("wide_to_cells", """SELECT l_returnflag AS sheet, l_orderkey * 10 + l_linenumber AS row_no, col_no, value_num, value_txt FROM (
  SELECT *, unnest([1, 2, 3, 4]) AS col_no, unnest([l_quantity, l_extendedprice, l_discount, NULL]) AS value_num,
    unnest([NULL, NULL, NULL, l_linestatus]) AS value_txt FROM lineitem)""")
def wide_to_cells(t):
    return diff.wide_to_cells(
        t.lineitem, F.col("l_returnflag"), F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"])


@query("snapshot_diff", f"""WITH {_PAIR},
j AS (SELECT coalesce(b.sheet, a.sheet) AS sheet, coalesce(b.row_no, a.row_no) AS row_no,
  coalesce(b.col_no, a.col_no) AS col_no, b.value_num AS before_num, a.value_num AS after_num,
  b.value_txt AS before_txt, a.value_txt AS after_txt, coalesce(b.formula, '') AS bf, coalesce(a.formula, '') AS af
  FROM b FULL JOIN a ON b.sheet = a.sheet AND b.row_no = a.row_no AND b.col_no = a.col_no)
SELECT sheet, row_no, col_no, before_num, after_num, before_txt, after_txt,
  CASE WHEN bf <> af THEN 'FORMULA_EXPRESSION_CHANGE' WHEN af <> '' THEN 'FORMULA_RESULT_CHANGE'
    ELSE 'DIRECT_INPUT_CHANGE' END AS change_kind
FROM j WHERE sheet IN (SELECT sheet FROM common) AND NOT (
  coalesce(abs(before_num - after_num) < 1e-9, before_num IS NULL AND after_num IS NULL)
  AND coalesce(before_txt, '') = coalesce(after_txt, ''))""")
def snapshot_diff(t):
    return diff.snapshot_diff(t.sql(BEFORE), t.sql(AFTER))


@query("snapshot_diff_by_blocks", ORACLES["snapshot_diff"])
def snapshot_diff_by_blocks(t):
    return diff.snapshot_diff_by_blocks(t.sql(BEFORE), t.sql(AFTER), block_rows=64)


_EXPRESSIONS = f"""WITH {_PAIR},
j AS (SELECT coalesce(b.sheet, a.sheet) AS sheet, coalesce(b.row_no, a.row_no) AS row_no,
  coalesce(b.col_no, a.col_no) AS col_no, b.formula AS before_formula, a.formula AS after_formula
  FROM (SELECT * FROM b WHERE formula <> '') b FULL JOIN (SELECT * FROM a WHERE formula <> '') a
  ON b.sheet = a.sheet AND b.row_no = a.row_no AND b.col_no = a.col_no)"""


@query("expression_diff", f"""{_EXPRESSIONS} SELECT *, CASE WHEN before_formula IS NULL THEN 'FORMULA_ADDED'
  WHEN after_formula IS NULL THEN 'FORMULA_REMOVED' ELSE 'FORMULA_MODIFIED' END AS change_type
FROM j WHERE sheet IN (SELECT sheet FROM common) AND before_formula IS DISTINCT FROM after_formula""")
def expression_diff(t):
    return diff.expression_diff(t.sql(BEFORE), t.sql(AFTER))


def _key_sql(x):
    return f"list_aggregate(list_transform(regexp_extract_all({x}, '\"[^\"]*\"|[^\"]+'), " \
           "lambda p: CASE WHEN starts_with(p, '\"') THEN p ELSE lower(p) END), 'string_agg', '')"


@query("expression_integrity", f"""{_EXPRESSIONS} SELECT *, CASE WHEN before_formula IS NULL THEN 'FORMULA_ADDED'
  WHEN after_formula IS NULL THEN 'FORMULA_REMOVED' ELSE 'FORMULA_MODIFIED' END AS change_type
FROM j WHERE sheet IN (SELECT sheet FROM common) AND (before_formula IS NULL OR after_formula IS NULL
  OR {_key_sql('before_formula')} <> {_key_sql('after_formula')})""")
def expression_integrity(t):
    return diff.expression_diff(t.sql(BEFORE), t.sql(AFTER), ignore_case=True)


@query("contract_check", f"""WITH {_PAIR}
SELECT b.sheet, b.row_no, b.col_no, b.formula, a.formula AS actual,
  CASE WHEN a.formula IS NULL THEN 'MISSING' ELSE 'ALTERED' END AS violation
FROM b LEFT JOIN (SELECT * FROM a WHERE formula <> '') a USING (sheet, row_no, col_no)
WHERE b.formula <> '' AND (a.formula IS NULL OR {_key_sql('a.formula')} <> {_key_sql('b.formula')})""")
def contract_check(t):
    contract = t.sql(BEFORE).filter("formula <> ''")
    return diff.contract_check(contract, t.sql(AFTER))


@query("structure_diff", f"""WITH {_PAIR},
sb AS (SELECT sheet, max(row_no) AS r, max(col_no) AS c, count(*) FILTER (WHERE formula <> '') AS f, count(*) AS n
  FROM b GROUP BY 1),
sa AS (SELECT sheet, max(row_no) AS r, max(col_no) AS c, count(*) FILTER (WHERE formula <> '') AS f, count(*) AS n
  FROM a GROUP BY 1)
SELECT coalesce(sb.sheet, sa.sheet) AS sheet, CASE WHEN sb.sheet IS NULL THEN 'ADDED'
  WHEN sa.sheet IS NULL THEN 'REMOVED' WHEN sb.r = sa.r AND sb.c = sa.c AND sb.f = sa.f AND sb.n = sa.n
  THEN 'UNCHANGED' ELSE 'CHANGED' END AS status, sb.r AS max_row_before, sa.r AS max_row_after,
  sb.c AS max_col_before, sa.c AS max_col_after, sb.f AS formulas_before, sa.f AS formulas_after,
  sb.n AS cells_before, sa.n AS cells_after FROM sb FULL JOIN sa ON sb.sheet = sa.sheet""")
def structure_diff(t):
    return diff.structure_diff(t.sql(BEFORE), t.sql(AFTER))


_POSITIONS = ("SELECT p_brand AS sheet, min(p_partkey) AS position FROM {part} GROUP BY p_brand",
              "SELECT p_brand AS sheet, min(p_partkey) AS position FROM {part} "
              "WHERE p_type <> 'ECONOMY' GROUP BY p_brand")


@query("sheet_order", f"""WITH b AS ({plain(_POSITIONS[0])}), a AS ({plain(_POSITIONS[1])}),
r AS (SELECT sheet, CAST(row_number() OVER (ORDER BY b.position) AS INT) AS rank_before,
  CAST(row_number() OVER (ORDER BY a.position) AS INT) AS rank_after FROM b JOIN a USING (sheet))
SELECT * FROM r WHERE rank_before <> rank_after""")
def sheet_order(t):
    return diff.order_changes(t.sql(_POSITIONS[0]), t.sql(_POSITIONS[1]))


_CELLS = "SELECT p_brand AS sheet, p_partkey AS row_no, p_size AS col_no FROM {part}"
# Promotional parts read two blocks of rows around them, some on another sheet.
_RANGE = """SELECT p_brand AS target_sheet, p_partkey AS target_row, 60 AS target_col, %d AS ref_no,
  %s AS ref_sheet, CASE WHEN p_size < 3 THEN p_partkey ELSE p_partkey - p_size * %d END AS row_start,
  CASE WHEN p_size < 3 THEN p_partkey ELSE p_partkey + p_size * 5 END AS row_end,
  CASE WHEN p_size < 3 THEN p_size ELSE 1 END AS col_start, p_size AS col_end
FROM {part} WHERE p_type = 'PROMO'"""
_RANGES = _RANGE % (0, "p_brand", 3) + " UNION ALL " + _RANGE % (
    1, "CASE WHEN p_size IN (4, 8, 16, 32) THEN 'Brand#1' ELSE p_brand END", 6) + """
UNION ALL SELECT p_brand, p_partkey, 61, 2, p_brand, 1, 5000000000, 1, 3 FROM {part} WHERE p_partkey % 400 = 1"""
_EDGES = f"""c AS ({plain(_CELLS)}), g AS ({plain(_RANGES)}),
h AS (SELECT c.*, g.*, CASE WHEN sheet <> target_sheet THEN 'cross_sheet'
  WHEN row_start = row_end AND col_start = col_end THEN 'cell' ELSE 'range' END AS kind
  FROM c JOIN g ON sheet = ref_sheet AND row_no BETWEEN row_start AND row_end AND col_no BETWEEN col_start AND col_end
  WHERE NOT (sheet = target_sheet AND row_no = target_row AND col_no = target_col))"""


@query("range_edges", f"""WITH {_EDGES}
SELECT sheet, row_no, col_no, target_sheet, target_row, target_col, min_by(kind, ref_no) AS dependency_type
FROM h GROUP BY ALL""")
def range_edges(t):
    return diff.range_edges(t.sql(_CELLS), t.sql(_RANGES))


# A grid of part sizes with merged blocks of two rows by three columns.
_GRID = """SELECT p_brand AS sheet, p_partkey AS row_no, p_size AS col_no,
  p_retailprice AS value_num, p_name AS value_txt FROM {part}"""
_MERGES = """SELECT p_brand AS sheet, p_partkey AS r1, p_size AS c1, p_partkey + 40 AS r2, p_size AS c2
FROM {part} WHERE p_partkey % 50 = 0"""


@query("merge_anchor", f"""WITH g AS ({plain(_GRID)}), m AS ({plain(_MERGES)})
SELECT g.sheet, g.row_no, g.col_no, coalesce(r1, g.row_no) AS anchor_row, coalesce(c1, g.col_no) AS anchor_col,
  CASE WHEN r1 IS NULL THEN g.value_num ELSE o.value_num END AS value_num,
  CASE WHEN r1 IS NULL THEN g.value_txt ELSE o.value_txt END AS value_txt
FROM g LEFT JOIN m ON m.sheet = g.sheet AND g.row_no BETWEEN r1 AND r2 AND g.col_no BETWEEN c1 AND c2
    AND NOT (g.row_no = r1 AND g.col_no = c1)
  LEFT JOIN g o ON o.sheet = m.sheet AND o.row_no = r1 AND o.col_no = c1""")
def merge_anchor(t):
    return diff.merge_anchor(t.sql(_GRID), t.sql(_MERGES))


# Blocks of two columns under a filled corner. What they cover is mostly blank; where it is not, it is hidden.
_BLOCKS = """SELECT p_brand AS sheet, p_partkey AS r1, 51 AS c1, p_partkey + 3 AS r2, 52 AS c2 FROM {part} WHERE p_partkey % 50 = 0"""
_COVERED_GRID = _GRID + """ UNION ALL SELECT p_brand, p_partkey, 51, CASE WHEN p_partkey % 100 = 0 THEN p_retailprice END, p_type FROM {part} WHERE p_partkey % 50 = 0
UNION ALL SELECT p_brand, p_partkey + 1, 52, 1.0D, 'hidden' FROM {part} WHERE p_partkey % 150 = 0"""
_COVERED = """SELECT p_brand AS sheet, p_partkey + CAST(d AS INT) AS row_no, CAST(c AS INT) AS col_no FROM {part}
LATERAL VIEW explode(array(0, 1, 2, 3, 4)) v AS d LATERAL VIEW explode(array(51, 52, 53)) w AS c WHERE p_partkey % 50 = 0"""


@query("merge_anchor_covered", f"""WITH g AS ({plain(_COVERED_GRID).replace('1.0D', '1.0')}), m AS ({plain(_BLOCKS)}),
t AS (SELECT DISTINCT p_brand AS sheet, p_partkey + d AS row_no, c AS col_no FROM part, (SELECT unnest(range(5)) AS d), (SELECT unnest([51, 52, 53]) AS c)
  WHERE p_partkey % 50 = 0)
SELECT t.sheet, t.row_no, CAST(t.col_no AS INT) AS col_no, coalesce(r1, t.row_no) AS anchor_row, CAST(coalesce(c1, t.col_no) AS INT) AS anchor_col,
  o.value_num, o.value_txt
FROM t LEFT JOIN m ON m.sheet = t.sheet AND t.row_no BETWEEN r1 AND r2 AND t.col_no BETWEEN c1 AND c2
  LEFT JOIN g o ON o.sheet = t.sheet AND o.row_no = coalesce(r1, t.row_no) AND o.col_no = coalesce(c1, t.col_no)""")
def merge_anchor_covered(t):
    return diff.merge_anchor(t.sql(_COVERED_GRID), t.sql(_BLOCKS), t.sql(_COVERED))


@query("cell_order", f"""WITH g AS ({plain(_GRID)})
SELECT sheet, row_no, col_no, row_number() OVER (ORDER BY sheet, row_no, col_no) AS position
FROM g""")
def cell_order(t):
    return ordered_positions(t.sql(_GRID), ["sheet", "row_no", "col_no"]).select(
        "sheet", "row_no", "col_no", "position")


@query("top_changes", f"""WITH {_PAIR}
SELECT b.sheet, b.row_no, a.value_num - b.value_num AS delta FROM b JOIN a USING (sheet, row_no, col_no)
ORDER BY abs(a.value_num - b.value_num) DESC NULLS LAST, b.sheet, b.row_no""")
def top_changes(t):
    return diff.ordered_changes(t.sql(BEFORE), t.sql(AFTER)).select("sheet", "row_no", "delta")
