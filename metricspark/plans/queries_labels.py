"""Label grids: header rows, contexts and roles of cells built from the part list."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.operators import layout
from metricspark.plans import views as v
from metricspark.plans.registry import plain, query
from metricspark.session import cut_lineage

# A hundred parts make a sheet; the size of a part decides what its row is.
_ROWS = """SELECT 'S' || CAST(floor(p_partkey / 100) AS INT) AS sheet, CAST(p_partkey % 100 + 1 AS INT) AS row_no,
  p_partkey, p_size, p_type, p_name, p_brand, p_retailprice, CASE
    WHEN p_size IN (49, 50) AND CAST(floor(p_partkey / 100) AS INT) % 3 <> 0 THEN 'section'
    WHEN p_size IN (40, 41, 42, 43) THEN 'group' WHEN p_size IN (30, 31, 32) THEN 'wide'
    WHEN p_size IN (33, 34) THEN 'band' ELSE 'data' END AS kind FROM {part}"""


def _cell(col, text, number, bold, where):
    return (f"SELECT sheet, row_no, {col} AS col_no, {text} AS text, {number} AS number, {bold} AS bold "
            f"FROM ({_ROWS}) r WHERE {where}")


_TEXT, _NONE = "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"
GRID = " UNION ALL ".join([
    _cell(2, "'SECCIÓN ' || p_type", _NONE, "true", "kind = 'section'"),
    _cell(2, "'A.' || p_size || '. ' || p_name", _NONE, "p_size <> 43", "kind = 'group'"),
    _cell(3, "'A.' || p_size || '. ' || p_name", _NONE, "true", "kind = 'group' AND p_size = 41"),
    *[_cell(c, t, _NONE, "false", "kind = 'wide'")
      for c, t in ((3, "p_type"), (4, "'Hombre'"), (5, "'Mujer'"), (6, "p_brand"))],
    _cell(4, "'Sub ' || p_type", _NONE, "false", "kind = 'band'"),
    _cell(5, "CASE WHEN p_size = 33 THEN 'Sub ' || p_brand ELSE 'Mujer' END", _NONE, "false", "kind = 'band'"),
    _cell(1, _TEXT, "CAST(p_partkey AS DOUBLE)", "false", "kind = 'data'"),
    _cell(2, "p_name", _NONE, "p_size = 7", "kind = 'data' AND p_size % 13 <> 0"),
    _cell(3, "CASE WHEN p_size % 10 = 0 THEN p_name ELSE p_brand END", _NONE, "false", "kind = 'data' AND p_size % 5 = 0"),
    _cell(3, _TEXT, "CAST(p_size AS DOUBLE)", "false", "kind = 'data' AND p_size % 5 = 1"),
    _cell(4, _TEXT, "p_retailprice", "false", "kind = 'data'"),
    _cell(5, "CASE WHEN p_size % 11 = 0 THEN 'obs' END", "CASE WHEN p_size % 11 <> 0 THEN p_retailprice END",
          "false", "kind = 'data' AND p_size % 2 = 0"),
    _cell(6, _TEXT, "p_retailprice", "false", "kind = 'data' AND p_size % 3 = 0"),
])
_KEYWORD, _GROUP = "(?i)" + fixed.SECTION_KEYWORD, "(?i)" + fixed.GROUP_HEADER
_PLAIN_GRID = f"g AS ({plain(GRID)}), ends AS (SELECT sheet, max(row_no) AS last_row FROM g GROUP BY 1)"
_HEADER_CTES = f"""l AS (SELECT *, lag(text) OVER w AS pt, lag(col_no) OVER w AS pc FROM g
  WINDOW w AS (PARTITION BY sheet, row_no ORDER BY col_no)),
tx AS (SELECT * FROM l WHERE text IS NOT NULL AND NOT coalesce(pt = text AND pc = col_no - 1, false)),
hr AS (SELECT sheet, row_no, count(*) AS n, count(DISTINCT text) AS nd, min(col_no) AS first_col,
  max(col_no) AS last_col, min_by(text, col_no) AS label, min_by(bold, col_no) AS b FROM tx GROUP BY 1, 2),
hw AS (SELECT hr.*, n >= 4 OR last_col - first_col >= 15 AS wide FROM hr JOIN ends ON ends.sheet = hr.sheet AND row_no <= last_row),
ht AS (SELECT *, NOT wide AND first_col <= 4 AND nd <= 2 AND b AS ok FROM hw),
hk AS (SELECT *, ok AND regexp_matches(label, '{_KEYWORD}') AS kw FROM ht),
hs AS (SELECT *, kw OR (ok AND first_col >= 2 AND length(label) >= 4) AS titled,
  bool_or(kw) OVER (PARTITION BY sheet) AS has FROM hk),
h AS (SELECT sheet, row_no, CAST(first_col AS INT) AS first_col, label, wide,
  CASE WHEN has THEN kw ELSE titled END AS section, has AND titled AND NOT kw AS grouping FROM hs)"""
_HEADERS = f"{_PLAIN_GRID},\n{_HEADER_CTES}"
# Nearest header, parent section and group by brute force over the rows of a sheet.
_CONTEXT_CTES = f"""t AS (SELECT sheet, row_no, col_no FROM g WHERE number IS NOT NULL AND col_no >= 4),
sec AS (SELECT * FROM h WHERE section), grp AS (SELECT * FROM h WHERE grouping),
c1 AS (SELECT t.*, max(sec.row_no) AS irow FROM t LEFT JOIN sec ON sec.sheet = t.sheet AND sec.row_no < t.row_no GROUP BY ALL),
c2 AS (SELECT c1.*, max(sec.row_no) AS orow FROM c1 LEFT JOIN sec ON sec.sheet = c1.sheet AND sec.row_no < irow GROUP BY ALL),
c3 AS (SELECT c2.*, max(grp.row_no) AS grow FROM c2 LEFT JOIN grp ON grp.sheet = c2.sheet AND grp.row_no < c2.row_no GROUP BY ALL),
c AS (SELECT c3.*, i.label AS ilabel, CASE WHEN irow - orow <= 2 THEN o.label END AS olabel, gg.label AS glabel,
  coalesce(own.section OR own.grouping, false) AS is_header
  FROM c3 LEFT JOIN sec i ON i.sheet = c3.sheet AND i.row_no = irow LEFT JOIN sec o ON o.sheet = c3.sheet AND o.row_no = orow
  LEFT JOIN grp gg ON gg.sheet = c3.sheet AND gg.row_no = grow LEFT JOIN h own ON own.sheet = c3.sheet AND own.row_no = c3.row_no)"""
_CONTEXT = f"{_HEADERS},\n{_CONTEXT_CTES}"

# The same grid with merged ranges: headers over several columns and rows, and covered cells, most of them blank.
MERGED_GRID = GRID + " UNION ALL " + " UNION ALL ".join([
    _cell(8, "'Turno ' || p_brand", _NONE, "p_size % 2 = 0", "p_partkey % 20 = 3"),
    _cell(9, _TEXT, "p_retailprice", "false", "p_partkey % 20 > 6"),
    _cell(8, "CASE WHEN p_partkey % 20 = 6 THEN p_type END", "CASE WHEN p_partkey % 20 > 6 THEN p_retailprice END", "false", "p_partkey % 20 >= 6"),
    _cell(9, "'oculto'", _NONE, "false", "p_partkey % 20 = 4"),
])
MERGES = f"""SELECT sheet, row_no AS r1, CASE WHEN kind = 'section' THEN 2 WHEN kind = 'group' THEN 2 ELSE 4 END AS c1, row_no AS r2,
  CASE kind WHEN 'section' THEN 4 WHEN 'group' THEN 3 WHEN 'wide' THEN 5 ELSE 6 END AS c2 FROM ({_ROWS}) r WHERE kind <> 'data'
UNION ALL SELECT sheet, row_no AS r1, 8 AS c1, row_no + 2 AS r2, 9 AS c2 FROM ({_ROWS}) r WHERE p_partkey % 20 = 3
UNION ALL SELECT sheet, row_no AS r1, 11 AS c1, row_no AS r2, 12 AS c2 FROM ({_ROWS}) r WHERE p_partkey % 50 = 3"""
_MERGED = f"""g0 AS ({plain(MERGED_GRID)}), mg AS ({plain(MERGES)}),
ends AS (SELECT sheet, max(row_no) AS last_row FROM g0 GROUP BY 1),
sp AS (SELECT sheet, r1, c1, row_no, unnest(range(c1, c2 + 1)) AS col_no
  FROM (SELECT *, unnest(range(r1, r2 + 1)) AS row_no FROM mg)),
g AS (SELECT * FROM g0 WHERE NOT EXISTS (SELECT 1 FROM mg WHERE mg.sheet = g0.sheet AND g0.row_no BETWEEN r1 AND r2 AND g0.col_no BETWEEN c1 AND c2)
  UNION ALL SELECT sp.sheet, CAST(sp.row_no AS INT), CAST(sp.col_no AS INT), a.text, a.number, a.bold FROM sp JOIN g0 a ON a.sheet = sp.sheet AND a.row_no = r1 AND a.col_no = c1)"""



def targets(t):
    return t.sql(GRID).filter("number is not null and col_no >= 4")


@query("header_rows", f"WITH {_HEADERS} SELECT * FROM h")
def header_rows(t):
    return layout.header_rows(t.sql(GRID))


@query("header_context", f"""WITH {_CONTEXT}
SELECT sheet, row_no, col_no, ilabel AS section, olabel AS parent, glabel AS group_label, is_header FROM c""")
def header_context(t):
    found = layout.header_context(
        targets(t).select("sheet", "row_no", "col_no"), cut_lineage(layout.header_rows(t.sql(GRID))))
    return found.select(
        "sheet", "row_no", "col_no", F.col("inner.label").alias("section"), F.col("inner.parent").alias("parent"),
        F.col("grp.label").alias("group_label"), "is_header")


_JOIN = "coalesce(array_to_string({}, ' | '), '')"


_LABELS = f"""txt AS (SELECT * FROM g WHERE text IS NOT NULL),
lf AS (SELECT c.sheet, c.row_no, c.col_no, list(x.text ORDER BY x.col_no) AS names, min(x.col_no) AS fc, max(x.col_no) AS lc
  FROM c JOIN txt x ON x.sheet = c.sheet AND x.row_no = c.row_no AND x.col_no < c.col_no GROUP BY ALL),
mx AS (SELECT DISTINCT lf.sheet, lf.row_no, lf.col_no FROM lf JOIN g ON g.sheet = lf.sheet AND g.row_no = lf.row_no
  AND g.number IS NOT NULL AND g.col_no > fc AND g.col_no < lc),
d AS (SELECT c.*, names, coalesce(fc, 2) AS label_col, mx.sheet IS NOT NULL AS mixed FROM c
  LEFT JOIN lf USING (sheet, row_no, col_no) LEFT JOIN mx USING (sheet, row_no, col_no)),
shaped AS (SELECT x.* FROM txt x WHERE regexp_matches(text, '{_GROUP}')
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.sheet = x.sheet AND h.row_no = x.row_no AND (wide OR section))),
d1 AS (SELECT d.*, max(s.row_no) AS srow, max_by(s.text, s.row_no) AS slabel FROM d LEFT JOIN shaped s
  ON s.sheet = d.sheet AND s.col_no = d.label_col AND s.row_no < d.row_no GROUP BY ALL),
d2 AS (SELECT *, CASE WHEN is_header THEN NULL
  WHEN coalesce(grow, 0) > coalesce(irow, 0) AND coalesce(grow, 0) >= coalesce(srow, 0) THEN glabel
  WHEN coalesce(srow, 0) > coalesce(irow, 0) THEN slabel END AS grp_label FROM d1),
free AS (SELECT x.sheet, x.row_no, x.col_no, x.text FROM txt x
  WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.sheet = x.sheet AND sec.row_no = x.row_no)),
isl AS (SELECT *, row_no - row_number() OVER (PARTITION BY sheet, col_no ORDER BY row_no) AS island FROM free),
run AS (SELECT *, min(row_no) OVER (PARTITION BY sheet, col_no, island) AS st,
  lag(text) OVER (PARTITION BY sheet, col_no, island ORDER BY row_no) AS up FROM isl),
near AS (SELECT d2.sheet, d2.row_no, d2.col_no, max(f.row_no) AS nr FROM d2 JOIN free f
  ON f.sheet = d2.sheet AND f.col_no = d2.col_no AND f.row_no < d2.row_no AND f.row_no > coalesce(d2.irow, 0) GROUP BY ALL),
ns AS (SELECT near.*, run.st, run.island FROM near JOIN run ON run.sheet = near.sheet AND run.col_no = near.col_no AND run.row_no = nr),
band AS (SELECT ns.sheet, ns.row_no, ns.col_no, list(run.text ORDER BY run.row_no) AS labels FROM ns JOIN run
  ON run.sheet = ns.sheet AND run.col_no = ns.col_no AND run.island = ns.island AND run.row_no <= nr
  AND run.up IS DISTINCT FROM run.text GROUP BY ALL),
note AS (SELECT ns.sheet, ns.row_no, ns.col_no FROM ns WHERE st > 1
  AND NOT EXISTS (SELECT 1 FROM g WHERE g.sheet = ns.sheet AND g.row_no = st - 1 AND g.col_no = ns.col_no
    AND (text IS NOT NULL OR number IS NOT NULL))
  AND NOT EXISTS (SELECT 1 FROM sec WHERE sec.sheet = ns.sheet AND sec.row_no = st - 1)
  AND EXISTS (SELECT 1 FROM txt WHERE txt.sheet = ns.sheet AND txt.row_no = st - 1 AND txt.col_no IN (ns.col_no - 1, ns.col_no + 1))),
e AS (SELECT d2.sheet, d2.row_no, d2.col_no,
  list_filter([olabel, ilabel], lambda x: x IS NOT NULL) AS sl,
  (list_concat(list_filter([grp_label], lambda x: x IS NOT NULL),
    list_filter(coalesce(names, []), lambda x, i: i = 1 OR x <> names[i - 1]))) AS rl,
  (coalesce(labels, [])) AS cl, mixed OR note.sheet IS NOT NULL AS noted
  FROM d2 LEFT JOIN band USING (sheet, row_no, col_no) LEFT JOIN note USING (sheet, row_no, col_no)),
n AS (SELECT *, list_transform(list_concat(sl, list_concat(rl, cl)), lambda x: {v.norm_sql('x')}) AS parts FROM e)
SELECT sheet, row_no, col_no, {_JOIN.format('sl')} AS section_labels, {_JOIN.format('rl')} AS row_labels,
  {_JOIN.format('cl')} AS column_labels, CASE WHEN len(parts) = 0 THEN 'NO_CONTEXT' WHEN noted THEN 'AMBIGUOUS'
    WHEN len(rl) > 0 AND len(cl) > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS context_status,
  {v.norm_sql('sheet')} || ' :: ' || CASE WHEN len(parts) = 0 THEN '<NO_CONTEXT>' ELSE array_to_string(parts, ' :: ') END AS signature
FROM n"""


@query("cell_labels", f"WITH {_CONTEXT},\n{_LABELS}")
def cell_labels(t):
    return _joined(layout.cell_labels(t.sql(GRID), targets(t)))


def _joined(found):
    return found.select(
        "sheet", "row_no", "col_no",
        *[F.array_join(f"{p}_labels", " | ").alias(f"{p}_labels") for p in ("section", "row", "column")],
        "context_status", "signature")


_CUT_LABELS = f"""txt AS (SELECT * FROM g WHERE text IS NOT NULL),
lf AS (SELECT c.sheet, c.row_no, c.col_no, list(x.text ORDER BY x.col_no) AS names, min(x.col_no) AS fc, max(x.col_no) AS lc
  FROM c JOIN txt x ON x.sheet = c.sheet AND x.row_no = c.row_no AND x.col_no < c.col_no GROUP BY ALL),
mx AS (SELECT DISTINCT lf.sheet, lf.row_no, lf.col_no FROM lf JOIN g ON g.sheet = lf.sheet AND g.row_no = lf.row_no
  AND g.number IS NOT NULL AND g.col_no > fc AND g.col_no < lc),
d AS (SELECT c.*, names, coalesce(fc, 2) AS label_col, mx.sheet IS NOT NULL AS mixed FROM c
  LEFT JOIN lf USING (sheet, row_no, col_no) LEFT JOIN mx USING (sheet, row_no, col_no)),
shaped AS (SELECT x.* FROM txt x WHERE regexp_matches(text, '{_GROUP}')
  AND NOT EXISTS (SELECT 1 FROM h WHERE h.sheet = x.sheet AND h.row_no = x.row_no AND (wide OR section))),
d1 AS (SELECT d.*, max(s.row_no) AS srow, max_by(s.text, s.row_no) AS slabel FROM d LEFT JOIN shaped s
  ON s.sheet = d.sheet AND s.col_no = d.label_col AND s.row_no < d.row_no GROUP BY ALL),
d2 AS (SELECT *, CASE WHEN is_header THEN NULL
  WHEN coalesce(grow, 0) > coalesce(irow, 0) AND coalesce(grow, 0) >= coalesce(srow, 0) THEN glabel
  WHEN coalesce(srow, 0) > coalesce(irow, 0) THEN slabel END AS grp_label FROM d1),
free AS (SELECT x.sheet, x.row_no, x.col_no, x.text FROM txt x
  WHERE NOT EXISTS (SELECT 1 FROM sec WHERE sec.sheet = x.sheet AND sec.row_no = x.row_no)),
isl AS (SELECT *, row_no - row_number() OVER (PARTITION BY sheet, col_no ORDER BY row_no) AS island FROM free),
run AS (SELECT *, min(row_no) OVER (PARTITION BY sheet, col_no, island) AS st,
  lag(text) OVER (PARTITION BY sheet, col_no, island ORDER BY row_no) AS up FROM isl),
near AS (SELECT d2.sheet, d2.row_no, d2.col_no, max(f.row_no) AS nr FROM d2 JOIN free f
  ON f.sheet = d2.sheet AND f.col_no = d2.col_no AND f.row_no < d2.row_no AND f.row_no > coalesce(d2.irow, 0) GROUP BY ALL),
ns AS (SELECT near.*, run.st, run.island FROM near JOIN run ON run.sheet = near.sheet AND run.col_no = near.col_no AND run.row_no = nr),
band AS (SELECT ns.sheet, ns.row_no, ns.col_no, list(run.text ORDER BY run.row_no) AS labels FROM ns JOIN run
  ON run.sheet = ns.sheet AND run.col_no = ns.col_no AND run.island = ns.island AND run.row_no <= nr
  AND run.up IS DISTINCT FROM run.text GROUP BY ALL),
note AS (SELECT ns.sheet, ns.row_no, ns.col_no FROM ns WHERE st > 1
  AND NOT EXISTS (SELECT 1 FROM g WHERE g.sheet = ns.sheet AND g.row_no = st - 1 AND g.col_no = ns.col_no
    AND (text IS NOT NULL OR number IS NOT NULL))
  AND NOT EXISTS (SELECT 1 FROM sec WHERE sec.sheet = ns.sheet AND sec.row_no = st - 1)
  AND EXISTS (SELECT 1 FROM txt WHERE txt.sheet = ns.sheet AND txt.row_no = st - 1 AND txt.col_no IN (ns.col_no - 1, ns.col_no + 1))),
e AS (SELECT d2.sheet, d2.row_no, d2.col_no,
  list_filter([olabel, ilabel], lambda x: x IS NOT NULL) AS sl,
  list_slice(list_concat(list_filter([grp_label], lambda x: x IS NOT NULL),
    list_filter(coalesce(names, []), lambda x, i: i = 1 OR x <> names[i - 1])), 1, 3) AS rl,
  list_slice(coalesce(labels, []), 1, 3) AS cl, mixed OR note.sheet IS NOT NULL AS noted
  FROM d2 LEFT JOIN band USING (sheet, row_no, col_no) LEFT JOIN note USING (sheet, row_no, col_no)),
n AS (SELECT *, list_transform(list_concat(sl, list_concat(rl, cl)), lambda x: {v.norm_sql('x')}) AS parts FROM e)
SELECT sheet, row_no, col_no, {_JOIN.format('sl')} AS section_labels, {_JOIN.format('rl')} AS row_labels,
  {_JOIN.format('cl')} AS column_labels, CASE WHEN len(parts) = 0 THEN 'NO_CONTEXT' WHEN noted THEN 'AMBIGUOUS'
    WHEN len(rl) > 0 AND len(cl) > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS context_status,
  {v.norm_sql('sheet')} || ' :: ' || CASE WHEN len(parts) = 0 THEN '<NO_CONTEXT>' ELSE array_to_string(parts, ' :: ') END AS signature
FROM n"""


@query("cell_labels_cut", f"WITH {_CONTEXT},\n{_CUT_LABELS}")
def cell_labels_cut(t):
    return _joined(layout.cell_labels(t.sql(GRID), targets(t), levels=3))


def targets_of(grid):
    return grid.filter("number is not null and col_no >= 4")


@query("header_rows_merged", f"WITH {_MERGED},\n{_HEADER_CTES} SELECT * FROM h")
def header_rows_merged(t):
    return layout.header_rows(t.sql(MERGED_GRID), t.sql(MERGES))


_MERGED_CONTEXT = f"{_MERGED},\n{_HEADER_CTES},\n{_CONTEXT_CTES.replace('FROM g WHERE number', 'FROM g0 WHERE number')}"


@query("header_context_merged", f"""WITH {_MERGED_CONTEXT}
SELECT sheet, row_no, col_no, ilabel AS section, olabel AS parent, glabel AS group_label, is_header FROM c""")
def header_context_merged(t):
    grid = t.sql(MERGED_GRID)
    found = layout.header_context(targets_of(grid).select("sheet", "row_no", "col_no"), layout.header_rows(grid, t.sql(MERGES)))
    return found.select(
        "sheet", "row_no", "col_no", F.col("inner.label").alias("section"), F.col("inner.parent").alias("parent"),
        F.col("grp.label").alias("group_label"), "is_header")


@query("cell_labels_merged", f"WITH {_MERGED_CONTEXT},\n{_LABELS}")
def cell_labels_merged(t):
    grid = t.sql(MERGED_GRID)
    return _joined(layout.cell_labels(grid, targets_of(grid), merges=t.sql(MERGES)))


_ROLES = """SELECT p_partkey, CASE WHEN p_size IN (5, 6) THEN '=SUM(A1)' WHEN p_size = 7 THEN '' END AS formula,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN CAST(p_partkey AS DOUBLE) WHEN p_size % 4 = 2 THEN 0.5 END AS value_num,
  CASE WHEN p_size % 4 = 3 THEN CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN ' ' || (1000 + p_partkey) ELSE '1,5' END END AS value_txt,
  CASE WHEN p_partkey % 5 = 0 THEN 'PARTIAL' WHEN p_partkey % 5 = 1 THEN 'NO_CONTEXT' WHEN p_partkey % 5 = 2 THEN 'AMBIGUOUS'
    ELSE 'COMPLETE' END AS context_status,
  p_type IN ('ECONOMY', 'PROMO', 'SMALL') AS protected, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 7 < 3 END AS locked
FROM {part}"""


@query("cell_roles", f"""WITH r AS ({plain(_ROLES)}),
f AS (SELECT *, trim(value_txt) AS tx, CASE WHEN value_num = floor(value_num) THEN CAST(CAST(value_num AS BIGINT) AS STRING) END AS wh,
  value_num IS NOT NULL OR coalesce(value_txt, '') <> '' AS filled FROM r),
k AS (SELECT *, CASE WHEN coalesce(formula, '') <> '' THEN 'FORMULA_TARGET'
  WHEN coalesce(regexp_full_match(tx, '[0-9]{{4,9}}'), false) OR coalesce(length(wh) BETWEEN 4 AND 9, false)
    OR coalesce(length(tx) > 3 AND NOT regexp_full_match(replace(replace(tx, '.', ''), ',', ''), '[0-9]+'), false) THEN 'STRUCTURAL'
  WHEN protected AND locked = false THEN CASE WHEN context_status = 'COMPLETE' THEN 'DIRECT_INPUT_TARGET' ELSE 'UNKNOWN' END
  WHEN protected THEN CASE WHEN context_status <> 'NO_CONTEXT' THEN 'STRUCTURAL' ELSE 'UNKNOWN' END
  WHEN context_status = 'COMPLETE' AND NOT filled THEN 'UNKNOWN'
  WHEN context_status <> 'NO_CONTEXT' AND filled THEN 'STRUCTURAL' ELSE 'UNKNOWN' END AS target_kind FROM f)
SELECT p_partkey, target_kind, CASE target_kind WHEN 'DIRECT_INPUT_TARGET' THEN 'INPUT_TARGET'
  WHEN 'FORMULA_TARGET' THEN 'DERIVED_TARGET' ELSE target_kind END AS target_role FROM k""")
def cell_roles(t):
    return layout.cell_roles(t.sql(_ROLES)).select("p_partkey", "target_kind", "target_role")
