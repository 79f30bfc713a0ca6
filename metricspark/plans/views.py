"""Input roles derived from the driver tables, in SQL that both engines read."""

from __future__ import annotations

from metricspark import fixed_values as fixed
from metricspark.plans.registry import plain

NBSP = " "


def _dmy(x: str, sep: str) -> str:
    return (f"lpad(CAST(day({x}) AS STRING), 2, '0') || '{sep}' || "
            f"lpad(CAST(month({x}) AS STRING), 2, '0') || '{sep}' || CAST(year({x}) AS STRING)")


def _pick(selector: str, values) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {selector} % {len(values)} {cases} END"


_BIRTH = "(DATE '1930-01-01' + CAST(o_custkey * 37 % 32000 AS INT))"
_STATES = fixed.INCLUDED_STATES + fixed.EXCLUDED_STATES
_KINDS = (
    "CONSULTA GENERAL", "Control Periodoncia", "EVALUACIÓN DE ORTODONCIA",
    "evaluacion de ortodoncia", fixed.CATEGORIES[0][4][1], "CONTROL ODONTOPEDIATRÍA", "CURACIÓN",
)
_WORKS = (
    "CONTROL APARATO FIJO Y CONTROL SPLINT", "instalación placa ortop. preq.", "PULIDO",
    "CONTROL MASCARA Y/O DISYUNTOR", "CONTROL TAPE LABIAL PREQ. + CONTROL CONTENCIÓN",
)

# Export of appointments out of the orders: text dates in two layouts, blanks of
# several kinds, unreadable dates, rows that are empty throughout, personal columns.
_FIELDS = {
    "DIA_CITA": (
        "CASE WHEN o_orderkey % 97 = 0 THEN 'no-es-fecha' WHEN o_orderkey % 89 = 0 THEN '  ' "
        f"WHEN o_orderkey % 2 = 0 THEN {_dmy('o_orderdate', '/')} ELSE {_dmy('o_orderdate', '-')} END"
    ),
    "FECHA_NACIMIENTO": (
        "CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 211 = 0 THEN '31/02/1990' "
        f"ELSE {_dmy(_BIRTH, '/')} END"
    ),
    "SEXO": f"CASE WHEN o_orderkey % 131 = 0 THEN ' {NBSP} ' WHEN o_custkey % 2 = 0 THEN 'Mujer' "
            "ELSE 'Hombre' END",
    "SUCURSAL": _pick("o_custkey", ("Santiago", "Ñuñoa", "Valparaíso", "Concepción")),
    "ESPECIALIDAD": "CASE WHEN o_orderkey % 61 = 0 THEN ' ' ELSE substr(o_orderpriority, 3) || ' ' "
                    "|| CAST(o_custkey % 3 AS STRING) END",
    "TIPO_DE_CITA": "CASE WHEN o_orderkey % 173 = 0 THEN 'nan' ELSE "
                    f"{_pick('(o_orderkey + o_custkey)', _KINDS)} END",
    "PRESTACION": f"CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE {_pick('o_custkey', _WORKS)} END",
    "ESTADO": f"CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN "
              f"' {_STATES[0].upper()} ' ELSE {_pick('(o_orderkey + 3 * o_custkey)', _STATES)} END",
    "MODALIDAD": "CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END",
}
DETAIL_FIELDS = tuple(_FIELDS)

RAW_DETAIL = "SELECT o_orderkey AS id, " + ", ".join(
    f"CASE WHEN o_orderkey % 307 = 0 THEN NULL ELSE {sql} END AS {name}"
    for name, sql in _FIELDS.items()
) + ", o_totalprice AS copago, 'x@y.cl' AS correo FROM {orders}"

_BLANK_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK_CLASS}+|{_BLANK_CLASS}+$', '', 'g')"


def norm_sql(x: str) -> str:
    squeezed = f"regexp_replace(coalesce({x}, ''), '{_BLANK_CLASS}+', ' ', 'g')"
    return f"strip_accents(upper({trim_sql(squeezed)}))"


def blank_sql(x: str) -> str:
    return f"coalesce({trim_sql(x)} IN ('', 'NaT', 'nan', 'None', '<NA>'), true)"


def date_sql(x: str) -> str:
    return f"CAST(try_strptime({trim_sql(x)}, ['%d/%m/%Y', '%d-%m-%Y', '%Y-%m-%d']) AS DATE)"


DATES = ("DIA_CITA", "FECHA_NACIMIENTO")

# CTEs for oracles: raw -> typed -> flags.
DETAIL_CTE = f"""raw AS ({plain(RAW_DETAIL)}),
typed AS (SELECT id, {', '.join(
    f'{date_sql(f)} AS {f}' if f in DATES else f"coalesce({f}, '') AS {f}" for f in DETAIL_FIELDS)},
  {', '.join(f'{blank_sql(f)} AS {f}_blank' for f in DETAIL_FIELDS)} FROM raw),
active AS (SELECT *, NOT ({' AND '.join(f'{f}_blank' for f in DETAIL_FIELDS)}) AS active FROM typed),
marked AS (SELECT *,
  active AND DIA_CITA IS NULL AS service_bad,
  active AND NOT FECHA_NACIMIENTO_blank AND FECHA_NACIMIENTO IS NULL AS birth_bad,
  active AND SEXO_blank AS sex_empty, active AND TIPO_DE_CITA_blank AS kind_empty,
  active AND coalesce(FECHA_NACIMIENTO > DIA_CITA, false) AS birth_after,
  CAST(date_trunc('month', DIA_CITA) AS DATE) AS period FROM active),
flags AS (SELECT *, service_bad OR birth_bad OR sex_empty OR kind_empty AS invalid,
  active AND NOT (service_bad OR birth_bad OR sex_empty OR kind_empty) AS valid FROM marked)"""

AGE_SQL = """CASE WHEN FECHA_NACIMIENTO IS NULL OR DIA_CITA IS NULL THEN NULL
  WHEN FECHA_NACIMIENTO > DIA_CITA THEN 0
  ELSE year(DIA_CITA) - year(FECHA_NACIMIENTO)
    - CASE WHEN strftime(DIA_CITA, '%m%d') < strftime(FECHA_NACIMIENTO, '%m%d') THEN 1 ELSE 0 END END"""
