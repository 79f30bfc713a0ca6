"""Lists, patterns and thresholds that results depend on.

They are data of the reporting rules, stated as they are and kept together. Every
operator takes its own values as a parameter; these are only the defaults.
"""

# Semantic fields of a detail record.
REQUIRED_FIELDS = (
    "DIA_CITA", "FECHA_NACIMIENTO", "SEXO", "SUCURSAL", "ESPECIALIDAD", "TIPO_DE_CITA",
    "PRESTACION",
)
OPTIONAL_FIELDS = ("ESTADO", "MODALIDAD", "PRESTACION_REALIZADA")

# Normalised header -> semantic field.
HEADER_ALIASES = {
    "DIA_CITA": "DIA_CITA",
    "FECHA_CITA": "DIA_CITA",
    "FECHA_DE_CITA": "DIA_CITA",
    "FECHA_ATENCION": "DIA_CITA",
    "FECHA_NACIMIENTO": "FECHA_NACIMIENTO",
    "FECHA_DE_NACIMIENTO": "FECHA_NACIMIENTO",
    "SEXO": "SEXO",
    "SUCURSAL": "SUCURSAL",
    "ESPECIALIDAD": "ESPECIALIDAD",
    "TIPO_DE_CITA": "TIPO_DE_CITA",
    "TIPO_CITA": "TIPO_DE_CITA",
    "ESTADO": "ESTADO",
    "ESTADO_CITA": "ESTADO",
    "MODALIDAD": "MODALIDAD",
    "PRESTACION": "PRESTACION",
    "PRESTACION_REALIZADA": "PRESTACION_REALIZADA",
}

# Statuses counted and not counted, compared trimmed and case-insensitively.
INCLUDED_STATES = ("Atendido", "En Sala de Espera", "Atención Pausada", "En Atención")
EXCLUDED_STATES = ("Cancelado", "No Se Presenta", "Agendado", "Confirmado", "Re-Agendado")

# Record categories as (code, field, operator, output literal, values).
CATEGORIES = (
    ("AG", "TIPO_DE_CITA", "equals", "consulta médico", (
        "CONSULTA MEDICA DE ESPECIALIDAD EN CIRUGIA PLASTICA Y REPARADORA - COD.0101316",
        "CONSULTA MEDICA DE ESPECIALIDAD EN GENETICA CLINICA - COD.0101325",
        "CONSULTA MEDICA DE ESPECIALIDAD EN OTORRINOLARINGOLOGIA - COD.0101205",
    )),
    ("AH", "TIPO_DE_CITA", "equals", "control odon esp", (
        "CONTROL ODONTOPEDIATRÍA",
        "CONTROL EVOLUCIÓN DENTARIA",
        "CONTROL PERIODONCIA",
        "CONTROL REHABILITACION ORAL",
    )),
    ("AI", "TIPO_DE_CITA", "equals", "evaluacion odon esp", (
        "EVALUACIÓN DE ORTODONCIA",
        "EVALUACIÓN REHABILITACIÓN ORAL",
        "EVALUACIÓN ODONTOPEDIATRIA",
        "EVALUACIÓN PERIODONCIA",
        "EVALUACIÓN DE ORTOPEDIA POSTQ.",
        "EVALUACIÓN DE ORTOPEDIA PREQ.",
    )),
    ("AJ", "PRESTACION", "contains", "", (
        "CONTROL APARATO REMOVIBLE",
        "CONTROL MÁSCARA Y/O DISYUNTOR",
        "CONTROL SPLINT",
        "CONTROL 2X4 SUP O INF",
        "CONTROL APARATO FIJO",
        "CONTROL CONTENCIÓN",
    )),
    ("AK", "PRESTACION", "contains", "", (
        "CONTROL PLACA ORTOP. PREQ.",
        "CONTROL CONFORMADOR PREQ.",
        "CONTROL TAPE LABIAL PREQ.",
    )),
    ("AL", "PRESTACION", "contains", "", (
        "INSTALACIÓN PLACA ORTOP. PREQ.",
        "INSTALACIÓN CONFORMADOR PREQ.",
        "INSTALACIÓN TAPE LABIAL PREQ.",
        "INSTALACIÓN CONFORMADOR NASAL POSTQ.",
        "INSTALACIÓN PLACA OBTURADORA POSTQ.",
    )),
)
# Derived concatenations, in operand order.
CONCATENATIONS = {
    "AC": ("TIPO_DE_CITA", "SUCURSAL"),
    "AD": ("TIPO_DE_CITA", "SEXO"),
    "AE": ("PRESTACION", "ESPECIALIDAD", "SEXO"),
}
AGE_COLUMN = "AF"
NO_MATCH = "#N/A"

# Age bands as (label, from, below).
AGE_BANDS = (
    ("0 a 4 años", 0, 5),
    ("5 a 9 años", 5, 10),
    ("10 a 14 años", 10, 15),
    ("15 a 19 años", 15, 20),
    ("20 a 39 años", 20, 40),
    ("40 a 64 años", 40, 65),
    ("65 años o más", 65, 10_000),
)
MISSING_LABEL = "(sin dato)"
OUTSIDE_LABEL = "(fuera de rango)"
OTHER_LABEL = "Otras especialidades"
EMPTY_LABEL = "<vacío>"
TOP_N = 8
MAX_PROBLEMS = 500
MAX_CATEGORICAL_UNIQUE = 40
MAX_DISTRIBUTION = 15

# Personal-data patterns.
PERSONAL_DATA = (
    ("NATIONAL_ID", r"\b\d{7,8}-[\dkK]\b"),
    ("DATE_DMY", r"\b\d{1,2}/\d{1,2}/\d{4}\b"),
    ("DATE_ISO", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("EMAIL", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
)

# Alignment weights and thresholds.
WEIGHTS = {
    "PROCEDURE_CODE": 5,
    "ROW_PATH": 4,
    "COLUMN_PATH": 4,
    "SEX": 3,
    "AGE": 3,
    "SECTION": 2,
    "AGGREGATION_SCOPE": 2,
}
EXACT_THRESHOLD = 1.0
STRONG_THRESHOLD = 0.75
TIE_MARGIN = 0.05

# Label cascade confidences and limits.
CONFIDENCE = {"exact": 1.0, "normalised": 0.85, "code": 0.7, "ambiguous": 0.4, "ambiguous_code": 0.35}

# Evidence needed before a policy for zeros is decided.
ZERO_MIN_CASES = 30
ZERO_MIN_RATIO = 0.98

VALUE_TOLERANCE = 1e-9

# Sex labels (normalised), criterion fragments and age-label patterns with
# their bounds: group number, "-1" for one less, a constant, or nothing for an open end.
SEX_LABELS = {
    "HOMBRE": "MALE", "HOMBRES": "MALE", "MUJER": "FEMALE", "MUJERES": "FEMALE",
    "AMBOS SEXO": "BOTH", "AMBOS SEXOS": "BOTH",
}
SEX_CRITERIA = {"hombre": "MALE", "mujer": "FEMALE"}
AGE_LABELS = (
    (r"^MEN(?:OS|OR) DE 1 ANO\s*-\s*1 ANO$", "0", "1"),
    (r"^MEN(?:OS|OR) DE\s*(\d+)\s*ANOS?$", None, "g1-1"),
    (r"(\d+)\s*Y\s*MAS\s*ANOS?", "g1", None),
    (r"^(\d+)\s*[-A]\s*(\d+)\s*ANOS?$", "g1", "g2"),
    (r"^(\d+)\s*-\s*(\d+)$", "g1", "g2"),
    (r"^(\d+)\s*ANOS?$", "g1", "g1"),
)
GROUP_HEADER = r"^\s*[A-Z]\s*[.\-]\s*(\d+\s*[.\-]|\-|)"
SECTION_KEYWORD = r"^\s*secci[oó]n\b"
PROCEDURE_DIGITS = (4, 8)
ROLLUP_SCOPES = ("TOTAL", "SUBTOTAL")
MIN_LABEL_LENGTH = 3
MAX_AMBIGUOUS_PER_LABEL = 6
