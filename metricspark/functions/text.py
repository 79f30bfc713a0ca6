"""Text normalisation as native column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as ``str.strip`` sees it: ASCII blanks, the four separator controls, NEL and
# every Unicode separator (no-break space among them). ``trim`` alone knows only spaces.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"

#: Pattern prefixes: any case in every alphabet; classes such as ``\\w`` in every alphabet.
ANY_CASE = "(?iu)"
ANY_SCRIPT = "(?U)"

# Texts that count as a blank cell after trimming.
BLANK_MARKERS = ("", "NaT", "nan", "None", "<NA>")


def _accent_pairs() -> tuple[str, str]:
    """Every precomposed letter that is one base letter plus combining marks."""
    source, target = [], []
    for code in range(0x00C0, 0xFFFF):
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) < 2:
            continue
        base = [ch for ch in parts if unicodedata.category(ch) != "Mn"]
        if len(base) == 1 and len(parts) > 1:
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_pairs()


def trim_ws(c: Column) -> Column:
    """Strip every kind of leading and trailing whitespace, not just spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{_SPACE}+", " "))


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def normalize_text(c: Column) -> Column:
    """Trimmed, upper case, single spaces, no accents; null becomes ``""``."""
    return strip_accents(F.upper(collapse_ws(F.coalesce(c.cast("string"), F.lit("")))))


#: Labels follow the same rule: digits and punctuation stay.
normalize_label = normalize_text


def casefold_text(c: Column) -> Column:
    """Case-insensitive but accent- and space-exact; null becomes ``""``."""
    return F.lower(F.coalesce(c.cast("string"), F.lit("")))


def status_key(c: Column) -> Column:
    return F.lower(trim_ws(c))


def is_blank(c: Column) -> Column:
    text = trim_ws(c.cast("string"))
    return F.coalesce(text.isin(*BLANK_MARKERS), F.lit(True))


def concat_text(c: Column, dtype: str) -> Column:
    """Spreadsheet-style text of one operand of a concatenation."""
    if dtype == "boolean":
        return F.when(c, "TRUE").when(~c, "FALSE").otherwise("")
    if dtype in ("double", "float"):
        whole = c.cast("decimal(38,0)").cast("string")
        text = F.when(F.isnan(c), "").when(c == F.floor(c), whole).otherwise(c.cast("string"))
        return F.coalesce(text, F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def concat_key(*parts: Column) -> Column:
    """Concatenation without separator where a null part counts as empty text."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def content_key(*parts: Column) -> Column:
    """Row fingerprint: parts joined by ``|``, absent parts empty."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def instruction_id(*parts: Column) -> Column:
    """Stable identity of an instruction: hash of its parts joined by a unit separator."""
    joined = F.concat_ws(chr(31), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit("wi:"), F.substring(F.sha2(joined, 256), 1, 20))


def signature(*paths: Column) -> Column:
    """Non-empty labels of several paths joined by `` :: ``, or ``<NO_CONTEXT>``."""
    labels = F.filter(F.concat(*paths), lambda x: x != "")
    return F.when(F.size(labels) == 0, "<NO_CONTEXT>").otherwise(F.array_join(labels, " :: "))


def expression_key(c: Column) -> Column:
    """Case-only normal form of an expression: quoted literals stay exact."""
    pieces = F.regexp_extract_all(c, F.lit(r'("(?:[^"]|"")*"?|[^"]+)'), 1)
    return F.array_join(
        F.transform(pieces, lambda p: F.when(p.startswith('"'), p).otherwise(F.lower(p))), ""
    )


def header_key(name: str) -> str:
    """Driver-side header normal form: upper case, no accents, ``_`` between words."""
    plain = unicodedata.normalize("NFD", " ".join(str(name).split()).upper())
    plain = "".join(ch for ch in plain if unicodedata.category(ch) != "Mn")
    return re.sub(r"[^A-Z0-9]+", "_", plain).strip("_")


def field_key(c: Column) -> Column:
    """The same normal form for header names that arrive as data."""
    return F.regexp_replace(F.regexp_replace(normalize_text(c), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
