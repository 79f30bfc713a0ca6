"""Counting criteria: ``">=18"``, ``"<>x*"``, ``"Mujer"`` and friends."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operators, two characters before one.
OPERATORS = ("<>", "<=", ">=", "<", ">", "=")

_SPLIT = re.compile(rf"({'|'.join(OPERATORS)}|)(.*)", re.S)
#: Order is defined between numbers only.
_UNDEFINED = {(op, kind) for op in ("<", "<=", ">", ">=") for kind in ("text", "wildcard")}
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


class UnsupportedCriterion(ValueError):
    """The criterion has no defined meaning, e.g. ``"<abc"``."""


class Criterion(NamedTuple):
    """An operator, the kind of its operand (``number``, ``text`` or ``wildcard``) and the operand."""

    op: str
    kind: str
    operand: float | str

    @property
    def number(self) -> float | None:
        return self.operand if self.kind == "number" else None

    @property
    def text(self) -> str | None:
        return self.operand if self.kind == "text" else None

    @property
    def pattern(self) -> str | None:
        return self.operand if self.kind == "wildcard" else None


def wildcard_regex(body: str) -> str:
    """``*`` any run, ``?`` any one character, ``~`` makes the next wildcard literal."""
    def piece(m: re.Match) -> str:
        token = m.group()
        if token[0] == "~" and len(token) == 2:
            return "\\" + token[1]
        return {"*": ".*", "?": "."}.get(token) or re.sub(r"([^\w\s])", r"\\\1", token)

    return r"(?s)\A" + re.sub(r"~[*?~]|.", piece, body.lower(), flags=re.S) + r"\z"


def _operand(body: str) -> tuple[str, float | str]:
    """Kind and value of what follows the operator."""
    if re.fullmatch(_NUMBER[1:-1], body) and math.isfinite(number := float(body)):
        return "number", number
    special = any(ch in body for ch in "*?~")
    return ("wildcard", wildcard_regex(body)) if special else ("text", body.lower())


def parse_criterion(raw: str) -> Criterion:
    op, body = _SPLIT.match(raw).groups()
    kind, operand = _operand(body)
    if (op, kind) in _UNDEFINED:
        raise UnsupportedCriterion(f"ordering test against text: {raw!r}")
    return Criterion(op, kind, operand)


def to_number(c: Column, dtype: str) -> Column:
    """Finite number behind a cell, else null. Booleans are never numbers."""
    if dtype == "boolean":
        return F.lit(None).cast("double")
    if dtype in NUMERIC_TYPES or dtype.startswith("decimal"):
        value = c.cast("double")
    else:
        text = c.cast("string")
        value = F.when(text.rlike(_NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def compare_numbers(value: Column, op: str, expected: Column) -> Column:
    return {
        "": value == expected,
        "=": value == expected,
        "<>": value != expected,
        "<": value < expected,
        "<=": value <= expected,
        ">": value > expected,
        ">=": value >= expected,
    }[op]


def matches(criterion: Criterion, c: Column, dtype: str = "string") -> Column:
    """Never-null boolean: does the cell satisfy the criterion?

    A numeric criterion never holds on a non-number, not even ``<>``. A text ``<>``
    is the plain negation of equality, so an absent cell satisfies it.
    """
    if criterion.number is not None:
        hit = compare_numbers(to_number(c, dtype), criterion.op, F.lit(criterion.number))
        return F.coalesce(hit, F.lit(False))
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    equal = text.rlike(criterion.pattern) if criterion.pattern else text == criterion.text
    return ~equal if criterion.op == "<>" else equal
