"""Rule tables compiled to column expressions: strict, multi-label and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.dates import age_years
from metricspark.functions.text import casefold_text, concat_key, normalize_text


class UnknownOperator(ValueError):
    pass


@dataclass(frozen=True)
class Category:
    code: str
    field: str
    operator: str
    output_literal: str
    values: tuple[str, ...]

    def hits(self) -> list[Column]:
        """One boolean per rule value, case-insensitive but accent-exact."""
        text = casefold_text(F.col(self.field))
        wanted = [v.lower() for v in self.values if v]
        if self.operator == "equals":
            return [text == v for v in wanted]
        if self.operator == "contains":
            return [text.contains(v) for v in wanted]
        raise UnknownOperator(self.operator)

    def matches(self) -> Column:
        text = casefold_text(F.col(self.field))
        if self.operator == "equals":
            return text.isin(*[v.lower() for v in self.values if v])
        return reduce(lambda a, b: a | b, self.hits(), F.lit(False))


CATEGORIES = tuple(Category(*c) for c in fixed.CATEGORIES)


def category_codes(categories: Sequence[Category] = CATEGORIES) -> Column:
    """Codes of all categories a record belongs to, possibly none."""
    return F.array_compact(F.array(*[F.when(c.matches(), F.lit(c.code)) for c in categories]))


def multi_classify(df: DataFrame, categories: Sequence[Category] = CATEGORIES) -> DataFrame:
    return df.withColumn("codes", category_codes(categories))


def category_counts(df: DataFrame, categories: Sequence[Category] = CATEGORIES) -> DataFrame:
    """Records per category, one conditional count each, plus those in none."""
    counted = df.agg(
        *[F.count_if(c.matches()).alias(c.code) for c in categories],
        F.count_if(F.size(category_codes(categories)) == 0).alias("NONE"),
    )
    return counted.unpivot([], [*[c.code for c in categories], "NONE"], "code", "records")


def derived_columns(
    df: DataFrame,
    categories: Sequence[Category] = CATEGORIES,
    *,
    sex: str = "SEXO",
    birth: str = "FECHA_NACIMIENTO",
    service: str = "DIA_CITA",
) -> DataFrame:
    """Concatenations, age, exact maps and pattern counts next to the record.

    An exact map without a hit is exactly ``#N/A``: the sex is not appended.
    """
    def value(category: Category) -> Column:
        if category.operator == "equals":
            return F.when(
                category.matches(), concat_key(F.lit(category.output_literal), F.col(sex))
            ).otherwise(fixed.NO_MATCH)
        found = reduce(lambda a, b: a + b, [h.cast("int") for h in category.hits()])
        return concat_key(found, F.col(sex))

    return df.withColumns({
        **{name: concat_key(*[F.col(f) for f in fields])
           for name, fields in fixed.CONCATENATIONS.items()},
        fixed.AGE_COLUMN: age_years(F.col(birth), F.col(service)),
        **{c.code: value(c) for c in categories},
    })


def condition(c: Column, spec) -> Column:
    """One condition of a strict rule; everything is normalised but the regex itself."""
    text = normalize_text(c)

    def norm(value) -> Column:
        return normalize_text(F.lit(value))

    if not isinstance(spec, Mapping):
        return text == norm(spec)
    # of several operators in one condition the first of this order decides
    tests = {
        "eq": lambda value: text == norm(value),
        "in": lambda value: text.isin(*[norm(v) for v in value]),
        "contains": lambda value: text.contains(norm(value)),
        "starts_with": lambda value: text.startswith(norm(value)),
        "regex": text.rlike,
    }
    for op, test in tests.items():
        if op in spec:
            return test(spec[op])
    raise UnknownOperator(str(spec))


@dataclass(frozen=True)
class StrictRule:
    id: str
    conditions: Mapping[str, object]
    result: Mapping[str, str] = field(default_factory=dict)

    def matches(self) -> Column:
        return reduce(and_, [condition(F.col(f), s) for f, s in self.conditions.items()],
                      F.lit(True))


def strict_classify(df: DataFrame, rules: Sequence[StrictRule]) -> DataFrame:
    """Adds ``rule_status`` (OK / UNKNOWN / AMBIGUOUS), matching ids and the result map.

    Only exactly one matching rule classifies; everything else is for the reject table.
    """
    ids = F.array_compact(F.array(*[F.when(r.matches(), F.lit(r.id)) for r in rules]))
    results = F.create_map(*[
        x for r in rules
        for x in (F.lit(r.id), F.create_map(*[F.lit(y) for kv in r.result.items() for y in kv])
                  .cast("map<string,string>"))
    ])
    only = F.col("rule_ids")[0]
    return df.withColumn("rule_ids", ids).withColumns({
        "rule_status": F.when(F.size("rule_ids") == 0, "UNKNOWN")
        .when(F.size("rule_ids") == 1, "OK").otherwise("AMBIGUOUS"),
        "result": F.when(F.size("rule_ids") == 1, results[only]),
    })


