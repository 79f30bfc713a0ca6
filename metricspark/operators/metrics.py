"""Catalogs of counting metrics evaluated in one pass over the facts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.functions import criteria as C
from metricspark.session import config_table

_MASK_BITS = 62


@dataclass(frozen=True)
class Term:
    """One signed conjunctive count. No predicates means every scoped record."""

    metric_id: str
    predicates: tuple[tuple[str, str], ...] = ()
    sign: int = 1


def column_types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def term_condition(term: Term, dtypes: Mapping[str, str]) -> Column:
    tests = [C.matches(C.parse_criterion(raw), F.col(c), dtypes[c]) for c, raw in term.predicates]
    return reduce(and_, tests) if tests else F.lit(True)


def metric_counts(
    facts: DataFrame,
    terms: Sequence[Term],
    *,
    period: str = "period",
    flags: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``(period, metric_id, value, …)``: every metric of every period, zeros included.

    ``flags`` adds one more count column per named sub-population, in the same pass.
    """
    weights = {"value": F.lit(True), **(flags or {})}
    return _compressed_counts(facts, terms, period, weights)


class _ColumnClasses:
    """All that a catalog can see of one column, as a few small grouping keys.

    Two records with equal classes satisfy exactly the same criteria, so grouping by
    classes keeps every count while the number of groups depends on the catalog only,
    never on how many records or distinct values there are.
    """

    def __init__(self, column: str, dtype: str, index: int, parsed: Sequence[C.Criterion]):
        self.column, self.dtype, self.prefix = column, dtype, f"__k{index}"
        self.values = sorted({c.text for c in parsed if c.kind == "text"})
        self.points = sorted({c.number for c in parsed if c.kind == "number"})
        self.patterns = sorted({c.pattern for c in parsed if c.kind == "wildcard"})

    def _interval(self, value: Column, lo: int, hi: int) -> Column:
        """Binary search over the cut points: 2i for the gap before, 2i+1 for the point."""
        if lo == hi:
            return F.lit(2 * lo)
        mid = (lo + hi) // 2
        point = F.lit(self.points[mid])
        return (
            F.when(value < point, self._interval(value, lo, mid))
            .when(value == point, F.lit(2 * mid + 1))
            .otherwise(self._interval(value, mid + 1, hi))
        )

    def keys(self) -> dict[str, Column]:
        raw = F.col(self.column)
        text = F.lower(F.coalesce(raw.cast("string"), F.lit("")))
        out: dict[str, Column] = {}
        if self.values:
            out[f"{self.prefix}_t"] = F.when(text.isin(*self.values), text)
        if self.points:
            number = C.to_number(raw, self.dtype)
            out[f"{self.prefix}_n"] = F.when(
                number.isNotNull(), self._interval(number, 0, len(self.points))
            )
        for start in range(0, len(self.patterns), _MASK_BITS):
            chunk = self.patterns[start:start + _MASK_BITS]
            bits = [F.when(text.rlike(p), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                    for i, p in enumerate(chunk)]
            out[f"{self.prefix}_w{start}"] = reduce(lambda a, b: a + b, bits)
        return out

    def holds(self, c: C.Criterion) -> Column:
        """The criterion, read off the grouping keys instead of the record."""
        if c.kind == "number":
            key = F.col(f"{self.prefix}_n")
            at = F.lit(2 * self.points.index(c.number) + 1)
            return F.coalesce(C.compare_numbers(key, c.op, at), F.lit(False))
        if c.kind == "text":
            equal = F.coalesce(F.col(f"{self.prefix}_t") == c.text, F.lit(False))
        else:
            start, bit = divmod(self.patterns.index(c.pattern), _MASK_BITS)
            mask = F.col(f"{self.prefix}_w{start * _MASK_BITS}")
            equal = mask.bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0
        return ~equal if c.op == "<>" else equal


    def class_of(self, c: C.Criterion) -> tuple[str, str]:
        """Grouping key and the one class an equality criterion admits."""
        if c.kind == "text":
            return f"{self.prefix}_t", c.text
        return f"{self.prefix}_n", str(2 * self.points.index(c.number) + 1)


def _is_equality(c: C.Criterion) -> bool:
    return c.op in ("", "=") and c.kind != "wildcard"


def _compressed_counts(facts, terms, period, weights) -> DataFrame:
    dtypes = column_types(facts)
    atoms = sorted({p for t in terms for p in t.predicates})
    parsed = {atom: C.parse_criterion(atom[1]) for atom in atoms}
    columns = sorted({c for c, _ in atoms})
    classes = {
        c: _ColumnClasses(c, dtypes[c], i, [parsed[a] for a in atoms if a[0] == c])
        for i, c in enumerate(columns)
    }
    keys = {name: expr for cls in classes.values() for name, expr in cls.keys().items()}
    counted = (
        facts.select(F.col(period), *[e.alias(n) for n, e in keys.items()],
                     *[w.alias(f"__{n}") for n, w in weights.items()])
        .groupBy(period, *keys)
        .agg(*[F.count_if(F.col(f"__{n}")).alias(n) for n in weights])
    )

    # A term is found by hash through all its equality predicates at once (its shape);
    # what is left, ranges and negations, is tested as bit masks.
    residual = [a for a in atoms if not _is_equality(parsed[a])]
    bit = {a: divmod(i, _MASK_BITS) for i, a in enumerate(residual)}
    words = max(1, -(-len(residual) // _MASK_BITS))
    shapes: dict[tuple[str, ...], int] = {(): 0}
    lookup = [(None, 1, 0, "", *[0] * words)]  # keeps periods in which nothing is hit
    for term in terms:
        equal = dict(classes[a[0]].class_of(parsed[a]) for a in term.predicates
                     if _is_equality(parsed[a]))
        wanted = [classes[a[0]].class_of(parsed[a]) for a in term.predicates
                  if _is_equality(parsed[a])]
        if any(equal[k] != v for k, v in wanted):
            continue  # two different values asked of one column: never true
        shape = tuple(sorted(equal))
        masks = [0] * words
        for a in term.predicates:
            if a in bit:
                masks[bit[a][0]] |= 1 << bit[a][1]
        lookup.append((term.metric_id, term.sign, shapes.setdefault(shape, len(shapes)),
                       chr(31).join(equal[k] for k in shape), *masks))
    term_table = config_table(
        facts.sparkSession, lookup,
        "metric_id string, sign int, shape int, key string, "
        + ", ".join(f"need{w} bigint" for w in range(words)),
    )

    def word(w: int) -> Column:
        tests = [F.when(classes[a[0]].holds(parsed[a]), F.lit(1 << b)).otherwise(F.lit(0))
                 .cast("bigint") for a, (at, b) in bit.items() if at == w]
        return reduce(lambda x, y: x + y, tests, F.lit(0).cast("bigint"))

    entries = F.array(*[
        F.struct(
            F.lit(number).alias("shape"),
            # a record outside the class of any equality has no key, so it meets no term
            F.concat_ws(chr(31), *[F.col(k).cast("string") for k in shape]).alias("key"),
            reduce(and_, [F.col(k).isNotNull() for k in shape], F.lit(True)).alias("__any"),
        )
        for shape, number in shapes.items()
    ])
    tuples = counted.select(
        period, *weights, *[word(w).alias(f"have{w}") for w in range(words)],
        F.inline(F.filter(entries, lambda e: e["__any"])),
    )
    covered = reduce(and_, [
        F.col(f"have{w}").bitwiseAND(F.col(f"need{w}")) == F.col(f"need{w}")
        for w in range(words)
    ])
    hits = (
        tuples.join(term_table, ["shape", "key"]).filter(covered)
        .groupBy(period, "metric_id")
        .agg(*[F.sum(F.col("sign") * F.col(n)).alias(n) for n in weights])
    )
    # A period's row without a metric stands for a zero of every metric of the catalog.
    metrics = list(dict.fromkeys(t.metric_id for t in terms))
    zero = F.lit(0).cast("bigint")
    zeros = F.transform(F.lit(metrics), lambda m: F.struct(m.alias("metric_id"), *[zero.alias(n) for n in weights]))
    own = F.array(F.struct("metric_id", *weights))
    filled = hits.select(period, F.inline(F.when(F.col("metric_id").isNull(), zeros).otherwise(own)))
    return filled.groupBy(period, "metric_id").agg(*[F.sum(n).alias(n) for n in weights])
