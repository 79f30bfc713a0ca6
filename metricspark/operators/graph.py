"""Dependency graphs between metrics as edge tables ``(metric_id, dep_metric_id, …)``.

Depths and closures contract chains and take few rounds; the other loops run once per level of the
graph. All checkpoint what they hand on.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricspark.functions.text import normalize_label
from metricspark.session import cut_lineage

#: Rounds by plain levels before chains are contracted: shallow graphs end before it pays.
PLAIN_ROUNDS = 3
UNKNOWN_SOURCE = "UNKNOWN_PENDING"
MIXED_SOURCE = "MIXED_DERIVED"


def _links(edges: DataFrame, weight: Column) -> DataFrame:
    """``(metric_id, dep_metric_id, w)`` of all edges, each once."""
    return edges.select("metric_id", "dep_metric_id").distinct().withColumn("w", weight)


def _shortcuts(state: DataFrame, best) -> DataFrame:
    """``(dep_metric_id, target, w_on, w_own)``: nodes that wait for just one other node, and how.

    An edge to such a node can go to what it waits for instead, so a chain halves in every round.
    """
    waits = F.col("dep_metric_id").isNotNull()
    return state.groupBy("metric_id").agg(
        F.count("dep_metric_id").alias("waiting"), F.max("dep_metric_id").alias("target"),
        best(F.when(waits, F.col("w"))).alias("w_on"), best(F.when(~waits, F.col("w"))).alias("w_own"),
    ).filter("waiting = 1 AND target <> metric_id").select(F.col("metric_id").alias("dep_metric_id"), "target", "w_on", "w_own")


def _merged(rows: Column, state: DataFrame, best) -> DataFrame:
    found = state.select("metric_id", F.inline(rows)).filter("w IS NOT NULL")
    return found.groupBy("metric_id", "dep_metric_id").agg(best("w").alias("w"))


def _row(dep: Column, w: Column) -> Column:
    # on a cycle an edge is put together without end; no path that counts is as long as this
    return F.struct(dep.alias("dep_metric_id"), F.when(w.isNotNull(), F.least(w, F.lit(1 << 40))).alias("w"))


def dag_depth(edges: DataFrame) -> DataFrame:
    """``(metric_id, depth, cyclic)``: longest path from a root.

    Nodes are released once all their dependencies are; whatever is never released lies on a cycle
    or downstream of one and has no depth. An edge to a node that waits for one other node only is
    moved on to that node, with the length of both, from round ``PLAIN_ROUNDS`` on, so chains and trees take as many rounds as the
    logarithm of their length; what was released takes no part in later rounds.

    The state has one row ``(metric_id, dep_metric_id, w)`` per edge that is still waited for, and
    per node one without a dependency for the longest path found so far.
    """
    links = _links(edges, F.lit(1).cast("long"))
    ends = F.array("metric_id", "dep_metric_id")
    start = links.select(F.explode(ends).alias("metric_id")).distinct().select(
        "metric_id", F.lit(None).cast(links.schema["dep_metric_id"].dataType).alias("dep_metric_id"), F.lit(0).cast("long").alias("w"))
    state = cut_lineage(links.unionByName(start))
    none = F.lit(None).cast(links.schema["dep_metric_id"].dataType)
    levels: list[DataFrame] = []
    while True:
        ready = cut_lineage(state.groupBy("metric_id").agg(
            F.count("dep_metric_id").alias("waiting"), F.max("w").alias("depth")).filter("waiting = 0").select("metric_id", "depth"))
        if ready.isEmpty():
            break
        levels.append(ready)
        told = state.join(ready.select("metric_id"), "metric_id", "left_anti").join(ready.select(_as_dependency(), "depth"), "dep_metric_id", "left")
        known = F.col("depth").isNotNull()
        state = _merged(
            F.array(_row(F.when(known, none).otherwise(F.col("dep_metric_id")), F.col("w") + F.coalesce("depth", F.lit(0)))),
            told, F.max)
        if len(levels) <= PLAIN_ROUNDS:
            state = cut_lineage(state)
            continue
        moved = state.join(_shortcuts(state, F.max), "dep_metric_id", "left")
        state = cut_lineage(_merged(F.when(F.col("target").isNull(), F.array(_row(F.col("dep_metric_id"), F.col("w")))).otherwise(
            F.array(_row(F.col("target"), F.col("w") + F.col("w_on")), _row(none, F.col("w") + F.col("w_own")))), moved, F.max))
    stuck = state.select("metric_id").distinct().withColumn("depth", F.lit(None).cast("int"))
    done = [level.withColumn("depth", F.col("depth").cast("int")) for level in levels]
    return reduce(DataFrame.unionByName, [*done, stuck]).withColumn("cyclic", F.col("depth").isNull())


def dag_closure(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``(metric_id, hops)``: all nodes that depend on a source, with the fewest steps.

    The first ``PLAIN_ROUNDS`` steps expand newly reached nodes only. Whatever lies further is told
    the steps of reached nodes in every round, while edges to a node with one dependency move on to
    that dependency; it ends when no number of steps falls. So chains take as many rounds as the
    logarithm of their length, and cycles end by themselves.
    """
    links = cut_lineage(_links(edges, F.lit(1).cast("long")))
    frontier = cut_lineage(sources.select("metric_id").distinct().withColumn("w", F.lit(0).cast("long")))
    reached, rounds = frontier, 0
    while not frontier.isEmpty() and rounds < PLAIN_ROUNDS:
        rounds += 1
        step = links.join(frontier.select(_as_dependency()), "dep_metric_id", "left_semi").select("metric_id").distinct()
        frontier = cut_lineage(step.join(reached, "metric_id", "left_anti").withColumn("w", F.lit(rounds).cast("long")))
        reached = reached.unionByName(frontier)
    if frontier.isEmpty():
        return reached.select("metric_id", F.col("w").cast("int").alias("hops"))
    none = F.lit(None).cast(links.schema["dep_metric_id"].dataType)
    # what a reached node depends on cannot bring it nearer
    rest = links.join(reached.select("metric_id"), "metric_id", "left_anti")
    state = cut_lineage(rest.unionByName(reached.withColumn("dep_metric_id", none)))
    before = None
    while True:
        found = state.filter("dep_metric_id IS NULL")
        size = found.agg(F.count(F.lit(1)), F.sum("w")).first()
        if size == before:
            break
        before = size
        hops = found.select(_as_dependency(), F.col("w").alias("hops"))
        told = state.join(hops, "dep_metric_id", "left").join(_shortcuts(state, F.min), "dep_metric_id", "left")
        state = cut_lineage(_merged(
            F.array(_row(F.coalesce("target", "dep_metric_id"), F.col("w") + F.coalesce("w_on", F.lit(0))), _row(none, F.col("w") + F.col("hops"))), told, F.min))
    return state.filter("dep_metric_id IS NULL").select("metric_id", F.col("w").cast("int").alias("hops"))


def propagate_pairs(edges: DataFrame, local: DataFrame, item: str) -> DataFrame:
    """Fixpoint of ``(metric_id, item)``: own items plus those of all dependencies.

    Works on pairs, never on growing sets, and only carries new pairs to the next step.
    """
    links = cut_lineage(edges.select("metric_id", "dep_metric_id").distinct())
    fresh = cut_lineage(local.select("metric_id", item).distinct())
    known = fresh
    while not fresh.isEmpty():
        step = (
            links.join(fresh.withColumnRenamed("metric_id", "dep_metric_id"), "dep_metric_id")
            .select("metric_id", item).distinct()
            .join(known, ["metric_id", item], "left_anti")
        )
        fresh = cut_lineage(step)
        known = known.unionByName(fresh)
    return known


def lineage_columns(edges: DataFrame, local: DataFrame, item: str = "column") -> DataFrame:
    """Transitive source columns of every metric, as one sorted array.

    The array is bounded by the number of source columns, not by the graph.
    """
    return propagate_pairs(edges, local, item).groupBy("metric_id").agg(
        F.sort_array(F.collect_set(item)).alias("columns")
    )


def derived_metrics(
    base: DataFrame, edges: DataFrame, literals: DataFrame | None = None
) -> DataFrame:
    """``(metric_id, value, available)`` of every metric that has counts, literals or dependencies.

    A value is one signed sum of a metric's own counts, its literals and its dependencies,
    whichever it has. A blank dependency counts as 0; a missing or unavailable one makes the
    metric unavailable, and so does a cycle. Values of whole counts and literals stay whole.
    """
    edges = cut_lineage(edges.select("metric_id", "dep_metric_id", "sign"))
    depths = cut_lineage(dag_depth(edges))
    top = depths.agg(F.max("depth")).first()[0] or 0
    parts = [base] if literals is None else [base, literals]
    whole = all(dict(p.dtypes)["value"] in ("tinyint", "smallint", "int", "bigint") for p in parts)
    number = "bigint" if whole else "double"
    own = reduce(DataFrame.unionByName, [
        p.select("metric_id", F.col("value").cast(number).alias("value")) for p in parts
    ]).groupBy("metric_id").agg(F.sum("value").alias("value"))
    own = cut_lineage(own)
    computed = edges.select("metric_id").distinct()
    values = own.join(computed, "metric_id", "left_anti").select("metric_id", "value", F.lit(True).alias("available"))
    staged = edges.join(depths.select("metric_id", "depth"), "metric_id")
    zero = F.lit(0).cast(number)
    for level in range(1, top + 1):
        known = values.select(_as_dependency(), "value", "available")
        totals = (
            staged.filter(F.col("depth") == level)
            .join(known, "dep_metric_id", "left")
            .groupBy("metric_id").agg(
                F.sum(F.col("sign") * F.coalesce("value", zero)).alias("referred"),
                F.bool_and(F.coalesce("available", F.lit(False))).alias("available"),
            )
            .join(own, "metric_id", "left")
        )
        total = (F.col("referred") + F.coalesce("value", zero)).cast(number)
        values = values.unionByName(cut_lineage(totals.select(
            "metric_id", F.when(F.col("available"), total).alias("value"), "available"
        )))
    cyclic = (
        depths.filter("cyclic").join(computed, "metric_id", "left_semi")
        .select("metric_id", F.lit(None).cast(number).alias("value"),
                F.lit(False).alias("available"))
    )
    return values.unionByName(cyclic)


def _as_dependency():
    return F.col("metric_id").alias("dep_metric_id")


def provenance(direct: DataFrame, derived: DataFrame, edges: DataFrame) -> DataFrame:
    """``(metric_id, source, status, needs_review)`` of changed nodes.

    ``direct`` carries classified changes ``(metric_id, source, status, needs_review)``,
    ``derived`` the ids whose result changed. A derived node takes the one base source
    of its changed dependencies, or is mixed; a mixed or unknown input asks for review.
    """
    changed = direct.select("metric_id").unionByName(derived.select("metric_id"))
    links = cut_lineage(
        edges.select("metric_id", "dep_metric_id").distinct()
        .join(derived.select("metric_id"), "metric_id", "left_semi")
        .join(changed.select(_as_dependency()), "dep_metric_id", "left_semi")
    )
    depths = cut_lineage(dag_depth(links))
    known = cut_lineage(direct.select(
        "metric_id", F.array("source").alias("sources"), F.lit(False).alias("mixed"),
        "needs_review", "status",
    ))
    top = depths.agg(F.max("depth")).first()[0] or 0
    staged = links.join(depths, "metric_id")
    upstream_of = lambda part: (
        part.join(known.withColumnRenamed("metric_id", "dep_metric_id"), "dep_metric_id")
        .groupBy("metric_id").agg(
            # at most one set per combination of sources, however many inputs there are
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
            F.bool_or("mixed").alias("any_mixed"),
            F.bool_or("needs_review").alias("any_review"),
        ).select(
            "metric_id", "sources",
            (F.col("any_mixed") | (F.size("sources") > 1)).alias("mixed"),
            (F.col("any_mixed") | F.col("any_review")
             | F.array_contains("sources", UNKNOWN_SOURCE)).alias("needs_review"),
            F.lit("DERIVED_FROM_DEPENDENCIES").alias("status"),
        )
    )
    roots = derived.select("metric_id").join(links.select("metric_id"), "metric_id", "left_anti")
    untraced = roots.select(
        "metric_id", F.array(F.lit(UNKNOWN_SOURCE)).alias("sources"), F.lit(False).alias("mixed"),
        F.lit(True).alias("needs_review"), F.lit("UNKNOWN").alias("status"),
    )
    known = known.unionByName(cut_lineage(untraced))
    for level in range(1, top + 1):
        known = known.unionByName(cut_lineage(upstream_of(staged.filter(F.col("depth") == level))))
    # Nodes on a cycle use whatever of their input is resolved.
    stuck = staged.filter("cyclic")
    rest = cut_lineage(upstream_of(stuck))
    lost = stuck.select("metric_id").distinct().join(rest, "metric_id", "left_anti").select(
        "metric_id", F.array(F.lit(UNKNOWN_SOURCE)).alias("sources"), F.lit(False).alias("mixed"),
        F.lit(True).alias("needs_review"), F.lit("UNKNOWN").alias("status"),
    )
    return known.unionByName(rest).unionByName(lost).select(
        "metric_id",
        F.when(F.col("mixed"), MIXED_SOURCE).otherwise(F.col("sources")[0]).alias("source"),
        "status", "needs_review", F.array_join("sources", ", ").alias("base_sources"),
    )


def _any_label(path: str, pattern: str) -> Column:
    return F.exists(path, lambda x: normalize_label(x).rlike(pattern))


@dataclass(frozen=True)
class SourceRule:
    """Where a directly entered value comes from, by evidence; unset evidence is not asked for.

    ``sheet`` is compared as a normalised label, ``section``, ``row`` and ``column`` are patterns
    that a normalised label of the path must contain, ``coded`` asks for a procedure code.
    """

    source: str
    status: str
    needs_review: bool = False
    sheet: str | None = None
    section: str | None = None
    row: str | None = None
    column: str | None = None
    coded: bool | None = None

    def holds(self) -> Column:
        tests = [F.lit(True)]
        if self.sheet is not None:
            tests.append(normalize_label(F.col("sheet")) == normalize_label(F.lit(self.sheet)))
        tests += [
            _any_label(f"{part}_path", getattr(self, part)) for part in ("section", "row", "column") if getattr(self, part) is not None]
        if self.coded is not None:
            tests.append((F.coalesce("procedure_code", F.lit("")) != "") == F.lit(self.coded))
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


def classify_direct(cells: DataFrame, rules: Sequence[SourceRule]) -> DataFrame:
    """Adds ``source, status, needs_review`` to directly changed cells; the first rule that holds decides.

    A cell whose expression itself changed has no known source and needs review, whatever the
    rules say, and so has a cell that no rule covers.
    """
    unknown = F.struct(F.lit(UNKNOWN_SOURCE).alias("source"), F.lit("UNKNOWN").alias("status"), F.lit(True).alias("needs_review"))
    found = F.when(F.coalesce("expression_changed", F.lit(False)), unknown)
    for rule in rules:
        found = found.when(rule.holds(), F.struct(
            F.lit(rule.source).alias("source"), F.lit(rule.status).alias("status"), F.lit(rule.needs_review).alias("needs_review")))
    return cells.withColumn("__direct", found.otherwise(unknown)).select("*", "__direct.*").drop("__direct")


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Fan-in and fan-out of every node, from one aggregation over edge ends."""
    ends = F.array(
        F.struct(F.col("metric_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("dep_metric_id").alias("metric_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )
    return edges.select("metric_id", "dep_metric_id").distinct().select(F.inline(ends)).groupBy(
        "metric_id"
    ).agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def group_dependencies(edges: DataFrame, group) -> DataFrame:
    """Edge counts between groups of nodes; ``group`` maps an id column to its group."""
    return edges.groupBy(
        group(F.col("metric_id")).alias("group_id"), group(F.col("dep_metric_id")).alias("dep_group")
    ).agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("metric_id").alias("metrics"))
