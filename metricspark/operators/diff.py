"""Cell-level diffs of two snapshots, contract checks and range dependencies.

Cells are long rows ``(sheet, row_no, col_no, value_num, value_txt, formula)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.text import expression_key
from metricspark.operators.summary import ordered_positions
from metricspark.session import cut_lineage

CELL_KEY = ["sheet", "row_no", "col_no"]


def wide_to_cells(
    df: DataFrame, sheet: Column, row: Column, columns: Sequence[str]
) -> DataFrame:
    """One cell per filled column of a wide row; column numbers follow ``columns``."""
    types = dict(df.dtypes)
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")

    def cell(i: int, name: str) -> Column:
        is_number = types[name] in numeric or types[name].startswith("decimal")
        return F.struct(
            F.lit(i + 1).alias("col_no"),
            (F.col(name).cast("double") if is_number else F.lit(None).cast("double")).alias("value_num"),
            (F.lit(None).cast("string") if is_number else F.col(name).cast("string")).alias("value_txt"),
        )

    cells = F.array(*[F.when(F.col(c).isNotNull(), cell(i, c)) for i, c in enumerate(columns)])
    return df.select(sheet.alias("sheet"), row.alias("row_no"), F.inline(F.array_compact(cells)))


def _sides(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    b = before.select(*key, F.struct(*[c for c in before.columns if c not in key]).alias("b"))
    a = after.select(*key, F.struct(*[c for c in after.columns if c not in key]).alias("a"))
    return b.join(a, list(key), "full_outer")


def values_equal(a_num: Column, a_txt: Column, b_num: Column, b_txt: Column) -> Column:
    """Null, blank and ``""`` are one value; numbers agree within a tolerance."""
    a_text = F.nullif(a_txt, F.lit(""))
    b_text = F.nullif(b_txt, F.lit(""))
    numbers = F.coalesce(F.abs(a_num - b_num) < fixed.VALUE_TOLERANCE, a_num.isNull() & b_num.isNull())
    return numbers & a_text.eqNullSafe(b_text)


def block_digests(cells: DataFrame, block_rows: int) -> DataFrame:
    """``(sheet, block, cells, digest)`` of every block of rows, whatever the order of its cells.

    A digest is the sum of two hashes of every cell with its place, so cells that repeat count
    and partial sums combine before the shuffle.
    """
    parts = [F.col(c) for c in (*CELL_KEY, "value_num", "value_txt", "formula")]
    present = [c.isNull().cast("int") for c in parts]  # a null is not skipped
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts, *present).cast("decimal(38,0)")) for seed in (1, 2)]
    return cells.groupBy("sheet", F.floor(F.col("row_no") / block_rows).alias("block")).agg(
        F.count(F.lit(1)).alias("cells"), F.struct(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).alias("digest"))


def differing_blocks(before: DataFrame, after: DataFrame, block_rows: int) -> DataFrame:
    """``(sheet, block)`` of the blocks of common sheets that are not the same in both snapshots."""
    both = _sides(block_digests(before, block_rows), block_digests(after, block_rows), ["sheet", "block"])
    sheet = Window.partitionBy("sheet")  # one row per block
    known = both.select("*", F.bool_or(F.col("b").isNotNull()).over(sheet).alias("in_b"), F.bool_or(F.col("a").isNotNull()).over(sheet).alias("in_a"))
    return known.filter(F.col("in_b") & F.col("in_a") & ~F.col("b").eqNullSafe(F.col("a"))).select("sheet", "block")


def snapshot_diff_by_blocks(before: DataFrame, after: DataFrame, block_rows: int = 4096) -> DataFrame:
    """``snapshot_diff`` of snapshots that are mostly the same.

    Digests tell which blocks of rows differ; only their cells are shuffled and joined. What is
    compared by digest is all a cell holds, so a block with mere noise within the tolerance is
    joined and found equal there.
    """
    changed = cut_lineage(differing_blocks(before, after, block_rows))

    def those(cells: DataFrame) -> DataFrame:
        return cells.withColumn("block", F.floor(F.col("row_no") / block_rows)).join(changed, ["sheet", "block"], "left_semi").drop("block")

    return _value_changes(_sides(those(before), those(after), CELL_KEY))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed cells of the sheets both snapshots have, with the kind of change."""
    common = before.select("sheet").distinct().join(after.select("sheet").distinct(), "sheet")
    return _value_changes(_sides(before, after, CELL_KEY).join(common, "sheet", "left_semi"))


def _value_changes(both: DataFrame) -> DataFrame:
    """Cells of both sides that differ, and how."""
    b_formula, a_formula = (F.coalesce(F.col(f"{s}.formula"), F.lit("")) for s in "ba")
    kind = (
        F.when(b_formula != a_formula, "FORMULA_EXPRESSION_CHANGE")
        .when(a_formula != "", "FORMULA_RESULT_CHANGE").otherwise("DIRECT_INPUT_CHANGE")
    )
    equal = values_equal(F.col("b.value_num"), F.col("b.value_txt"),
                         F.col("a.value_num"), F.col("a.value_txt"))
    return both.filter(~equal).select(
        *CELL_KEY,
        F.col("b.value_num").alias("before_num"), F.col("a.value_num").alias("after_num"),
        F.col("b.value_txt").alias("before_txt"), F.col("a.value_txt").alias("after_txt"),
        kind.alias("change_kind"),
    )


def expression_diff(before: DataFrame, after: DataFrame, *, ignore_case: bool = False) -> DataFrame:
    """Expressions added, removed or modified on common sheets."""
    def with_formula(df: DataFrame) -> DataFrame:
        return df.filter(F.coalesce("formula", F.lit("")) != "").select(*CELL_KEY, "formula")

    common = before.select("sheet").distinct().join(after.select("sheet").distinct(), "sheet")
    both = _sides(with_formula(before), with_formula(after), CELL_KEY).join(common, "sheet", "left_semi")
    b, a = F.col("b.formula"), F.col("a.formula")
    same = expression_key(b) == expression_key(a) if ignore_case else b == a
    change = (
        F.when(b.isNull(), "FORMULA_ADDED").when(a.isNull(), "FORMULA_REMOVED")
        .when(~same, "FORMULA_MODIFIED")
    )
    return both.select(*CELL_KEY, b.alias("before_formula"), a.alias("after_formula"),
                       change.alias("change_type")).filter(F.col("change_type").isNotNull())


def sheet_structure(cells: DataFrame) -> DataFrame:
    return cells.groupBy("sheet").agg(
        F.max("row_no").alias("max_row"), F.max("col_no").alias("max_col"),
        F.count_if(F.coalesce("formula", F.lit("")) != "").alias("formulas"),
        F.count(F.lit(1)).alias("cells"),
    )


def structure_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sheets added, removed or changed in extent or counts, one row per sheet."""
    both = _sides(sheet_structure(before), sheet_structure(after), ["sheet"])
    measures = ("max_row", "max_col", "formulas", "cells")
    same = F.lit(True)
    for m in measures:
        same = same & (F.col(f"b.{m}") == F.col(f"a.{m}"))
    status = (
        F.when(F.col("b").isNull(), "ADDED").when(F.col("a").isNull(), "REMOVED")
        .when(same, "UNCHANGED").otherwise("CHANGED")
    )
    return both.select("sheet", status.alias("status"), *[
        F.col(f"{side}.{m}").alias(f"{m}_{name}")
        for m in measures for side, name in (("b", "before"), ("a", "after"))
    ])


def order_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Common sheets whose rank among the common sheets moved, from ``(sheet, position)``; equal positions go by name.

    Ranks come from ranges of the positions, so no task orders all sheets.
    """
    both = _sides(before, after, ["sheet"]).filter(F.col("b").isNotNull() & F.col("a").isNotNull()).select(
        "sheet", F.col("b.position").alias("before"), F.col("a.position").alias("after"))

    def ranked(side: str) -> DataFrame:
        return ordered_positions(both.select(side, "sheet"), [side, "sheet"]).select("sheet", F.col("position").cast("int").alias(f"rank_{side}"))

    return ranked("before").join(ranked("after"), "sheet").filter("rank_before <> rank_after")


def contract_check(contract: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared expressions that are missing or altered; undeclared cells are ignored."""
    found = actual.filter(F.coalesce("formula", F.lit("")) != "").select(
        *CELL_KEY, F.col("formula").alias("actual"))
    status = F.when(F.col("actual").isNull(), "MISSING").when(
        expression_key(F.col("actual")) != expression_key(F.col("formula")), "ALTERED")
    return (
        contract.select(*CELL_KEY, "formula").join(found, CELL_KEY, "left")
        .withColumn("violation", status).filter(F.col("violation").isNotNull())
    )


def _bin(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value.cast("bigint"), level)


def _level(start: str, end: str) -> Column:
    """Bit length of a range's extent: its size class."""
    return F.length(F.bin(F.col(end).cast("bigint") - F.col(start).cast("bigint")))


def range_edges(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Which cells lie in the ranges another cell reads, one edge per pair of cells.

    ``ranges``: ``target_sheet, target_row, target_col, ref_no, ref_sheet, row_start,
    row_end, col_start, col_end``. A range is filed under at most two bins of rows and two
    of columns, in the size class it fits in, and a cell under one bin per size class that
    any range has. The join is an equality however long a range is, and no range is
    spelled out cell by cell. A cell meets a range under one bin only, so edges of targets that
    read one range are final as they are found; only those of targets with several are grouped.
    """
    def bins(start: str, end: str, level: str) -> Column:
        return F.explode(F.array_distinct(F.array(
            _bin(F.col(start), F.col(level)), _bin(F.col(end), F.col(level)))))

    target = ["target_sheet", "target_row", "target_col"]
    several = ranges.groupBy(*target).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        *[F.col(c).alias(f"__{c}") for c in target], F.lit(True).alias("several"))
    known = ranges.join(several, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in target], "left").drop(*[f"__{c}" for c in target])
    filed = known.withColumns({
        "rows": _level("row_start", "row_end"), "cols": _level("col_start", "col_end"),
    }).withColumn("row_bin", bins("row_start", "row_end", "rows")).withColumn(
        "col_bin", bins("col_start", "col_end", "cols"))
    # the classes in use are pairs of bit lengths, so a few dozen at most
    classes = filed.agg(F.collect_set(F.struct("rows", "cols"))).scalar()
    spots = cells.select(*CELL_KEY).distinct().withColumn("classes", classes).select(*CELL_KEY, F.inline("classes")).withColumns({"row_bin": _bin(F.col("row_no"), F.col("rows")), "col_bin": _bin(F.col("col_no"), F.col("cols"))})
    single = (F.col("row_start") == F.col("row_end")) & (F.col("col_start") == F.col("col_end"))
    # What the estimate knows of a side is its file, not what the bins multiply it by: never broadcast.
    hits = spots.hint("merge").join(filed, [
        spots["sheet"] == filed["ref_sheet"],
        *[spots[c] == filed[c] for c in ("rows", "cols", "row_bin", "col_bin")],
        spots["row_no"].between(filed["row_start"], filed["row_end"]),
        spots["col_no"].between(filed["col_start"], filed["col_end"]),
    ]).filter(~(
        (F.col("sheet") == F.col("target_sheet")) & (F.col("row_no") == F.col("target_row"))
        & (F.col("col_no") == F.col("target_col"))
    ))
    kind = F.when(F.col("sheet") != F.col("target_sheet"), "cross_sheet").when(single, "cell").otherwise("range")
    pair = [*CELL_KEY, *target]
    edges = hits.select(*pair, "ref_no", "several", kind.alias("dependency_type"))
    return edges.filter("several IS NULL").select(*pair, "dependency_type").unionByName(
        edges.filter("several").groupBy(*pair).agg(F.min_by("dependency_type", "ref_no").alias("dependency_type")))


def merge_anchor(cells: DataFrame, merges: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Every cell of a merged range reads the value of its top left corner.

    ``merges``: ``sheet, r1, c1, r2, c2``, which do not overlap. Covered cells are blank in a
    grid of filled cells, so ``targets`` (``sheet, row_no, col_no``; default: the filled cells)
    says which cells to read; those outside merges that are not filled read as blank.
    """
    if targets is not None:
        values = cells.select(*CELL_KEY, "value_num", "value_txt")
        wanted = targets.select(*CELL_KEY).distinct().join(values, CELL_KEY, "left")
    else:
        wanted = cells
    as_ranges = merges.select(
        F.col("sheet").alias("target_sheet"), F.col("r1").alias("target_row"),
        F.col("c1").alias("target_col"), F.lit(0).alias("ref_no"), F.col("sheet").alias("ref_sheet"),
        F.col("r1").alias("row_start"), F.col("r2").alias("row_end"),
        F.col("c1").alias("col_start"), F.col("c2").alias("col_end"),
    )
    inside = range_edges(wanted, as_ranges).select(
        *CELL_KEY, F.col("target_row").alias("anchor_row"), F.col("target_col").alias("anchor_col"))
    anchors = cells.select(
        "sheet", F.col("row_no").alias("anchor_row"), F.col("col_no").alias("anchor_col"),
        F.col("value_num").alias("anchor_num"), F.col("value_txt").alias("anchor_txt"))
    return (
        wanted.join(inside, CELL_KEY, "left").join(anchors, ["sheet", "anchor_row", "anchor_col"], "left")
        .select(
            *CELL_KEY,
            F.coalesce("anchor_row", "row_no").alias("anchor_row"),
            F.coalesce("anchor_col", "col_no").alias("anchor_col"),
            F.when(F.col("anchor_row").isNull(), F.col("value_num")).otherwise(F.col("anchor_num"))
            .alias("value_num"),
            F.when(F.col("anchor_row").isNull(), F.col("value_txt")).otherwise(F.col("anchor_txt"))
            .alias("value_txt"),
        )
    )


def ordered_changes(before: DataFrame, after: DataFrame, k: int | None = None) -> DataFrame:
    """Numeric changes of cells both snapshots have, largest first; all of them unless ``k`` is given."""
    both = _sides(before, after, CELL_KEY).filter(F.col("b").isNotNull() & F.col("a").isNotNull())
    delta = F.col("a.value_num") - F.col("b.value_num")
    ordered = both.select(*CELL_KEY, delta.alias("delta")).orderBy(F.desc_nulls_last(F.abs("delta")), *CELL_KEY)
    return ordered if k is None else ordered.limit(k)
