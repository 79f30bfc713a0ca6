"""Context of a cell in a grid: sections, groups, labels to the left and header bands.

Cells are long rows ``(sheet, row_no, col_no, text, number, bold)``, one per filled cell.
A sheet may hold a large part of all cells, so nothing is ordered over a whole sheet or
column: order only matters inside blocks of rows, and blocks hand over what they carry.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark import fixed_values as fixed
from metricspark.functions.labels import normal_path
from metricspark.functions.text import ANY_CASE, normalize_label, signature
from metricspark.session import cut_lineage

BLOCK_ROWS = 4096
CELL = ["sheet", "row_no", "col_no"]
_SPREAD, _WIDE_TEXTS, _LABEL_COLUMNS = 15, 4, 4


def nearest_above(points: DataFrame, marks: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """For each point the payload of the last mark strictly above it, as column ``name``.

    ``marks``: ``(*keys, row_no, payload)``.
    """
    return states_above(points, marks.withColumnRenamed("payload", name), keys, [name])


def spread_merges(cells: DataFrame, merges: DataFrame | None) -> DataFrame:
    """The grid with every cell of a merged range reading its top left corner.

    ``merges``: ``sheet, r1, c1, r2, c2``, which do not overlap. Covered cells are blank in a grid of
    filled cells and are added; what they hold themselves is hidden. A range whose corner is blank
    hides what it covers. The corner is found by equality, and a range is spelled out by a generator
    in the task that has its corner.
    """
    if merges is None:
        return cells
    corner = cells.withColumnsRenamed({"row_no": "r1", "col_no": "c1"})

    def covered(ranges: DataFrame) -> DataFrame:
        rows = ranges.withColumn("row_no", F.explode(F.sequence("r1", "r2")))
        return rows.withColumn("col_no", F.explode(F.sequence("c1", "c2")))

    kept = cells.join(covered(merges).select(*CELL), CELL, "left_anti")
    return kept.unionByName(covered(merges.join(corner, ["sheet", "r1", "c1"])).select(*cells.columns))


def _flagged(cells: DataFrame, last_rows: DataFrame | None = None) -> DataFrame:
    """Cells with what their row is, all but whether it is a section: that takes the whole sheet."""
    row = Window.partitionBy("sheet", "row_no")
    by_col = row.orderBy("col_no")
    repeat = (F.lag("text").over(by_col) == F.col("text")) & (F.lag("col_no").over(by_col) == F.col("col_no") - 1)
    fresh = F.col("text").isNotNull() & ~F.coalesce(repeat, F.lit(False))
    named = cells.withColumn("__col", F.when(fresh, F.col("col_no")))
    first = F.min_by(F.struct("text", "bold"), "__col").over(row)
    spread = named.withColumns({
        "n": F.count("__col").over(row), "n_distinct": F.size(F.collect_set("text").over(row)),
        "first_col": F.min("__col").over(row), "last_col": F.max("__col").over(row), "first": first,
    }).withColumns({"label": F.col("first.text"), "wide": (F.col("n") >= _WIDE_TEXTS) | (F.col("last_col") - F.col("first_col") >= _SPREAD)})
    titled = (~F.col("wide") & (F.col("first_col") <= _LABEL_COLUMNS) & (F.col("n_distinct") <= 2) & F.col("first.bold"))
    if last_rows is not None:  # below the last filled row, covered cells make no header
        spread = spread.join(last_rows, "sheet")
        titled = titled & (F.col("row_no") <= F.col("last_row"))
    keyword = titled & F.col("label").rlike(ANY_CASE + fixed.SECTION_KEYWORD)
    return spread.withColumn("keyword", F.coalesce(keyword, F.lit(False))).withColumn("titled", F.coalesce(
        F.col("keyword") | (titled & (F.col("first_col") >= 2) & (F.length("label") >= 4)), F.lit(False)))


def _sectioned(flagged: DataFrame, keyed: DataFrame) -> DataFrame:
    """Adds ``section`` and ``grouping``; ``keyed`` says which sheets have a row with the keyword."""
    return flagged.join(keyed, "sheet").withColumns({
        "section": F.when(F.col("has_keyword"), F.col("keyword")).otherwise(F.col("titled")),
        "grouping": F.col("has_keyword") & F.col("titled") & ~F.col("keyword")}).drop("has_keyword")


def _keyed(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("sheet").agg(F.bool_or("keyword").alias("has_keyword"))


def _last_rows(cells: DataFrame, merges: DataFrame | None) -> DataFrame | None:
    return None if merges is None else cells.groupBy("sheet").agg(F.max("row_no").alias("last_row"))


def header_rows(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """``(sheet, row_no, first_col, label, wide, section, grouping)`` of rows with text.

    With ``merges`` (see ``spread_merges``) a row also has the texts of ranges that reach into it.
    """
    flagged = _flagged(spread_merges(cells, merges), _last_rows(cells, merges))
    if merges is not None:
        flagged = flagged.filter("row_no <= last_row")
    rows = flagged.filter("first_col IS NOT NULL").groupBy("sheet", "row_no").agg(
        *[F.first(c).alias(c) for c in ("first_col", "label", "wide", "keyword", "titled")])
    return _sectioned(rows, _keyed(rows)).select("sheet", "row_no", "first_col", "label", "wide", "section", "grouping")


def _parents(sections: DataFrame) -> DataFrame:
    """``(sheet, row_no, parent)``: the label of the nearest section, if at most two rows above."""
    return sections.select("sheet", "row_no", "label", F.explode(F.array(F.lit(1), F.lit(2))).alias("off")).groupBy(
        "sheet", (F.col("row_no") + F.col("off")).alias("row_no")).agg(F.min_by("label", "off").alias("parent"))


def states_above(points: DataFrame, marks: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """For each point, per name, the last value strictly above it that is not null.

    ``marks``: ``(*keys, row_no, *names)``. One scan follows all names: inside blocks of rows, and
    over the last values of the blocks.
    """
    block = F.floor(F.col("row_no") / BLOCK_ROWS).alias("__block")
    ends = marks.groupBy(*keys, block).agg(*[
        F.max_by(n, F.when(F.col(n).isNotNull(), F.col("row_no"))).alias(n) for n in names])
    asked = points.select(*keys, block).distinct()
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    steps = ends.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "__block").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])
    carried = steps.select(*keys, "__block", *[F.last(n, ignorenulls=True).over(earlier).alias(f"__carry_{n}") for n in names])
    # At one row a point comes before a mark, which keeps "above" strict.
    events = points.withColumn("__mark", F.lit(0)).unionByName(
        marks.select(*keys, "row_no", *names, F.lit(1).alias("__mark")), allowMissingColumns=True).withColumn("__block", F.floor(F.col("row_no") / BLOCK_ROWS))
    inside = Window.partitionBy(*keys, "__block").orderBy("row_no", "__mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = events.select("*", *[F.last(n, ignorenulls=True).over(inside).alias(f"__own_{n}") for n in names]).filter("__mark = 0")
    return own.join(carried, [*keys, "__block"]).select(
        *points.columns, *[F.coalesce(f"__own_{n}", f"__carry_{n}").alias(n) for n in names])


def _header_marks(headers: DataFrame) -> DataFrame:
    """``inner`` (section with its parent) and ``grp`` as marks, from ``sheet, row_no, label, section, grouping``."""
    named = headers.filter("section OR grouping")
    with_parent = named.join(_parents(named.filter("section")), ["sheet", "row_no"], "left")
    return with_parent.select(
        "sheet", "row_no", F.when(F.col("section"), F.struct("row_no", "label", "parent")).alias("inner"),
        F.when(F.col("grouping"), F.struct("row_no", "label")).alias("grp"))


def header_context(points: DataFrame, headers: DataFrame) -> DataFrame:
    """Adds ``inner`` (nearest section above, with its parent), ``grp`` (nearest group) and ``is_header``.

    Headers made with merges give the context of a grid with merges.
    """
    found = states_above(points, _header_marks(headers), ["sheet"], ["inner", "grp"])
    own = headers.filter("section or grouping").select("sheet", "row_no", F.lit(True).alias("is_header"))
    return found.join(own, ["sheet", "row_no"], "left").withColumn("is_header", F.coalesce("is_header", F.lit(False)))


def _left_labels(events: DataFrame) -> DataFrame:
    """Targets with the texts left of them in their row: all without repeats, the first one's column, numbers between them.

    ``events`` are the cells of a row and its targets (``target``), told apart at one column by their order.
    """
    by_col = Window.partitionBy("sheet", "row_no").orderBy("col_no", F.desc("target"))
    before, upto = by_col.rowsBetween(Window.unboundedPreceding, -1), by_col.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    differs = F.col("text").isNotNull() & ~F.col("text").eqNullSafe(F.last("text", ignorenulls=True).over(before))
    seen = F.min(F.when(F.col("text").isNotNull(), F.col("col_no"))).over(upto)
    marked = events.withColumns({"__fresh": F.when(differs, F.col("text")), "__first": seen}).withColumn(
        "__late", F.col("number").isNotNull() & F.col("text").isNull() & F.col("__first").isNotNull())
    mixed = F.col("text").isNotNull() & F.coalesce(F.max("__late").over(before), F.lit(False))
    return marked.withColumn("__mixed", mixed).select(
        "*", F.when(F.col("target"), F.collect_list("__fresh").over(upto)).alias("leaf"),
        F.max("__mixed").over(upto).alias("mixed")).filter("target").select(
        "sheet", "row_no", "col_no", "leaf", F.coalesce("__first", F.lit(2)).alias("label_col"), "mixed")


def _bands(texts: DataFrame) -> DataFrame:
    """Texts of header bands with ``start`` (whether a band begins here) and ``level`` (whether its label does).

    The text above is found by its row, so a band may be as long as the sheet.
    """
    above = texts.select("sheet", "col_no", (F.col("row_no") + 1).alias("row_no"), F.col("text").alias("up"))
    return texts.join(above, ["sheet", "col_no", "row_no"], "left").withColumns({
        "start": F.col("up").isNull(), "level": ~F.col("up").eqNullSafe(F.col("text"))})


def _gap_notes(bands: DataFrame, cells: DataFrame) -> DataFrame:
    """Bands with an empty cell right above them and a text beside it: their context is ambiguous."""
    gap = bands.filter("start AND row_no > 1").select("sheet", "col_no", F.col("row_no").alias("start"), (F.col("row_no") - 1).alias("gap_row"))
    # What the row of the gap says about a column: it is filled, a section, or has a text beside it.
    around = cells.filter("text IS NOT NULL OR number IS NOT NULL").select(
        "sheet", F.col("row_no").alias("gap_row"), F.inline(F.array(
            F.struct(F.col("col_no").alias("col_no"), F.lit(True).alias("filled"), F.lit(False).alias("beside")),
            *[F.struct((F.col("col_no") + d).alias("col_no"), F.lit(False).alias("filled"), F.col("text").isNotNull().alias("beside")) for d in (-1, 1)])))
    facts = around.groupBy("sheet", "gap_row", "col_no").agg(F.bool_or("filled").alias("filled"), F.bool_or("beside").alias("beside"))
    sections = cells.filter("section").select("sheet", F.col("row_no").alias("gap_row")).distinct()
    return gap.join(facts.filter("beside AND NOT filled"), ["sheet", "gap_row", "col_no"], "left_semi").join(
        sections, ["sheet", "gap_row"], "left_anti").select("sheet", "col_no", "start", F.lit(True).alias("gap_note"))


def cell_labels(cells: DataFrame, targets: DataFrame, levels: int | None = None, merges: DataFrame | None = None) -> DataFrame:
    """Section, row and column labels of each target, with the status of its context.

    Row and column labels have all their levels, or the first ``levels``. With ``merges`` every cell
    of a merged range reads its corner, so each column under a merged header has its label.

    The cells are sorted once by row, where a row's kind and the labels to the left are found, and
    stored. Two scans over that table then follow what lies above: sections and groups by sheet,
    group texts and header bands by column.
    """
    def cut(labels: Column) -> Column:
        return labels if levels is None else F.slice(labels, 1, levels)

    grid = spread_merges(cells.select(*CELL, "text", "number", "bold"), merges)
    flagged = _flagged(grid, _last_rows(cells, merges))
    asked = targets.select(*CELL).distinct().withColumn("target", F.lit(True))
    events = flagged.withColumn("target", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    stored = cut_lineage(events.select(*CELL, "text", "number", "label", "first_col", "wide", "keyword", "titled", "target"))
    known = _sectioned(stored.filter("NOT target"), _keyed(stored.filter("NOT target")))
    headers = known.filter((F.col("section") | F.col("grouping")) & (F.col("col_no") == F.col("first_col")))
    placed = header_context(_left_labels(stored.select(*CELL, "text", "number", "target")), headers)

    texts = known.filter("text IS NOT NULL AND NOT section").select(*CELL, "text", "wide")
    bands = cut_lineage(_bands(texts))
    shape = F.col("text").rlike(ANY_CASE + fixed.GROUP_HEADER) & ~F.col("wide")
    # Bands and group texts are followed by column in one scan: a target asks once in its own column, once in that of its row's label.
    marks = bands.select(
        "sheet", "col_no", "row_no", F.struct("row_no").alias("near"), F.when(F.col("start"), F.col("row_no")).alias("start"),
        F.when(shape, F.struct("row_no", F.col("text").alias("label"))).alias("shaped"))
    twice = placed.select("*", F.inline(F.array(
        F.struct(F.col("col_no").alias("__at"), F.lit("band").alias("__ask")), F.struct(F.col("label_col").alias("__at"), F.lit("group").alias("__ask")))))
    spots = twice.withColumnRenamed("col_no", "__col").withColumnRenamed("__at", "col_no")
    found = states_above(spots, marks, ["sheet", "col_no"], ["near", "start", "shaped"])
    facts = [c for c in placed.columns if c not in CELL]
    joined = found.groupBy("sheet", "row_no", F.col("__col").alias("col_no")).agg(
        *[F.first(c).alias(c) for c in facts],
        *[F.first(F.when(F.col("__ask") == ask, F.col(c)), ignorenulls=True).alias(c) for c, ask in (("near", "band"), ("start", "band"), ("shaped", "group"))])
    of_band = states_above(
        bands.filter("level").select("sheet", "col_no", (F.col("row_no") + 1).alias("row_no"), "text"), marks, ["sheet", "col_no"], ["start"])
    by_row = Window.partitionBy("sheet", "col_no", "start").orderBy("row_no")
    kept = of_band if levels is None else of_band.withColumn("n", F.row_number().over(by_row)).filter(F.col("n") <= levels)
    labels = kept.groupBy("sheet", "col_no", "start").agg(
        F.sort_array(F.collect_list(F.struct((F.col("row_no") - 1).alias("row_no"), "text"))).alias("band"))
    labelled = joined.join(labels, ["sheet", "col_no", "start"], "left").join(_gap_notes(bands, known), ["sheet", "col_no", "start"], "left")
    floor = F.coalesce(F.col("inner.row_no"), F.lit(0))
    # A section between the text and the cell hides the band.
    visible = F.coalesce(F.col("near.row_no") > floor, F.lit(False))
    shown = F.transform(F.filter("band", lambda x: x["row_no"] <= F.col("near.row_no")), lambda x: x["text"])
    none = F.array().cast("array<string>")
    column = F.when(visible, F.coalesce(shown, none)).otherwise(none)
    nearest = F.array_max(F.filter(F.array(
        F.struct(F.col("grp.row_no").alias("row_no"), F.lit(1).alias("rank"), F.col("grp.label").alias("label")),
        F.struct(F.col("shaped.row_no").alias("row_no"), F.lit(0).alias("rank"), F.col("shaped.label").alias("label")),
    ), lambda x: x["row_no"] > floor))
    group = F.when(F.col("is_header") | nearest.isNull(), none).otherwise(F.array(nearest["label"]))
    section = F.array_compact(F.array(F.col("inner.parent"), F.col("inner.label")))
    noted = F.col("mixed") | (visible & F.coalesce("gap_note", F.lit(False)))
    sizes = F.size("section_labels") + F.size("row_labels") + F.size("column_labels")
    return labelled.select(
        *CELL, section.alias("section_labels"), cut(F.concat(group, "leaf")).alias("row_labels"),
        cut(column).alias("column_labels"), noted.alias("noted"),
    ).withColumn(
        "context_status",
        F.when(sizes == 0, "NO_CONTEXT").when(F.col("noted"), "AMBIGUOUS")
        .when((F.size("row_labels") > 0) & (F.size("column_labels") > 0), "COMPLETE").otherwise("PARTIAL"),
    ).withColumn(
        "signature", F.concat_ws(" :: ", normalize_label(F.col("sheet")), signature(
            *[normal_path(F.col(f"{p}_labels")) for p in ("section", "row", "column")]))
    ).drop("noted")


def cell_roles(cells: DataFrame) -> DataFrame:
    """Kind and role of a cell from evidence; doubt is never turned into an input slot.

    Needs ``formula, value_num, value_txt, context_status, protected, locked``.
    """
    text = F.trim("value_txt")
    whole = F.when(F.col("value_num") == F.floor("value_num"), F.col("value_num").cast("bigint").cast("string"))
    code_like = text.rlike(r"^\d{4,9}$") | F.coalesce(F.length(whole).between(4, 9), F.lit(False))
    wordy = (F.length(text) > 3) & ~F.translate(text, ".,", "").rlike(r"^\d+$")
    filled = F.col("value_num").isNotNull() | (F.coalesce(F.col("value_txt"), F.lit("")) != "")
    in_grid = F.col("context_status") == "COMPLETE"
    beside = in_grid | F.col("context_status").isin("PARTIAL", "AMBIGUOUS")
    kind = (
        F.when(F.coalesce("formula", F.lit("")) != "", "FORMULA_TARGET")
        .when(F.coalesce(code_like, F.lit(False)) | F.coalesce(wordy, F.lit(False)), "STRUCTURAL")
        .when(F.col("protected") & (F.col("locked") == False),  # noqa: E712
              F.when(in_grid, "DIRECT_INPUT_TARGET").otherwise("UNKNOWN"))
        .when(F.col("protected"), F.when(beside, "STRUCTURAL").otherwise("UNKNOWN"))
        .when(in_grid & ~filled, "UNKNOWN")
        .when(beside & filled, "STRUCTURAL").otherwise("UNKNOWN")
    )
    role = (
        F.when(F.col("target_kind") == "DIRECT_INPUT_TARGET", "INPUT_TARGET")
        .when(F.col("target_kind") == "FORMULA_TARGET", "DERIVED_TARGET").otherwise(F.col("target_kind"))
    )
    return cells.withColumn("target_kind", kind).withColumn("target_role", role)
