"""Counting metrics whose catalog is a table: terms and predicates never come to the driver.

1. Every column of the facts that the catalog tests is cut down to what the catalog can see of a
   value: the text if some equality asks for it, its place among the numbers that are asked for
   (``2k`` between two of them, ``2k + 1`` on one), and the wildcards it matches. Records are
   grouped by these classes, so what follows depends on the catalog and not on the records.
2. Each term is filed under one predicate: an equality, else a wildcard, else a range of places,
   which falls into few nodes of a binary tree over the places. Classes are filed under all they
   could be asked for, so they meet their terms by equality; the other predicates are tested on
   the pairs that met.
3. A term with negations only is the same as signed terms with the negated predicates turned
   around (``not a`` counts all less ``a``), so it is filed like the others.

Terms with the same predicates are one body: all this is done once per body, and metrics take up
the counts of their bodies with their signs at the end.

Only the names of the columns, with how many numbers are asked of each, are read by the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark.functions import criteria as C
from metricspark.operators.layout import states_above
from metricspark.operators.summary import ordered_positions
from metricspark.session import cut_lineage

#: Tasks among which the grid of periods and metrics is dealt.
GRID_SALTS = 64
#: Patterns are filed under at most so many characters of their beginning.
STEM = 3
_MARK = "\uE000"
_PREDICATE = "struct<col:string,op:string,kind:string,at:int,text:string,pattern:bigint>"


def wildcard_pattern(body: Column) -> Column:
    """``*`` any run, ``?`` any one character, ``~`` makes the next wildcard literal; as a regular expression."""
    marked = F.regexp_replace(F.lower(body), r"~([*?~])", _MARK + "$1")
    quoted = F.regexp_replace(marked, rf"([^\p{{L}}\p{{N}}_\s*?{_MARK}])", r"\\$1")
    runs = F.regexp_replace(F.regexp_replace(quoted, rf"(?<!{_MARK})\*", ".*"), rf"(?<!{_MARK})\?", ".")
    return F.concat(F.lit(r"(?s)\A"), F.regexp_replace(runs, rf"{_MARK}\\?(.)", r"\\$1"), F.lit(r"\z"))


def parsed_predicates(predicates: DataFrame) -> DataFrame:
    """``metric_id, term_no, col, op, kind`` and the operand as ``number``, ``text`` or ``pattern`` with its ``stem``."""
    raw = F.concat(F.coalesce("op", F.lit("")), F.coalesce("value", F.lit("")))
    split = predicates.select("metric_id", "term_no", "col", raw.alias("raw")).withColumn(
        "op", F.regexp_extract("raw", rf"^({'|'.join(C.OPERATORS)}|)", 1)).withColumn("body", F.expr("substring(raw, length(op) + 1)"))
    number = C.to_number(F.col("body"), "string")
    kind = F.when(F.col("number").isNotNull(), "number").when(F.col("body").rlike("[*?~]"), "wildcard").otherwise("text")
    return split.withColumn("number", number).withColumn("kind", kind).select(
        "metric_id", "term_no", "col", "op", "kind", "raw", "number",
        F.when(F.col("kind") == "text", F.lower("body")).alias("text"),
        F.when(F.col("kind") == "wildcard", wildcard_pattern(F.col("body"))).alias("pattern"),
        F.when(F.col("kind") == "wildcard", F.substring(F.regexp_extract(F.lower("body"), r"^[^*?~]*", 0), 1, STEM)).alias("stem"))


def _checked(terms: DataFrame, parsed: DataFrame, facts: DataFrame) -> None:
    from metricspark.sources.catalog import CatalogError, TERM_SCHEMA, require

    require(terms, TERM_SCHEMA, ["metric_id", "term_no"])
    undefined = parsed.filter(F.col("op").isin("<", "<=", ">", ">=") & (F.col("kind") != "number")).select("raw").limit(5).collect()
    if undefined:
        raise C.UnsupportedCriterion(f"ordering tests against text: {[r.raw for r in undefined]}")
    loose = parsed.join(terms, ["metric_id", "term_no"], "left_anti").limit(5).collect()
    if loose:
        raise CatalogError(f"predicates without a term: {[(r.metric_id, r.term_no) for r in loose]}")


def _places(parsed: DataFrame) -> DataFrame:
    """``col, number, at``: the place of every number that is asked for among those of its column."""
    by_value = Window.partitionBy("col").orderBy("number")  # as many rows as the catalog has numbers
    return parsed.filter("kind = 'number'").select("col", "number").distinct().withColumn(
        "at", (2 * F.row_number().over(by_value) - 1).cast("int"))


def value_classes(values: DataFrame, parsed: DataFrame, places: DataFrame) -> DataFrame:
    """``col, raw, text, place, patterns`` of every value ``(col, raw, number)`` of the facts."""
    lower = values.withColumn("lower", F.lower(F.coalesce("raw", F.lit(""))))
    asked = parsed.filter("kind = 'text'").select("col", F.col("text").alias("lower"), F.col("text").alias("text")).distinct()
    numbers = values.filter("number IS NOT NULL").select("col", "number", F.lit(None).cast("int").alias("at")).unionByName(places)
    ordered = ordered_positions(numbers.groupBy("col", "number").agg(F.max("at").alias("at")), ["col", "number"]).select(
        "col", "number", "at", F.col("position").alias("row_no"))
    marks = ordered.filter("at IS NOT NULL").select("col", "row_no", F.col("at").alias("below"))
    placed = states_above(ordered, marks, ["col"], ["below"]).select(
        "col", "number", F.coalesce("at", F.col("below") + 1, F.lit(0)).cast("int").alias("place"))
    patterns = parsed.filter("kind = 'wildcard'").select("col", "stem", "pattern").distinct().withColumn("id", F.xxhash64("col", "pattern"))
    begun = lower.select("col", "lower").distinct().select(
        "col", "lower", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(STEM)), lambda n: F.substring("lower", F.lit(1), n)))).alias("stem"))
    matched = begun.join(patterns, ["col", "stem"]).filter(F.rlike("lower", F.col("pattern"))).groupBy("col", "lower").agg(
        F.sort_array(F.collect_set("id")).alias("patterns"))
    return lower.join(asked, ["col", "lower"], "left").join(placed, ["col", "number"], "left").join(matched, ["col", "lower"], "left").select(
        "col", "raw", "text", "place", "patterns")


def _positive(p: Column) -> Column:
    return (p["kind"] == "number") | p["op"].isin("", "=")


def _nodes(low: Column, high: Column) -> Column:
    """Nodes ``level:index`` of a binary tree over places that cover ``low`` to ``high``, both included."""
    def at(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), level)
        first, stop = F.floor((low + width - 1) / width), F.floor((high + 1) / width)
        odd = first % 2 == 1
        return F.array(
            F.when(odd & (first < stop), F.concat_ws(":", level, first)),
            F.when((stop % 2 == 1) & (first + F.when(odd, 1).otherwise(0) < stop), F.concat_ws(":", level, stop - 1)))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(31)), at)))


def _key(col: Column, kind: str, what: Column) -> Column:
    return F.concat_ws("\x1f", col, F.lit(kind), what)


def filed_terms(terms: DataFrame, parsed: DataFrame, places: DataFrame) -> DataFrame:
    """``metric_id, sign, preds, key``: terms under the keys they are found by; a null key is met by all records."""
    most = places.groupBy("col").agg(F.max("at").alias("most"))
    known = parsed.join(places, ["col", "number"], "left").withColumn("pattern", F.when(F.col("pattern").isNotNull(), F.xxhash64("col", "pattern")))
    preds = known.groupBy("metric_id", "term_no").agg(F.collect_list(F.struct("col", "op", "kind", "at", "text", "pattern")).alias("preds"))
    none = F.array().cast(f"array<{_PREDICATE}>")
    rows = terms.join(preds, ["metric_id", "term_no"], "left").select("metric_id", "sign", F.coalesce("preds", none).alias("preds"))
    # Negations only: all less those that hold, for every subset of the negated predicates.
    start = F.array(F.struct(F.col("sign").cast("bigint").alias("sign"), none.alias("preds")))
    subsets = F.aggregate("preds", start, lambda acc, p: F.concat(acc, F.transform(acc, lambda a: F.struct(
        (-a["sign"]).alias("sign"), F.concat(a["preds"], F.array(p.withField("op", F.lit("=")))).alias("preds")))))
    own = F.array(F.struct(F.col("sign").cast("bigint").alias("sign"), F.col("preds").alias("preds")))
    signed = rows.select("metric_id", F.inline(F.when(F.exists("preds", _positive), own).otherwise(subsets)))
    rank = F.transform("preds", lambda p, i: F.struct(
        F.when(~_positive(p), 9).when(p["op"].isin("", "=") & (p["kind"] != "wildcard"), 0).when(p["kind"] == "wildcard", 1).otherwise(2).alias("rank"),
        i.alias("i"), p.alias("p")))
    anchored = signed.withColumn("best", F.array_min(rank)).withColumn("a", F.col("best.p")).withColumn("col", F.col("a.col")).join(most, "col", "left")
    at, op, top = F.col("a.at"), F.col("a.op"), F.col("most") + 1
    spans = (
        F.when(op.isin("<", "<="), _nodes(F.lit(0), at - F.when(op == "<", 1).otherwise(0)))
        .when(op.isin(">", ">="), _nodes(at + F.when(op == ">", 1).otherwise(0), top))
        .otherwise(F.concat(_nodes(F.lit(0), at - 1), _nodes(at + 1, top))))
    keys = (
        F.when(F.col("best").isNull(), F.array(F.lit(None).cast("string")))
        .when(F.col("best.rank") == 0, F.array(F.when(F.col("a.kind") == "text", _key(F.col("col"), "t", F.col("a.text"))).otherwise(_key(F.col("col"), "n", at))))
        .when(F.col("best.rank") == 1, F.array(_key(F.col("col"), "w", F.col("a.pattern"))))
        .otherwise(F.transform(spans, lambda node: _key(F.col("col"), "d", node))))
    rest = F.filter("preds", lambda p, i: i != F.col("best.i"))
    return anchored.select("metric_id", "sign", F.when(F.col("best").isNull(), none).otherwise(rest).alias("preds"), F.explode(keys).alias("key"))


def term_bodies(terms: DataFrame, parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, bodies, asked)``: the body of every term, bodies as terms of their own, their predicates."""
    term, asks = ["metric_id", "term_no"], ["col", "op", "kind", "number", "text", "pattern", "stem"]
    same = F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct(*asks)))), 256)
    members = cut_lineage(terms.join(parsed.groupBy(*term).agg(same.alias("body")), term, "left").select(
        *term, "sign", F.coalesce("body", F.lit("")).alias("body")))
    one = cut_lineage(members.groupBy("body").agg(F.min(F.struct(*term)).alias("first")).select("first.*", "body"))
    bodies = one.select(F.col("body").alias("metric_id"), F.lit(1).alias("term_no"), F.lit(1).alias("sign"))
    asked = parsed.join(one, term).select(F.col("body").alias("metric_id"), F.lit(1).alias("term_no"), *asks)
    return members, bodies, cut_lineage(asked)


def _holds(p: Column, classes: str) -> Column:
    """Whether a predicate holds for the class of its column."""
    of = F.element_at(F.col(classes), p["col"])
    place, at, op = of["place"], p["at"], p["op"]
    number = reduce(lambda out, o: out.when(op == o, C.compare_numbers(place, o, at)), C.OPERATORS, F.when(op == "", place == at))
    equal = F.when(p["kind"] == "text", of["text"] == p["text"]).otherwise(F.array_contains(of["patterns"], p["pattern"]))
    equal = F.coalesce(equal, F.lit(False))
    return F.when(p["kind"] == "number", F.coalesce(number, F.lit(False))).otherwise(F.when(op == "<>", ~equal).otherwise(equal))


def _found_by(column: str, of: Column, numbers: int) -> list[Column]:
    """Arrays of the keys under which terms may be filed that ask for something this class has."""
    name = F.lit(column)
    keys = [
        F.array(F.when(of["text"].isNotNull(), _key(name, "t", of["text"])), F.when(of["place"].isNotNull(), _key(name, "n", of["place"]))),
        F.transform(F.coalesce(of["patterns"], F.array().cast("array<bigint>")), lambda w: _key(name, "w", w))]
    if numbers:
        levels = F.sequence(F.lit(0), F.lit((2 * numbers + 1).bit_length()))
        place = of["place"].cast("bigint")
        keys.append(F.when(place.isNotNull(), F.transform(levels, lambda j: _key(name, "d", F.concat_ws(":", j, F.call_function("shiftright", place, j))))))
    return keys


def metric_counts_from_tables(facts: DataFrame, terms: DataFrame, predicates: DataFrame, *, period: str = "period") -> DataFrame:
    """``(period, metric_id, value)``: every metric of every period, zeros included.

    ``terms`` and ``predicates`` are tables as ``sources.catalog`` describes them. They are checked
    first: repeated terms, predicates without a term, columns the facts lack and ordering tests
    against text stop the run. Blank values of the facts count as empty texts.
    """
    parsed = cut_lineage(parsed_predicates(predicates))
    _checked(terms, parsed, facts)
    # Names of columns only: no more than the facts have.
    used = {r.col: r.n for r in parsed.groupBy("col").agg(F.count_distinct("number").alias("n")).collect()}
    missing = sorted(set(used) - set(facts.columns))
    if missing:
        from metricspark.sources.catalog import CatalogError
        raise CatalogError(f"the facts have no columns {missing[:5]}")
    columns, dtypes = sorted(used), dict(facts.dtypes)
    places = cut_lineage(_places(parsed))
    raws = {c: f"__r{i}" for i, c in enumerate(columns)}
    grouped = facts.groupBy(F.col(period).alias("period"), *[F.col(f"`{c}`").alias(raws[c]) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    grouped = cut_lineage(grouped)
    members, bodies, asked = term_bodies(terms, parsed)
    filed = cut_lineage(filed_terms(bodies, asked, places))
    of_body = members.select("metric_id", "body", F.col("sign").cast("bigint").alias("own"))
    by_class = grouped.select("period", "n")
    if columns:
        values = grouped.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("col"), F.col(raws[c]).cast("string").alias("raw"), C.to_number(F.col(raws[c]), dtypes[c]).alias("number")) for c in columns]))).distinct()
        classes = cut_lineage(value_classes(values, parsed, places))
        joined = grouped
        for c in columns:
            own = classes.filter(F.col("col") == c).select(F.col("raw").alias("__raw"), F.struct("text", "place", "patterns").alias(f"__c_{raws[c]}"))
            joined = joined.join(own, joined[raws[c]].cast("string").eqNullSafe(own["__raw"])).drop("__raw", raws[c])
        sees = [f"__c_{raws[c]}" for c in columns]
        by_class = joined.groupBy("period", *sees).agg(F.sum("n").alias("n"))
        keys = [key for c, see in zip(columns, sees) for key in _found_by(c, F.col(see), used[c])]
        found_by = F.array_compact(F.flatten(F.array_compact(F.array(*keys))))
        seen = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(s) for s in sees]))
        asking = by_class.select("period", "n", seen.alias("classes"), F.explode(found_by).alias("key"))
        hits = asking.join(filed.filter("key IS NOT NULL"), "key").filter(F.forall("preds", lambda p: _holds(p, "classes")))
        counted = cut_lineage(hits.groupBy("period", F.col("metric_id").alias("body")).agg(F.sum(F.col("sign") * F.col("n")).alias("hits")))
        found = of_body.join(counted, "body").groupBy("period", "metric_id").agg(F.sum(F.col("own") * F.col("hits")).alias("hits"))
    else:
        found = None
    # Every metric next to every period: that grid is the result, dealt among tasks by the metric.
    whole = filed.filter("key IS NULL").groupBy(F.col("metric_id").alias("body")).agg(F.sum("sign").alias("whole"))
    whole = of_body.join(whole, "body").groupBy("metric_id").agg(F.sum(F.col("own") * F.col("whole")).alias("whole"))
    metrics = terms.select("metric_id").distinct().join(whole, "metric_id", "left").withColumn("salt", F.pmod(F.xxhash64("metric_id"), F.lit(GRID_SALTS)))
    periods = grouped.groupBy("period").agg(F.sum("n").alias("total")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID_SALTS - 1).cast("bigint"))))
    grid = periods.join(metrics, "salt").select(F.col("period").alias("__p"), F.col("metric_id").alias("__m"), (F.coalesce("whole", F.lit(0)) * F.col("total")).alias("base"))
    if found is None:
        return grid.select(F.col("__p").alias("period"), F.col("__m").alias("metric_id"), F.col("base").cast("bigint").alias("value"))
    return grid.join(found, grid["__p"].eqNullSafe(found["period"]) & (grid["__m"] == found["metric_id"]), "left").select(
        F.col("__p").alias("period"), F.col("__m").alias("metric_id"), (F.col("base") + F.coalesce("hits", F.lit(0))).cast("bigint").alias("value"))
