"""Strict rules and categories kept as a table: any number of them, never one expression each.

1. Records are reduced to the distinct combinations of the tested fields, and those to the distinct
   texts of each field; rules to their distinct tests ``(field, op, value)``.
2. Every test is filed under one anchor that a text must hold to pass it: an equality under its
   value, a beginning under its first ``GRAM`` characters, a pattern under the rarest of its pieces
   of ``GRAM`` characters, a regular expression under the rarest piece of a literal it cannot do
   without. Texts are filed under all their pieces, so both meet by equality; the test itself is
   then made on the pairs that met. A test without any literal meets every distinct text.
3. Conditions that ask the same are one condition and rules with the same conditions one body with
   several ids. Every combination gets the conditions that its texts hold.
4. A body is filed under its condition that fewest combinations hold. A combination meets the bodies of
   the conditions it holds, and their other conditions are looked up in the same row.
5. Ids are far more than hits: each task gets the ids of the bodies it needs once, next to its hits and
   records, and puts lists together in place, so no list is shuffled for every combination it belongs to.
   Where combinations are few against the records, lists are made for them and joined on.

The driver reads the names of fields and operators and the lengths of anchors, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricspark.functions.text import casefold_text, normalize_text
from metricspark.operators.classify import UnknownOperator
from metricspark.session import cut_lineage

#: Characters of an anchor; shorter values are filed whole.
GRAM = 4
#: Bodies under one condition come in lists of about this many.
BODY_LIST = 256
#: Records of one combination are dealt over places of about this many.
CLASS_BLOCK = 4096
#: With so many records a combination on average, lists are made per combination and joined on.
CLASS_RECORDS = 8
OPERATORS = ("eq", "contains", "starts_with", "regex")
_TEST = ["field", "op", "value"]


def required_literal(pattern: Column) -> Column:
    """The longest literal that every match of a regular expression holds, ``""`` if that is not plain to see.

    Groups, alternatives, escapes and nested classes are not looked into. Classes, anchors and
    single characters with a quantifier that allows none of them part the literals.
    """
    cut = F.regexp_replace(pattern, r"\[\^?\]?[^\[\]]*\]", "\x00")
    cut = F.regexp_replace(cut, r"[^?*{}](?:[?*]|\{[^{}]*\})", "\x00")
    runs = F.split(cut, "[\x00.^$+?*{}]")
    longest = F.reduce(runs, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    nested = pattern.rlike(r"[|()\\]|\[[^\]]*\[|&&")
    return F.when(nested | cut.contains("[") | cut.contains("]"), "").otherwise(longest)


def _pieces(text: Column, length: Column) -> Column:
    """The different pieces of so many characters of a text; the empty piece for 0."""
    last = F.length(text) - length + 1
    return F.when(length == 0, F.array(F.lit(""))).when(last < 1, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, length))))


def _passes(text: Column, op: Column, value: Column) -> Column:
    return F.when(op == "contains", F.contains(text, value)).when(op == "starts_with", F.startswith(text, value)).when(
        op == "regex", F.regexp_like(text, value)).otherwise(text == value)


def _anchored(tests: DataFrame, texts: DataFrame) -> DataFrame:
    """``field, op, value, kind, anchor``: every test with the one piece it is filed under."""
    short = F.least(F.length("literal"), F.lit(GRAM))
    literal = F.when(F.col("op") == "regex", required_literal(F.col("value"))).otherwise(F.col("value"))
    with_literal = tests.withColumn("literal", literal)
    whole = with_literal.filter("op = 'eq'").select(*_TEST, F.lit("eq").alias("kind"), F.col("value").alias("anchor"))
    start = with_literal.filter("op = 'starts_with'").select(
        *_TEST, F.lit("start").alias("kind"), F.substring("literal", 1, GRAM).alias("anchor"))
    inside = with_literal.filter("op IN ('contains', 'regex')").select(*_TEST, F.explode(_pieces(F.col("literal"), short)).alias("anchor"))
    asked = inside.select("field", "anchor").distinct()
    common = _filed(texts, asked.withColumn("kind", F.lit("piece"))).join(asked, ["field", "anchor"], "left_semi").groupBy(
        "field", "anchor").agg(F.count(F.lit(1)).alias("texts"))
    rarest = inside.join(common, ["field", "anchor"], "left").groupBy(*_TEST).agg(
        F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), F.col("anchor"))).alias("best"))
    return whole.unionByName(start).unionByName(rarest.select(*_TEST, F.lit("piece").alias("kind"), F.col("best.anchor").alias("anchor")))


def _filed(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """``kind, anchor`` and the columns of ``texts``: every text under all anchors of the lengths that its field is asked for."""
    lengths = {(r["field"], r["kind"], r["n"]) for r in anchors.filter("kind <> 'eq'").select(
        "field", "kind", F.least(F.length("anchor"), F.lit(GRAM)).alias("n")).distinct().collect()}
    parts = [texts.select("*", F.lit("eq").alias("kind"), F.col("text").alias("anchor"))]
    for field, kind, n in sorted(lengths):
        text = F.col("text")
        own = texts.filter((F.col("field") == field) & (F.length(text) >= n))
        anchor = F.explode(_pieces(text, F.lit(n))) if kind == "piece" else F.substring(text, 1, n)
        parts.append(own.select("*", F.lit(kind).alias("kind"), anchor.alias("anchor")))
    return reduce(DataFrame.unionByName, parts)


def passed_tests(texts: DataFrame, tests: DataFrame) -> DataFrame:
    """``text_no, test_no`` of all distinct texts (``field, text, text_no``) and the tests (``field, op, value, test_no``) they pass."""
    anchors = cut_lineage(_anchored(tests, texts).join(tests, _TEST))
    met = _filed(texts, anchors).join(anchors, ["field", "kind", "anchor"])
    return met.filter(_passes(F.col("text"), F.col("op"), F.col("value"))).select("text_no", "test_no")


def rule_hits(df: DataFrame, rules: DataFrame, *, text: Callable[[Column], Column] = normalize_text, empty: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(classes, hits, members)``: distinct combinations of tested fields, the bodies each one meets, the rules of a body.

    ``rules`` has the columns ``rule_id, condition_no, field, op, value``. Rows of one condition are
    alternatives, all conditions of a rule must hold; a condition is about one field. Texts and values
    are compared in the form that ``text`` gives, but a regular expression is taken as it is; ``empty``
    says whether an empty value is a test at all. Rows of rules that repeat count once; a null value
    counts as empty text, and so does a null field of a record. An operator or a field that is not known is an error.
    ``classes`` has the fields as ``__field``, the key ``class``, its number and its ``records``; ``hits`` has
    ``class_no, body`` and ``members`` has ``body, rule_id``.
    """
    known = {(r["field"], r["op"]) for r in rules.select("field", "op").distinct().collect()}
    for field, op in sorted(known, key=str):
        if op not in OPERATORS:
            raise UnknownOperator(str(op))
        if field not in df.columns:
            raise ValueError(f"no such field: {field}")
    fields = sorted({field for field, _ in known})
    raw = F.coalesce(F.col("value").cast("string"), F.lit(""))
    asked = rules.select("rule_id", "condition_no", "field", "op", F.when(F.col("op") == "regex", raw).otherwise(text(raw)).alias("value")).distinct()
    asked = asked if empty else asked.filter("value <> ''")
    # a rule with a condition that has no test left is met by nothing
    whole = rules.groupBy("rule_id").agg(F.countDistinct("condition_no").alias("conditions"))
    left = asked.groupBy("rule_id").agg(F.countDistinct("condition_no").alias("conditions"))
    asked = cut_lineage(asked.join(left.join(whole, ["rule_id", "conditions"]), "rule_id").drop("conditions"))
    tests, bodies, members = _bodies(asked)
    texts_of = class_texts(df, fields, text)
    classes = cut_lineage(texts_of.groupBy(*[F.col(f"`{c}`") for c in texts_of.columns]).agg(
        F.count(F.lit(1)).alias("records")).withColumn("class_no", F.monotonically_increasing_id()))
    if not fields:
        return classes, classes.select("class_no", F.lit(0).cast("bigint").alias("body")).limit(0), members
    held = cut_lineage(_held(classes, fields, tests))
    return classes, cut_lineage(_met(held, bodies)), members


def _held(classes: DataFrame, fields: list[str], tests: DataFrame) -> DataFrame:
    """``class_no, held``: the conditions that each combination holds, from ``cond, field, op, value``."""
    long = classes.unpivot("class_no", [f"__{f}" for f in fields], "field", "text").withColumn("field", F.expr("substring(field, 3)"))
    texts = cut_lineage(long.select("field", "text").distinct().withColumn("text_no", F.monotonically_increasing_id()))
    numbered = cut_lineage(tests.select(*_TEST).distinct().withColumn("test_no", F.monotonically_increasing_id()))
    passed = passed_tests(texts, numbered).join(tests.join(numbered, _TEST).select("test_no", "cond"), "test_no")
    by_text = cut_lineage(texts.join(passed.groupBy("text_no").agg(F.collect_set("cond").alias("conds")), "text_no").drop("text_no"))
    rows = classes.select("class_no", *[F.col(f"`__{f}`").alias(f"text_{i}") for i, f in enumerate(fields)])
    for i, f in enumerate(fields):
        own = by_text.filter(F.col("field") == f).select(F.col("text").alias(f"text_{i}"), F.col("conds").alias(f"conds_{i}"))
        rows = rows.join(own, f"text_{i}", "left")
    none = F.array().cast("array<bigint>")
    return rows.select("class_no", F.concat(*[F.coalesce(f"conds_{i}", none) for i in range(len(fields))]).alias("held")).filter(F.size("held") > 0)


def _met(held: DataFrame, bodies: DataFrame) -> DataFrame:
    """``class_no, body``: the combinations that hold all conditions of a body (``body, cond, conds``)."""
    cost = held.select(F.explode("held").alias("cond")).groupBy("cond").agg(F.count(F.lit(1)).alias("cost"))
    # a body with a condition that nothing holds has no hit
    ordered = bodies.join(cost, "cond").groupBy("body", "conds").agg(
        F.sort_array(F.collect_list(F.struct("cost", "cond"))).alias("all")).filter(F.size("all") == F.col("conds"))
    conds = F.col("all.cond")
    filed = ordered.select("body", conds[0].alias("lead"), F.slice(conds, 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("others"))
    lists = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lead")) / BODY_LIST)
    led = filed.withColumn("list", F.pmod(F.xxhash64("body"), lists)).groupBy("lead", "list").agg(
        F.collect_list(F.struct("body", "others")).alias("bodies"))
    whole = F.filter("bodies", lambda b: F.forall(b["others"], lambda c: F.array_contains(F.col("held"), c)))
    return held.select("class_no", "held", F.explode("held").alias("lead")).join(led, "lead").select(
        "class_no", F.explode(whole.getField("body")).alias("body"))


def _sums(*columns: str) -> list[Column]:
    """The size of a set of rows and two sums of hashes: what tells sets apart without gathering them."""
    return [F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(20,0)")).alias(f"h{seed}") for seed in (1, 2)]]


def _bodies(asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``cond, field, op, value`` of all conditions, ``body, cond, conds`` of all bodies, and ``body, rule_id`` of all rules.

    Conditions are one if their tests are the same, rules have one body if their conditions are. Sets are compared
    by their sizes and two sums of hashes, so no rule is gathered in one place.
    """
    same = ["n", "h1", "h2"]
    conditions = asked.groupBy("rule_id", "condition_no").agg(*_sums(*_TEST))
    conds = cut_lineage(conditions.groupBy(*same).agg(F.min(F.struct("rule_id", "condition_no")).alias("one")).withColumn(
        "cond", F.monotonically_increasing_id()))
    tests = cut_lineage(asked.join(conds.select("one.*", "cond"), ["rule_id", "condition_no"]).select("cond", *_TEST))
    of_rule = cut_lineage(conditions.join(conds, same).select("rule_id", "cond").distinct())
    rules = cut_lineage(of_rule.groupBy("rule_id").agg(*_sums("cond")))
    bodies = cut_lineage(rules.groupBy(*same).agg(F.min("rule_id").alias("rule_id")).withColumn("body", F.monotonically_increasing_id()))
    members = rules.join(bodies.drop("rule_id"), same).select("body", "rule_id")
    return tests, cut_lineage(bodies.join(of_rule, "rule_id").select("body", "cond", F.col("n").alias("conds"))), members


def class_texts(df: DataFrame, fields: list[str], text: Callable[[Column], Column]) -> DataFrame:
    """The compared form of the fields of every record, and the key of their combination."""
    forms = [text(F.col(f"`{f}`")).alias(f"__{f}") for f in fields]
    return df.select(*forms).withColumn("class", F.sha2(F.to_json(F.struct(*[F.col(f"`__{f}`") for f in fields])), 256))


def _classified(df: DataFrame, rules: DataFrame, text: Callable[[Column], Column], empty: bool, results: DataFrame | None = None) -> DataFrame:
    """All records with the sorted ``__rule_ids`` of their combination and the ``__result`` of the one rule it meets."""
    classes, hits, members = rule_hits(df, rules, text=text, empty=empty)
    ids = cut_lineage(members.groupBy("body").agg(F.sort_array(F.collect_list("rule_id")).alias("ids")))
    facts = ids.select("body", F.size("ids").alias("n"), F.lit(None).cast("map<string,string>").alias("__result"))
    if results is not None:
        maps = results.groupBy("rule_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("__result"))
        only = ids.filter("size(ids) = 1").select("body", F.col("ids")[0].alias("rule_id")).join(maps, "rule_id").select("body", "__result")
        facts = facts.drop("__result").join(only, "body", "left")
    met = hits.join(facts, "body").groupBy("class_no").agg(F.sum("n").alias("n"), F.first("__result", ignorenulls=True).alias("__result"))
    met = met.join(classes.select("class_no", F.col("class").alias("__class"), F.ceil(F.col("records") / CLASS_BLOCK).cast("int").alias("blocks")), "class_no")
    met = met.withColumn("__result", F.when(F.col("n") == 1, F.col("__result"))).drop("n")
    fields = sorted(r["field"] for r in rules.select("field").distinct().collect())
    forms = F.struct(*[text(F.col(f"`{f}`")).alias(f"__{f}") for f in fields])
    keyed = df.withColumn("__class", F.sha2(F.to_json(forms), 256))
    many = classes.agg(F.sum("records").alias("records"), F.count(F.lit(1)).alias("classes")).first()
    if (many["records"] or 0) >= CLASS_RECORDS * many["classes"]:
        # few combinations: lists are made for each and are little next to the records
        lists = _lists(met.select("class_no", F.lit(0).alias("block"), F.struct("__class").alias("record"), "__result"), met.withColumn("blocks", F.lit(1)), hits, ids)
        own = lists.select("record.__class", "__rule_ids", "__result")
        # Lists of ids are far wider than any estimate made from the tables: never broadcast.
        return keyed.join(own.hint("merge"), "__class", "left").drop("__class").withColumn(
            "__rule_ids", F.coalesce("__rule_ids", F.array().cast("array<string>")))
    # A map has no hash. Records without a hit go to places of their own, under numbers that no combination has.
    dealt = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])
    records = keyed.join(met, "__class", "left").select(
        F.coalesce("class_no", -1 - F.pmod(dealt, F.lit(1 << 40))).alias("class_no"), F.coalesce(F.pmod(dealt, "blocks").cast("int"), F.lit(0)).alias("block"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), "__result")
    return _lists(records, met, hits, ids).select("record.*", "__rule_ids", "__result")


def _lists(records: DataFrame, met: DataFrame, hits: DataFrame, ids: DataFrame) -> DataFrame:
    """``record, __rule_ids, __result`` of ``class_no, block, record, __result``; ``met`` says how many ``blocks`` a combination has.

    Hits, records and the ids of bodies come to the places of their combinations in one exchange. There ids
    pass to hits, and lists to records, by order alone: what is dealt by place needs no further exchange.
    """
    places = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64("class_no", "block"), F.lit(places)).cast("int").alias("place")
    hit = hits.join(met.select("class_no", "blocks"), "class_no").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        place, F.lit(1).alias("kind"), "body", "class_no", "block")
    needed = hit.select("place", "body").distinct().join(ids, "body").select("place", F.lit(0).alias("kind"), "body", "ids")
    # no body has a number below 0
    waiting = records.select(place, F.lit(2).alias("kind"), (-1 - F.abs("class_no")).alias("body"), "class_no", "block", "record", "__result")
    gathered = needed.unionByName(hit, allowMissingColumns=True).unionByName(waiting, allowMissingColumns=True).repartition(places, "place")
    of_body = Window.partitionBy("place", "body").orderBy("kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_ids = gathered.withColumn("ids", F.first("ids", ignorenulls=True).over(of_body)).filter("kind > 0")
    lists = with_ids.withColumn("lists", F.collect_list("ids").over(Window.partitionBy("place", "class_no", "block"))).filter("kind = 2")
    return lists.select("record", F.sort_array(F.flatten("lists")).alias("__rule_ids"), "__result")


def strict_classify_from_tables(df: DataFrame, rules: DataFrame, results: DataFrame) -> DataFrame:
    """Adds ``rule_ids`` (sorted), ``rule_status`` and ``result`` to every record, as ``strict_classify`` does.

    ``rules`` as for ``rule_hits``; ``results`` has ``rule_id, name, value``. Exactly one matching rule
    classifies. A rule is what has conditions: one without any row does not exist.
    """
    n = F.size("__rule_ids")
    status = F.when(n == 0, "UNKNOWN").when(n == 1, "OK").otherwise("AMBIGUOUS")
    return _classified(df, rules, normalize_text, True, results).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("__rule_ids").alias("rule_ids"), status.alias("rule_status"), F.col("__result").alias("result"))


def multi_classify_from_tables(df: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds the sorted ``codes`` of all categories a record belongs to.

    ``categories`` has ``code, field, operator, value``, one row per value; operators are ``equals`` and
    ``contains``, case-insensitive but accent-exact. An empty value never matches.
    """
    op = F.when(F.col("operator") == "equals", "eq").otherwise(F.col("operator"))
    unknown = categories.filter("operator NOT IN ('equals', 'contains')").select("operator").first()
    if unknown:
        raise UnknownOperator(unknown["operator"])
    rules = categories.select(F.col("code").alias("rule_id"), F.lit(1).alias("condition_no"), "field", op.alias("op"), "value")
    return _classified(df, rules, casefold_text, False).select(
        *[F.col(f"`{c}`") for c in df.columns], F.col("__rule_ids").alias("codes"))
