"""Decision tables and decision models as Column builders and joins.

A decision model here is what the model computes, not an engine: business
functions become SQL functions with explicit parameters, a decision table
becomes a CASE (few rows) or a join (many rows), a context becomes chained
named columns, and a decision service is a projection of chosen outputs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from math import prod
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.functions.columns import is_missing
from ruleframe.functions.trying import null_on_error
from ruleframe.model import RuleSuite, quoted
from ruleframe.operators.joins import join_small
from ruleframe.operators.runner import fresh, stage
from ruleframe.sources.bindings import Binding, bind_fields
from ruleframe.suites import GROUPS, MISSING

NAME_MARK = "\x1f"  # between field names
HIT_POLICIES = ("UNIQUE", "FIRST", "ANY", "COLLECT")


@dataclass(frozen=True)
class DecisionTable:
    """Single-input decision table: input value -> output.

    ``hit_policy`` UNIQUE means at most one row may match an input;
    :meth:`conflicts` finds inputs that break it.  With no ``default`` an
    unmatched input gives NULL.
    """

    name: str
    rows: tuple[tuple[Any, Any], ...]
    input_type: str = "string"
    output_type: str = "array<string>"
    hit_policy: str = "UNIQUE"
    default: Any = None

    def __post_init__(self):
        if self.hit_policy not in HIT_POLICIES:
            raise ValueError(f"hit policy {self.hit_policy!r} not in {HIT_POLICIES}")

    def _lit(self, v: Any) -> Column:
        if isinstance(v, (list, tuple)):
            return F.array(*[F.lit(x) for x in v]).cast(self.output_type)
        return F.lit(v).cast(self.output_type)

    def check(self) -> None:
        """Raises where the rows break the hit policy: UNIQUE (one row an input), ANY (one output an input)."""
        seen: dict = {}
        for k, v in self.rows:
            if k in seen and (self.hit_policy == "UNIQUE" or self.hit_policy == "ANY" and seen[k] != v):
                raise ValueError(f"decision table {self.name}: input {k!r} breaks hit policy {self.hit_policy}")
            seen.setdefault(k, v)

    def column(self, value: Column) -> Column:
        """CASE form: the first matching row (the only one for UNIQUE, any of equals for ANY), or all for COLLECT.

        Any number of rows; :meth:`lookup` gives the same and plans faster for many.
        """
        self.check()
        if self.hit_policy == "COLLECT":
            return self.collect_column(value)
        out = None
        for k, v in self.rows:
            cond = value == F.lit(k)
            out = F.when(cond, self._lit(v)) if out is None else out.when(cond, self._lit(v))
        if out is None:
            return self._lit(self.default)
        return out.otherwise(self._lit(self.default)) if self.default is not None else out

    def collect_column(self, value: Column) -> Column:
        """COLLECT: array of the outputs of every matching row, in table order.

        Each row gives a one-element or empty array and ``flatten`` joins
        them: generated code, no per-element lambda.
        """
        none = F.array().cast(f"array<{self.output_type}>")
        hits = [F.when(value == F.lit(k), F.array(self._lit(v))).otherwise(none) for k, v in self.rows]
        return F.flatten(F.array(*hits))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(k, list(v) if isinstance(v, tuple) else v) for k, v in self.rows]
        return spark.createDataFrame(rows, f"input {self.input_type}, output {self.output_type}")

    def long_form(self, spark: SparkSession) -> DataFrame:
        """(input, member) rows for list outputs."""
        return self.frame(spark).select("input", F.explode("output").alias("member"))

    def lookup(self, spark: SparkSession, df: DataFrame, value_col: str, out: str) -> DataFrame:
        """Join form, same answers as :meth:`column`: one row for each row of ``df``."""
        self.check()
        rows = [(i, k, list(v) if isinstance(v, tuple) else v) for i, (k, v) in enumerate(self.rows)]
        table = spark.createDataFrame(rows, f"position int, input {self.input_type}, output {self.output_type}")
        default = None if self.default is None else self._lit(self.default)
        return lookup_frame(df, table, value_col, out, self.hit_policy, default, self._bytes())

    def _bytes(self) -> int:
        return sum(len(str(k)) + len(str(v)) + 16 for k, v in self.rows)

    def conflicts(self, spark: SparkSession) -> DataFrame:
        """Inputs matched by more than one row: a UNIQUE violation."""
        return self.frame(spark).groupBy("input").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")

    def hit_counts(self, spark: SparkSession, df: DataFrame, value_col: str) -> DataFrame:
        """Per row: how many table rows match its value, and whether the hit policy holds.

        The table is aggregated first (one row per input), so the join adds
        one row at most per record and broadcasts a side no larger than the table.
        """
        own, n = fresh(df, "__input"), fresh(df, "__hits")
        counts = self.frame(spark).groupBy(F.col("input").alias(own)).agg(F.count(F.lit(1)).alias(n))
        j = join_small(df, counts, [(value_col, own)], self._bytes(), "left").drop(own)
        hits = F.coalesce(F.col(n), F.lit(0)).cast("int")
        ok = hits <= 1 if self.hit_policy == "UNIQUE" else F.lit(True)
        return j.withColumns({"hits": hits, "policy_ok": ok}).drop(n)


def lookup_frame(df: DataFrame, table: DataFrame, value_col: str, out: str, hit_policy: str = "UNIQUE",
                 default: Column | None = None, table_bytes: int | None = None) -> DataFrame:
    """``df`` with the output of a decision table that is a frame (position, input, output), of any size.

    The table is aggregated to one row an input by its hit policy, so the
    left join keeps the rows of ``df`` as they are.  An input that breaks
    UNIQUE or ANY fails the job.  COLLECT gives an array in table order
    (empty without a match); other policies give ``default`` without one.
    """
    if hit_policy not in HIT_POLICIES:
        raise ValueError(f"hit policy {hit_policy!r} not in {HIT_POLICIES}")
    output = F.col("output")
    if hit_policy == "COLLECT":
        value = F.transform(F.array_sort(F.collect_list(F.struct("position", "output"))), lambda x: x["output"])
    else:
        value = F.min_by(output, "position")
        broken = {"UNIQUE": F.count(F.lit(1)) > 1,
                  "ANY": F.min(F.to_json(F.struct("output"))) < F.max(F.to_json(F.struct("output")))}.get(hit_policy)
        if broken is not None:
            value = F.when(broken, F.raise_error(F.concat(
                F.lit(f"hit policy {hit_policy} broken by input "), F.first("input").cast("string")))).otherwise(value)
    own, result, hit = fresh(df, "__input"), fresh(df, "__output"), fresh(df, "__hit")
    rows = table.groupBy(F.col("input").alias(own)).agg(value.alias(result), F.first(F.lit(True)).alias(hit))
    joined = join_small(df, rows, [(value_col, own)], table_bytes, "left").drop(own)
    if hit_policy == "COLLECT":
        default = F.array().cast(joined.schema[result].dataType)
    # by the match, not by NULL: a matched row may hold a NULL output
    found = F.when(F.col(hit), F.col(result))
    return joined.withColumn(out, found if default is None else found.otherwise(default)).drop(result, hit)


def group_table(hit_policy: str = "UNIQUE") -> DecisionTable:
    """Group name -> member locations, no default row (the decision model's table)."""
    return DecisionTable("locations_expanded", tuple((g, ms) for g, ms in GROUPS.items()), hit_policy=hit_policy)


def member_table() -> DecisionTable:
    """Location -> group: the reverse table, where one input hits several rows."""
    return DecisionTable("groups_of_location",
                         tuple((m, g) for g, ms in GROUPS.items() for m in ms), output_type="string")


@dataclass(frozen=True)
class DecisionModel:
    """Decisions over the named boolean entries of a suite.

    ``decisions`` maps a decision to the (set id, rule id) pairs it lists, in
    order; the first decision of the default, ``evaluate``, lists every rule.
    ``services`` name the decisions that each service exposes.  The suite's
    functions are the imported business functions.
    """

    suite: RuleSuite
    decisions: dict = field(default_factory=dict)
    services: dict = field(default_factory=lambda: {"DQService": ("evaluate",)})

    def _key(self, rule_set, rule) -> tuple[int, int]:
        return rule_set.id.id, rule.id.id

    def all_decisions(self) -> dict:
        return {"evaluate": tuple(self._key(s, r) for s, r in self.suite.rules()), **self.decisions}

    def entry_names(self) -> list[str]:
        """The suite's entry names: a rule's own, else r<rule>, or s<set>_r<rule> with several sets."""
        return self.suite.entry_names()

    def evaluate(self, spark: SparkSession, df: DataFrame, binding: Binding | None = None,
                 service: str | None = "DQService", out: str = "quality", as_json: bool = False,
                 with_context: bool = False) -> DataFrame:
        """Append the decision result.

        A struct with one array<boolean> field for each decision that
        ``service`` exposes (None: every decision of the model), or its JSON
        text; with_context also keeps the named entries.  Rows whose JSON
        input cannot be read get a NULL result when the binding asks for it.
        """
        decisions = self.all_decisions()
        names = list(decisions) if service is None else list(self.services[service])
        unknown = [n for n in names if n not in decisions]
        if unknown:
            raise ValueError(f"service {service!r} exposes unknown decisions {unknown}")
        s = stage(spark, df, self.suite, binding)
        context = fresh(s.df, "__ctx")
        entries = F.struct(*[r.alias(n) for n, r in zip(self.entry_names(), s.rules)])
        if s.binding.errors_null == "result":
            entries = null_on_error(entries, s.holds)
        staged = s.df.withColumn(context, entries)
        entry = {self._key(x, r): n for n, (x, r) in zip(self.entry_names(), self.suite.rules())}
        fields = [F.array(*[F.col(context).getField(entry[k]) for k in decisions[n]]).alias(n) for n in names]
        if with_context:
            fields.append(F.col(context).alias("context"))
        res = F.struct(*fields)
        for bad in (s.binding.bad_record(), F.col(context).isNull() if s.binding.errors_null == "result" else None):
            if bad is not None:
                res = F.when(bad, F.lit(None)).otherwise(res)
        if as_json:
            res = F.to_json(res)
        return s.cleanup(staged.withColumn(out, res).drop(context))


@dataclass(frozen=True)
class Condition:
    """A rule as data: every field is one of its values; the fields in ``missing`` are null or blank."""

    rule_id: int
    values: dict
    missing: tuple[str, ...] = ()


def conditions(rule_table) -> list[Condition]:
    """The benchmark's rules (location group or missing id, and department) as data."""
    return [Condition(rid, {"department": (dept,)}, ("id",)) if test == MISSING
            else Condition(rid, {"location": GROUPS[test], "department": (dept,)}) for rid, test, dept in rule_table]


def condition_frame(spark: SparkSession, rules: Sequence[Condition]) -> DataFrame:
    """The rules as a frame for :func:`rule_hits`: rule_id, missing, and an array column of values for each field."""
    fields = sorted({f for r in rules for f in r.values})
    kinds = {f: _array_type(f, [v for r in rules for v in r.values.get(f, ())]) for f in fields}
    rows = [(r.rule_id, list(r.missing), *[list(r.values[f]) if f in r.values else None for f in fields]) for r in rules]
    ddl = "".join(f", {quoted(f)} array<{kinds[f]}>" for f in fields)
    return spark.createDataFrame(rows, f"rule_id int, missing array<string>{ddl}")


def _array_type(field: str, values: list) -> str:
    kinds = {type(v) for v in values if v is not None}
    for types, name in ((({bool}), "boolean"), ({int}, "bigint"), ({int, float}, "double"), ({Decimal}, "decimal(38,18)"),
                        ({datetime}, "timestamp"), ({date}, "date"), ({bytes}, "binary"), ({str}, "string")):
        if kinds <= types:
            return name if kinds else "string"
    raise ValueError(f"values of {field!r} are of different types: {sorted(k.__name__ for k in kinds)}")


def _common_type(df: DataFrame, a: T.DataType, b: T.DataType) -> str:
    """The type in which Spark compares the two."""
    null = lambda t: F.lit(None).cast(t)
    return df.limit(0).select(F.array(null(a), null(b)).alias("x")).schema["x"].dataType.elementType.simpleString()


def rule_hits(spark: SparkSession, records: DataFrame, rules, key: str, binding: Binding | None = None) -> DataFrame:
    """(key, rule_id) for every rule that is TRUE on a record, by one equi-join.

    ``rules`` is a frame of any size: ``rule_id``, optionally ``missing``
    (array of fields that must be null or blank) and for each field a column
    with the value, or an array of the values, that the rule allows; NULL
    where it does not ask for the field.  :class:`Condition` rows and the
    benchmark's rule table are made into one.

    Rules over the same fields share a shape.  The executors expand each rule
    to a row for each combination of its values; a record emits one probe for
    each shape - its own values, typed, in the type that Spark compares both
    in - and one join finds the rules that it meets.  Only the shapes reach
    the driver.  One scan of the records; output <= rules x records; a row
    that lists a value twice counts once, two rows with one id count each.  A NULL value matches
    nothing, as a NULL rule result is not TRUE; a value that the common type
    can't hold matches nothing; a bad record matches nothing.
    """
    listed = None
    if not isinstance(rules, DataFrame):
        listed = [r if isinstance(r, Condition) else conditions([r])[0] for r in rules]
        rules = condition_frame(spark, listed)
    b = (binding or bind_fields()).over(records)
    fields = [f for f in rules.columns if f.lower() not in ("rule_id", "missing")]
    if {"asked", "was_asked"} & {f.lower() for f in fields}:
        raise ValueError("fields named asked or was_asked: rename them")
    missing = F.sort_array(F.col("missing")) if "missing" in rules.columns else F.lit(None).cast("array<string>")
    missing = F.coalesce(missing, F.array().cast("array<string>"))
    shapes = _shapes(listed, rules, fields, missing)
    prepared = b.prepare(records, {*fields, *(f for _, absent in shapes for f in absent)})
    bad = b.bad_record()
    if bad is not None:
        prepared = prepared.where(~F.coalesce(bad, F.lit(False)))

    own = {f: prepared.select(F.expr(b.ref(f)).alias("x")).schema["x"].dataType for f in fields}
    kinds, table = {}, rules.select("rule_id", F.concat_ws(NAME_MARK, missing).alias("missing"),
                                    _asked(fields).alias("asked"), *[quoted(f) for f in fields])
    for f in fields:
        kind, value = table.schema[f].dataType, F.col(quoted(f))
        if not isinstance(kind, T.ArrayType):
            kind, value = T.ArrayType(kind), F.when(value.isNotNull(), F.array(value))
        kinds[f] = _common_type(prepared, own[f], kind.elementType)
        # a rule that does not ask for the field keeps one row, with NULL; a value that can't be cast goes
        allowed = F.coalesce(F.array_distinct(value.try_cast(f"array<{kinds[f]}>")), F.array(F.lit(None).cast(kinds[f])))
        table = (table.withColumn("was_asked", value.isNotNull()).withColumn(f, F.explode(allowed))
                 .where(F.col(quoted(f)).isNotNull() | ~F.col("was_asked")))
    table = table.select("rule_id", F.struct("asked", "missing", *[quoted(f) for f in fields]).alias("met"))

    probes = []
    for names, absent in shapes:
        values = {f: F.expr(b.ref(f)).try_cast(kinds[f]) if f in names else F.lit(None).cast(kinds[f]) for f in fields}
        met = F.lit(True)
        for f in names:
            met = met & values[f].isNotNull()
        for f in absent:
            met = met & is_missing(F.expr(b.ref(f)))
        texts = [F.lit(NAME_MARK.join(x)).alias(c) for x, c in ((names, "asked"), (absent, "missing"))]
        probes.append(F.when(met, F.struct(*texts, *[v.alias(f) for f, v in values.items()])))
    if not probes:  # no rules
        probes = [F.lit(None).cast(table.schema["met"].dataType)]
    probe = (prepared.select(F.col(key).alias("key"), F.explode(F.array(*probes)).alias("own"))
             .where(F.col("own").isNotNull()))
    # a driver-side list is measured here, a frame by one aggregation
    size = None if listed is None else sum(
        prod(map(len, r.values.values())) * (64 * (1 + len(fields)) + sum(
            max((4 * len(str(v)) for v in vs), default=0) for vs in r.values.values())) for r in listed)
    # by a hash, one long, then by the values
    probe, table = probe.withColumn("own_hash", F.xxhash64("own")), table.withColumn("met_hash", F.xxhash64("met"))
    hits = join_small(probe, table, [("own_hash", "met_hash")], size).where(F.col("own") == F.col("met"))
    return hits.select(F.col("key").alias(key), "rule_id")


def _asked(fields: Sequence[str]) -> Column:
    """The fields that a rule asks for, as one text."""
    return F.concat_ws(NAME_MARK, *[F.when(F.col(quoted(f)).isNotNull(), F.lit(f)) for f in fields])


def _shapes(listed: list[Condition] | None, rules: DataFrame, fields: Sequence[str], missing: Column) -> list[tuple]:
    """Distinct (fields asked for, fields that must be missing): as many as there are, whatever the number of rules."""
    if listed is not None:
        return sorted({(tuple(f for f in fields if f in r.values), tuple(sorted(r.missing))) for r in listed})
    rows = rules.select(_asked(fields).alias("asked"), F.concat_ws(NAME_MARK, missing).alias("missing")).distinct().collect()
    return sorted(tuple(tuple(n for n in r[c].split(NAME_MARK) if n) for c in ("asked", "missing")) for r in rows)
