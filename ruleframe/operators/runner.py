"""Compile a rule suite into Spark columns and evaluate it.

All results are native Catalyst expressions: rule text goes through
``F.expr``, suite functions are SQL functions the analyzer inlines, and
literal CASE lookups constant-fold.  Evaluation is narrow projections over
the scan (no shuffle, generated code).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleframe.functions.sql import register_scoped
from ruleframe.functions.trying import guard, null_on_error, row_guard
from ruleframe.model import Rule, RuleSuite, fill, placeholders, rename_calls
from ruleframe.sources.bindings import Binding, bind_fields

VECTOR_COL = "__rule_vector"
WIDE = 16  # rules above which a vector is kept out of whole-stage code


def rule_column(rule: Rule, binding: Binding | None = None) -> Column:
    """One rule as a boolean column (three-valued: NULL inputs may give NULL).

    Suite functions are called by their own names: register them first
    (:func:`~ruleframe.functions.sql.register_functions`).
    """
    b = binding or bind_fields()
    value, named = F.expr(rule.sql(b.refs())), sorted(placeholders(rule.expr))
    return null_on_error(value, guard(F.expr(b.ref(named[0]))) if named else None) if b.errors_null else value


def rule_vector(suite: RuleSuite, binding: Binding | None = None) -> Column:
    """array<boolean>, one element per rule in suite order, as one expression.

    Functions as for :func:`rule_column`; a rule that names another holds
    that one's text (:func:`with_vector` evaluates each once).
    """
    b = binding or bind_fields()
    texts: dict[str, str] = {}
    for name, rule, needs in suite.entry_order(b.has_field):
        texts[name] = fill(rule.expr, _Named(b, {n.lower(): f"({texts[n]})" for n in needs}))
    out = []
    for name, (_, rule) in zip(suite.entry_names(), suite.rules()):
        named = sorted(p for p in suite.fields() if b.has_field(p)) or sorted(placeholders(rule.expr))
        value = F.expr(texts[name])
        out.append(null_on_error(value, guard(F.expr(b.ref(named[0]))) if named else None) if b.errors_null else value)
    return F.array(*out)


def template_vector(templates: list[str], binding: Binding | None = None) -> Column:
    """array<boolean> from rule text templates (the hand-written baseline)."""
    refs = (binding or bind_fields()).refs()
    return F.array(*[F.expr(fill(t, refs)) for t in templates])


class _Named(dict):
    """Placeholder -> SQL text: entries by name, everything else by the binding."""

    def __init__(self, binding: Binding, entries: dict[str, str]):
        super().__init__()
        self._b, self._entries = binding, entries

    def __missing__(self, name: str) -> str:
        return self._entries.get(name.lower()) or self._b.ref(name)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


@dataclass(frozen=True)
class Staged:
    """A suite bound to a frame: the frame with what rules need, and a column for each rule in suite order."""

    df: DataFrame
    binding: Binding
    rules: list[Column]
    hidden: tuple[str, ...]  # columns added for entries that other rules name
    holds: Column | None

    def result(self, value: Column) -> Column:
        """``value`` made of the rules, NULL for bad records and, if asked, where any rule fails."""
        if self.binding.errors_null == "result":
            value = null_on_error(value, self.holds)
        bad = self.binding.bad_record()
        return value if bad is None else F.when(bad, F.lit(None)).otherwise(value)

    def cleanup(self, df: DataFrame) -> DataFrame:
        return self.binding.cleanup(df.drop(*self.hidden))


def stage(spark: SparkSession, df: DataFrame, suite: RuleSuite, binding: Binding | None) -> Staged:
    """Binds ``suite`` to ``df``.

    Functions get session names of their own.  Entries that other rules name
    become columns, level by level, so each is evaluated once however often
    it is named; the others stay expressions.
    """
    if VECTOR_COL in df.columns:
        raise ValueError(f"column {VECTOR_COL} is used inside: rename it")
    b = (binding or bind_fields()).over(df)
    names = register_scoped(spark, suite.functions)
    df = b.prepare(df, suite.fields())
    per_rule = b.errors_null in (True, "rule")
    holds = row_guard(df) if b.errors_null else None
    order = suite.entry_order(b.has_field)
    needed = set().union(*(needs for _, _, needs in order))
    level, at, value, hidden, stages = {}, {}, {}, [], {}
    for name, rule, needs in order:
        level[name] = 1 + max((level[n] for n in needs), default=-1)
        text = fill(rename_calls(rule.expr, names), _Named(b, {n.lower(): at[n] for n in needs}))
        value[name] = null_on_error(F.expr(text), holds) if per_rule else F.expr(text)
        at[name] = f"({text})"  # a failure may make the whole result NULL: nothing may fail before
        if name in needed and b.errors_null != "result":
            hidden.append(fresh(df, f"__entry_{len(hidden)}"))
            stages.setdefault(level[name], {})[hidden[-1]] = value[name]
            at[name], value[name] = f"`{hidden[-1]}`", F.col(f"`{hidden[-1]}`")
    for k in sorted(stages):
        df = df.withColumns(stages[k])
    return Staged(df, b, [value[n] for n in suite.entry_names()], tuple(hidden), holds)


def vector_of(df: DataFrame, rules: list[Column]) -> Column:
    """array<boolean> of rule columns over ``df``.

    Whole-stage code puts all rules into one method, and one that is too
    long is never compiled by the JVM.  An empty array from a function
    without generated code, appended to a wide vector, makes Spark evaluate
    that projection by itself, in methods of bounded length.
    """
    v = F.array(*rules)
    kept = row_guard(df) if len(rules) > WIDE else None
    return v if kept is None else F.concat(v, F.filter(F.array(kept), lambda x: ~x))


def _contains_false(v: Column) -> Column:
    return F.array_contains(v, F.lit(False))


def _rules_map(keys: list[int], values: Column, first: int, whole: bool) -> Column:
    """map<bigint, boolean> from key ids and ``values`` elements first, first+1, ...

    Two arrays whatever the width, so analysis and generated code stay small;
    a NULL or short vector gives NULL entries (one known to be ``whole``, up
    to the last key but one, need not be filled up).
    """
    n = len(keys)
    ids = F.array(*[F.lit(k).cast("bigint") for k in keys])
    if whole and first:
        return F.map_from_arrays(ids, F.concat(F.slice(values, first + 1, n - first), F.array_repeat(
            F.lit(None).cast("boolean"), first)))
    if whole:
        return F.map_from_arrays(ids, values)
    none = F.array().cast("array<boolean>")
    filled = F.concat(F.coalesce(values, none), F.array_repeat(F.lit(None).cast("boolean"), first + n))
    return F.map_from_arrays(ids, F.slice(filled, first + 1, n))


def audit(vector: Column, suite: RuleSuite, whole: bool = False) -> Column:
    """Nested result keyed by the suite's own ids.

    struct<any_failed, ruleSets: map<set id, struct<any_failed, rules: map<rule id, boolean>>>>.
    ``any_failed`` is TRUE when some rule is FALSE (NULL when none is FALSE
    but some is NULL).  ``vector`` must follow suite order; a NULL or short
    one gives NULL rules, unless it is known to be ``whole``.
    """
    sets = []
    pos = 0
    for s in suite.sets:
        n = len(s.rules)
        part = F.slice(vector, pos + 1, n) if len(suite.sets) > 1 else vector
        rules = _rules_map([r.id.id for r in s.rules], part if whole else vector, 0 if whole else pos, whole)
        sets += [F.lit(s.id.id).cast("bigint"),
                 F.struct(_contains_false(part).alias("any_failed"), rules.alias("rules"))]
        pos += n
    return F.struct(_contains_false(vector).alias("any_failed"), F.create_map(*sets).alias("ruleSets"))


def audit_compat(vector: Column, n_rules: int, set_id: int = 1) -> Column:
    """The benchmark's audit layout, kept bit-for-bit, for a vector of one rule set."""
    return audit_compat_sets(vector, {set_id: n_rules})


def audit_compat_sets(vector: Column, sets: dict[int, int], whole: bool = False) -> Column:
    """The benchmark's audit layout over set id -> number of rules, in suite order.

    struct<overallResult, ruleSets: map<bigint, struct<setResult, rules: map<bigint, boolean>>>>
    where a set's rules key i (0-based) holds element i+1 of its part of the
    vector (so the first rule is not shown and the last key is NULL) and the
    set/overall results are "vector contains FALSE".
    """
    entries, pos = [], 0
    for set_id, n in sets.items():
        part = F.slice(vector, pos + 1, n) if len(sets) > 1 else vector
        entries += [F.lit(set_id).cast("bigint"),
                    F.struct(_contains_false(part).alias("setResult"), _rules_map(list(range(n)), part, 1, whole).alias("rules"))]
        pos += n
    return F.struct(_contains_false(vector).alias("overallResult"), F.create_map(*entries).alias("ruleSets"))


def with_vector(spark: SparkSession, df: DataFrame, suite: RuleSuite, binding: Binding | None = None,
                out: str = "quality") -> DataFrame:
    """Append the rule vector as ``out``."""
    s = stage(spark, df, suite, binding)
    return s.cleanup(s.df.withColumn(out, s.result(vector_of(s.df, s.rules))))


def run_rules(spark: SparkSession, df: DataFrame, suite: RuleSuite, binding: Binding | None = None,
              out: str = "quality", compat: bool = False) -> DataFrame:
    """Append the audit result of ``suite`` as column ``out``.

    The vector is projected first into its own column and the audit is
    built over it (an interim projection): the audit reads the vector 17+
    times, and Catalyst keeps the two projections apart instead of
    repeating the whole vector expression in each read.
    """
    s = stage(spark, df, suite, binding)
    staged = s.df.withColumn(VECTOR_COL, s.result(vector_of(s.df, s.rules)))
    res = suite_result(F.col(VECTOR_COL), suite, compat, null_without_vector(s.binding), whole=True)
    return s.cleanup(staged.withColumn(out, res).drop(VECTOR_COL))


def null_without_vector(binding: Binding) -> bool:
    """Whether the binding makes whole results NULL."""
    return binding.bad_record() is not None or binding.errors_null == "result"


def suite_result(vector: Column, suite: RuleSuite, compat: bool = False, null_without_vector: bool = False,
                 whole: bool = False) -> Column:
    """The audit of ``suite`` built from its rule vector (NULL for a NULL vector if asked).

    ``whole`` says that a vector that isn't NULL has an element for each rule.
    """
    whole = whole and all(s.rules for s in suite.sets)
    res = (audit_compat_sets(vector, {s.id.id: len(s.rules) for s in suite.sets}, whole) if compat
           else audit(vector, suite, whole))
    if null_without_vector:
        res = F.when(vector.isNull(), F.lit(None)).otherwise(res)
    return res
