"""Suite model: versioned ids, rules, rule sets, suites and SQL functions.

Everything here is driver-side metadata (a few hundred bytes per rule).  It
compiles to Spark columns; nothing in this module touches data.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter
from typing import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


# Text that is no SQL by itself: string literals (raw ones take no escapes) and comments; then quoted names.
_LITERAL = r"""\b[rR]'[^']*'|\b[rR]"[^"]*"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|--[^\n]*|/\*.*?\*/"""
_NAME = r"`(?:[^`]|``)*`"
_TOKEN = re.compile(rf"(?:{_LITERAL}|{_NAME})|\{{([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)\}}", re.S)
_CALL = re.compile(rf"(?:{_LITERAL})|(?<![\w.`])({_NAME}|[A-Za-z_]\w*)(?=\s*\()|{_NAME}", re.S)


def fill(text: str, refs: Mapping[str, str]) -> str:
    """Rule text with its ``{field}`` and ``{field.inner}`` placeholders replaced.

    Only a field name or path in braces outside literals, quoted names and
    comments is a placeholder; every other brace (a regex quantifier, a JSON
    path) is part of the SQL and stays.
    """
    return _TOKEN.sub(lambda m: refs[m[1]] if m[1] else m[0], text)


def placeholders(text: str) -> set[str]:
    return {m[1] for m in _TOKEN.finditer(text) if m[1]}


def _plain(name: str) -> str:
    return name[1:-1].replace("``", "`") if name.startswith("`") else name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def calls(text: str) -> set[str]:
    """Names that SQL text calls as functions, in lower case; not those in literals, comments or other schemas."""
    return {_plain(m[1]).lower() for m in _CALL.finditer(text) if m[1]}


def rename_calls(text: str, names: Mapping[str, str]) -> str:
    """SQL text with the functions in ``names`` (lower case -> new name) called by their new names."""
    def one(m: re.Match) -> str:
        new = names.get(_plain(m[1]).lower()) if m[1] else None
        return m[0] if new is None else quoted(new)

    return _CALL.sub(one, text)


def ordered(graph: Mapping[str, set[str]], what: str) -> list[str]:
    """The nodes of a dependency graph, each after those it needs; a cycle raises with its nodes."""
    sorter = TopologicalSorter(graph)
    try:
        return list(sorter.static_order())
    except CycleError as e:
        raise ValueError(f"{what} need each other: {' -> '.join(e.args[1])}") from None


@dataclass(frozen=True, order=True)
class Id:
    """Identity with version, used on suites, sets, rules and functions."""

    id: int
    version: int = 1


@dataclass(frozen=True)
class Rule:
    """A boolean SQL expression.

    ``expr`` may refer to record fields as ``{field}`` placeholders; a
    :class:`~ruleframe.sources.bindings.Binding` fills them in so that one
    rule runs against fields, a struct column or a parsed JSON column.  A
    placeholder may also name another rule of the suite by its entry name
    (``name``, else r<rule id>): it stands for that rule's result.
    """

    id: Id
    expr: str

    name: str | None = None

    def sql(self, refs: Mapping[str, str]) -> str:
        """The text over a binding."""
        return fill(self.expr, refs)


@dataclass(frozen=True)
class RuleSet:
    id: Id
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class FunctionDef:
    """A named SQL function shared by the rules of a suite.

    Registered as ``CREATE TEMPORARY FUNCTION name(params) RETURNS t RETURN
    body``; the analyzer inlines the body at each call site, so calls cost
    the same as hand-written expressions.  Names may contain spaces.
    """

    name: str
    params: tuple[tuple[str, str], ...]
    returns: str
    body: str
    id: Id = Id(0, 1)

    def create_sql(self) -> str:
        args = ", ".join(f"{p} {t}" for p, t in self.params)
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {quoted(self.name)}({args}) RETURNS {self.returns} RETURN {self.body}"


def library_order(functions: Iterable[FunctionDef]) -> list[FunctionDef]:
    """The functions, each after those that its body calls; functions that call each other in a circle raise."""
    by_name = {f.name.lower(): f for f in functions}
    return [by_name[n] for n in ordered({n: calls(f.body) & set(by_name) for n, f in by_name.items()}, "functions")]


def renamed(functions: Iterable[FunctionDef], new_name: Callable[[FunctionDef], str]) -> list[FunctionDef]:
    """A library under other names, calls inside its bodies included; ``new_name`` sees a body already renamed."""
    names, out = {}, []
    for f in library_order(functions):
        moved = replace(f, body=rename_calls(f.body, names))
        names[f.name.lower()] = new_name(moved)
        out.append(replace(moved, name=names[f.name.lower()]))
    return out


def scoped(functions: Iterable[FunctionDef]) -> tuple[list[FunctionDef], dict[str, str]]:
    """A library under session names made from its definitions, and plain name (lower case) -> session name.

    A definition always gets the same name and different ones never share
    one, so suites can't replace each other's functions or the user's own.
    """
    functions = library_order(functions)
    moved = renamed(functions, lambda f: "ruleframe_" + hashlib.sha256(
        replace(f, name="f", id=Id(0)).create_sql().encode()).hexdigest()[:20])
    return moved, {f.name.lower(): m.name for f, m in zip(functions, moved)}


@dataclass(frozen=True)
class RuleSuite:
    id: Id
    sets: tuple[RuleSet, ...]
    functions: tuple[FunctionDef, ...] = field(default_factory=tuple)

    def __post_init__(self):
        """Results are keyed by set id and rule id, so each may occur once (in one version)."""
        sets = [s.id.id for s in self.sets]
        if len(set(sets)) < len(sets):
            raise ValueError(f"rule set ids repeat: {sorted(sets)}")
        for s in self.sets:
            ids = [r.id.id for r in s.rules]
            if len(set(ids)) < len(ids):
                raise ValueError(f"rule ids repeat in set {s.id.id}: {sorted(ids)}")

    def rules(self) -> list[tuple[RuleSet, Rule]]:
        """Rules in suite order, each with its set."""
        return [(s, r) for s in self.sets for r in s.rules]

    def fields(self) -> set[str]:
        """Record fields and paths (``a.b``) that the rules name, other rules included."""
        return {p for _, r in self.rules() for p in placeholders(r.expr)}

    def entry_names(self) -> list[str]:
        """Name of each rule: its own, else r<rule>, with s<set>_ before it when there are several sets
        (rule ids may repeat between them)."""
        several = len(self.sets) > 1
        return [r.name or (f"s{s.id.id}_" if several else "") + f"r{r.id.id}" for s, r in self.rules()]

    def entry_order(self, is_field: Callable[[str], bool]) -> list[tuple[str, Rule, set[str]]]:
        """(entry name, rule, entries it needs), each after those it needs.

        A placeholder names an entry unless the record has a field of that
        name.  Rules that need each other raise.
        """
        names = self.entry_names()
        entries = {n.lower(): n for n in names}
        if len(entries) < len(names):
            raise ValueError(f"rule names repeat: {sorted(names)}")
        rules = dict(zip(names, (r for _, r in self.rules())))
        graph = {n: {entries[p.lower()] for p in placeholders(r.expr) if p.lower() in entries and not is_field(p)}
                 for n, r in rules.items()}
        return [(n, rules[n], graph[n]) for n in ordered(graph, "rules")]

    def with_functions(self, extra: Iterable[FunctionDef], prefix: str = "") -> "RuleSuite":
        """The suite with another library imported, its names (and the calls inside it) under ``prefix``.

        A name that the suite defines otherwise raises: import the library under another prefix.
        """
        by_name = {f.name.lower(): f for f in self.functions}
        for f in renamed(extra, lambda f: prefix + f.name):
            own = by_name.setdefault(f.name.lower(), f)
            if own != f:
                raise ValueError(f"function {f.name!r} is already defined (id {own.id.id} version {own.id.version}, "
                                 f"not id {f.id.id} version {f.id.version}): import it under another prefix")
        return RuleSuite(self.id, self.sets, tuple(by_name.values()))

    def uses(self) -> dict[tuple[int, int], dict[str, bool]]:
        """(set id, rule id) -> function name -> whether the rule calls it itself (else through other functions)."""
        by_name = {f.name.lower(): f for f in self.functions}
        reach: dict[str, set[str]] = {}
        for f in library_order(self.functions):
            direct = calls(f.body) & set(by_name)
            reach[f.name.lower()] = direct.union(*(reach[n] for n in direct))
        out = {}
        for s, r in self.rules():
            direct = calls(r.expr) & set(by_name)
            out[s.id.id, r.id.id] = {by_name[n].name: n in direct
                                     for n in sorted(direct.union(*(reach[n] for n in direct)))}
        return out

    def function_metadata(self, spark: SparkSession) -> DataFrame:
        """One row for each function and rule that depends on it (none: one row without a rule).

        Columns: function name, id and version, set and rule id with the
        rule's version, and whether the rule calls the function itself.
        """
        versions = {(s.id.id, r.id.id): r.id.version for s, r in self.rules()}
        rows = [(f.name, f.id.id, f.id.version, *key, versions[key], used[f.name])
                for f in self.functions for key, used in self.uses().items() if f.name in used]
        used = {r[0] for r in rows}
        rows += [(f.name, f.id.id, f.id.version, None, None, None, None) for f in self.functions if f.name not in used]
        return spark.createDataFrame(rows, "function_name string, function_id int, function_version int, "
                                           "set_id int, rule_id int, rule_version int, direct boolean")

    def changed_rules(self, newer: "RuleSuite") -> list[tuple[int, int]]:
        """(set id, rule id) of the rules of ``newer`` whose text, or a function they depend on, is not as here."""
        old_text = {(s.id.id, r.id.id): r.expr for s, r in self.rules()}
        old = {f.name.lower(): f for f in self.functions}
        changed = {f.name for f in newer.functions if old.get(f.name.lower()) != f}
        gone = set(old) - {f.name.lower() for f in newer.functions}
        return [(s.id.id, r.id.id) for s, r in newer.rules()
                if old_text.get((s.id.id, r.id.id)) != r.expr or calls(r.expr) & gone
                or changed & set(newer.uses()[s.id.id, r.id.id])]

    def metadata(self, spark: SparkSession) -> DataFrame:
        """One row per rule: suite, set and rule ids with versions, and the text.

        One row per rule.  The planner has no size for a frame built on the
        driver, so a join must broadcast the small side by hint.
        """
        schema = T.StructType(
            [
                T.StructField("suite_id", T.IntegerType(), False),
                T.StructField("suite_version", T.IntegerType(), False),
                T.StructField("set_id", T.IntegerType(), False),
                T.StructField("set_version", T.IntegerType(), False),
                T.StructField("rule_id", T.IntegerType(), False),
                T.StructField("rule_version", T.IntegerType(), False),
                T.StructField("position", T.IntegerType(), False),
                T.StructField("expr", T.StringType(), False),
            ]
        )
        rows = [
            (self.id.id, self.id.version, s.id.id, s.id.version, r.id.id, r.id.version, i, r.expr)
            for i, (s, r) in enumerate(self.rules())
        ]
        return spark.createDataFrame(rows, schema)
