"""Bind a record to a DataFrame: from separate columns, a struct or JSON text.

A binding fills the ``{field}`` placeholders of rule text with SQL that
reaches the field.  JSON is parsed once into a hidden struct column by
:meth:`Binding.prepare`, so every rule reads the same parsed value (Catalyst
would otherwise plan one parser per referenced field).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleframe.model import quoted
from ruleframe.suites import RECORD_FIELDS, record_ddl

PARSED_COL = "__record"
CORRUPT_FIELD = "_corrupt_record"


def _path(parts: Sequence[str]) -> str:
    return ".".join(quoted(p) for p in parts)


def _steps(path: str) -> list[str]:
    """Names along a dotted path; a part in backquotes is one name."""
    return [(m[1] or "").replace("``", "`") or m[2] for m in re.finditer(r"`((?:[^`]|``)*)`|([^.`]+)", path)]


def pruned(schema: T.DataType, paths: Iterable[Sequence[str]]) -> T.DataType:
    """The part of a type that the paths read: whole where a path ends, else only what they go on to.

    Names are compared without case.  Paths go through arrays; a map is kept whole.
    """
    paths = [list(p) for p in paths]
    if any(not p for p in paths) or not paths:
        return schema
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(pruned(schema.elementType, paths), schema.containsNull)
    if not isinstance(schema, T.StructType):
        return schema
    fields = []
    for f in schema.fields:
        own = [p[1:] for p in paths if p[0].lower() == f.name.lower()]
        if own:
            fields.append(T.StructField(f.name, pruned(f.dataType, own), f.nullable))
    return T.StructType(fields) if fields else schema


@dataclass(frozen=True)
class Binding:
    """How rule placeholders reach the record's fields.

    kind: "fields" (one column per field), "struct" (a struct column) or
    "json" (a JSON string column parsed with ``ddl``).  A placeholder is a
    field name or a path into nested fields (``address.city``); names are
    compared without case, as Spark's resolver does.  ``columns`` maps
    placeholders to columns or paths from a column; a part in backquotes is
    one name, and so is a whole dotted name if the frame has such a column.

    ``errors_null``: "rule" (or True) makes a rule that fails on a row NULL,
    "result" the row's whole result.
    """

    kind: str
    source: str | None = None
    columns: Mapping[str, str] = field(default_factory=dict)
    ddl: str = record_ddl()
    bad_records_null: bool = False
    errors_null: bool | str = False
    frame: T.StructType | None = None  # of the frame bound to, see :meth:`over`

    def __post_init__(self):
        if self.kind not in ("fields", "struct", "json"):
            raise ValueError(f"unknown binding kind {self.kind!r}")
        if self.errors_null not in (False, True, "rule", "result"):
            raise ValueError(f"errors_null is 'rule' or 'result', not {self.errors_null!r}")

    def over(self, df: DataFrame) -> "Binding":
        """The binding with the columns of ``df`` known."""
        return replace(self, frame=df.schema)

    @property
    def field_names(self) -> list[str]:
        """Record fields: from the DDL for JSON, else the mapping or the benchmark record."""
        if self.kind == "json":
            # Spark's own DDL parser: nested types and quoted names hold commas
            return [f.name for f in T.StructType.fromDDL(self.ddl).fields]
        if self.columns:
            return list(self.columns)
        return [n for n, _ in RECORD_FIELDS]

    def _column(self, path: str) -> str:
        """SQL text of a column or a path from one."""
        if self.frame is not None and "`" not in path and path.lower() in (n.lower() for n in self.frame.names):
            return quoted(path)
        return _path(_steps(path))

    def ref(self, name: str) -> str:
        """SQL text reaching the record field or path ``name``."""
        mapped = {k.lower(): v for k, v in self.columns.items()}
        steps = _steps(name)
        for n in range(len(steps), 0, -1):  # the longest part that is mapped, then on from there
            column = mapped.get(".".join(steps[:n]).lower())
            if column is not None:
                return ".".join([self._column(column), *(quoted(s) for s in steps[n:])])
        if self.kind == "fields":
            return self._column(name)
        return _path([self.source if self.kind == "struct" else PARSED_COL, *steps])

    def has_field(self, name: str) -> bool:
        """Whether the record has a field of that name, as far as is known (see :meth:`over`)."""
        head = _steps(name)[0].lower()
        known = {k.lower() for k in self.columns} | {_steps(k)[0].lower() for k in self.columns}
        if self.kind == "json":
            known |= {n.lower() for n in self.field_names}
        elif self.frame is not None:
            types = {f.name.lower(): f.dataType for f in self.frame.fields}
            inner = types if self.kind == "fields" else types.get((self.source or "").lower())
            known |= set(inner) if isinstance(inner, dict) else {n.lower() for n in getattr(inner, "names", ())}
        return head in known

    def refs(self) -> Mapping[str, str]:
        """Placeholder -> SQL text, for any field name a rule uses."""
        return _Refs(self)

    def prepare(self, df: DataFrame, used: set[str] | None = None) -> DataFrame:
        """Add what the rule text needs (the parsed JSON struct), nothing else.

        With the fields and paths ``used`` by the rules only those are
        parsed, unless a bad record must be told by all of them.
        """
        if self.kind != "json":
            return df
        if PARSED_COL in df.columns:
            raise ValueError(f"column {PARSED_COL} is used inside: rename it")
        return df.withColumn(PARSED_COL, self.parsed(used))

    def parsed(self, used: set[str] | None = None) -> Column:
        if not self.bad_records_null:
            schema = T.StructType.fromDDL(self.ddl)
            return F.from_json(F.col(self.source), schema if used is None else pruned(schema, [_steps(u) for u in used]))
        ddl = self.ddl if CORRUPT_FIELD in self.field_names else f"{self.ddl}, {CORRUPT_FIELD} STRING"
        return F.from_json(
            F.col(self.source),
            ddl,
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_FIELD},
        )

    def bad_record(self) -> Column | None:
        """TRUE for rows whose record could not be read (JSON with bad_records_null)."""
        if self.kind == "json" and self.bad_records_null:
            # NULL and blank text parse to nothing without being marked corrupt
            source = F.col(self.source)
            return (F.col(PARSED_COL).getField(CORRUPT_FIELD).isNotNull() | F.col(PARSED_COL).isNull()
                    | source.isNull() | (F.trim(source) == ""))
        return None

    def record(self) -> Column:
        """The bound record as one struct column (after :meth:`prepare`)."""
        if self.kind == "struct":
            return F.col(self.source)
        return F.struct(*[F.expr(self.ref(n)).alias(n) for n in self.field_names])

    def cleanup(self, df: DataFrame) -> DataFrame:
        return df.drop(PARSED_COL) if self.kind == "json" else df


class _Refs(dict):
    def __init__(self, binding: Binding):
        super().__init__()
        self._b = binding

    def __missing__(self, name: str) -> str:
        return self._b.ref(name)


def bind_fields(columns: Mapping[str, str] | None = None, errors_null: bool | str = False) -> Binding:
    """Record fields are columns; ``columns`` renames field -> column, or path from one (``address.city``)."""
    return Binding("fields", columns=dict(columns or {}), errors_null=errors_null)


def bind_struct(column: str, columns: Mapping[str, str] | None = None, errors_null: bool | str = False) -> Binding:
    """Record is the struct in ``column``; ``columns`` names fields that are columns beside it."""
    return Binding("struct", source=column, columns=dict(columns or {}), errors_null=errors_null)


def bind_json(column: str, ddl: str | None = None, bad_records_null: bool = False, errors_null: bool | str = False,
              columns: Mapping[str, str] | None = None) -> Binding:
    """Record is JSON text in ``column``; parsed once with schema ``ddl``.

    With ``bad_records_null`` a malformed or wrongly typed record makes the
    whole result NULL instead of evaluating rules on partially-read fields;
    so does NULL or blank text.  With ``errors_null`` a rule that fails on a
    row (a cast, a division, an index, an overflow) gives NULL there instead
    of an error, or with "result" makes the row's whole result NULL.
    ``columns`` names fields that are columns beside the text.
    """
    return Binding("json", source=column, ddl=ddl or record_ddl(), bad_records_null=bad_records_null,
                   errors_null=errors_null, columns=dict(columns or {}))


def _cast_back(df: DataFrame, cast: Column, kind: T.DataType) -> Column | None:
    """``cast`` converted back to its source's type; None where Spark has no such cast or can't compare it."""
    back = cast.try_cast(kind.simpleString())
    try:
        df.select(back.eqNullSafe(back))
    except AnalysisException:
        return None
    return back


def lossless(df: DataFrame, source: str, typ: str) -> tuple[Column, Column]:
    """(column ``source`` cast to ``typ``, whether a value that isn't NULL keeps its meaning in it).

    A value that can't be cast gives NULL.  Text is compared by what it
    says: as exact decimals for numbers, as an instant for dates and times
    (a time of day doesn't fit a DATE, nor more than six digits of a second a
    TIMESTAMP).  Text too long for CHAR(n) or VARCHAR(n) (but for trailing
    spaces) gives NULL.  Everything else must survive the cast there and back.
    """
    src = F.col(source)
    kind = df.select(src.alias("c")).schema["c"].dataType
    sized = re.fullmatch(r"\s*(?:var)?char\s*\(\s*(\d+)\s*\)\s*", typ, re.I)
    cast = src.try_cast("string" if sized else typ)
    if sized:
        cast = F.when(F.char_length(F.rtrim(cast)) <= int(sized[1]), cast)
    fits, target = cast.isNotNull(), df.select(cast.alias("c")).schema["c"].dataType
    if not isinstance(kind, T.StringType):
        back = _cast_back(df, cast, kind)
        return cast, fits if back is None else fits & back.eqNullSafe(src)
    if isinstance(target, T.NumericType):
        exact = "decimal(38,18)"
        said, kept = src.try_cast(exact), cast.cast("string").try_cast(exact)  # 0.1 as FLOAT says 0.1
        close = src.try_cast("double").eqNullSafe(cast.try_cast("double"))     # beyond 20 digits before the point
        fits = fits & F.coalesce(said == kept, close)
    elif isinstance(target, T.DateType):
        fits = fits & cast.cast("timestamp_ntz").eqNullSafe(src.try_cast("timestamp_ntz"))
    elif isinstance(target, (T.TimestampType, T.TimestampNTZType)):
        fits = fits & ~src.rlike(r"\.[0-9]{6}0*[1-9]")
    return cast, fits


def typed_record(df: DataFrame, fields: Sequence[tuple[str, str]] = RECORD_FIELDS,
                 columns: Mapping[str, str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Cast bound fields to the declared record type, flagging values that do not fit.

    Returns ``keep`` columns, one column per field with the declared type (a
    value that can't be cast becomes NULL) and ``type_ok``: every non-null
    input value converted without loss (see :func:`lossless`).
    """
    columns = dict(columns or {})
    casts, ok = [], []
    for name, typ in fields:
        source = columns.get(name, name)
        cast, fits = lossless(df, source, typ)
        casts.append(cast.alias(name))
        ok.append(F.col(source).isNull() | fits)
    return df.select(*[F.col(k) for k in keep], *casts, reduce(lambda a, b: a & b, ok).alias("type_ok"))
