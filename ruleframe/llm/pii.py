"""Personal data by candidate generation and boosted trees, in DataFrame functions only.

Base rules find emails, IP addresses, payment cards and phone numbers by
format.  Wider generators, one per kind, propose spans that the base rules
can't express (an obfuscated email, a phone without its plus, ...).  Gradient
boosted trees score each proposal by its format and context; a margin
calibrated on held-out proposals selects those that are added.  Base spans
always stay, and a proposal that touches one is not added.

The trees learn from proposals of at most ``TRAIN_ROWS`` documents, picked by
a hash (a documented bound; every document is scored).  A proposal that covers
a valid base span, or lies in one, is positive, and so is one over a base span
rewritten in place into the wider formats; each positive also gives a decoy
whose format is broken.  Negative are proposals that touch a base span in any
other way or fail a format check.  The rest, well formed and apart from base
spans, may be the very data that the wide formats are for: nothing is learned
from it.  The fitted trees become one SQL expression, so scoring happens inside
the scan of the texts.

Spans are code points, end exclusive.  Defined results: a NULL or empty text
has no spans; repeated rows are judged alike; other columns pass through, one
named like the output column is replaced; with too few proposals of both
kinds nothing is added; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import fresh, written

KINDS = ("email", "ip", "card", "phone")
TRAIN_ROWS = 20_000
LEAST_EXAMPLES = 20     # positives, and negatives, below which nothing is learned
TREES, DEPTH = 12, 3
PRECISION = 0.99        # asked of the held-out proposals above the margin
STEPS = 1_000           # of the margin's histogram, per unit
CONTEXT = 32            # characters before a proposal that are looked at

# --- fixed values: the base formats.  Same matches as the plain patterns, written so that Java finds them in
# linear time: a run is tried from its start (or where the last match ended) only, and never given back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of this can't hold the kind.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"email": r"@|[\[({\x20](?:at|AT)[\])}\x20]", "ip": r"[0-9][.\[(]", "card": "[0-9]{4}", "phone": "[0-9]",
              "national": "[0-9]{3}"}
# Wider formats, for proposals.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?|\x20(?:at|AT)\x20)"
             r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]{1,63}){1,6}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{2,7}){2,5}(?![0-9])",
    "phone": r"(?<![0-9])(?!(?:19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.])(?:\+|00\x20?)?[(]?[0-9]{1,4}[)]?(?:[\x20./-]{1,2}[(]?[0-9]{2,4}[)]?){2,5}(?![0-9])",
    "national": r"(?<![0-9])(?:[(][0-9]{3}[)]\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
KIND_OF = {"national": "phone"}  # a part of a base phone too: shows the trees numbers without a country
CONTEXT_WORDS = {
    "email": r"e-?mail|contact|write|reach|address", "ip": r"\bip\b|host|server|address|login",
    "card": r"card|visa|credit|payment|account", "phone": r"phone|tel|call|mobile|fax|dial",
}
# ----------------------------------------------------------------------------------------------------------------
FEATURES = ("valid", "digits", "length", "groups", "longest", "brackets", "dots", "spaces", "hyphens", "letters", "cue",
            "inside", "kind")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum of a digit string, doubled from the second digit on the right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 1, 2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _small_parts(s: Column) -> Column:
    return F.forall(F.split(s, "[^0-9]+"), lambda p: F.regexp_replace(p, "^0+", "").rlike(
        "^(?:|[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _valid(kind: str, s: Column) -> Column:
    digits = _digits(s)
    if kind == "ip":
        return _small_parts(s)
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _well_formed(kind: str, s: Column) -> Column:
    """The format check of a proposal: a bare "at" needs a dot that is spelled out or bracketed."""
    if kind == "email":
        return s.rlike(r"[@\[({]|\x20(?:dot|DOT)\x20")
    return _valid(kind, s)


def _matches(text: Column, pattern: str, need: str, keep=lambda s: F.lit(True)) -> Column:
    """Matches from the left with their places, those of them that ``keep`` takes.

    What stands between the matches gives the offsets; a dropped match only moves the offset on, so texts with
    very many (short runs of digits, say) cost one step each.
    """
    none = F.array().cast("array<struct<start: int, end: int, text: string>>")
    found = F.when(text.rlike(need), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>"))

    def placed(m: Column) -> Column:
        between = F.split(text, pattern, -1)
        return F.aggregate(
            F.arrays_zip(m.alias("m"), F.slice(between, 1, F.size(m)).alias("b")),
            F.struct(F.lit(0).alias("at"), none.alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"),
                F.when(keep(x["m"]), F.concat(a["spans"], F.array(F.struct(
                    (a["at"] + F.length(x["b"])).alias("start"),
                    (a["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), x["m"].alias("text")))))
                .otherwise(a["spans"]).alias("spans")),
            lambda a: a["spans"])

    return F.transform(F.array(found), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))[0]


def base_spans(text: Column) -> dict[str, Column]:
    """Valid matches of each kind, leftmost and not overlapping; failing matches are dropped without another try."""
    def of(kind: str) -> Column:
        return _matches(text, BASE[kind], NEEDS[kind], lambda s: _valid(kind, s))

    return {k: of(k) for k in KINDS}


def _touches(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def _proposals(text: Column, format: str) -> Column:
    """Spans of a wide format with features, as an array of structs."""
    kind = KIND_OF.get(format, format)
    parts = lambda s: F.filter(F.split(s, "[^0-9A-Za-z]+"), lambda p: p != "")

    def described(x: Column) -> Column:
        s = x["text"]
        count = lambda c: F.length(s) - F.length(F.regexp_replace(s, c, ""))
        before = F.lower(F.substring(text, F.greatest(x["start"] + 1 - CONTEXT, F.lit(1)),
                                     F.least(x["start"], F.lit(CONTEXT))))
        after = F.substring(text, x["end"] + 1, F.lit(1))
        values = {
            "valid": _well_formed(kind, s).cast("double"), "digits": F.length(_digits(s)), "length": F.length(s),
            "groups": F.size(parts(s)),
            "longest": F.aggregate(parts(s), F.lit(0), lambda a, p: F.greatest(a, F.length(p))),
            "brackets": count(r"[()\[\]{}]"), "dots": count(r"\."), "spaces": count(" "), "hyphens": count("-"),
            "letters": count("[A-Za-z]"), "cue": before.rlike(CONTEXT_WORDS[kind]).cast("double"),
            "inside": (F.substring(before, -1, 1).rlike("[A-Za-z0-9]") | after.rlike("[A-Za-z0-9]")).cast("double"),
            "kind": F.lit(float(KINDS.index(kind))),
        }
        return F.struct(F.lit(kind).alias("kind_name"), x["start"].alias("start"), x["end"].alias("end"),
                        *[values[f].cast("double").alias(f) for f in FEATURES])

    return F.transform(_matches(text, WIDE[format], WIDE_NEEDS[format]), described)


# ---- learning ---------------------------------------------------------------------------------------------------

def _tree_sql(lines: list[str], at: int = 0) -> tuple[str, int]:
    """One tree of a model's printed form as nested CASE over {feature} fields."""
    line = lines[at].strip()
    leaf = re.fullmatch(r"Predict: (\S+)", line)
    if leaf:
        return f"double('{float(leaf[1])!r}')", at + 1
    test = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line)
    yes, at = _tree_sql(lines, at + 1)
    no, at = _tree_sql(lines, at + 1)  # past the Else line
    return f"CASE WHEN c.{FEATURES[int(test[1])]} <= double('{float(test[2])!r}') THEN {yes} ELSE {no} END", at


def _margin_sql(model) -> str:
    """The sum of the weighted trees."""
    terms = []
    for tree, weight in zip(model.trees, model.treeWeights):
        lines = [x for x in tree.toDebugString.splitlines()[1:] if x.strip()]
        terms.append(f"double('{float(weight)!r}') * {_tree_sql(lines)[0]}")
    return " + ".join(terms)


def _rewrites(kind: str, s: Column) -> list[Column]:
    """A base span in the wider formats."""
    swap = lambda x, p, r: F.regexp_replace(x, p, r)
    if kind == "email":
        name, host = F.substring_index(s, "@", 1), F.substring_index(s, "@", -1)
        forms = [(" [at] ", " dot "), ("(at)", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("[@]", "[.]")]
        return [F.concat(name, F.lit(at), swap(host, r"\.", dot)) for at, dot in forms]
    if kind == "ip":
        return [swap(s, r"\.", "[.]"), swap(s, r"\.", "(.)")]
    if kind == "card":
        return [swap(_digits(s), "([0-9]{4})(?=[0-9]{2})", "$1" + x) for x in (".", "/", "_", "  ")]
    bare = swap(s, r"^\+", "")
    return [bare, F.concat(F.lit("00"), bare), swap(bare, r"[\x20()-]+", "."), swap(bare, r"[\x20().-]+", "/"),
            swap(bare, r"^[0-9]{1,3}[\x20.-]", "")]


def _examples(part: DataFrame) -> DataFrame:
    """Labelled proposals of the texts ``t``, and of their base spans rewritten: (h, features, label)."""
    covers = lambda c, s: ((c["start"] <= s["start"]) & (s["end"] <= c["end"])
                           | (s["start"] <= c["start"]) & (c["end"] <= s["end"]))
    own = base_spans(F.col("t"))
    named = lambda k: F.transform(own[k], lambda s: F.struct(
        F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text")))
    part = part.select(F.xxhash64("t").alias("h"), "t", F.concat(*[named(k) for k in KINDS]).alias("base"))
    every = lambda t: F.concat(*[_proposals(t, w) for w in WIDE])
    found = F.transform(every(F.col("t")), lambda c: c.withField("label", F.exists(
        "base", lambda s: (s["kind"] == c["kind_name"]) & covers(c, s)).cast("double")))
    seen = part.select("h", F.inline(F.filter(
        found, lambda c: (c["label"] == 1) | (c["valid"] == 0) | _touches(c, F.col("base")))))

    def rewritten(s: Column, form: Column) -> Column:
        before = F.substring(F.col("t"), F.greatest(s["start"] + 1 - CONTEXT, F.lit(1)),
                             F.least(s["start"], F.lit(CONTEXT)))
        return F.struct(s["kind"].alias("base_kind"), F.length(before).alias("at"), F.length(form).alias("size"),
                        F.concat(before, form, F.substring(F.col("t"), s["end"] + 1, F.lit(1))).alias("s"))

    def of(kind: str) -> Column:
        return F.flatten(F.transform(F.filter("base", lambda s: s["kind"] == kind), lambda s: F.array(
            *[rewritten(s, x) for x in _rewrites(kind, s["text"])])))

    snippets = part.select("h", F.inline(F.concat(*[of(k) for k in KINDS])))
    place = F.struct(F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("end"))
    more = F.transform(F.filter(every(F.col("s")), lambda c: _touches(c, F.array(place))), lambda c: c.withField(
        "label", ((F.col("base_kind") == c["kind_name"]) & (c["valid"] == 1) & covers(c, place)).cast("double")))
    seen = seen.unionByName(snippets.select("h", F.inline(more)))
    decoy = seen.where("label = 1").withColumns({"valid": F.lit(0.0), "label": F.lit(0.0)})
    return seen.unionByName(decoy)


def _least_margin(scored: DataFrame) -> float | None:
    """The lowest margin above which precision is kept, from rows (m, label).

    The running precision goes over all steps of a histogram of margins; the
    trees' weights bound them, so there are some thousand steps at most.
    """
    step = F.floor(F.col("m") * STEPS)
    good = n = 0
    least = None
    for r in sorted(scored.groupBy(step.alias("step")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
                    .collect(), key=lambda r: -r["step"]):
        good, n = good + r["good"], n + r["n"]
        if good >= PRECISION * n and r["step"] >= 0:
            least = r["step"] / STEPS
    return least


def learn(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> tuple[str, float] | None:
    """SQL for the margin of a proposal ``c``, and the least margin of an added span; None if there is too little."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.count()
    if not total:
        return None
    mark = F.pmod(F.xxhash64(text), F.lit(1_000_000))
    part = docs.where(mark < max(1, int(1_000_000 * min(1.0, rows / total)))).select(text.alias("t")).distinct()
    seen = written(_examples(part), "proposals")
    fold = F.pmod(F.xxhash64("h", F.lit("fold")), F.lit(5)) == 0
    sizes = seen.where(~fold).groupBy("label").count().collect()
    if len(sizes) < 2 or min(r["count"] for r in sizes) < LEAST_EXAMPLES:
        return None
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3,
                          seed=5).fit(vector.transform(seen.where(~fold)))
    margin = _margin_sql(model)
    own = seen.where(fold).withColumn("c", F.struct(*FEATURES)).withColumn("m", F.expr(margin))
    least = _least_margin(own)
    return None if least is None else (margin, least)


# ---- finding ----------------------------------------------------------------------------------------------------

def find(docs: DataFrame, text_col: str = "text", out: str = "pii", model: tuple[str, float] | None = None) -> DataFrame:
    """``docs`` with a struct: ``base`` and ``added``, arrays of (kind, start, end) by kind and start.

    ``model`` is what :func:`learn` gives; None adds nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    span = "array<struct<kind: string, start: int, end: int>>"
    named = lambda spans, k: F.transform(spans, lambda s: F.struct(
        F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = base_spans(text)
    found, wide = fresh(docs, "__base"), fresh(docs, "__wide")
    df = docs.withColumn(found, F.concat(*[named(base[k], k) for k in KINDS]))
    added = F.array().cast(span)
    if model is not None:
        margin, least = model
        every = F.concat(*[_proposals(text, w) for w in WIDE])
        df = df.withColumn(wide, F.filter(every, lambda c: ~_touches(c, F.col(found))))
        df = df.withColumn(wide, F.expr(
            f"transform(filter({wide}, c -> {margin} >= double('{least!r}')), "
            "c -> named_struct('kind', c.kind_name, 'start', c.start, 'end', c.end))"))
        # of selected proposals of a kind that overlap, the one listed first stays
        added = F.filter(wide, lambda c, i: ~F.exists(
            F.slice(wide, 1, i), lambda s: (s["kind"] == c["kind"]) & (s["start"] < c["end"])
            & (c["start"] < s["end"]))).cast(span)
    df = df.withColumn(out, F.struct(F.col(found).cast(span).alias("base"), added.alias("added")))
    return df.drop(found, wide)


def listed(spans: Column) -> Column:
    """kind:start:end, by kind as listed and start, comma-joined."""
    def of(kind: str) -> Column:
        own = F.transform(F.filter(spans, lambda s: s["kind"] == kind),
                          lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.transform(F.array_sort(own), lambda s: F.concat_ws(
            ":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[of(k) for k in KINDS]), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
