"""Line deduplication by content-defined chunks of lines, in DataFrame functions only.

A document's lines are cut into chunks where a rolling hash over the last
``ROLL`` line hashes is a multiple of ``DIVISOR``, and around every long line:
the cuts depend on the lines themselves, so text inserted above moves no
later cut.  A chunk (several lines, or one long line) found more than once in
the corpus keeps its first occurrence, in the order of doc_id and then line;
the others are removed after their bytes were compared.  From a removed chunk
the removal goes on over neighbouring lines as long as each pair of lines is
itself such a repeat, which takes in the ragged ends of a passage.  A run of
``RUN_PAIRS`` or more repeated pairs whose lines hold ``LEAST_BYTES`` together
is a repeated chunk too, wherever the cuts fell; blank lines and closing
brackets that code, poems and tables share are none.

Chunks are found by hash: only keys are aggregated, and only texts of
repeated chunks are compared.  Documents are joined once.

Defined results: a NULL text stays NULL; a document all of whose lines are
removed has the text ''; short repeats (under ``LEAST_BYTES``) stay; rows
with equal id and text are one document, each kept with the same text; NULL
ids come first; other columns pass through (those named like the added ones
are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import fresh, written

ROLL = 2
DIVISOR = 2
LONG_BYTES = 64      # a line of at least so many bytes is a chunk of its own
LEAST_BYTES = 48     # of a chunk that may be removed
RUN_PAIRS = 4        # so many repeated pairs of lines in a row count as a repeated chunk
CHUNK, PAIR = 1, 2


def _hash(*columns: Column) -> Column:
    return F.xxhash64(*columns)


def _keys(text: Column) -> Column:
    """Array of (kind, start, size, key): chunks that may be removed, and pairs of lines.

    Two long lines are no pair: each is a chunk, found by itself.
    """
    lines = F.split(text, "\n", -1)
    rows = F.transform(lines, lambda x: F.struct(_hash(x).alias("h"), F.octet_length(x).alias("n")))

    def keyed(line: Column) -> Column:
        n = F.size(line)
        at = lambda i: F.get(line, i)

        def rolled(i: Column) -> Column:
            h = at(i)["h"]
            for back in range(1, ROLL):
                h = _hash(h, at(i - F.lit(back))["h"])
            return h

        def cut_before(i: Column) -> Column:
            return ((i == 0) | (at(i)["n"] >= LONG_BYTES) | (at(i - 1)["n"] >= LONG_BYTES)
                    | (F.pmod(rolled(i - 1), F.lit(DIVISOR)) == 0))

        starts = F.filter(F.sequence(F.lit(0), n - 1), cut_before)
        return F.transform(F.array(starts), lambda s: F.concat(
            F.filter(F.transform(s, lambda b, j: chunk(line, b, F.coalesce(F.get(s, j + 1), n))),
                     lambda c: c["key"].isNotNull()),
            F.transform(F.filter(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")),
                                 lambda i: F.least(at(i)["n"], at(i + 1)["n"]) < LONG_BYTES),
                        lambda i: F.struct(F.lit(PAIR).alias("kind"), i.alias("start"), F.lit(2).alias("size"),
                                           _hash(F.lit(PAIR), at(i)["h"], at(i + 1)["h"]).alias("key")))))[0]

    def chunk(line: Column, start: Column, end: Column) -> Column:
        part = F.slice(line, start + 1, end - start)
        size = F.aggregate(part, F.lit(0), lambda a, x: a + x["n"])
        return F.struct(F.lit(CHUNK).alias("kind"), start.alias("start"), (end - start).alias("size"),
                        F.when(size >= LEAST_BYTES, _hash(F.lit(CHUNK), F.transform(part, lambda x: x["h"])))
                        .alias("key"))

    # bound once through one-element arrays: an expression used twice would be computed twice
    return F.transform(F.array(rows), keyed)[0]


def _with_texts(lines: Column, found: Column) -> Column:
    """Each repeat with its own text; the lines are split once and not carried along with every repeat."""
    return F.transform(F.array(lines), lambda own: F.transform(found, lambda f: F.struct(
        *[f[c].alias(c) for c in ("kind", "start", "size", "key", "is_first")],
        F.array_join(F.slice(own, f["start"] + 1, f["size"]), "\n").alias("text"))))[0]


def _marks(found: Column, kind: int) -> Column:
    return F.array_sort(F.transform(F.filter(found, lambda x: x["kind"] == kind),
                                    lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"))))


def _strong_runs(pairs: Column, lines: Column) -> Column:
    """Marks of the runs of RUN_PAIRS or more repeated pairs in a row whose lines hold LEAST_BYTES together."""
    starts = F.transform(pairs, lambda m: m["start"])

    def runs(s: Column) -> Column:
        first = F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1) != x - 1, F.lit(True)))
        last = F.filter(s, lambda x, j: F.coalesce(F.get(s, j + 1) != x + 1, F.lit(True)))
        return F.zip_with(first, last, lambda a, z: F.struct(a.alias("start"), (z - a + 2).alias("size")))

    def sized(r: Column) -> Column:
        return F.aggregate(F.slice(lines, r["start"] + 1, r["size"]), F.lit(0), lambda n, x: n + F.octet_length(x))

    # the starts are bound once, through a one-element array
    found = F.transform(F.array(starts), runs)[0]
    return F.filter(F.filter(found, lambda r: r["size"] > RUN_PAIRS), lambda r: sized(r) >= LEAST_BYTES)


def _kept_lines(lines: Column, found: Column) -> Column:
    """Lines left of a document with ``found`` repeats: R marks a removed line, = a repeated pair."""
    n = F.size(lines)

    def runs(marks: Column, size: Column | int, gap: str, mark: str) -> Column:
        def end(m):
            return m["start"] + (m["size"] if size is None else F.lit(size))

        # bound once, as above: the marks would be sorted anew for each of them
        done = F.transform(F.array(marks), lambda ms: F.array_join(F.transform(ms, lambda m, j: F.concat(
            F.repeat(F.lit(gap), m["start"] - F.coalesce(end(F.get(ms, j - 1)), F.lit(0))),
            F.repeat(F.lit(mark), m["size"] if size is None else F.lit(size)))), ""))[0]
        return F.rpad(F.coalesce(done, F.lit("")), n, gap)

    chunk = F.split(runs(_marks(found, CHUNK), None, "k", "R"), "")
    pairs = _marks(found, PAIR)
    pair = F.split(runs(pairs, 1, "-", "="), "")
    run = F.split(runs(_strong_runs(pairs, lines), None, "k", "R"), "")
    both = F.transform(F.array(F.struct(chunk.alias("chunk"), run.alias("run"), pair.alias("pair"))), lambda z: F.array_join(
        F.transform(F.slice(z["chunk"], 1, n), lambda c, i: F.concat(
            F.least(c, F.get(z["run"], i)), F.get(z["pair"], i))), ""))[0]  # R sorts before k
    spread = lambda s: F.regexp_replace(s, r"((?<=R)=|\G(?!^)=)k", "$1R")
    # both ways over the string of "line pair line pair ..."; the last pair sign is none
    onward = spread(F.substring(both, F.lit(1), 2 * n - 1))
    return F.transform(F.array(F.split(F.reverse(spread(F.reverse(onward))), "")), lambda s: F.filter(
        lines, lambda x, i: F.get(s, 2 * i) == "k"))[0]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text left, and n_lines and n_removed (lines before, and removed)."""
    docs = docs.drop("n_lines", "n_removed")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    # other columns travel as one, whatever their names
    packed = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"),
                         F.struct(F.lit(0).alias(fresh(docs, "none")), *[F.col(f"`{c}`") for c in others]).alias("row"))
    out = _deduplicated(packed, "doc", "text")
    own = {id_col: F.col("doc"), text_col: F.col("text")}
    return out.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns], "n_lines", "n_removed")


def _deduplicated(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = docs.withColumn("__h", _hash(F.col(text_col)))
    key = [F.col(id_col).alias("id"), F.col("__h").alias("h")]
    keys = (own.where(F.col(text_col).isNotNull()).select(*key, F.inline(_keys(F.col(text_col))))
            .select("id", "h", "kind", "start", "size", "key"))
    repeats = written(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "h", "start")).alias("first"))
        .where("n > 1").select("key", "first"), "repeats")
    found = keys.join(repeats, "key").select(
        "id", "h", "kind", "start", "size", "key",
        (F.struct("id", "h", "start").eqNullSafe(F.col("first"))).alias("is_first"))
    found = found.groupBy(F.col("id").alias("__id"), F.col("h").alias("__hh")).agg(F.collect_set(F.struct("kind", "start", "size", "key", "is_first"))
                                         .alias("__found"))  # at most two entries for a line
    joined = written(own.join(found, own[id_col].eqNullSafe(found["__id"]) & (own["__h"] == found["__hh"]), "left")
                     .drop("__id", "__hh"), "lines")
    lines = F.split(F.col(text_col), "\n", -1)
    # byte comparison: a key whose occurrences hold more than one text is no repeat by itself
    texts = (joined.where(F.col("__found").isNotNull())
             .select(F.col(id_col).alias("id"), "__h", F.inline(_with_texts(lines, F.col("__found")))))
    mixed = written(texts.groupBy("key", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
                    .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "mixed")
    repeated = F.filter("__found", lambda x: ~x["is_first"])
    if not mixed.isEmpty():  # hash collisions: there the first occurrence counts for each text apart
        odd = texts.join(mixed, "key", "left_semi")
        first = odd.groupBy("key", "text").agg(F.min(F.struct("id", "__h", "start")).alias("first"))
        late = (odd.join(first, ["key", "text"])
                .where(~F.struct("id", "__h", "start").eqNullSafe(F.col("first")))
                .select("id", F.col("__h").alias("h"), F.struct("kind", "start", "size", "key").alias("f")).distinct()
                .groupBy(F.col("id").alias("__id"), F.col("h").alias("__hh")).agg(F.collect_list("f").alias("__late")))
        fine = (texts.join(mixed, "key", "left_anti").where(~F.col("is_first"))
                .select("id", F.col("__h").alias("h"), F.struct("kind", "start", "size", "key").alias("f")).distinct()
                .groupBy(F.col("id").alias("__id"), F.col("h").alias("__hh")).agg(F.collect_list("f").alias("__fine")))
        for part in (late, fine):
            joined = joined.join(part, joined[id_col].eqNullSafe(part["__id"]) & (joined["__h"] == part["__hh"]),
                                 "left").drop("__id", "__hh")
        none = F.array().cast(joined.schema["__late"].dataType)
        repeated = F.concat(F.coalesce("__late", none), F.coalesce("__fine", none))
    touched = (F.exists(repeated, lambda x: x["kind"] == CHUNK)
               | (F.size(F.filter(repeated, lambda x: x["kind"] == PAIR)) >= RUN_PAIRS))
    left = F.when(touched, _kept_lines(lines, repeated)).otherwise(lines)
    return (joined.withColumn("__left", left)
            .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("bigint"))
            .withColumn("n_removed", F.when(F.col(text_col).isNull(), 0)
                        .otherwise(F.size(lines) - F.size("__left")).cast("bigint"))
            .withColumn(text_col, F.array_join("__left", "\n"))
            .select(*[c for c in own.columns if c != "__h"], "n_lines", "n_removed"))
