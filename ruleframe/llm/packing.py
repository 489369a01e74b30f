"""Packing of tokenized documents into fixed-length sequences by cutting-stock column generation.

A document's ids (with one end id) are cut into full-length pieces and a
rest.  Piece lengths are rounded up to classes of ``UNIT`` tokens; the
histogram over classes (bounded, whatever the corpus) is the demand of a
cutting-stock problem.  Column generation solves its linear program: a
revised simplex holds one pattern per class, and an unbounded-knapsack
dynamic program prices new patterns.  Rounded-down pattern counts are laid
out as consecutive sequences; the few pieces left over by rounding fill
further sequences, largest piece first.

Every class's pieces are ranked across the cluster (a hot class is ranked in
slices whose offsets are summed), and a rank alone says which sequence a
piece goes to, so assigning needs no shuffle.

Defined results: a NULL or empty text is one piece holding the end id;
repeated rows and NULL ids are packed like any other row; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ruleframe.llm.common import texts, written

SEQUENCE = 2048
UNIT = 8
END_ID = 1
GAP = 5e-4              # the linear program is solved to this relative gap
ROUNDS = 4_000          # pivots at most; stopping earlier only costs padding

# --- fixed values: the byte-level BPE's split pattern -------------------------------
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# -------------------------------------------------------------------------------------


def _byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character; this maps them back."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, for a byte-level BPE ``tokenizers`` file.

    The file's vocabulary is run by tiktoken, about four times as fast, where
    that is the same thing: merges in the order of their ids and the usual
    split.  Any other file is run by tokenizers itself, and so is a text that
    tiktoken gives up on: its split backtracks over whitespace, and a run of
    about a million characters is too much for its stack.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    same = (model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))

    @lru_cache(maxsize=1)
    def tokenizer():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def plain(text: str) -> list[int]:
        return tokenizer().encode(text, add_special_tokens=False).ids

    if not same:
        return plain
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    symbol = _byte_symbols()
    ranks = {bytes(symbol[c] for c in k): v for k, v in vocab.items() if k not in special}
    bpe = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def fast(text: str) -> list[int]:
        try:
            return bpe.encode(text, allowed_special="all")
        except ValueError:
            return plain(text)

    return fast


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
           with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document cut at every ``length``-th id."""
    piece = "start: bigint, length: bigint, ids_crc32: bigint" + (", ids: array<int>" if with_ids else "")

    @F.arrow_udf(f"doc_tokens bigint, pieces array<struct<{piece}>>")
    def cut(text: pa.Array) -> pa.Array:
        encode = encoder(path)
        tokens, starts, lengths, crcs, ids, ends = [], [], [], [], [], [0]
        for t in texts(text):
            a = np.array([*encode(t), END_ID], "<u4")
            data = a.data.cast("B")
            for s in range(0, len(a), length):
                starts.append(s)
                lengths.append(min(length, len(a) - s))
                crcs.append(zlib.crc32(data[4 * s:4 * (s + length)]))
                if with_ids:
                    ids.append(a[s:s + length].astype(np.int32))
            tokens.append(len(a))
            ends.append(len(starts))
        columns = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
        names = ["start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=names))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), rows], names=["doc_tokens", "pieces"])

    rows = docs.select(F.col(id_col).alias("doc_id"), cut.asNondeterministic()(F.col(text_col)).alias("cut"))
    rows = rows.select("doc_id", "cut.doc_tokens", F.inline("cut.pieces"))
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []))


# ---- the cutting-stock problem, on the driver: its size depends on the classes only ----

def _best_pattern(sizes: np.ndarray, value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of sizes that fits."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for w in range(1, room + 1):
        best[w] = best[w - 1]
        k = int(np.searchsorted(sizes, w, side="right"))
        if k:
            gain = value[:k] + best[w - sizes[:k]]
            i = int(gain.argmax())
            if gain[i] > best[w] + 1e-12:
                best[w], taken[w] = gain[i], i
    counts, w = np.zeros(len(sizes)), room
    while w > 0:
        if taken[w] < 0:
            w -= 1
        else:
            counts[taken[w]] += 1
            w -= int(sizes[taken[w]])
    return float(best[room]), counts


def _greedy_pattern(sizes: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """The largest piece left, and a fill of what remains (by the same dynamic program) from pieces left."""
    pattern = np.zeros(len(sizes))
    pattern[np.flatnonzero(left > 0)[-1]] = 1
    while True:
        space = room - int(pattern @ sizes)
        can = np.flatnonzero((left - pattern > 0) & (sizes <= space))
        if not len(can):
            return pattern
        fill = _best_pattern(sizes[can], sizes[can] / room, space)[1]
        pattern[can] += np.minimum(fill, np.ceil(left - pattern)[can])


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Column generation: patterns (rows) and how often each is used, meeting the demand exactly.

    It starts from greedy patterns, each used until a class is spent (so they
    form a triangular basis), and prices with duals drawn towards the best
    bound known, which steadies them.  It stops at the relative gap ``GAP``.
    """
    m = len(sizes)
    patterns, left, alive = np.zeros((m, m)), demand.astype(float), np.ones(m, bool)
    order = np.zeros(m, np.int64)
    for k in range(m):
        # an alive class with nothing left gets a pattern too, used zero times
        patterns[k] = _greedy_pattern(sizes, np.where(alive, np.inf, 0), room)
        inside = np.flatnonzero(patterns[k])
        ratio = left[inside] / patterns[k][inside]
        spent = inside[int(ratio.argmin())]
        left = np.maximum(left - ratio.min() * patterns[k], 0)
        left[spent], alive[spent], order[k] = 0, False, spent
    # Row k uses only classes spent at k or later: inverted by back substitution.  (einsum instead of matrix
    # products throughout: small, and free of BLAS threads, which can hang in a process that also runs a JVM.)
    inverse = np.zeros((m, m))  # of patterns.T: inverse[k] are the duals' shares of pattern k
    for k in range(m):
        row = np.zeros(m)
        row[order[k]] = 1
        row -= np.einsum("i,ij->j", patterns[:k, order[k]], inverse[:k])
        inverse[k] = row / patterns[k, order[k]]
    used = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    centre = sizes / room  # a feasible dual: no pattern is worth more than 1
    bound = float(demand @ centre)
    for _ in range(ROUNDS):
        if used.sum() <= bound * (1 + GAP):
            break
        price = inverse.sum(axis=0)  # every pattern costs one sequence
        for pull in (0.8, 0.4, 0.0):
            dual = pull * centre + (1 - pull) * price
            worth, counts = _best_pattern(sizes, dual, room)
            if worth > 0 and demand @ dual / worth > bound:
                bound, centre = float(demand @ dual / worth), dual / worth
            if price @ counts > 1 + 1e-7:
                break
        else:
            break  # no pattern is worth its cost: optimal
        step = np.einsum("ij,j->i", inverse, counts)
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        patterns[leave] = counts
        used = np.maximum(np.einsum("ij,j->i", inverse, demand), 0)
    return patterns.astype(np.int64), used


def layout(demand: dict[int, int], room: int) -> list[tuple[int, int, int, int]]:
    """(class, first rank, per sequence, first sequence) entries that place every piece; demand by class."""
    sizes = np.array(sorted(demand), np.int64)
    left = np.array([demand[s] for s in sizes.tolist()], np.int64)
    entries, placed, sequence = [], np.zeros(len(sizes), np.int64), 0

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left, placed, sequence
        for c in np.flatnonzero(pattern).tolist():
            entries.append((int(sizes[c]), int(placed[c]), int(pattern[c]), sequence))
        placed, left, sequence = placed + pattern * times, left - pattern * times, sequence + times

    if len(sizes):
        for pattern, times in zip(*fractional_patterns(sizes, left.astype(float), room)):
            inside = pattern > 0
            times = min(int(times + 1e-6), int((left[inside] // pattern[inside]).min()))
            if times > 0:
                use(pattern, times)
    while left.any():  # the few pieces that rounding down leaves over
        pattern = _greedy_pattern(sizes, left, room).astype(np.int64)
        use(pattern, int((left[pattern > 0] // pattern[pattern > 0]).min()))
    return entries


# ---- assigning ranked pieces -------------------------------------------------------------

def _ranked(rows: DataFrame, n: int) -> DataFrame:
    """``rank`` of each row within its class, from 0; slices of a class are ranked apart and offset."""
    slices = max(1, math.isqrt(n))  # balances the rows of a hot class's slice against the slices of a class
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    sizes = rows.groupBy("class", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("class", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("class", "slice").orderBy("row")
    return (rows.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["class", "slice"])
            .withColumn("rank", F.col("offset") + F.col("own")).drop("offset", "own", "slice"))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = SEQUENCE,
         unit: int = UNIT, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one per piece."""
    cut = pieces(docs, path, id_col, text_col, length, with_ids)
    rows = written(cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int"))
                   .withColumn("row", F.monotonically_increasing_id()), "pieces")  # fixed by being written
    demand = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_class: dict[int, list] = {}
    for c, *entry in layout(demand, length // unit):
        by_class.setdefault(c, []).append(entry)
    places = docs.sparkSession.sparkContext.broadcast(
        {c: np.array(sorted(e), np.int64).T for c, e in by_class.items()})

    @F.arrow_udf("bigint")
    def sequence_of(klass: pa.Array, rank: pa.Array) -> pa.Array:
        c, r = klass.to_numpy(), rank.to_numpy()
        out = np.empty(len(c), np.int64)
        for k in np.unique(c).tolist():
            own = c == k
            first, per, sequence = places.value[k]
            e = np.searchsorted(first, r[own], side="right") - 1
            out[own] = sequence[e] + (r[own] - first[e]) // per[e]
        return pa.array(out)

    placed = _ranked(rows, sum(demand.values())).withColumn("sequence_id", sequence_of("class", "rank"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row").rowsBetween(
        Window.unboundedPreceding, -1)  # at most `length` pieces share a sequence
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                         *(["ids"] if with_ids else []))
