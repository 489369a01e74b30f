"""SimHash near-duplicates found with pivot distance tables.

A document's fingerprint takes, bit by bit, the majority of its shingle
hashes.  Documents link when their fingerprints differ in at most
``distance`` bits; linked documents form a component.

Work is done on distinct fingerprints, so exact copies cost nothing.  By the
triangle inequality two fingerprints within ``distance`` bits differ by at
most that much in their Hamming distances to any reference fingerprint
(pivot).  A pivot therefore splits a set of fingerprints in two: those up to
a middle distance, and those above it less the link distance; a linked pair
meets in at least one half.

The first splits are made for all at once, by fixed pivots and their middle
distances in the whole table, until a cell should hold ``CELL_AIM``
fingerprints.  Cells that came out larger than ``CELL_ROWS`` are then split
by pivots chosen among their own fingerprints, at the distance that leaves
the smallest larger half, round by round until they fit.  In a cell the
distances to ``CHECK_PIVOTS`` pivots are tabulated; pairs are discarded by the
largest difference of their coordinates, and the survivors verified by their
bits.

A cell that none of its pivots splits by a fifth (a dense cluster of near
copies) is solved exactly without pairs: two fingerprints are within 2 bits
just if one fingerprint lies within 1 bit of both, so each goes to the 65
fingerprints around it and those that meet are linked through the smallest.

Defined results: a NULL or blank text has fingerprint zero, linked like any
other; repeated rows each get a row, with the same component; NULL ids get
the component of their fingerprint; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleframe.llm.common import texts, written
from ruleframe.llm.graphs import components

CHECK_PIVOTS = 12     # coordinates tabulated in a cell
CELL_AIM = 2_048      # expected fingerprints of a cell after the first splits
CELL_ROWS = 4_096     # above this a cell is split again
OWN_PIVOTS = 3        # fingerprints of a cell tried as its next pivot
SPLIT = 0.8           # of a cell its larger half may hold; else the cell is dense
BROADCAST_CELLS = 500_000
BLOCK = 64            # rows of a cell compared with the others at a time
BITS = 64


def shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) < k:
        return [b" ".join(words)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [joined[s:e] for s, e in zip(starts, ends[k - 1:])]


def fingerprint(text: str, k: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the A-Z lower-cased text's word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
    digest = xxhash.xxh64_digest
    h = b"".join([digest(x, seed) for x in shingles(words, k)])
    n = len(h) // 8
    if not n:
        return 0
    # big-endian bytes: the first unpacked column is the highest bit
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        block = np.frombuffer(h, np.uint8, count=8 * min(1 << 16, n - at), offset=8 * at).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                 mark: Column | None = None) -> DataFrame:
    """Rows (doc_id, fp[, mark]) of all documents; ``mark`` is any further small expression over a row."""

    @F.arrow_udf("bigint")
    def simhash(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t, k) for t in texts(text)], pa.int64())

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp"),
                       *([] if mark is None else [mark.alias("mark")]))


def pivots(n: int) -> list[int]:
    """Reference fingerprints by a fixed rule: the signed XXH64 of 'pivot 0', 'pivot 1', ..."""
    return [int.from_bytes(xxhash.xxh64_digest(f"pivot {i}".encode()), "big", signed=True) for i in range(n)]


def _distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot).cast("bigint")))


def _middle(counts: np.ndarray, distance: int) -> tuple[int, float, float]:
    """(middle distance, shares of the two halves) that leave the smallest larger half, of a histogram of distances."""
    below = np.cumsum(counts) / max(1, counts.sum())
    upper = 1 - np.r_[np.zeros(distance), below[:-distance]]
    at = int(np.argmin(np.maximum(below, upper)))
    return at, float(below[at]), float(upper[at])


def cells(fps: DataFrame, n: int, distance: int, aim: int = CELL_AIM) -> DataFrame:
    """Rows (cell, fp) for each cell that a fingerprint goes to; ``n`` fingerprints are expected in all."""
    refs = pivots(max(0, math.ceil(math.log(max(1, n / aim)) / math.log(1.5))))
    if not refs:
        return fps.select(F.lit(0).cast("bigint").alias("cell"), "fp")
    far = F.posexplode(F.array(*[_distance(F.col("fp"), p) for p in refs]))
    counts = np.zeros((len(refs), BITS + 1), np.int64)
    for r in fps.select(far.alias("pivot", "far")).groupBy("pivot", "far").count().collect():  # 65 rows a pivot
        counts[r["pivot"], r["far"]] = r["count"]
    grid = [(p, *_middle(c, distance)) for p, c in zip(refs, counts)]

    def assign(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            cell, expected = np.zeros(len(fp), np.uint64), np.full(len(fp), float(n))
            for pivot, middle, lower, upper in grid:
                far = np.bitwise_count((fp ^ np.int64(pivot)).view(np.uint64)).astype(np.int64)
                open_ = expected > aim  # the others stay where they are
                low, high = np.flatnonzero(open_ & (far <= middle)), np.flatnonzero(open_ & (far > middle - distance))
                done = np.flatnonzero(~open_)
                fp = np.concatenate([fp[done], fp[low], fp[high]])
                step = cell * np.uint64(0x9E3779B97F4A7C15)  # wraps: cells that collide are only larger
                cell = np.concatenate([cell[done], step[low] + np.uint64(1), step[high] + np.uint64(2)])
                expected = np.concatenate([expected[done], expected[low] * lower, expected[high] * upper])
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp)], names=["cell", "fp"])

    return fps.select("fp").mapInArrow(assign, "cell bigint, fp bigint")


def _split(crowded: DataFrame, n_cells: int, distance: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the halves, rows of cells that no own pivot splits) of written rows (cell, fp, n)."""
    own = crowded.groupBy("cell", "n").agg(F.array_distinct(F.array(
        *[F.min_by("fp", F.xxhash64("fp", F.lit(turn * OWN_PIVOTS + i))) for i in range(OWN_PIVOTS)])).alias("pivots"))
    small = (lambda df: F.broadcast(df)) if n_cells <= BROADCAST_CELLS else (lambda df: df)
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))).alias("far")
    counts = (crowded.join(small(own.select("cell", "pivots")), "cell")
              .select("cell", "n", "fp", F.explode("pivots").alias("pivot"))
              .select("cell", "n", "pivot", far).groupBy("cell", "n", "pivot", "far").agg(F.count(F.lit(1)).alias("c")))
    by = Window.partitionBy("cell", "pivot").orderBy("far")  # at most 65 rows
    upto = F.sum("c").over(by.rangeBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("c").over(by.rangeBetween(Window.unboundedPreceding, -distance)), F.lit(0))
    sizes = counts.select("cell", "n", "pivot", "far", F.greatest(upto, F.col("n") - before).alias("larger"))
    best = written(sizes.groupBy("cell", "n").agg(
        F.min_by(F.struct("pivot", F.col("far").alias("middle"), "larger"), F.struct("larger", "pivot", "far")).alias("s"))
        .select("cell", "s.pivot", "s.middle", (F.col("s.larger") <= SPLIT * F.col("n")).alias("splits")), "pivots")
    rows = crowded.select("cell", "fp").join(small(best), "cell").select("cell", "fp", "middle", "splits", far)
    halves = rows.where("splits").select(F.explode(F.filter(F.array(
        F.when(F.col("far") <= F.col("middle"), F.xxhash64("cell", F.lit(2 * turn))),
        F.when(F.col("far") > F.col("middle") - distance, F.xxhash64("cell", F.lit(2 * turn + 1)))),
        lambda c: c.isNotNull())).alias("cell"), "fp")
    return halves, rows.where(~F.col("splits")).select("fp")


def partition(fps: DataFrame, n: int, distance: int, cell_rows: int = CELL_ROWS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Written rows (cell, fp) of cells that fit, and rows (fp) of dense ones, which keep each linked pair together."""
    fit, dense, turn = [], [], 0
    rows = written(cells(fps, n, distance, max(1, min(CELL_AIM, cell_rows // 2))), "cells")
    while True:
        sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        n_cells = sizes.where(F.col("n") > cell_rows).count()
        if not n_cells:
            fit.append(rows)
            return fit, dense
        sizes = written(sizes, "sizes")
        fit.append(rows.join(sizes.where(F.col("n") <= cell_rows).select("cell"), "cell", "left_semi"))
        crowded = sizes.where(F.col("n") > cell_rows)
        crowded = written(rows.join(F.broadcast(crowded) if n_cells <= BROADCAST_CELLS else crowded, "cell"), "crowded")
        halves, left = _split(crowded, n_cells, distance, turn)
        rows, turn = written(halves, "cells"), turn + 1
        dense.append(left)


def close_pairs(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within ``distance`` bits: by their largest coordinate difference, then their bits."""
    far = [np.bitwise_count((fp ^ np.int64(p)).view(np.uint64)).astype(np.int8) for p in pivots(CHECK_PIVOTS)]
    order = np.argsort(far[0], kind="stable")
    far, bits, found = [c[order] for c in far], fp[order], [(np.empty(0, np.int64),) * 2]
    for at in range(0, len(fp), BLOCK):
        # sorted by the first coordinate: what may be close lies behind, up to the link distance
        last = min(len(fp), at + BLOCK)
        end = int(np.searchsorted(far[0], far[0][last - 1] + distance, "right"))
        near = np.arange(at, last)[:, None] < np.arange(at, end)
        for c in far[1:4]:
            near &= np.abs(c[at:last, None] - c[at:end]) <= distance
        x, y = np.nonzero(near)
        x, y = x + at, y + at
        for c in far[4:]:
            stays = np.abs(c[x] - c[y]) <= distance
            x, y = x[stays], y[stays]
        stays = np.bitwise_count((bits[x] ^ bits[y]).view(np.uint64)) <= distance
        found.append((x[stays], y[stays]))
    x, y = (np.concatenate(c) for c in zip(*found))
    return order[x], order[y]


def _spanning(n: int, x: np.ndarray, y: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of n places as one link from each linked fingerprint to the smallest of its component."""
    rank = np.argsort(np.argsort(fp))
    root = rank.copy()
    while len(x):
        low, old = np.minimum(root[x], root[y]), root.copy()
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        if (root == old).all():
            break
    linked = np.flatnonzero(root != rank)
    return np.argsort(rank)[root[linked]], linked


def links(fps: DataFrame, distance: int = 2, cell_rows: int = CELL_ROWS, spanning: bool = False) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly those within ``distance`` bits.

    Pairs found in cells are all given, or with ``spanning`` one for each
    fingerprint that has any; in dense cells a spanning set of them.
    """
    if distance != 2:
        raise ValueError("dense cells are solved for a distance of 2")
    fps = written(fps.select("fp").distinct(), "fingerprints")
    fit, dense = partition(fps, fps.count(), distance, cell_rows)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        fp = np.unique(group.column("fp").to_numpy())  # cells may collide
        x, y = close_pairs(fp, distance)
        if spanning:
            x, y = _spanning(len(fp), x, y, fp)
        a, b = fp[x], fp[y]
        return pa.table([np.minimum(a, b), np.maximum(a, b)], schema=schema)

    pairs = reduce(DataFrame.unionByName, fit).groupBy("cell").applyInArrow(search, "a bigint, b bigint").distinct()
    if not dense:
        return pairs
    around = F.concat(F.array("fp"), F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))))
    met = (reduce(DataFrame.unionByName, dense).distinct().select("fp", F.explode(around).alias("ball")).groupBy("ball")
           .agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 in a ball
           .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3,
                    distance: int = 2, mark: Column | None = None) -> DataFrame:
    """Rows (doc_id, fp, component_id, root[, mark]).

    component_id is the smallest doc_id reachable over links, the document's
    own included; root is the smallest fingerprint, which names components
    without ids apart.
    """
    prints = written(fingerprints(docs, id_col, text_col, k, mark), "simhash")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = components(links(prints, distance, spanning=True), "a", "b")
    rooted = first.join(nodes, first["fp"] == nodes["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "root", *prints.columns[2:])


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
