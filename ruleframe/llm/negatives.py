"""Hard negatives of anchor vectors, by exact integer products in tiles.

Components become integers, floor(scale * x); the score of a row for an
anchor is their inner product.  An anchor's positives are the best rows of
its label; the negatives of (anchor, positive) are the best rows of other
labels whose score lies in a window below the positive's.

Anchors are the stated query set.  They are written in blocks of bounded size
and each block goes over all rows twice, first for the positives, then for
the windows that these open.  A task multiplies anchors and rows in tiles by
Strassen's recursion (seven products of half the size instead of eight; odd
sides padded with zeros).  The additions are on 64-bit integers, exact modulo
2**64, so the products are exact wherever they fit.  Each tile's scores go
into heaps of bounded size, one for each anchor or each anchor and positive:
what can't enter a full heap is dropped, heaps of different tiles merge by
score and id, and those of the tasks are merged by the same order in Spark.
A label held by a third of the rows needs no care: nothing is grouped by it.

Defined results: rows with a NULL label, or a vector that is NULL, empty,
holds a NULL or non-finite component or differs in length from the anchors,
take no part; a NULL id is no anchor and comes last among ties (it is shown
as NULL, as is the id 2**63 - 1); repeated rows are rows of their own, so
repeated anchors each get their results and a copy of an anchor can be its
positive; ties go to the smaller id, then to the earlier written row; an
anchor without positives, or a positive with an empty window, gives no row;
other columns are ignored; an empty table gives an empty result.  Components
beyond ``limit`` raise.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ruleframe.llm.common import integer_vectors, largest, written
from ruleframe.sources.io import scratch_path

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
WINDOW = (80, 100)        # percent of the positive's score
BLOCK_ANCHORS = 16_384    # sent to the tasks at once: 8 MB of 64 components
TILE = (256, 512)         # anchors x rows multiplied at a time
LEAF = 16                 # no further recursion at or below this side
LAST = 2**63 - 1          # stands for a NULL id in the order of ties


def limit(dims: int) -> int:
    """Largest absolute integer for which a hundredfold score stays in 64 bits."""
    return math.isqrt((2**63 - 1) // (100 * dims))


def product(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b on int64 by Strassen's recursion; right wherever the entries of the result fit."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    if (m, k, n) != (2 * hm, 2 * hk, 2 * hn):
        a = np.pad(a, ((0, 2 * hm - m), (0, 2 * hk - k)))
        b = np.pad(b, ((0, 2 * hk - k), (0, 2 * hn - n)))
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    p1 = product(a11 + a22, b11 + b22, leaf)
    p2 = product(a21 + a22, b11, leaf)
    p3 = product(a11, b12 - b22, leaf)
    p4 = product(a22, b21 - b11, leaf)
    p5 = product(a11 + a12, b22, leaf)
    p6 = product(a21 - a11, b11 + b12, leaf)
    p7 = product(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * hm, 2 * hn), np.int64)
    out[:hm, :hn] = p1 + p4 - p5 + p7
    out[:hm, hn:] = p3 + p5
    out[hm:, :hn] = p2 + p4
    out[hm:, hn:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """The best ``size`` (score, id, row) of each slot: higher scores first, then smaller ids and rows."""

    def __init__(self, slots: int, size: int):
        self.size = size
        self.floor = np.full(slots, -2**63, np.int64)  # scores below can't enter
        self.slot = self.score = self.id = self.row = np.empty(0, np.int64)

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        enters = score >= self.floor[slot]
        slot, score, ids, rows = (np.concatenate([old, new[enters]]) for old, new in
                                  ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, rows)))
        order = np.lexsort((rows, ids, -score, slot))
        slot = slot[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.empty(0, np.int64)
        rank = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        stays = order[rank < self.size]
        last = order[rank == self.size - 1]
        self.floor[slot[rank == self.size - 1]] = score[last]
        self.slot, self.score, self.id, self.row = slot[rank < self.size], score[stays], ids[stays], rows[stays]


class Block:
    """Some anchors: row numbers, ids, labels and integer vectors."""

    def __init__(self, rows, ids, labels, vectors):
        self.rows, self.ids, self.labels, self.vectors = rows, ids, labels, vectors

    def tiles(self, batch: pa.RecordBatch, own_label: bool):
        """(anchor numbers, row numbers, ids, scores, whether labels are equal), a tile at a time.

        With ``own_label`` only tiles of one label are multiplied.
        """
        row, ids, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, self.vectors.shape[1])
        every = np.arange(len(self.rows)), np.arange(len(row))
        groups = ((np.flatnonzero(self.labels == x), np.flatnonzero(label == x))
                  for x in np.unique(label)) if own_label else [every]
        for anchors, others in groups:
            for i in range(0, len(anchors), TILE[0]):
                a = anchors[i:i + TILE[0]]
                for j in range(0, len(others), TILE[1]):
                    c = others[j:j + TILE[1]]
                    yield (a, row[c], ids[c], product(self.vectors[a], vectors[c].T),
                           self.labels[a][:, None] == label[c][None, :])


def _best(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The tasks' heaps merged: the first ``size`` rows of each key, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id", "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def _positives(rows: DataFrame, block: Block, size: int) -> DataFrame:
    """Rows (anchor, rank, id, row, score): the best other rows of each anchor's label."""

    def search(batches):
        heaps = Heaps(len(block.rows), size)
        for batch in batches:
            for a, row, ids, score, _ in block.tiles(batch, own_label=True):
                x, y = np.nonzero((score >= heaps.floor[a][:, None]) & (block.rows[a][:, None] != row[None, :]))
                heaps.merge(a[x], score[x, y], ids[y], row[y])
        yield pa.RecordBatch.from_pydict({"anchor": heaps.slot, "score": heaps.score, "id": heaps.id, "row": heaps.row})

    found = rows.mapInArrow(search, "anchor bigint, score bigint, id bigint, row bigint")
    return _best(found, ["anchor"], size)


def _negatives(rows: DataFrame, block: Block, positives: list, size: int, window: tuple[int, int]) -> DataFrame:
    """Rows (anchor_id, positive_id, positive_score, rank, id, score): each window's best rows of other labels."""
    by = sorted((r["anchor"], r["rank"], r["id"], r["score"]) for r in positives)
    anchor, rank, positive, high = (np.array(c, np.int64) for c in zip(*by))
    low, high = -((-window[0] * high) // 100), window[1] * high // 100  # whole scores inside the window
    own = np.array([r[3] for r in by], np.int64)
    first, last = (np.searchsorted(anchor, np.arange(len(block.rows)), side) for side in ("left", "right"))

    def search(batches):
        heaps = Heaps(len(anchor), size)
        for batch in batches:
            for a, row, ids, score, same in block.tiles(batch, own_label=False):
                for k in range(int((last - first)[a].max())):  # the k-th positive of all anchors at once
                    has = np.flatnonzero(last[a] - first[a] > k)
                    slot = first[a[has]] + k
                    s = score[has]
                    least = np.maximum(low[slot], heaps.floor[slot])
                    x, y = np.nonzero((s >= least[:, None]) & (s <= high[slot][:, None]) & ~same[has])
                    heaps.merge(slot[x], s[x, y], ids[y], row[y])
        yield pa.RecordBatch.from_pydict({
            "anchor": block.rows[anchor[heaps.slot]], "place": rank[heaps.slot],
            "anchor_id": block.ids[anchor[heaps.slot]], "positive_id": positive[heaps.slot],
            "positive_score": own[heaps.slot], "score": heaps.score, "id": heaps.id, "row": heaps.row})

    found = rows.mapInArrow(search, "anchor bigint, place bigint, anchor_id bigint, positive_id bigint, "
                                    "positive_score bigint, score bigint, id bigint, row bigint")
    return _best(found, ["anchor", "place"], size)


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
         label: Column | str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES,
         window: tuple[int, int] = WINDOW, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` tells the anchors, ``label`` is a column or an integer expression over the rows.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    own = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
                         F.col(vector_col).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    sound = integer_vectors(own.where(F.col("label").isNotNull()), "x", scale, "v").drop("x")
    rows = written(sound.withColumn("row", F.monotonically_increasing_id()), "vectors")
    chosen = rows.where(F.col("anchor") & F.col("id").isNotNull())
    n, dims = chosen.agg(F.count(F.lit(1)), F.min_by(F.size("v"), F.struct("id", "v"))).first()
    out = scratch_path(spark, "negatives")
    columns = ("anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, "
               "negative_score bigint")
    spark.createDataFrame([], columns).write.parquet(out)
    if n:
        rows = rows.where(F.size("v") == dims)
        most = rows.agg(largest(F.col("v"))).first()[0]
        if most > limit(dims):
            raise ValueError(f"component {most} is beyond {limit(dims)}")
        # dealt evenly, so a written part holds about block_anchors of them
        parts = written(rows.where(F.col("anchor") & F.col("id").isNotNull()).repartition(-(-n // block_anchors))
                        .withColumn("part", F.spark_partition_id()), "anchors")
        tied = rows.select("row", F.coalesce("id", F.lit(LAST)).alias("id"), "label", "v")
        for part in sorted(r["part"] for r in parts.select("part").distinct().collect()):
            held = parts.where(F.col("part") == part).orderBy("row").select("row", "id", "label", "v").toArrow()
            block = Block(*(held[c].to_numpy() for c in ("row", "id", "label")),
                          np.concatenate([c.flatten().to_numpy() for c in held["v"].chunks]).reshape(-1, dims))
            found = _positives(tied, block, positives).collect()  # bounded: a block's anchors times positives
            if found:
                shown = F.when(F.col("id") != LAST, F.col("id"))
                (_negatives(tied, block, found, negatives, window).select(
                    "anchor_id", F.when(F.col("positive_id") != LAST, F.col("positive_id")).alias("positive_id"),
                    F.col("rank").cast("int").alias("rank"), shown.alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")).write.mode("append").parquet(out))
    return spark.read.schema(columns).parquet(out)
