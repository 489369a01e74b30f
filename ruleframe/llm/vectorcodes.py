"""Vectors compressed to short codes: one codebook entry for each of their equal parts.

Components become integers, floor(scale * x); a vector is cut into equal
consecutive parts and each part is named by the nearest entry of its
position's codebook (squared distance, ties to the lower entry).  The
codebooks start from the vectors with the smallest ids and are moved to the
floor of their parts' mean for a number of rounds.

Distances come from value dictionaries.  A task takes its vectors a chunk at
a time; every dimension of the chunk gets the list of its distinct integers
and each vector the place of its own in that list.  The squared differences
of the distinct integers to all entries are tabulated once, and the distances
of the parts are gathered from the tables and added: no multiplication for
each vector.  A dictionary holds no more than the chunk has rows, whatever
the table's range, so nothing that grows is broadcast: rounds send the
entries out (parts x entries x width integers) and one sum for each entry and
task back.

Defined results: vectors that are NULL or empty, hold a NULL or non-finite
component, or differ in length from the one with the smallest id are dropped;
repeated rows each get a row; rows with equal ids are started from in the
order of their components; a NULL id never starts an entry, its row is coded
like any other; fewer rows than entries make fewer entries; if no row has an
id, codes and errors are NULL; other columns are ignored; an empty table
gives an empty result.  Components beyond ``limit`` (where distances would
leave 64 bits) raise.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import integer_vectors, largest, written

SCALE = 4_096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK_ROWS = 1 << 15  # vectors that share dictionaries; bounds a task's memory


def limit(dims: int) -> int:
    """Largest absolute integer for which the distances of whole vectors stay in 64 bits."""
    return math.isqrt((2**63 - 1) // dims) // 2


def dictionary(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct integers ascending, place of each row's integer among them)."""
    low, high = int(column.min()), int(column.max())
    if high - low > 4 * len(column) + (1 << 16):  # a wide range: by sorting
        return np.unique(column, return_inverse=True)
    present = np.zeros(high - low + 1, bool)
    present[column - low] = True
    return np.flatnonzero(present) + low, (np.cumsum(present) - 1)[column - low]


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each rows x parts, of integer vectors under books (parts x entries x width)."""
    n, (parts, entries, width) = len(vectors), books.shape
    codes, errors = np.empty((n, parts), np.int64), np.empty((n, parts), np.int64)
    for p in range(parts):
        total = np.zeros((n, entries), np.int64)
        for k in range(width):
            values, place = dictionary(vectors[:, p * width + k])
            table = (values[:, None] - books[p, :, k]) ** 2
            total += table[place]
        codes[:, p] = total.argmin(axis=1)  # the first of equal entries
        errors[:, p] = np.take_along_axis(total, codes[:, p, None], axis=1)[:, 0]
    return codes, errors


def _chunks(batches):
    """Arrow tables of at most about CHUNK_ROWS rows."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            held.append(batch.slice(at, CHUNK_ROWS))
            n += held[-1].num_rows
            if n >= CHUNK_ROWS:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]).reshape(-1, dims)


def integer_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 scale: int = SCALE) -> DataFrame:
    """Written rows (id, label, v) of the usable vectors, v as integers."""
    own = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    rows = written(integer_vectors(own, "x", scale, "v").drop("x"), "vectors")
    first = rows.where(F.col("id").isNotNull()).agg(F.min_by(F.size("v"), F.struct("id", "v"))).first()[0]
    return rows if first is None else rows.where(F.size("v") == first)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of written rows (id, label, v)."""
    start = rows.where(F.col("id").isNotNull()).orderBy("id", "v").limit(entries).collect()
    if not start:
        return np.zeros((parts, 0, 0), np.int64)
    dims = len(start[0]["v"])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    most = rows.agg(largest(F.col("v"))).first()[0]
    if most > limit(dims):
        raise ValueError(f"component {most} is beyond {limit(dims)}")
    width = dims // parts
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), parts, width).swapaxes(0, 1).copy()
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry at the floor of the mean of the parts nearest to it; unused entries stay."""
    parts, entries, width = books.shape
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def assign(batches):
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for chunk in _chunks(batches):
            v = _matrix(chunk["v"], parts * width)
            codes, _ = nearest(v, books)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=entries)
                for k in range(width):  # exact: a chunk's sums stay below 2**53
                    sums[p, :, k] += np.bincount(codes[:, p], v[:, p * width + k], entries).astype(np.int64)
        used = [(p, e) for p in range(parts) for e in range(entries) if n[p, e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
             pa.array([int(n[x]) for x in used], pa.int64()),
             pa.array([sums[x].tolist() for x in used], pa.list_(pa.int64()))], schema=schema)

    found = rows.select("v").mapInArrow(assign, "part int, entry int, n bigint, sums array<bigint>")
    total = found.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}")
                                 for k in range(width)]).collect()  # at most parts x entries rows
    books = books.copy()
    for r in total:
        books[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(width)]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """Rows (id, label, code array<int>, error): each part's entry and the squared distances together."""
    parts, entries, width = books.shape
    if not entries:
        return rows.select("id", "label", F.lit(None).cast("array<int>").alias("code"),
                           F.lit(None).cast("bigint").alias("error"))

    def assign(batches):
        for chunk in _chunks(batches):
            codes, errors = nearest(_matrix(chunk["v"], parts * width), books)
            flat = pa.array(codes.ravel().astype(np.int32))
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), flat)
            whole = pa.table({"id": chunk["id"], "label": chunk["label"], "code": code,
                              "error": pa.array(errors.sum(axis=1))})
            yield from whole.to_batches()

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select("id", "label", "v").mapInArrow(
        assign, f"id {types['id']}, label {types['label']}, code array<int>, error bigint")


def decode(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for: its parts' entries, one after another."""
    own = F.array(*[F.array(*[F.array(*[F.lit(int(x) / scale) for x in e]) for e in part]) for part in books])
    return F.flatten(F.transform(code, lambda e, p: F.get(F.get(own, p), e)))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def hexadecimal(code: Column) -> Column:
    return F.array_join(F.transform(code, lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
