"""Language-model scoring with Brown's class-based bigrams.

A word is predicted by its class given the class of the word before, and then
by its share of its class.  Classes come from exchange clustering: words move
to the class that most raises the likelihood of the training bigrams.

Every word with ``LEAST_COUNT`` occurrences is clustered by its own bigrams;
only the words below go by their endings (``ENDINGS`` buckets).  The classes
start from a sequential exchange over the ``SEED`` most frequent words, in one
task; then all words move in distributed rounds: Spark sums each word's counts
with the classes before and after it, and each word takes its best class
against those of the round before - all words in the first round, then every
other one in turn, so that words don't run after each other.  Rounds go on
(``ROUNDS`` at most) while the likelihood rises.

The ``TABLE`` most frequent of them are broadcast with their counts and classes.
All other words with ``LEAST_COUNT`` occurrences, however many and however
long, are late words: they go along with their endings in those rounds, then
each moves by its own bigrams.  Their counts, classes and pairs stay in Spark,
keyed by word; only class bigrams reach the driver.

Counts cover all training documents.  Each text is split into types once, in a
written table that the counts of bigrams and the scores read.  The words of a
document that are not in the broadcast table meet their counts and classes in
one join, by word.

Defined results: a NULL or empty text is the end token alone; words without
training count take the smoothed share of an unseen word; repeated rows each
get a row; NULL ids are kept; other columns are ignored; with no training
document every count is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import fresh, most_frequent, written

LEAST_COUNT = 4        # occurrences of a word clustered by itself
ENDINGS = 256          # buckets of endings for all other words
CLASSES = 64
SEED = 2_048           # words of the first, sequential exchange
PASSES = 6             # of that exchange
ROUNDS = 1             # in which all words move; four more raise the likelihood by 0.4 % (sf0.1)
TABLE = 131_072        # words whose counts are broadcast
TABLE_BYTES = 64       # longest of them
PRIOR = 10.0           # weight of the class unigram in a transition
TEXT_BYTES = 16 << 20  # of text handled at a time inside a task (and a longer row by itself)
LINE_BYTES = 2 << 20   # of lines
BLOCK = 16_384         # cells of a counter that are dealt out together: types of any frequency
END = 0                # type of the end token; also the context before a first word


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _parts(column: pa.Array, most: int):
    """(begin, end) of runs of rows: one of any length, and others with fewer than ``most`` bytes together."""
    group = np.asarray(pc.binary_length(column).fill_null(0)).cumsum(dtype=np.int64) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1)).tolist()
    return list(zip(starts, [*starts[1:], len(column)]))


def _split(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``words_of`` all texts in a row, and their number by text; NULL has none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text.fill_null("")))
    n, words = np.asarray(pc.list_value_length(lists)), lists.flatten().cast(pa.binary())
    found = np.asarray(pc.binary_length(words)) > 0  # blanks at an end leave an empty word there
    if not found.all():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[found], minlength=len(n))
        words = words.filter(pa.array(found))
    return n.astype(np.int64), words


# ---- counts ------------------------------------------------------------------------------

def _count(batches):
    """Word counts of one task, by parts of its texts; the end token is b' '."""
    for batch in batches:
        text = batch.column(0)
        for begin, end in _parts(text, TEXT_BYTES):
            count = _split(text.slice(begin, end - begin))[1].value_counts()
            yield pa.RecordBatch.from_arrays([count.field("values"), count.field("counts")], names=["word", "n"])
        yield pa.RecordBatch.from_pydict({"word": [b" "], "n": [len(text)]})


def word_counts(training: DataFrame, text_col: str = "text") -> DataFrame:
    return written(training.select(text_col).mapInArrow(_count, "word binary, n bigint")
                   .groupBy("word").agg(F.sum("n").alias("n")), "words")


# ---- types and classes ---------------------------------------------------------------------

@dataclass
class Types:
    """Word -> type: the end token, a word of its own (most frequent first), a bucket of endings, or, once they
    have moved, the late words of a class."""

    own: dict[bytes, int]
    late: DataFrame | None = None  # rows (word, class); only the driver can look them up

    @property
    def first(self) -> int:
        """The first bucket of endings."""
        return 1 + len(self.own)

    @property
    def size(self) -> int:
        return self.first + ENDINGS

    def of(self, words: list[bytes]) -> np.ndarray:
        get, first = self.own.get, self.first
        found = np.array([get(w) or first + _ending(w) for w in words], np.int64)
        if self.late is not None:
            rest = {words[i] for i in np.flatnonzero(found >= first).tolist()}
            late = {bytes(r["word"]): self.size + r["class"]
                    for r in self.late.where(F.col("word").isin([bytearray(w) for w in rest])).collect()}
            found = np.array([late.get(w, t) for w, t in zip(words, found.tolist())], np.int64)
        return found

    def seeds(self) -> np.ndarray:
        """Type -> type of the seed exchange: the end token, the SEED first words, a bucket of endings."""
        words = min(SEED, len(self.own))
        late = [1 + words + _ending(w) for w in list(self.own)[words:]]
        return np.array([*range(1 + words), *late, *range(1 + words, 1 + words + ENDINGS)], np.int64)


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _f(x):
    return x * np.log(np.maximum(x, 1))  # counts: 0 and 1 both give 0


def likelihood(grid: np.ndarray) -> float:
    """What the classes decide of the training likelihood."""
    return float(_f(grid).sum() - _f(grid.sum(axis=0)).sum() - _f(grid.sum(axis=1)).sum())


def gains(grid: np.ndarray, o: np.ndarray, i: np.ndarray, own: float) -> np.ndarray:
    """Gain in likelihood by class that a type joins.

    ``grid`` are class bigrams without the type; ``o`` and ``i`` its counts
    with the classes after and before it, ``own`` with itself.
    """
    # the classes around the type keep their counts with it, whichever class it joins
    rows, columns, now = grid.sum(axis=1) + i, grid.sum(axis=0) + o, np.diagonal(grid)
    after, before = np.flatnonzero(o), np.flatnonzero(i)
    gain = ((_f(grid[:, after] + o[after]) - _f(grid[:, after])).sum(axis=1)
            + (_f(grid[before] + i[before, None]) - _f(grid[before])).sum(axis=0))
    gain += _f(now + o + i + own) - _f(now + o) - _f(now + i) + _f(now)
    gain -= _f(rows + o.sum() + own) - _f(rows) + _f(columns + i.sum() + own) - _f(columns)
    gain[0] = -np.inf  # the end token's
    return gain


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Class of each type from the matrix of type bigrams, types moving one at a time; END stays alone in class 0."""
    n = len(bigrams)
    weight = bigrams.sum(axis=1) + bigrams.sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    order = order[order != END]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    follow, lead = np.zeros((n, classes)), np.zeros((n, classes))  # by type: classes after and before it
    for c in range(classes):
        follow[:, c] = bigrams[:, of == c].sum(axis=1)
        lead[:, c] = bigrams[of == c].sum(axis=0)
    grid = np.zeros((classes, classes))
    for c in range(classes):
        grid[c] = follow[of == c].sum(axis=0)
    for _ in range(passes):
        moved = 0
        for w in order[weight[order] > 0].tolist():
            a, own = of[w], bigrams[w, w]
            o, i = follow[w].copy(), lead[w].copy()
            b = _best(grid, a, o, i, own)
            grid[b] += o
            grid[:, b] += i
            grid[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                follow[:, a] -= bigrams[:, w]
                follow[:, b] += bigrams[:, w]
                lead[:, a] -= bigrams[w]
                lead[:, b] += bigrams[w]
        if not moved:
            break
    return of


def _best(grid: np.ndarray, a: int, o: np.ndarray, i: np.ndarray, own: float) -> int:
    """Takes a type of class ``a`` out of ``grid`` (and its pairs with itself out of o and i); its best class."""
    o[a] -= own
    i[a] -= own
    grid[a] -= o
    grid[:, a] -= i
    grid[a, a] -= own
    gain = gains(grid, o, i, own)
    b = int(gain.argmax())
    return b if gain[b] > gain[a] + 1e-6 else int(a)


def gains_of_all(grid: np.ndarray, of: np.ndarray, o: np.ndarray, i: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``gains`` of many types at once, each taken out of its class in ``of`` and out of ``grid``.

    A row of ``o`` and ``i`` are a type's counts with the classes after and before it, those with itself included.
    """
    each = np.arange(len(of))
    o, i = o.astype(float), i.astype(float)
    o[each, of] -= own
    i[each, of] -= own
    after, before, own = o.sum(axis=1, keepdims=True), i.sum(axis=1, keepdims=True), own[:, None].astype(float)
    rows, columns, now = (np.tile(x, (len(of), 1)) for x in (grid.sum(axis=1), grid.sum(axis=0), np.diagonal(grid)))
    rows[each, of] -= (after + own)[:, 0]
    columns[each, of] -= (before + own)[:, 0]
    now[each, of] -= o[each, of] + i[each, of] + own[:, 0]
    gain = _added(grid, of, o, i, own) + _added(grid.T, of, i, o, own)
    gain += _f(now + o + i + own) - _f(now + o) - _f(now + i) + _f(now)
    gain -= _f(rows + after + own) - _f(rows) + _f(columns + before + own) - _f(columns)
    gain[:, 0] = -np.inf  # the end token's
    return gain


def _added(grid: np.ndarray, of: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray) -> np.ndarray:
    """By type and class c: the sum of f(g[c, j] + x[j]) - f(g[c, j]) over j, g being the grid without the type:
    row of its class less x, column less y, the cell of both also less own."""
    out = np.zeros(x.shape)
    t, j = np.nonzero(x)
    if not len(t):
        return out
    n, a = x[t, j], of[t]
    # most counts are small: cells of equal column and count are worked out once
    pair, place = np.unique(n * len(grid) + j, return_inverse=True)
    cells = grid.T[(pair % len(grid)).astype(np.int64)]
    step = (_f(cells + (pair // len(grid))[:, None]) - _f(cells))[place]
    without = grid[a, j] - n
    step[np.arange(len(t)), a] = _f(without + n) - _f(without)
    at = np.flatnonzero(j == a)  # the column of its class
    cells = grid.T[a[at]] - y[t[at]]
    cells[np.arange(len(at)), a[at]] -= n[at] + own[t[at], 0]
    step[at] = _f(cells + n[at, None]) - _f(cells)
    starts = np.flatnonzero(np.diff(t, prepend=-1))
    out[t[starts]] = np.add.reduceat(step, starts, axis=0)
    return out


def best_classes(grid: np.ndarray, of: np.ndarray, o: np.ndarray, i: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Each type's best class; it stays where nothing is gained."""
    out = of.copy()
    for at in range(0, len(of), 512):  # bounds the cells in memory
        part = slice(at, at + 512)
        gain = gains_of_all(grid, of[part], o[part], i[part], own[part])
        best, each = gain.argmax(axis=1), np.arange(len(gain))
        out[part] = np.where(gain[each, best] > gain[each, of[part]] + 1e-6, best, of[part])
    return out


def type_lines(docs: DataFrame, types: Types, text_col: str = "text", more: tuple[Column, ...] = ()) -> DataFrame:
    """Written rows (*more, s, row): s.line are the types of each document's words as int32, s.rest its words without
    a type of their own, in order, with blanks between them; ``row`` names the row in every later read."""
    own = pa.array(list(types.own), pa.binary())
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def typed_part(text: pa.Array, own: pa.Array) -> pa.Array:
        n, words = _split(text)
        found = pc.index_in(words, value_set=own)
        line = 1 + np.asarray(found.fill_null(0)).astype(np.int32)
        out = np.flatnonzero(np.asarray(found.is_null()))
        rest = words.take(pa.array(out))
        line[out] = [1 + len(own) + _ending(w) for w in rest.to_pylist()]
        row = np.repeat(np.arange(len(n)), n)[out]
        lists = pa.ListArray.from_arrays(pa.array(_ends(np.bincount(row, minlength=len(n))), pa.int32()), rest)
        return pa.StructArray.from_arrays([_binaries(line, n), pc.binary_join(lists, b" ")], names=["line", "rest"])

    @F.arrow_udf("line binary, rest binary")
    def typed(text: pa.Array) -> pa.Array:
        own = shared.value
        return pa.concat_arrays([typed_part(text.slice(a, b - a), own) for a, b in _parts(text, TEXT_BYTES)]
                                or [typed_part(text, own)])

    return written(docs.select(*more, typed.asNondeterministic()(F.col(text_col)).alias("s"))
                   .withColumn("row", F.monotonically_increasing_id()), "lines")


def _ends(n: np.ndarray) -> np.ndarray:
    """Where each of n's runs begins, and the end of all."""
    return np.concatenate([[0], n.cumsum()])


def _binaries(codes: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of n int32 codes as bytes, a run in each row."""
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * _ends(n)).astype(np.int32)),
                                                       pa.py_buffer(codes.astype("<i4"))])


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The int32 codes of all rows, and their number by row."""
    return (np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64),
            np.asarray(pc.binary_length(column)).astype(np.int64) // 4)


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield batch.slice(at, 1024)


def _line_slices(batches):
    for batch in batches:
        for begin, end in _parts(batch.column(0), LINE_BYTES):
            yield batch.slice(begin, end - begin)


def _chain(lines: pa.Array) -> np.ndarray:
    """All lines in a row, with the end token before, between and after them."""
    codes, n = _codes(lines)
    return np.concatenate([[END], np.insert(codes, n.cumsum(), END)])


def _chains(batches):
    for part in _line_slices(batches):
        yield _chain(part.column(0))


def counted(lines: DataFrame, types: int, width: int, tally, each, schema: str) -> DataFrame:
    """The batches of ``each(types, counts)`` over all lines, for some types at a time, with ``width`` counts of each.

    ``tally(total, chain)`` counts some lines into the task's counter of types
    x width cells.  A task hands on the cells that occur, in a row for each
    block of about BLOCK cells, as 16-bit places and counts of 1 to 4 bytes;
    they are added up where the block is dealt to.  A block takes types at
    equal steps, so that the frequent ones are spread over all blocks.
    """
    step = -(-types // max(BLOCK // width, 1))

    def count(batches):
        total = np.zeros(types * width, np.uint32)
        for chain in _chains(batches):
            tally(total, chain)
        total = total.reshape(types, width)
        for at in range(0, step, 64):  # blocks of a batch
            out = []
            for block in range(at, min(at + 64, step)):
                part = total[block::step].ravel()
                cells = np.flatnonzero(part)
                if len(cells):
                    n = part[cells]
                    n = n.astype(np.min_scalar_type(n.max()).newbyteorder("<"))
                    out.append((block, n.tobytes(), cells.astype("<u2").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["block", "n", "cells"])

    def add(batches):
        totals: dict[int, np.ndarray] = {}  # all blocks together: one counter
        for batch in batches:
            for block, n, cells in zip(*(c.to_pylist() for c in batch.columns)):
                total = totals.setdefault(block, np.zeros(len(range(block, types, step)) * width, np.int64))
                cells = np.frombuffer(cells, "<u2")
                total[cells] += np.frombuffer(n, f"<u{len(n) // len(cells)}")
        for block, total in totals.items():
            yield each(np.arange(block, types, step), total.reshape(-1, width))

    return (lines.select("s.line").mapInArrow(count, "block int, n binary, cells binary")
            .repartition("block").mapInArrow(add, schema))


def seed_classes(lines: DataFrame, types: Types) -> tuple[np.ndarray, np.ndarray]:
    """Class of each type after the exchange over the seed types, and the class bigram counts.

    The exchange runs in one task over SEED + ENDINGS types squared at most.
    """
    seed = types.seeds()
    n = int(seed.max()) + 1

    def tally(total, chain):
        s = seed[chain]
        np.add.at(total, s[:-1] * n + s[1:], 1)

    def each(types, count):
        return pa.RecordBatch.from_arrays([pa.array(types, pa.int32()), pa.array([x.astype("<i8").tobytes() for x in count])],
                                          names=["type", "n"])

    cells = written(counted(lines, n, n, tally, each, "type int, n binary"), "bigrams")

    def cluster(batches):
        bigrams = np.zeros((n, n))
        for batch in batches:
            for t, row in zip(*(c.to_pylist() for c in batch.columns)):
                bigrams[t] = np.frombuffer(row, "<i8")
        of = exchange(bigrams)
        grid = np.zeros((CLASSES, CLASSES))
        a, b = np.nonzero(bigrams)
        np.add.at(grid, (of[a], of[b]), bigrams[a, b])
        yield pa.RecordBatch.from_arrays([pa.array([x.ravel().tolist()]) for x in (of, grid)], names=["of", "grid"])

    found = cells.coalesce(1).mapInArrow(cluster, "of array<bigint>, grid array<double>").first()
    return np.array(found["of"], np.int64)[seed], np.array(found["grid"]).reshape(CLASSES, CLASSES)


def _cells(columns: dict[str, np.ndarray], total: np.ndarray):
    """Batches of the cells that occur with their counts; ``columns`` ends with the places in ``total``."""
    *_, place = columns.values()
    for at in range(0, len(place), 100_000):
        part = {k: v[at:at + 100_000] for k, v in columns.items()}
        yield pa.RecordBatch.from_pydict(part | {"n": total[place[at:at + 100_000]].astype(np.int64)})


def of_contexts(lines: DataFrame, of: np.ndarray, each, schema: str) -> DataFrame:
    """The batches of ``each(types, count)``, for every type that occurs once: ``count`` has a row for each type with its
    bigrams with the classes after it (at class) and before it (at CLASSES + class), and with itself (at 2 CLASSES)."""
    shared, width = lines.sparkSession.sparkContext.broadcast(of), 2 * CLASSES + 1

    def tally(total, chain):
        c, a, z = shared.value[chain], chain[:-1] * width, chain[1:] * width
        np.add.at(total, a + c[1:], 1)
        np.add.at(total, z + CLASSES + c[:-1], 1)
        np.add.at(total, a[chain[:-1] == chain[1:]] + 2 * CLASSES, 1)

    def occurring(types, count):
        found = count.any(axis=1)
        return each(types[found], count[found])

    return counted(lines, len(of), width, tally, occurring, schema)


def contexts(lines: DataFrame, of: np.ndarray) -> DataFrame:
    """Rows (type, at, n) of the counts of ``of_contexts`` that are not 0."""
    def each(types, count):
        row, at = np.nonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(types[row], pa.int32()), pa.array(at, pa.int32()), pa.array(count[row, at])],
                                          names=["type", "at", "n"])

    return of_contexts(lines, of, each, "type int, at int, n bigint")


def class_bigrams(lines: DataFrame, of: np.ndarray) -> np.ndarray:
    """Counts of (class before, class) over all lines: a task hands on at most CLASSES squared of them."""
    shared = lines.sparkSession.sparkContext.broadcast(of)

    def count(batches):
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for chain in _chains(batches):
            c = shared.value[chain]
            total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        yield from _cells({"cell": np.flatnonzero(total)}, total)

    grid = np.zeros(CLASSES * CLASSES)
    for r in lines.select("s.line").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        grid[r["cell"]] = r["n"]
    return grid.reshape(CLASSES, CLASSES)


def moved(lines: DataFrame, of: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Each type's best class against the classes of the round before."""
    shared = lines.sparkSession.sparkContext.broadcast((of, grid))

    def each(types, count):
        of, grid = shared.value
        types, count = types[types != END], count[types != END]
        best = best_classes(grid, of[types], count[:, :CLASSES], count[:, CLASSES:-1], count[:, -1])
        return pa.RecordBatch.from_arrays([pa.array(types, pa.int32()), pa.array(best, pa.int32())], names=["type", "class"])

    now = of_contexts(lines, of, each, "type int, class int").toArrow()  # at most TABLE + ENDINGS
    out = of.copy()
    out[now.column("type").to_numpy()] = now.column("class").to_numpy()
    return out


def classes_of_types(lines: DataFrame, types: Types) -> tuple[np.ndarray, np.ndarray]:
    """Class of each type, and the class bigram counts."""
    best = seed_classes(lines, types)
    for turn in range(ROUNDS):
        of, grid = best
        now = moved(lines, of, grid)
        of = np.where(_half(len(of), turn), of, now) if turn else now
        grid = class_bigrams(lines, of)
        if likelihood(grid) <= likelihood(best[1]):
            break
        best = of, grid
    return best


def _rows_of(lists: pa.Array) -> np.ndarray:
    """The row of each value in the flattened lists; NULL is an empty list."""
    return np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists).fill_null(0)))


def around(lines: DataFrame, types: Types, of: np.ndarray) -> DataFrame:
    """Written rows (word, next, cells, n) of the words without a type of their own, for each part of the lines.

    ``next`` NULL: the classes around each occurrence of the word there, (class before * CLASSES + class after) * 2,
    plus 1 if it is followed by itself, in 16 bits each.  ``cells`` NULL: how often it is followed by the word
    ``next``, which has no type of its own either.
    """
    shared, first = lines.sparkSession.sparkContext.broadcast(of), types.first

    def count(batches):
        for part in _line_slices(batches):
            chain = _chain(part.column(0))
            place = np.flatnonzero(chain >= first)
            words = pa.array(b" ".join(part.column(1).to_pylist()).split(), pa.binary()).dictionary_encode()
            word, words = words.indices.to_numpy().astype(np.int64), words.dictionary
            follow = np.flatnonzero(np.diff(place) == 1)
            same = np.zeros(len(place), np.int64)
            same[follow] = word[follow] == word[follow + 1]
            c = shared.value[chain]
            cells = ((c[place - 1] * CLASSES + c[place + 1]) * 2 + same)[np.argsort(word, kind="stable")].astype("<u2")
            ends = _ends(2 * np.bincount(word, minlength=len(words)))
            cells = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cells)])
            yield pa.RecordBatch.from_arrays([words, pa.nulls(len(words), pa.binary()), cells, pa.nulls(len(words), pa.int64())],
                                             names=["word", "next", "cells", "n"])
            pair, times = np.unique(word[follow] * len(words) + word[follow + 1], return_counts=True)
            if len(pair):
                yield pa.RecordBatch.from_arrays(
                    [words.take(pa.array(pair // len(words))), words.take(pa.array(pair % len(words))),
                     pa.nulls(len(pair), pa.binary()), pa.array(times, pa.int64())], names=["word", "next", "cells", "n"])

    return written(lines.select("s.line", "s.rest").mapInArrow(count, "word binary, next binary, cells binary, n bigint"), "around")


def _sums(batches):
    """(words, counts) from sorted rows (word, cells) of ``around``: a word's bigrams with the classes after and before
    it and with itself, as in ``of_contexts``."""
    width, last = 2 * CLASSES + 1, None  # the last word's rows may go on in the next batch
    for part in _slices(batches):
        words = part.column(0).dictionary_encode()
        row, words = words.indices.to_numpy(), words.dictionary.to_pylist()
        cells = np.frombuffer(b"".join(part.column(1).to_pylist()), "<u2").astype(np.int64)
        at = np.repeat(row.astype(np.int64), np.asarray(pc.binary_length(part.column(1))) // 2) * width
        places = np.concatenate([at + cells // 2 % CLASSES, at + CLASSES + cells // 2 // CLASSES, (at + 2 * CLASSES)[cells % 2 > 0]])
        count = np.bincount(places, minlength=len(words) * width).reshape(-1, width)
        if last is not None:
            if words[0] == last[0][0]:
                count[0] += last[1][0]
            else:
                words, count = last[0] + words, np.concatenate([last[1], count])
        if len(words) > 1:
            yield words[:-1], count[:-1]
        last = words[-1:], count[-1:]
    if last is not None:
        yield last


def late_classes(lines: DataFrame, types: Types, of: np.ndarray, grid: np.ndarray) -> tuple[DataFrame | None, np.ndarray]:
    """Rows (word, class) of the late words after each moved by its own bigrams, and the class bigrams then.

    No rows and the class bigrams as they were if the likelihood does not rise.
    """
    every, first = around(lines, types, of), types.first
    shared = lines.sparkSession.sparkContext.broadcast((of, grid))

    def move(batches):
        """A row for each word, and the task's changes of the class bigrams by cell (``word`` NULL).

        Each side of a bigram is counted as if the other side stayed.
        """
        of, grid = shared.value
        change = np.zeros((CLASSES, CLASSES), np.int64)
        for words, count in _sums(batches):
            late = np.flatnonzero(count[:, :CLASSES].sum(axis=1) >= LEAST_COUNT)
            if not len(late):
                continue
            words, count = [words[k] for k in late.tolist()], count[late]
            o, i = count[:, :CLASSES], count[:, CLASSES:-1]
            was = of[[first + _ending(w) for w in words]]
            now = best_classes(grid, was, o, i, count[:, -1])
            for to, sign in ((now, 1), (was, -1)):
                np.add.at(change, to, sign * o)
                np.add.at(change.T, to, sign * i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(was, pa.int32()), pa.array(now, pa.int32()),
                 pa.nulls(len(words), pa.int64())], names=["word", "was", "class", "n"])
        a, b = np.nonzero(change)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(a), pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(change[a, b])],
            names=["word", "was", "class", "n"])

    words = every.where(F.col("next").isNull()).select("word", "cells").repartition("word").sortWithinPartitions("word")
    done = written(words.mapInArrow(move, "word binary, was int, class int, n bigint"), "late")
    late, after = done.where(F.col("word").isNotNull()).drop("n"), grid.copy()
    # where both words of a pair moved, the bigram goes from one pair of classes to the other
    changed = late.where(F.col("was") != F.col("class"))
    a, b = changed.toDF("word", "a", "to_a"), changed.toDF("next", "b", "to_b")
    pairs = every.where(F.col("next").isNotNull()).select("word", "next", "n").join(a, "word").join(b, "next")

    def both(batches):
        change = np.zeros((CLASSES, CLASSES), np.int64)
        for batch in batches:
            a, to_a, b, to_b, n = (c.to_numpy() for c in batch.columns)
            for x, y, sign in ((a, b, 1), (to_a, to_b, 1), (a, to_b, -1), (to_a, b, -1)):
                np.add.at(change, (x, y), sign * n)
        x, y = np.nonzero(change)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(change[x, y])],
                                         names=["was", "class", "n"])

    pairs = pairs.select("a", "to_a", "b", "to_b", "n").mapInArrow(both, "was int, class int, n bigint")
    for rows in (done.where(F.col("word").isNull()), pairs):
        for r in rows.groupBy("was", "class").agg(F.sum("n").alias("n")).collect():  # at most CLASSES squared
            after[r["was"], r["class"]] += r["n"]
    if likelihood(after) <= likelihood(grid):
        return None, grid
    return late.drop("was"), after


def _half(n: int, turn: int) -> np.ndarray:
    """About half of n types, another half in the next turn; neighbours in frequency fall on both sides."""
    mixed = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(63)).astype(bool) ^ bool(turn % 2)


# ---- the model and its scores ------------------------------------------------------------------

@dataclass
class Model:
    types: Types
    of: np.ndarray            # class of each type
    transition: np.ndarray    # log10 P(class | class before)
    share: np.ndarray         # log10 of each class's smoothed total
    table: dict[bytes, int]   # counts of the words with a type of their own
    ends: int                 # count of the end token
    tokens: int
    distinct: int
    counts: DataFrame | None = None  # rows (word, n, class) of all words


@dataclass
class Vocabulary:
    counts: DataFrame       # rows (word, n) of all words, the end token among them
    totals: dict[str, int]  # tokens n, distinct words v, end tokens, words clustered by themselves
    table: dict[bytes, int]
    types: Types


def vocabulary(training: DataFrame, text_col: str = "text") -> Vocabulary:
    counts = word_counts(training, text_col)
    ended, clustered = F.col("word") == b" ", F.col("n") >= LEAST_COUNT
    totals = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(ended, F.col("n"))).alias("ends"),
                        F.count_if(~ended & clustered).alias("clustered")).first()
    top = most_frequent(counts.where((F.octet_length("word") <= TABLE_BYTES) & clustered & ~ended), "word", "n", TABLE)
    table = {bytes(r["word"]): r["n"] for r in top}
    return Vocabulary(counts, {k: v or 0 for k, v in totals.asDict().items()}, table, Types({w: 1 + i for i, w in enumerate(table)}))


def learn(training: DataFrame, text_col: str = "text") -> Model:
    words = vocabulary(training, text_col)
    return modelled(words, type_lines(training, words.types, text_col))


def modelled(words: Vocabulary, lines: DataFrame) -> Model:
    """The model of the training documents' lines."""
    counts, totals, types = words.counts, words.totals, words.types
    ended = F.col("word") == b" "
    of, grid = classes_of_types(lines, types)
    late = None
    if totals["clustered"] > len(types.own):
        late, grid = late_classes(lines, types, of, grid)
    shared = lines.sparkSession.sparkContext.broadcast((types, of))

    @F.arrow_udf("int")
    def class_of(word: pa.Array) -> pa.Array:
        types, of = shared.value
        return pa.array(of[types.of(word.to_pylist())], pa.int32())

    by_type = F.when(ended, F.lit(END)).otherwise(class_of("word"))
    if late is not None:
        known = counts.join(late, "word", "left").select("word", "n", F.coalesce("class", by_type).alias("class"))
    else:
        known = counts.select("word", "n", by_type.alias("class"))
    known = written(known, "vocabulary")
    # per class: tokens, distinct words, and one share for unseen words
    sizes = np.zeros((CLASSES, 2))
    for r in known.where(~ended).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        sizes[r["class"]] = r["n"], r["v"]
    unigram = (sizes[:, 0] + 1) / (sizes[:, 0] + 1).sum()
    unigram[0] = (totals["ends"] + 1) / (sizes[:, 0].sum() + totals["ends"] + CLASSES)
    unigram /= unigram.sum()
    transition = np.log10((grid + PRIOR * unigram) / (grid.sum(axis=1, keepdims=True) + PRIOR))
    share = np.log10(sizes.sum(axis=1) + 1)
    # types of late words follow those of the lines: one for each class
    return Model(Types(types.own, late), np.concatenate([of, np.arange(CLASSES)]), transition, share, words.table,
                 totals["ends"], totals["n"], totals["v"], known)


SCORED = ("n_tokens bigint, known bigint, logs double, chain double, rest array<struct<word: binary, times: bigint>>, "
          "codes binary")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          more: tuple[Column, ...] = ()) -> DataFrame:
    """Rows (doc_id, *more, n_tokens, n_known, train_tokens, base_score, score), log10 probabilities of whole texts.

    base_score is the add-one unigram; score the class model, in which a
    word's share of its class is (count + 1) / (class tokens + words + 1).
    """
    return score_lines(type_lines(docs, model.types, text_col, (F.col(id_col).alias("doc_id"), *more)), model)


def learn_and_score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
                    more: tuple[Column, ...] = ()) -> DataFrame:
    """``score`` of all documents by the model of those where ``training`` holds, whose lines serve both."""
    words = vocabulary(docs.where(training), text_col)
    columns = (F.col(id_col).alias("doc_id"), *more)
    learned = fresh(docs.select(*columns), "_training")
    lines = type_lines(docs, words.types, text_col, (*columns, training.alias(learned)))
    return score_lines(lines.drop(learned), modelled(words, lines.where(F.col(learned))))


def score_lines(lines: DataFrame, model: Model) -> DataFrame:
    """``score`` of the rows of ``type_lines``.

    Bigrams of table words are scored where the line is read.  Those with
    another word wait for its class: they are written as int32 codes, first
    the number of other words and their classes by ending, then all left and
    all right sides, each a class or CLASSES + the word's place among them.
    """
    first, counts = model.types.first, model.counts
    logs = np.zeros(len(model.of))  # by type; other words' come by the join
    logs[1:first] = np.log10(np.array([*model.table.values()]) + 1.0)
    shared = lines.sparkSession.sparkContext.broadcast((model.of, logs, model.transition, model.share, model.ends))

    def scored_part(lines: pa.Array, rest: pa.Array) -> pa.Array:
        of, logs, transition, share, n_ends = shared.value
        types, n = _codes(lines)
        row, rows, own = np.repeat(np.arange(len(n)), n), len(n), types < first
        by_row = lambda rows_of, x=None: np.bincount(rows_of, x, rows)
        # the distinct other words of each row, and each occurrence's place among its row's
        words = pa.array(b" ".join(rest.to_pylist()).split(), pa.binary()).dictionary_encode()
        word, words = words.indices.to_numpy().astype(np.int64), words.dictionary
        out, kinds = np.flatnonzero(~own), max(len(words), 1)
        pair, one, place, times = np.unique(row[out] * kinds + word, return_index=True, return_inverse=True, return_counts=True)
        n_rest = by_row(pair // kinds)
        begin = _ends(n_rest)
        sides = of[types]
        endings = sides[out[one]]  # by distinct word
        sides[out] = CLASSES + place - begin[row[out]]
        chain = np.concatenate([[END], np.insert(sides, n.cumsum(), END)])
        left, right, pair_row = chain[:-1], chain[1:], np.repeat(np.arange(rows), n + 1)
        waits = (left >= CLASSES) | (right >= CLASSES)
        done = (by_row(pair_row[~waits], transition[left[~waits], right[~waits]])
                - by_row(row[own], share[sides[own]]))
        # the codes of a row: 1, n_rest, n_wait, n_wait
        left, right, pair_row = left[waits], right[waits], pair_row[waits]
        n_wait = by_row(pair_row)
        size = 1 + n_rest + 2 * n_wait
        start, codes = _ends(size)[:-1], np.zeros(size.sum(), np.int32)
        codes[start] = n_rest
        codes[np.repeat(start + 1 - begin[:-1], n_rest) + np.arange(len(pair))] = endings
        at = (start + 1 + n_rest - _ends(n_wait)[:-1])[pair_row] + np.arange(len(pair_row))
        codes[at], codes[at + n_wait[pair_row]] = left, right
        others = pa.StructArray.from_arrays([words.take(pa.array(pair % kinds)), pa.array(times, pa.int64())], names=["word", "times"])
        return pa.StructArray.from_arrays(
            [pa.array(n + 1), pa.array(n - by_row(row[out]) + (n_ends > 0)), pa.array(by_row(row, logs[types]) + np.log10(n_ends + 1.0)),
             pa.array(done), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), others), _binaries(codes, size)],
            names=["n_tokens", "known", "logs", "chain", "rest", "codes"])

    @F.arrow_udf(SCORED)
    def scored(lines: pa.Array, rest: pa.Array) -> pa.Array:
        return pa.concat_arrays([scored_part(lines.slice(a, b - a), rest.slice(a, b - a)) for a, b in _parts(lines, LINE_BYTES)]
                                or [scored_part(lines, rest)])

    def waiting_part(codes: pa.Array, late: pa.Array) -> np.ndarray:
        transition, share = shared.value[2:4]
        flat, size = _codes(codes)
        start, rows = _ends(size)[:-1], np.arange(len(size))
        n_rest = flat[start]
        begin, n_wait = _ends(n_rest), (size - 1 - n_rest) // 2
        of = flat[np.repeat(start + 1 - begin[:-1], n_rest) + np.arange(begin[-1])]  # class by word
        found = late.flatten()
        of[begin[_rows_of(late)] + found.field("at").to_numpy()] = found.field("class").to_numpy()
        row = np.repeat(rows, n_wait)
        at = (start + 1 + n_rest - _ends(n_wait)[:-1])[row] + np.arange(len(row))

        def classes(side: np.ndarray) -> np.ndarray:
            out, other = side.copy(), np.flatnonzero(side >= CLASSES)
            out[other] = of[begin[row[other]] + side[other] - CLASSES]
            return out

        right = flat[at + n_wait[row]]
        to, other = classes(right), right >= CLASSES
        return (np.bincount(row, transition[classes(flat[at]), to], len(size))
                - np.bincount(row[other], share[to[other]], len(size)))

    @F.arrow_udf("double")
    def waiting(codes: pa.Array, late: pa.Array) -> pa.Array:
        """The pairs that wait for classes, by ending if the word is not among ``late`` (at, class)."""
        parts = [waiting_part(codes.slice(a, b - a), late.slice(a, b - a)) for a, b in _parts(codes, LINE_BYTES)]
        return pa.array(np.concatenate(parts or [np.zeros(0)]), pa.float64())

    rows = written(lines.withColumn("s", scored.asNondeterministic()("s.line", "s.rest")), "scored")
    rare = (rows.select("row", F.posexplode("s.rest").alias("at", "r"))
            .select("row", "at", "r.word", "r.times").join(counts, "word"))
    found = rare.groupBy("row").agg(
        F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"),
        F.collect_list(F.when(F.col("n") >= LEAST_COUNT, F.struct("at", "class"))).alias("late"))
    whole = rows.join(found, "row", "left")
    logs = F.col("s.logs") + F.coalesce("more_logs", F.lit(0.0))
    names = [c for c in rows.columns if c not in ("s", "row")]
    return whole.select(
        *names, "s.n_tokens", (F.col("s.known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (logs - F.col("s.n_tokens") * F.log10(F.lit(float(model.tokens + model.distinct + 1)))).alias("base_score"),
        (logs - F.log10(F.lit(model.ends + 1.0)) + F.col("s.chain")
         + waiting("s.codes", "late")).alias("score"))
