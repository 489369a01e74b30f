"""Vector codes and hard negatives against plain Python over all rows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleframe.llm import negatives, vectorcodes

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def _sound(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def _floors(v, scale):
    return [math.floor(x * scale) for x in v]


def _rows(seed, n, dims, steps):
    """Few distinct components, so that distances and scores tie."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-steps, steps + 1) / 64 for _ in range(dims)], rng.choice([0, 1, 2, 2, 2, None]))
            for i in range(n)]


FAULTY = [(3, None, 1), (4, [None] * 16, 1), (5, [math.nan] * 16, 1), (6, [0.1] * 15 + [math.inf], 1), (7, [], 1)]


def plain_codes(rows, parts, entries, rounds):
    kept = [(i, label, _floors(v, 4096)) for i, v, label in rows if _sound(v)]
    starts = sorted((i, v) for i, _, v in kept if i is not None)[:entries]
    width = len(starts[0][1]) // parts
    cut = lambda v: [v[p * width:(p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in starts] for p in range(parts)]

    def assigned():
        out = []
        for _, _, v in kept:
            far = [[sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]] for p, x in enumerate(cut(v))]
            out.append([(min(d), d.index(min(d))) for d in far])
        return out

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(v)[p] for (_, _, v), a in zip(kept, now) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    return [(i, label, [e for _, e in a], sum(d for d, _ in a)) for (i, label, _), a in zip(kept, assigned())], books


@pytest.mark.parametrize("n, entries, rounds", [(120, 16, 6), (9, 16, 2), (60, 3, 0)])
def test_codes_equal_a_plain_version(spark, monkeypatch, n, entries, rounds):
    monkeypatch.setattr(vectorcodes, "CHUNK_ROWS", 7)  # several dictionaries in a task
    rows = _rows(n, n, 16, 9) + FAULTY + [(2, [0.5] * 16, 1), (None, [0.25] * 16, None)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in ("id", "v", "x", "code", "error")})
    ints = vectorcodes.integer_rows(df)
    books = vectorcodes.learn(ints, 4, entries, rounds)
    got = [(r.id, r.label, r.code, r.error) for r in vectorcodes.encode(ints, books).collect()]
    want, plain = plain_codes(rows, 4, entries, rounds)
    assert books.tolist() == plain
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_decoded_vectors_are_the_entries(spark):
    df = spark.createDataFrame(_rows(1, 40, 16, 9), SCHEMA)
    ints = vectorcodes.integer_rows(df)
    books = vectorcodes.learn(ints, 4, 8, 3)
    rows = vectorcodes.encode(ints, books).join(ints.select("id", "v"), "id")
    for r in rows.select("v", "error", vectorcodes.decode(F.col("code"), books).alias("back")).collect():
        assert len(r.back) == 16
        assert sum((a - round(b * 4096)) ** 2 for a, b in zip(r.v, r.back)) == r.error


def test_codes_of_odd_tables(spark):
    df = spark.createDataFrame(_rows(2, 30, 16, 9), SCHEMA)
    none = vectorcodes.integer_rows(df.limit(0))
    books = vectorcodes.learn(none)
    assert vectorcodes.encode(none, books).collect() == [] and vectorcodes.digest(books) == vectorcodes.digest(np.zeros(0))
    nameless = vectorcodes.integer_rows(df.limit(2).withColumn("vec_id", F.lit(None).cast("bigint")))
    assert [(r.code, r.error) for r in vectorcodes.encode(nameless, vectorcodes.learn(nameless)).collect()] == [(None, None)] * 2
    other = vectorcodes.integer_rows(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 8, 1)], SCHEMA))
    assert [r.id for r in other.collect()] == [1]  # another length than the first
    with pytest.raises(ValueError, match="equal parts"):
        vectorcodes.learn(vectorcodes.integer_rows(spark.createDataFrame([(1, [0.5] * 15, 1)], SCHEMA)))
    with pytest.raises(ValueError, match="beyond"):
        vectorcodes.learn(vectorcodes.integer_rows(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA)))


@pytest.mark.parametrize("spread", [10, 10**9])
def test_dictionary(spread):
    column = np.random.default_rng(3).integers(-spread, spread, 500)
    values, place = vectorcodes.dictionary(column)
    assert values.tolist() == sorted(set(column.tolist())) and (values[place] == column).all()


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 64, 5), (17, 33, 41), (64, 64, 64), (129, 20, 70)])
@pytest.mark.parametrize("leaf", [1, 4, 16])
def test_product_is_exact(shape, leaf):
    m, k, n = shape
    rng = np.random.default_rng(m * n)
    most = math.isqrt((2**63 - 1) // k)  # the largest for which every sum fits; the recursion's own sums overflow
    a, b = rng.integers(-most, most + 1, (m, k)), rng.integers(-most, most + 1, (k, n))
    want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b.T] for r in a]
    assert negatives.product(a, b, leaf).tolist() == want


def plain_negatives(rows, anchor):
    kept = [(i, label, _floors(v, 256)) for i, v, label in rows if label is not None and _sound(v)]
    tie = lambda i: (i is None, i)
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i is None or not anchor(i):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), tie(j), k) for k, (j, _, w) in enumerate(kept) if k != a))
        same = [s for s in scored if kept[s[2]][1] == label][:5]
        for s, _, p in same:
            fit = [t for t in scored if kept[t[2]][1] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out += [(i, kept[p][0], r, kept[t[2]][0], -s, -t[0]) for r, t in enumerate(fit, 1)]
    return out


@pytest.mark.parametrize("block", [4, negatives.BLOCK_ANCHORS])
def test_negatives_equal_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "TILE", (3, 8))
    rows = _rows(7, 150, 16, 6) + FAULTY + [(20, [0.05] * 16, 2)] * 2 + [(None, [0.05] * 16, 1), (None, None, None)]
    clash = ("id", "row", "anchor", "score", "slot", "v", "x", "part", "place")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("own") for c in clash}).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, block_anchors=block).collect()
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    # copies of an id tie in everything that the result shows
    assert want and sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_negatives_of_odd_tables(spark):
    df = spark.createDataFrame(_rows(2, 30, 16, 9), SCHEMA)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for odd in (df.limit(0), df.where("vec_id % 10 <> 0"), df.withColumn("label", F.lit(None).cast("int")),
                df.withColumn("label", F.col("vec_id").cast("int"))):  # the last: no positives
        out = negatives.mine(odd, F.col("vec_id") % 10 == 0)
        assert out.columns == columns and out.collect() == []
    with pytest.raises(ValueError, match="beyond"):
        negatives.mine(spark.createDataFrame([(10, [1e30], 1)], SCHEMA), F.col("vec_id") % 10 == 0)


def test_heaps_merge_like_one_sort():
    rng = np.random.default_rng(5)
    slot, score, ids = (rng.integers(0, n, 900) for n in (7, 12, 40))
    rows = np.arange(900)
    heaps = negatives.Heaps(7, 5)
    for at in range(0, 900, 50):
        heaps.merge(*(x[at:at + 50] for x in (slot, score, ids, rows)))
    got = list(zip(heaps.slot.tolist(), heaps.score.tolist(), heaps.id.tolist(), heaps.row.tolist()))
    order = sorted(zip(slot.tolist(), (-score).tolist(), ids.tolist(), rows.tolist()))
    want = [(s, -n, i, r) for _, g in itertools.groupby(order, key=lambda x: x[0]) for s, n, i, r in list(g)[:5]]
    assert got == want
