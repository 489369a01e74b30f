"""The methods inside the operators, on small planted cases."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ruleframe.llm import decontam, linededup, lm, packing, pii, toxicity
from ruleframe.llm.fmindex import FMIndex, suffix_array


@pytest.mark.parametrize("seed", range(12))
def test_fm_index_finds_all_occurrences(seed):
    rng = random.Random(seed)
    symbols = rng.choice([2, 3, 9, 70])
    text = np.array([rng.randrange(symbols) for _ in range(rng.randint(1, 300))] * rng.choice([1, 3]) + [0], np.int64)
    order = suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    index = FMIndex(text, symbols, sample=4)
    for k in (1, 2, 5):
        patterns = np.array([[rng.randrange(1, symbols) for _ in range(k)] for _ in range(30)], np.int64)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns.tolist(), low.tolist(), high.tolist()):
            want = [i for i in range(len(text) - k + 1) if text[i:i + k].tolist() == p]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def _plain_hits(text, items):
    words = decontam.words_of(text or "")
    hit, found = set(), set()
    for item_id, t in items:
        own = decontam.words_of(t or "")
        k = min(13, len(own))
        for a in range(len(own) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i:i + k] == own[a:a + k]:
                    hit.update(range(i, i + k))
                    found.update(() if item_id is None else {str(item_id)})
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("block_bytes, shard_words", [(1 << 20, 1 << 20), (1 << 20, 15), (60, 40)])
def test_decontamination_blocks_and_shards(spark, block_bytes, shard_words):
    rng = random.Random(2)
    word = lambda: rng.choice(["a", "B", "c", "É", "d1", "-", "x."])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 12, 13, 14, 20, 30])] + [(None, "c c c")]
    docs = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + " " + rng.choice(items)[1]) for i in range(40)]
    docs += [(40, None), (41, docs[3][1]), (41, docs[3][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontam.search(d, b, block_bytes=block_bytes, shard_words=shard_words).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, found = _plain_hits(r.text, items)
        assert (r.hits.n_words, list(r.hits["items"])) == (n, found)
        assert [i for s in r.hits.spans for i in range(s.start, s.end)] == sorted(hit)
        assert all(x.end < y.start for x, y in zip(r.hits.spans, r.hits.spans[1:]))


@pytest.mark.parametrize("seed", range(6))
def test_layout_places_every_rank_once_and_fits(seed):
    rng = random.Random(seed)
    room = rng.choice([32, 256])
    demand = {rng.randint(1, room): rng.choice([1, 3, 50, 4_000]) for _ in range(rng.randint(1, 30))}
    entries = packing.layout(demand, room)
    last = {}
    fill = {}
    for size, first, per, sequence in sorted(entries):
        last.setdefault(size, []).append((first, per, sequence))
    for size, n in demand.items():
        ends = [f for f, _, _ in last[size][1:]] + [n]
        assert last[size][0][0] == 0
        for (first, per, sequence), end in zip(last[size], ends):
            for r in range(first, end):
                s = sequence + (r - first) // per
                fill[s] = fill.get(s, 0) + size
    assert max(fill.values()) <= room and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= sum(-(-n // (room // s)) for s, n in demand.items())  # no worse than one class a sequence


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.arange(1, 129)
    demand = rng.integers(1, 500, 128).astype(float)
    patterns, used = packing.fractional_patterns(sizes, demand, 128)
    assert (patterns @ sizes <= 128).all()
    assert np.allclose(np.einsum("ij,i->j", patterns, used), demand)
    assert used.sum() <= 1.015 * max(demand @ sizes / 128, demand[sizes > 64].sum())  # the size bound


def test_exchange_separates_two_languages():
    rng = np.random.default_rng(0)
    n = 41
    bigrams = np.zeros((n, n))
    for side in (range(1, 21), range(21, 41)):
        for a in side:
            for b in side:
                bigrams[a, b] = rng.integers(5, 20)
        bigrams[0, list(side)] = bigrams[list(side), 0] = 5
    of = lm.exchange(bigrams, classes=3)
    assert of[0] == 0 and len(set(of[1:21])) == len(set(of[21:])) == 1 and of[1] != of[21]


def test_class_model_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b a c", "b a", "c c a b", ""] * 5)],
                                 "doc_id bigint, text string")
    model = lm.learn(docs)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    shares = {}
    for r in model.counts.where(F.col("word") != b" ").collect():
        c = int(model.of[model.types.of([bytes(r["word"])])[0]])
        shares[c] = shares.get(c, 0) + (r["n"] + 1) / 10 ** model.share[c]
    for c, s in shares.items():
        assert np.isclose(s + 1 / 10 ** model.share[c], 1)  # the rest is the share of unseen words


def test_factorization_machine_learns_a_pair():
    """Both terms together are toxic, either alone is not: no linear weights do this."""
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([i for i, on in enumerate((a, b)) if on] + [2 + rng.integers(20)], np.int64))
        labels.append(float(a == b))
    m = toxicity.FactorizationMachine({}, 0.0, np.zeros(22), rng.normal(0, 0.1, (22, 4)))
    m.fit(rows, np.array(labels), epochs=40)
    p = m.score([np.array(x, np.int64) for x in ([5], [0, 5], [1, 5], [0, 1, 5])])
    assert p[0] > 0.8 and p[3] > 0.8 and p[1] < 0.2 and p[2] < 0.2


def test_factorization_machine_scores_all_pairs():
    rng = np.random.default_rng(9)
    m = toxicity.FactorizationMachine({}, 0.3, rng.normal(size=12), rng.normal(size=(12, 4)))
    rows = [np.array(x, np.int64) for x in ([], [3], [0, 5], [1, 2, 7, 11], list(range(12)))]
    for row, p in zip(rows, m.score(rows)):
        z = m.bias + sum(m.weight[i] for i in row)
        z += sum(m.factors[i] @ m.factors[j] for a, i in enumerate(row) for j in row[a + 1:])
        assert math.isclose(p, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_training_keeps_a_pair_of_balanced_words(spark):
    """As above through training_rows() and train(): either word is as common in both classes."""
    rng = np.random.default_rng(6)
    noise = ["".join(x) for x in rng.choice(list("cdefghijklm"), (300, 6))]
    docs, labels = [], []
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        docs.append((i, " ".join([w for w, on in (("alpha", a), ("beta", b)) if on] + [*rng.choice(noise, 10)])))
        labels.append((i, int(a == b)))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    model = toxicity.train(toxicity.training_rows(d, spark.createDataFrame(labels, "doc_id bigint, toxic int"),
                                                  F.col("doc_id") < 2500))
    held_out = toxicity.score(d.where("doc_id >= 2500"), model).collect()
    assert np.mean([(r.toxicity >= 0.5) == labels[r.doc_id][1] for r in held_out]) > 0.9


def test_learned_proposals_add_what_the_base_formats_miss(spark):
    rng = random.Random(1)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet, 12", "in 2001,"]) for _ in range(8))
    rows = [(i, f"{filler()} +1 ({digit(3)}) {digit(3)}-{digit(4)} {filler()} {digit(16)} {filler()} "
                f"u{i}@mail{i % 5}.example.com {filler()} {rng.randint(1, 255)}.2.3.{rng.randint(1, 399)} {filler()}")
            for i in range(400)]
    model = pii.learn(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert model is not None
    cases = {"call (555) 123-4567 now": [("phone", "(555) 123-4567")],
             "write to john [at] mail dot com": [("email", "john [at] mail dot com")],
             "10[.]2[.]300[.]4 and 9807915762804490": [], "nothing to see in 1999, 12 34": [],
             "a@b.cc_x@d.ee +1 (974) 555-3436": []}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id int, text string")
    for r in pii.find(df, model=model).collect():
        assert [(s.kind, r.text[s.start:s.end]) for s in r.pii.added] == cases[r.text], r.text


def test_proposals_in_the_training_texts_are_no_negatives(spark):
    """As above, but each training text itself holds the data that the wide formats are for."""
    rng = random.Random(4)
    digit = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet, 12", "in 2001,"]) for _ in range(8))
    rows = [(i, f"{filler()} +1 ({digit(3)}) {digit(3)}-{digit(4)} {filler()} {digit(16)} {filler()} "
                f"u{i}@mail{i % 5}.example.com {filler()} {rng.randint(1, 255)}.2.3.{rng.randint(1, 399)} {filler()} "
                f"ann{i} [at] mail dot com {filler()} 10[.]2[.]{rng.randint(1, 255)}[.]4 {filler()} "
                f"({digit(3)}) {digit(3)}-{digit(4)} {filler()} 4111.1111.1111.1111 {filler()}")
            for i in range(400)]
    model = pii.learn(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert model is not None
    cases = {"call (555) 123-4567 now": [("phone", "(555) 123-4567")],
             "write to john [at] mail dot com": [("email", "john [at] mail dot com")],
             "host 10[.]2[.]30[.]4 is up": [("ip", "10[.]2[.]30[.]4")],
             "card 4111.1111.1111.1111 is charged": [("card", "4111.1111.1111.1111")],
             "10[.]2[.]300[.]4 and 9807915762804490": [], "we met at noon.Then 12 34": []}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id int, text string")
    for r in pii.find(df, model=model).collect():
        assert [(s.kind, r.text[s.start:s.end]) for s in r.pii.added] == cases[r.text], r.text


def test_calibration_counts_every_margin(spark):
    """30,000 distinct margins, all of positives but some near 0: the threshold lies below the largest 10,000."""
    rows = spark.range(1, 30_001).select((F.col("id") / 10_000).alias("m"), (F.col("id") > 600).cast("double").alias("label"))
    least = pii._least_margin(rows)
    good = lambda x: rows.where(F.col("m") >= x).agg(F.avg("label")).first()[0]
    assert good(least) >= pii.PRECISION > good(least - 1.1 / pii.STEPS)


PASSAGE = [f"passage line {i} has a few words of its own" for i in range(8)]


def _lines(spark, rows):
    out = linededup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r.doc_id: r.text.split("\n") for r in out}


@pytest.mark.parametrize("passage", [PASSAGE, ["one long line " * 12], ["short a b", "and one long line " * 9, "c d"]])
def test_shared_passages_stay_once(spark, passage):
    own = {i: [f"document {i} own line {k} {'x' * (k * i % 7)}" for k in range(i % 5 + 2)] for i in range(12)}
    rows = [(i, "\n".join(own[i][:i % 3] + passage + own[i][i % 3:])) for i in own]
    got = _lines(spark, rows)
    assert got[0] == rows[0][1].split("\n")
    for i in range(1, 12):
        assert [x for x in got[i] if x not in passage] == own[i]
        assert not set(got[i]) & set(passage)


def test_colliding_hashes_remove_equal_bytes_only(spark, monkeypatch):
    monkeypatch.setattr(linededup, "_hash", lambda *c: F.lit(1).cast("bigint"))  # everything collides
    lines = [f"line {c} " * 12 for c in "abc"]
    rows = [(1, lines[0]), (2, lines[1]), (3, lines[0] + "\n" + lines[2]), (4, lines[1])]
    assert _lines(spark, rows) == {1: [lines[0]], 2: [lines[1]], 3: [lines[2]], 4: [""]}


@pytest.mark.parametrize("shared", [[""] * 6, ["    }", "  }", " }", "}", ""], ["a", "b", "c", "d", "e", "f", "g"]])
def test_short_lines_that_texts_share_stay(spark, shared):
    """Blank lines, closing brackets and one-letter lines hold too few bytes, in the text itself and across texts."""
    rows = [(i, "\n".join([f"own beginning {i}", *shared, f"own end {i}"])) for i in range(4)]
    assert _lines(spark, rows) == {i: t.split("\n") for i, t in rows}


def test_a_run_of_short_lines_with_enough_bytes_goes(spark):
    shared = [f"row {c} of this table" for c in "abcdef"]  # no line is long, none a chunk by itself
    rows = [(i, "\n".join([f"own beginning {i}", *shared, f"own end {i}"])) for i in range(3)]
    got = _lines(spark, rows)
    assert got[0] == rows[0][1].split("\n")
    assert all(got[i] == [f"own beginning {i}", f"own end {i}"] for i in (1, 2))


CORPUS = ["the cat sat on the mat", "A dog sat on the log", "the dog and the cat ran", None, "", "the the the cat",
          "on and on the mat ran a dog", "zebra once", "The cat sat on a log and a mat"] * 3


def _plain_model(docs, types, of):
    """(log10 score of a text) from the definition: class given the class before, then the word's share of its class."""
    lines = [[0, *types.of(lm.words_of(t or "")).tolist(), 0] for t in docs]
    grid = Counter((int(of[a]), int(of[b])) for line in lines for a, b in zip(line, line[1:]))
    # the end of a document is the context of the next one's beginning: counted once
    counts = Counter(w for t in docs for w in lm.words_of(t or ""))
    size, distinct = Counter(), Counter()
    for w, n in counts.items():
        c = int(of[types.of([w])[0]])
        size[c] += n
        distinct[c] += 1
    total = sum(size.values())
    prior = {c: (size[c] + 1) / (total + lm.CLASSES) for c in range(lm.CLASSES)}
    prior[0] = (len(docs) + 1) / (total + len(docs) + lm.CLASSES)
    norm = sum(prior.values())

    def step(a, b):
        row = sum(n for (x, _), n in grid.items() if x == a)
        return (grid[a, b] + lm.PRIOR * prior[b] / norm) / (row + lm.PRIOR)

    def score(text):
        words = lm.words_of(text or "")
        line = [0, *(int(of[t]) for t in types.of(words)), 0]
        out = sum(math.log10(step(a, b)) for a, b in zip(line, line[1:]))
        return out + sum(math.log10((counts[w] + 1) / (size[c] + distinct[c] + 1)) for w, c in zip(words, line[1:]))

    return score


def test_class_model_scores_equal_the_definition(spark, monkeypatch):
    monkeypatch.setattr(lm, "TABLE", 9)  # some words meet their counts by the join
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id bigint, text string").coalesce(1)
    model = lm.learn(df)
    assert 1 < len(model.types.own) <= 9
    plain = _plain_model(CORPUS, model.types, model.of)
    new = [(100, "the zebra sat"), (101, "unseen words only"), (102, None), (103, "cat " * 50)]
    every = df.union(spark.createDataFrame(new, df.schema))
    texts = dict(enumerate(CORPUS)) | dict(new)
    for r in lm.score(every, model).collect():
        assert math.isclose(r.score, plain(texts[r.doc_id]), rel_tol=1e-9), texts[r.doc_id]


def test_contexts_and_class_bigrams_equal_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id bigint, text string").coalesce(1)
    types = lm.Types({w: i for i, w in enumerate([b"the", b"cat", b"on"], 1)})
    of = np.random.default_rng(1).integers(1, 5, types.size)
    of[0] = 0
    chain = [0]
    for t in CORPUS:
        chain += [*types.of(lm.words_of(t or "")).tolist(), 0]
    want = Counter()
    for a, b in zip(chain, chain[1:]):
        want[a, int(of[b])] += 1
        want[b, lm.CLASSES + int(of[a])] += 1
        want[a, 2 * lm.CLASSES] += a == b
    lines = lm.type_lines(df, types)
    assert {(r.type, r.at): r.n for r in lm.contexts(lines, of).collect()} == {k: n for k, n in want.items() if n}
    grid = lm.class_bigrams(lines, of)
    assert {(a, b): n for (a, b), n in np.ndenumerate(grid) if n} == {
        k: n for k, n in Counter((int(of[a]), int(of[b])) for a, b in zip(chain, chain[1:])).items()}


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(3)
    bigrams = rng.poisson(2, (12, 12)).astype(float)
    of = np.array([0, *rng.integers(1, 4, 11)])
    grid_of = lambda c: np.array([[bigrams[np.ix_(c == a, c == b)].sum() for b in range(4)] for a in range(4)])
    for w in range(1, 12):
        o = np.array([bigrams[w, of == c].sum() for c in range(4)])
        i = np.array([bigrams[of == c, w].sum() for c in range(4)])
        grid, own, a = grid_of(of), bigrams[w, w], of[w]
        o[a] -= own
        i[a] -= own
        grid[a] -= o
        grid[:, a] -= i
        grid[a, a] -= own
        gain = lm.gains(grid, o, i, own)
        to = lambda b: np.where(np.arange(12) == w, b, of)
        for b in (1, 2, 3):
            assert math.isclose(gain[b] - gain[1], lm.likelihood(grid_of(to(b))) - lm.likelihood(grid_of(to(1))), abs_tol=1e-6)


def test_all_words_move_in_rounds(spark, monkeypatch):
    """Words outside the seed exchange join the class of words used like them."""
    monkeypatch.setattr(lm, "SEED", 4)
    rng = random.Random(2)
    nouns, verbs = [f"n{i}x{i % 50}" for i in range(200)], [f"v{i}y{i % 50}" for i in range(200)]
    docs = [" ".join(w for _ in range(20) for w in ("the", rng.choice(nouns), rng.choice(verbs))) for _ in range(250)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id bigint, text string")
    model = lm.learn(df)
    of = {w: int(model.of[t]) for w, t in model.types.own.items()}
    assert len(of) == 401
    kinds = Counter((of[w.encode()], w[0]) for w in nouns + verbs)
    mixed = sum(min(kinds[c, "n"], kinds[c, "v"]) for c in set(of.values()))
    assert mixed < 0.02 * len(of)


def test_words_beyond_the_table_move_by_their_own_bigrams(spark, monkeypatch):
    """All have one ending, so that only their bigrams tell them apart; some are longer than the table takes."""
    monkeypatch.setattr(lm, "TABLE", 202)
    rng = random.Random(2)
    long = "w" * lm.TABLE_BYTES
    common = {k: [f"{k}{i}" for i in range(100)] for k in "nv"}
    late = {k: [f"{long if i % 9 == 0 else ''}{k}{i}end" for i in range(100)] for k in "nv"}
    docs = []
    for _ in range(400):
        kinds = rng.choices("nv", k=60)
        docs.append(" ".join(w for k in kinds for w in ("the" if k == "n" else "to", rng.choice(common[k] * 3 + late[k]))))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id bigint, text string")
    model = lm.learn(df)
    assert len(model.types.own) <= 202 and not any(w.encode() in model.types.own for w in late["n"] + late["v"])
    of = {k: model.of[model.types.of([w.encode() for w in late[k]])].tolist() for k in "nv"}
    kinds = Counter((c, k) for k in "nv" for c in of[k])
    mixed = sum(min(kinds[c, "n"], kinds[c, "v"]) for c in set(of["n"]))
    assert mixed < 0.02 * 200


@pytest.mark.parametrize("table", [1, 4, 12])
def test_scores_with_late_words_equal_the_definition(spark, monkeypatch, table):
    """Late words beside late words, beside themselves, and beside words of the table; rare and unseen ones."""
    monkeypatch.setattr(lm, "TABLE", table)
    rng = random.Random(table)
    words = ["the", "of", *(f"w{i}" for i in range(30)), "x" * 65, "y" * 70]
    docs = [" ".join(rng.choices(words, [40, 20, *range(30, 0, -1), 30, 5], k=rng.randint(0, 60))) for _ in range(25)]
    docs += ["w3 w3 w3 w4 w4 w5", None, "", "rare words here"] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id bigint, text string").coalesce(1)
    model = lm.learn(df)
    rest = sorted(w for w, n in Counter(w for t in docs for w in lm.words_of(t or "")).items()
                  if n >= lm.LEAST_COUNT and w not in model.types.own)
    late = {bytes(r["word"]): r["class"] for r in model.types.late.collect()}
    assert sorted(late) == rest and len(set(late.values())) > 1
    plain = _plain_model(docs, model.types, model.of)
    new = [(1000, "w3 unseen w3 w3 unseen w9 the"), (1001, "unseen words"), (1002, "x" * 65 + " w1")]
    texts = dict(enumerate(docs)) | dict(new)
    for r in lm.score(df.union(spark.createDataFrame(new, df.schema)), model).collect():
        assert math.isclose(r.score, plain(texts[r.doc_id]), rel_tol=1e-9), texts[r.doc_id]


def test_texts_are_split_as_words_of():
    texts = [None, "", " ", "A bC\tD", " lead", "trail \n", "a\x0b\x0cb\rc", "É È x y　", "a" + "".join(map(chr, range(128))) + "Z",
             " ".join(map(chr, range(128)))]
    n, words = lm._split(pa.array(texts, pa.string()))
    want = [lm.words_of(t or "") for t in texts]
    assert n.tolist() == [len(w) for w in want]
    assert words.to_pylist() == [w for ws in want for w in ws]
    assert lm._split(pa.array([], pa.string()))[0].tolist() == []


@pytest.mark.parametrize("most", [1, 30, 10**6])
def test_parts_hold_every_row_once(most):
    rng = random.Random(most)
    column = pa.array([None, b"", *(b"x" * rng.randint(0, 50) for _ in range(40)), b""], pa.binary())
    parts = lm._parts(column, most)
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(column)))
    assert all(sum(len(x or b"") for x in column.slice(a + 1, b - a - 1).to_pylist()) < most for a, b in parts)  # after its first row
    assert lm._parts(column.slice(0, 0), most) == []


def test_scores_of_all_documents_split_each_text_twice(spark, monkeypatch):
    """Once for the counts, once for the lines, which the model and the scores share; the scores are those of two calls."""
    monkeypatch.setattr(lm, "TABLE", 9)
    monkeypatch.setattr(lm, "TEXT_BYTES", 60)  # several parts of a batch
    monkeypatch.setattr(lm, "LINE_BYTES", 60)
    read, training = spark.sparkContext.accumulator(0), F.col("doc_id") % 3 != 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id bigint, text string").coalesce(1)

    @F.udf("string")
    def counted(text):
        read.add(1)
        return text

    got = lm.learn_and_score(docs.withColumn("text", counted.asNondeterministic()("text")), training,
                             more=(F.col("doc_id").alias("_training"),)).collect()
    assert len(CORPUS) < read.value <= 2 * len(CORPUS)
    want = {r.doc_id: r for r in lm.score(docs, lm.learn(docs.where(training))).collect()}
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        w = want[r.doc_id]
        assert (r._training, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id, w.n_tokens, w.n_known, w.train_tokens)
        assert math.isclose(r.score, w.score, rel_tol=1e-12) and math.isclose(r.base_score, w.base_score, rel_tol=1e-12)


def test_cells_are_handed_on_by_block_and_added_up(spark, monkeypatch):
    """Counts of 1, 2 and 4 bytes, in several tasks and blocks of 2 types; the last block has one."""
    monkeypatch.setattr(lm, "BLOCK", 7)
    df = spark.createDataFrame([(i, "a") for i in range(3)], "doc_id bigint, text string").repartition(3)
    lines = lm.type_lines(df, lm.Types({b"a": 1}))
    tasks = lines.rdd.getNumPartitions()
    cells = {0: 1, 9: 255, 10: 256, 12: 65_536, 20: 2**31, 26: 3}

    def tally(total, chain):
        for cell, n in cells.items():
            total[cell] = n

    def each(types, count):
        t, at = np.nonzero(count)
        return pa.RecordBatch.from_arrays([pa.array(types[t] * 3 + at), pa.array(count[t, at])], names=["cell", "n"])

    counts = lm.counted(lines, 9, 3, tally, each, "cell bigint, n bigint")
    assert sorted(map(tuple, counts.collect())) == [(c, n * tasks) for c, n in cells.items()]


def test_counts_of_types_are_shuffled_once_and_packed(spark):
    """No row for each cell and no aggregation of them: at most a row for each block and task."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CORPUS)], "doc_id bigint, text string").coalesce(1)
    types = lm.Types({w: i for i, w in enumerate([b"the", b"cat", b"on"], 1)})
    of = np.arange(types.size) % lm.CLASSES
    counts = lm.contexts(lm.type_lines(df, types), of)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("MapInArrow") == 2 and plan.count("RepartitionByExpression") == 1
    assert counts.count() > 0


@pytest.mark.parametrize("size", [1, 3, 100])
def test_a_words_rows_are_summed_over_batches(size):
    rng = np.random.default_rng(size)
    rows = [(b"w%02d" % (k // 7), rng.integers(0, 2 * lm.CLASSES**2, rng.integers(1, 6))) for k in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()),
                                           pa.array([c.astype("<u2").tobytes() for _, c in part], pa.binary())], names=["word", "cells"])
               for part in (rows[k:k + size] for k in range(0, len(rows), size))]
    got = {}
    for words, count in lm._sums(batches):
        for w, x in zip(words, count, strict=True):
            assert w not in got
            got[w] = {k: int(n) for k, n in enumerate(x) if n}
    want = {}
    for w, cells in rows:
        mine = want.setdefault(w, Counter())
        for c in cells.tolist():
            mine[c // 2 % lm.CLASSES] += 1
            mine[lm.CLASSES + c // 2 // lm.CLASSES] += 1
            if c % 2:
                mine[2 * lm.CLASSES] += 1
    assert got == want


def test_best_classes_of_many_are_those_of_each():
    rng = np.random.default_rng(4)
    n, classes = 700, 6
    bigrams = rng.poisson(0.3, (n, n)).astype(float) * rng.choice([1, 1, 5], (n, 1))
    of = np.array([0, *rng.integers(1, classes, n - 1)])
    of[:classes] = range(classes)
    member = np.eye(classes)[of]
    grid, o, i, own = member.T @ bigrams @ member, bigrams @ member, bigrams.T @ member, np.diagonal(bigrams)
    got = lm.best_classes(grid, of[1:], o[1:], i[1:], own[1:])
    assert got.tolist() == [lm._best(grid.copy(), of[w], o[w].copy(), i[w].copy(), own[w]) for w in range(1, n)]
    assert (got != of[1:]).any()


@pytest.mark.parametrize("n", [1, 256, 700])
def test_places_of_many_matches(spark, n):
    """Code points, with wider characters between the matches."""
    rng = random.Random(n)
    text, want = "", []
    for i in range(n):
        text += "é " * rng.randint(1, 4)
        mail = f"user{i}@host{i % 7}.example"
        want.append((len(text), len(text) + len(mail)))
        text += mail + " "
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    spans = pii.find(df).first().pii.base
    assert [(s.start, s.end) for s in spans if s.kind == "email"] == want


def test_columns_named_like_scratch_columns_stay(spark):
    names = ("__base", "__wide", "___WIDE")
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id int, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    row = pii.find(df).first()
    assert all(row[c] == f"own {c}" for c in names) and len(row.pii.base) == 1

