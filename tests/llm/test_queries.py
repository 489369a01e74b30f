"""Registered queries against DuckDB SQL, or a plain version where SQL can't say the same, on the small tables."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash

from conftest import SF001
from ruleframe.llm.queries import ORACLE, QUERIES, tokenizer_file

COLUMNS = {
    "op1": ["doc_id", "held_out", "score", "predicted"], "op2": ["doc_id", "fingerprint", "component_id"],
    "op3": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4": ["page_id", "host", "path", "rule", "verdict"], "op5": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op9": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10": ["doc_id", "n_lines", "n_removed", "text"],
    "op11": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op12": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def got(spark):
    done = {}

    def rows(op):
        if op not in done:
            name = next(n for n in QUERIES if n.startswith(f"{op}_"))
            df = QUERIES[name](spark, SF001)
            assert set(COLUMNS[op]) <= set(df.columns)
            done[op] = df.collect()
        return done[op]

    return rows


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(duck, got, name):
    rows = got(name.split("_")[0])
    want = duck.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(rows[0].asDict())
    assert sorted([tuple(r[c] for c in names) for r in rows], key=repr) == sorted(want.fetchall(), key=repr)


def test_toxicity_learns(duck, got):
    toxic = dict(duck.execute("SELECT doc_id, toxic FROM labels").fetchall())
    rows = got("op1")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    # what it learned from (one held-out document of the small table is toxic: too few to judge by)
    pos, neg = ([r.score for r in rows if toxic.get(r.doc_id) == t and not r.held_out] for t in (1, 0))
    assert len(pos) >= 5 and sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) >= 0.95 * len(pos) * len(neg)
    assert sum(x >= 0.5 for x in pos) >= 0.9 * len(pos) and not any(x >= 0.5 for x in neg)
    assert not any(r.predicted for r in rows if toxic.get(r.doc_id) == 0)


def test_simhash(got, texts):
    def plain(text):
        words = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: plain(t) for i, t in texts.items()}
    root = {i: i for i in fp}
    for _ in range(len(fp)):
        moved = False
        for a in fp:
            for b in fp:
                if (fp[a] ^ fp[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], moved = root[b], True
        if not moved:
            break
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got("op2")} == {
        i: (f"{fp[i]:016x}", root[i]) for i in fp}


def test_tokens(got, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got("op5")} == {
        i: (len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts.items()}


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _fits(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if _fits(k, m.group())]


def test_personal_data(got, texts):
    for r in got("op7"):
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]
        assert set(spans) <= set(r.spans.split(","))


def test_packing(got, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rows = got("op8")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids, at = tokenizer.encode(t, add_special_tokens=False).ids + [1], 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at:at + r.length]))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) * 2048 < 1.05 * sum(r.length for r in rows)


def test_language_model(got, texts):
    tokens = {i: t.encode().lower().split() + [b" "] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    better = []
    for r in got("op9"):
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), n)
        assert r.n_known == sum(count[w] > 0 for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        if r.held_out:
            better.append(r.score > r.base_score)
    assert sum(better) > 0.8 * len(better)


def _hash(*longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", x % 2**64), h)
    return h


def plain_line_dedup(docs):
    """{id: text left}, from (id, text) with distinct ids."""
    found, cut = {}, {}
    for i, t in sorted(docs.items()):
        lines = t.split("\n")
        size = [len(x.encode()) for x in lines]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
        rolled = [_hash(h[k]) if k == 0 else _hash(h[k], h[k - 1]) for k in range(len(lines))]
        starts = [k for k in range(len(lines)) if k == 0 or size[k] >= 64 or size[k - 1] >= 64 or rolled[k - 1] % 2 == 0]
        cut[i] = lines
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            if sum(size[a:b]) >= 48:
                found.setdefault(("chunk", *lines[a:b]), []).append((i, range(a, b)))
        for k in range(len(lines) - 1):
            if min(size[k:k + 2]) < 64:
                found.setdefault(("pair", *lines[k:k + 2]), []).append((i, k))
    gone, pairs = {i: set() for i in cut}, {i: set() for i in cut}
    for (kind, *_), places in found.items():
        for i, what in places[1:]:
            gone[i].update(what) if kind == "chunk" else pairs[i].add(what)
    for i, lines in cut.items():
        size, k = [len(x.encode()) for x in lines], 0
        while k < len(lines):  # runs of repeated pairs: at least four, with 48 bytes in their lines
            end = k
            while end in pairs[i]:
                end += 1
            if end - k >= 4 and sum(size[k:end + 1]) >= 48:
                gone[i].update(range(k, end + 1))
            k = end + 1
        if gone[i]:
            for k in [*range(len(lines) - 1)]:
                if k in gone[i] and k in pairs[i]:
                    gone[i].add(k + 1)
            for k in reversed(range(len(lines) - 1)):
                if k + 1 in gone[i] and k in pairs[i]:
                    gone[i].add(k)
    return {i: "\n".join(x for k, x in enumerate(lines) if k not in gone[i]) for i, lines in cut.items()}


def test_line_dedup(got, texts):
    assert {r.doc_id: r.text for r in got("op10")} == plain_line_dedup(texts)


def test_pipeline(spark, got, texts):
    import corpus_pipeline as P

    docs, kept = spark.read.parquet(f"{SF001}/documents.parquet"), dict(texts)
    names = docs.columns
    for (name, stage), op in zip(P.STAGES, (3, 10, 2, 6, 8)):
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        docs = stage(spark, docs, SF001)
        if op == 8:
            assert set(COLUMNS["op8"]) <= set(docs.columns)
            assert {r.doc_id for r in docs.collect()} == set(kept)
            break
        assert docs.columns == names
        rows = docs.collect()
        kept = {r.doc_id: r.text for r in rows}
        assert len(kept) == len(rows)
        if op == 3:
            assert kept == {r.doc_id: texts[r.doc_id] for r in got("op3") if r.kept}
        if op == 10:
            assert kept == plain_line_dedup(before)
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id])
        if op == 2:
            groups = {}
            from ruleframe.llm.simhash import near_duplicates
            for r in near_duplicates(spark.createDataFrame(list(before.items()), "doc_id bigint, text string")).collect():
                groups.setdefault(r.component_id, []).append(r.doc_id)
            assert set(kept) == set(groups) and all(kept[i] == before[i] for i in kept)
        if op == 6:
            dirty = {r.doc_id for r in got("op6") if r.contaminated}
            assert set(before) - set(kept) <= set(before) and not (set(kept) & dirty & {
                i for i in before if before[i] == texts[i]})


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as P

    rows = [(5, "one two three four", "en", "a", 1), (5, "one two three four", "en", "a", 1),
            (3, "another text with words", "en", "a", 1), (5, "another text with words", "en", "b", 2),
            (None, "no id at all here", "en", "a", 1), (None, "no id at all here", "fr", None, None),
            (7, None, None, None, None), (8, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in P.near_dedup(spark, docs, SF001).collect()), key=repr)
    assert got == sorted([(5, "one two three four"), (3, "another text with words"), (None, "no id at all here"),
                          (7, None)], key=repr)


def test_language(duck, got):
    lang = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = got("op13")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.lang_pred in {*lang.values(), "und"} for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
