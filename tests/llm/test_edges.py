"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from ruleframe.llm import decontam, language, linededup, lm, packing, pii, quality, simhash, tokens, toxicity, urls
from ruleframe.llm.queries import tokenizer_file

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [(1, "Some words here, and a few more of them.\nA second line"), (2, "tie tie tie"), (2, "tie tie tie"),
        (3, None), (4, ""), (5, " \n\t \x0b\n"), (6, LONG), (7, LONG), (None, "no id here"), (None, None),
        (8, "x" * 300_000), (9, "\n" * 5_000), (10, "a\x00b é\u0301 日本 🙂 <|endoftext|> <s> ▁"), (11, "+1 a@b.c 1.2.3.4")]
# names that the operators use for their own results and scratch columns
CLASH = ("ledger", "tokens", "hits", "pii", "toxicity", "judged", "id", "h", "key", "fp", "mark", "n", "row", "class",
         "rank", "slice", "word", "start", "size", "kind", "label", "terms", "s", "root", "n_lines", "n_removed", "c", "t",
         "__h", "__s", "__hh", "__id", "__found", "__left", "__late", "__fine", "__base", "__wide", "doc", "none", "own", "hh")
# columns that an operator adds, and so replaces
ADDED = {"toxicity", "ledger", "judged", "tokens", "hits", "pii", "n_lines", "n_removed", "language"}


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def _labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (6, None), (11, 0)], "doc_id bigint, toxic int")


def _bench(spark):
    return spark.createDataFrame([(1, "few more OF them"), (2, None), (None, "second line"), (3, "..."), (4, "tie")],
                                 "item_id bigint, text string")


def _score(spark, d):
    rows = toxicity.training_rows(d, _labels(spark), F.lit(True))
    return toxicity.score(d, toxicity.train(rows))


OPERATORS = {
    "toxicity": (_score, ["toxicity"]),
    "simhash": (lambda spark, d: simhash.near_duplicates(d), ["doc_id", "fp", "component_id", "root"]),
    "quality": (lambda spark, d: quality.ledger(d), ["ledger"]),
    "urls": (lambda spark, d: urls.judge(d, "text"), ["judged"]),
    "tokens": (lambda spark, d: tokens.count_tokens(d, tokenizer_file("piece_bpe_32k.model")), ["tokens"]),
    "decontam": (lambda spark, d: decontam.search(d, _bench(spark)), ["hits"]),
    "pii": (lambda spark, d: pii.find(d, model=pii.learn(d)), ["pii"]),
    "language": (lambda spark, d: language.predict(d, language.train(language.training_rows(
        d.withColumn("lang", F.lit("en")), F.lit(True)))), ["language"]),
    "lm": (lambda spark, d: lm.score(d, lm.learn(d)), ["doc_id", "n_tokens", "n_known", "base_score", "score"]),
    "linededup": (lambda spark, d: linededup.deduplicate(d), ["text", "n_lines", "n_removed"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(spark, docs, name):
    run, columns = OPERATORS[name]
    out = run(spark, docs)
    assert set(columns) <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for c in set(CLASH) - ADDED - {"n", "s", "fp", "root", "mark"}:  # other columns come through as they were
        if c in out.columns:
            assert {r[c] for r in rows} == {f"own {c}"}
    if "doc_id" in out.columns:
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _ in ROWS)


# What the operators say of NULL, '', blank and repeated texts: doc_id -> value of an expression over the result.
VALUES = {
    "quality": ("ledger.n_words", {3: 0, 4: 0, 5: 0, 2: 3, 8: 1, 9: 0}),
    "tokens": ("tokens.n_bytes", {3: 0, 4: 0, 5: 6, 2: 11, 8: 300_000, 9: 5_000}),
    "decontam": ("size(hits.items)", {3: 0, 4: 0, 5: 0, 2: 1, 8: 0}),  # item 4 is "tie"
    "pii": ("concat_ws(',', transform(pii.base, s -> concat_ws(':', s.kind, s.start, s.end)))",
            {3: "", 4: "", 2: "", 11: "email:3:8,ip:9:16"}),
    "lm": ("n_tokens", {3: 1, 4: 1, 5: 1, 2: 4, 8: 2, 6: 60_001}),
    "linededup": ("concat(coalesce(text, 'NULL'), '|', n_lines, '|', n_removed)",
                  {3: "NULL|0|0", 4: "|1|0", 2: "tie tie tie|1|0", 7: "|1|1"}),  # the second copy of a long line goes
    "simhash": ("component_id", {2: 2, 3: 3, 4: 3, 5: 3, 9: 3, 6: 6, 7: 6}),  # blank texts are one group
    "language": ("language.lang", {3: "und", 4: "und", 5: "und", 9: "und"}),
}


@pytest.mark.parametrize("name", sorted(VALUES))
def test_values_of_edge_rows(spark, docs, name):
    value, want = VALUES[name]
    got = OPERATORS[name][0](spark, docs).select("doc_id", F.expr(value).alias("v")).collect()
    for i, v in want.items():
        assert {r.v for r in got if r.doc_id == i} == {v}, i


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, docs, name):
    run, columns = OPERATORS[name]
    out = run(spark, docs.limit(0))
    assert set(columns) <= set(out.columns) and out.count() == 0


def test_packing_edges(spark, docs):
    path = tokenizer_file("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    assert sum(r.start == 0 for r in rows) == len(ROWS)
    assert sorted((r.doc_id for r in rows if r.doc_tokens == 1), key=str) == [3, 4, None]
    assert packing.pack(docs.limit(0), path).count() == 0


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_packing_takes_whitespace_runs_of_any_length(spark, blank):
    from tokenizers import Tokenizer

    path, text = tokenizer_file("byte_bpe_50k.json"), f"before{blank * 2_000_000}after"
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string"), path,
                        with_ids=True).collect()
    assert {r.doc_id for r in rows} == {1, 2}
    ids = [x for r in sorted(rows, key=lambda r: r.start) if r.doc_id == 1 for x in r.ids]
    assert ids == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, packing.END_ID]
