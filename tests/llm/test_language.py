"""Language identification: subwords against a plain version, learning, calibration, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ruleframe.llm import language

SCHEMA = "doc_id bigint, text string, lang string"
WORDS = {"xx": "kalo mira tenu soba", "yy": "przy chrzan wszedl grzyb", "zz": "日本 東京 大阪 京都"}


def _texts(n):
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang)
            for i, lang in enumerate(sorted(WORDS) * n)]


def _plain(text):
    """Number of subwords of each size: runs of letters inside ' word ', with at most its ends as blanks."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    seq = "".join(f" {w}" for w in words) + " "
    return sum(1 for n in language.SIZES for i in range(len(seq) - n + 1) if " " not in seq[i + 1:i + n - 1]) if words else 0


@pytest.mark.parametrize("text", ["", "12 -- !", "a", "One, two;\n\n THREE", "é́x 日本語 🙂ab", "x" * 50 + " . " * 20 + "yz"])
def test_subwords(text, monkeypatch):
    whole = Counter(int(b) for part in language.subwords(text) for b in part)
    assert sum(whole.values()) == _plain(text)
    for piece in (1, 3, 7):  # pieces change nothing
        monkeypatch.setattr(language, "PIECE", piece)
        assert Counter(int(b) for part in language.subwords(text) for b in part) == whole


def test_prediction_is_the_softmax_of_the_average():
    rng = np.random.default_rng(1)
    for langs in (["a", "b"], [f"l{i}" for i in range(20)]):  # fewer and more than the embedding has numbers
        model = language.LanguageModel(langs, rng.normal(size=(language.BUCKETS, language.DIM)),
                                       rng.normal(size=(language.DIM, len(langs))), 0.7, 0.5)
        text = "some words of a text"
        rows = np.concatenate(list(language.subwords(text)))
        z = sum(model.embeddings[b] for b in rows) / len(rows) @ model.weights / 0.7
        p = [math.exp(x) / sum(math.exp(y) for y in z) for x in z]
        (lang, score, rejected), = model.predict([text])
        assert lang == langs[int(np.argmax(p))] and math.isclose(score, max(p)) and rejected == (max(p) < 0.5)


def test_learns_and_keeps_odd_rows(spark):
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 34 ?!", "yy"), (1003, "mira soba", None), (None, "grzyb", "yy"),
           (1004, "東京", "zz"), (1005, "kalo " * 50_000, "xx"), (1004, "東京", "zz")]
    df = spark.createDataFrame(_texts(40) + odd, SCHEMA).withColumns(
        {c: F.lit(f"own {c}") for c in ("key", "bag", "n", "share", "turn", "language", "score")})
    model = language.train(language.training_rows(df, F.lit(True)))
    assert model.langs == sorted(WORDS)
    rows = language.predict(df, model).collect()
    assert len(rows) == 128 and all(r.key == "own key" and r.score == "own score" for r in rows)
    for r in rows:
        if r.doc_id in (1000, 1001, 1002):
            assert tuple(r.language) == ("und", 0.0, True)
        elif r.doc_id != 1003:
            assert r.language.lang == r.lang and r.language.score > 0.5
        else:
            assert r.language.lang == "xx"


def test_rare_languages_and_copies(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_ROWS", 60)
    rows = _texts(10) + [(500 + i, "the very same text", "yy") for i in range(3000)] + [(9000, "vzácný jazyk", "cs")]
    sample = language.training_rows(spark.createDataFrame(rows, SCHEMA), F.lit(True), most=60).collect()
    count = Counter(r.lang for r in sample)
    assert count["cs"] == 1 and count["xx"] == len({t for _, t, lang in rows if lang == "xx"})
    assert len(sample) <= 60


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame(_texts(2), SCHEMA)
    for learned in (df.limit(0), df.withColumn("lang", F.lit(None).cast("string")), df.withColumn("text", F.lit("12"))):
        model = language.train(language.training_rows(learned, F.lit(True)))
        assert {tuple(r.language) for r in language.predict(df, model).collect()} == {("und", 0.0, True)}
    assert language.predict(df.limit(0), model).collect() == []


def test_calibration():
    rng = np.random.default_rng(2)
    model = language.LanguageModel(["a", "b"], np.zeros((language.BUCKETS, language.DIM)), np.zeros((language.DIM, 2)))
    model.embeddings[:1000, 0] = np.linspace(-1, 1, 1000)
    model.weights[0] = 1, -1
    x = rng.integers(0, 1000, 4000)
    chance = 1 / (1 + np.exp(-8 * model.embeddings[x, 0]))  # of "a"; the model says 2x where 8x is right
    label = (rng.random(4000) > chance).astype(int)
    language.calibrate(model, [np.array([i]) for i in x], label)
    assert model.temperature == pytest.approx(0.25, rel=0.25)
    score = 1 / (1 + np.exp(-2 * np.abs(model.embeddings[x, 0]) / model.temperature))
    right = (model.embeddings[x, 0] < 0) == (label == 1)
    taken = score >= model.least - 1e-12
    assert 0 < taken.mean() < 1 and right[taken].mean() >= language.ACCURACY - 0.01 and right[~taken].mean() < 0.97
