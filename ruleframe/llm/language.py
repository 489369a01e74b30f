"""Language of documents: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of 2 to 4 letters inside its lower-cased
words, with the word's ends marked; each is hashed to a bucket that has an
embedding.  A document is the average of all its subwords' embeddings, and a
linear softmax over that average gives the probability of each language.
Embeddings and softmax are fitted together by stochastic gradient descent in
numpy, from batches that draw a few subwords of each document anew.

Learning takes a bounded sample: about ``TRAIN_ROWS`` documents, the same
number for each language where there are as many (rarer languages enter
whole), each with at most ``DRAWN`` subwords drawn from its whole text.  The
languages are those of the training rows (the ``MOST_LANGS`` most frequent,
if there are more).  A fifth of the sample is kept from the fit and
calibrates it: a temperature makes scores probabilities, and ``least`` is the
smallest score from which on ``ACCURACY`` of the predictions are right;
predictions below are marked as rejected.

Defined results: a text that is NULL or has no letter is ``und`` with score 0
and rejected, and so is every text if nothing could be learned from; equal
texts get equal results; ties go to the first language in sorted order; NULL
languages aren't learned from; other columns are passed through (one with the
output's name is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import most_frequent, texts, written

SIZES = (2, 3, 4)
BUCKETS = 1 << 16
DIM = 16
PIECE = 1 << 16      # code points handled at a time: bounds the memory of a long text
TRAIN_ROWS = 8_000   # documents learned from at most, of all languages together (about)
MOST_LANGS = 512
DRAWN = 1_024        # subwords kept of a training document
EPOCHS, BATCH, STEP_SUBWORDS, RATE = 12, 32, 64, 2.0
LEAST_STEPS = 2_000  # small samples are gone over more often
ACCURACY = 0.99
UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str):
    """Buckets of all subwords of a text, an array for each piece; none if it has no letter."""
    held = np.zeros(1, np.uint32)  # what windows of the next piece can still begin with; 0 stands between words
    for at in range(0, len(text) + 1, PIECE):
        piece = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        seq = np.concatenate([held, np.where(_is_letter()[piece], piece, 0)])
        if at + PIECE > len(text):
            seq = np.append(seq, np.uint32(0))
        seq = seq[np.r_[True, (seq[1:] != 0) | (seq[:-1] != 0)]]
        old, h, found = len(held), np.zeros(len(seq), np.uint64), []
        for n in range(1, SIZES[-1] + 1):
            h = h[:len(seq) - n + 1] if len(seq) >= n else h[:0]
            h = h * np.uint64(0x9E3779B97F4A7C15) + seq[n - 1:].astype(np.uint64) + np.uint64(n)
            if n in SIZES:
                first = max(0, old - n + 1)  # earlier windows were counted with the last piece
                inside = np.ones(len(h), bool)
                for k in range(1, n - 1):
                    inside &= seq[k:k + len(h)] != 0
                mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found.append((mixed >> np.uint64(48)).astype(np.int64)[first:][inside[first:]])
        held = seq[max(0, len(seq) - SIZES[-1] + 1):]
        if any(map(len, found)):
            yield np.concatenate(found)


@dataclass
class LanguageModel:
    langs: list[str]
    embeddings: np.ndarray          # buckets x dim
    weights: np.ndarray             # dim x languages
    temperature: float = 1.0
    least: float = 0.0              # smaller scores are rejected

    def predict(self, values) -> list[tuple[str, float, bool]]:
        # an average of embeddings times the weights is the average of their products
        narrow = len(self.langs) <= self.embeddings.shape[1]
        own = self.embeddings @ self.weights if narrow else self.embeddings
        out = []
        for text in values:
            total, n = np.zeros(own.shape[1]), 0
            for buckets in subwords(text):
                total += own[buckets].sum(axis=0, dtype=np.float64)
                n += len(buckets)
            if not n or not self.langs:
                out.append((UNKNOWN, 0.0, True))
                continue
            logits = (total if narrow else total @ self.weights) / n
            p = _softmax(logits[None] / self.temperature)[0]
            best = int(p.argmax())
            out.append((self.langs[best], float(p[best]), bool(p[best] < self.least)))
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _drawn(text: str, most: int = DRAWN) -> np.ndarray:
    """At most ``most`` subwords of a whole text, each equally likely; the same ones for the same text."""
    rng = np.random.default_rng(len(text))
    kept, order = np.empty(0, np.int64), np.empty(0)
    for buckets in subwords(text):
        kept, order = np.concatenate([kept, buckets]), np.concatenate([order, rng.random(len(buckets))])
        if len(kept) > most:
            stays = np.sort(np.argpartition(order, most)[:most])
            kept, order = kept[stays], order[stays]
    return kept


def fit(bags: list[np.ndarray], labels: np.ndarray, langs: list[str]) -> LanguageModel:
    """Stochastic gradient descent on the cross-entropy of averaged subwords."""
    rng = np.random.default_rng(11)
    model = LanguageModel(langs, rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32),
                          np.zeros((DIM, len(langs)), np.float32))
    if not bags:
        return model
    ends = np.cumsum([len(b) for b in bags])
    starts, sizes, flat = ends - [len(b) for b in bags], np.array([len(b) for b in bags]), np.concatenate(bags)
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(bags) // BATCH)))
    steps, step = epochs * -(-len(bags) // BATCH), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            rate, step = np.float32(RATE * (1 - step / steps)), step + 1
            drawn = flat[starts[rows][:, None] + (rng.random((len(rows), STEP_SUBWORDS)) * sizes[rows][:, None]).astype(int)]
            average = model.embeddings[drawn].mean(axis=1)
            slope = _softmax(average @ model.weights)
            slope[np.arange(len(rows)), labels[rows]] -= 1
            back = slope @ model.weights.T / STEP_SUBWORDS
            model.weights -= rate / len(rows) * (average.T @ slope)
            np.subtract.at(model.embeddings, drawn.ravel(), np.repeat(rate * back, STEP_SUBWORDS, axis=0))
    return model


def calibrate(model: LanguageModel, bags: list[np.ndarray], labels: np.ndarray) -> None:
    """The temperature with the least cross-entropy, then the least score with the wanted accuracy from there on."""
    if not bags:
        return
    logits = np.stack([model.embeddings[b].mean(axis=0, dtype=np.float64) for b in bags]) @ model.weights
    own = np.arange(len(bags)), labels
    loss = {t: -np.log(_softmax(logits / t)[own] + 1e-12).mean() for t in 2.0 ** np.arange(-4, 4.25, 0.25)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(logits / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-score, kind="stable")
    good = np.flatnonzero(np.cumsum(right[order]) >= ACCURACY * np.arange(1, len(order) + 1))
    # all of them reach it: nothing is known against smaller scores either
    model.least = 0.0 if len(good) and good[-1] == len(order) - 1 else float(
        score[order[good[-1]]] if len(good) else np.nextafter(score.max(), 2))


def training_rows(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", most: int = TRAIN_ROWS) -> DataFrame:
    """Written rows (key, lang, bag): about ``most`` usable documents with a language and a letter, equal texts once."""
    known = docs.where(F.coalesce(usable, F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.xxhash64(text_col).alias("key"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(1_000_000_000)).alias("turn"))
    counts = most_frequent(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "n", MOST_LANGS)
    spark = docs.sparkSession
    share = [(r["lang"], int(1_000_000_000 * min(1.0, most / len(counts) / r["n"])) + 1) for r in counts]
    shares = spark.createDataFrame(share, "lang string, share bigint")
    picked = known.join(F.broadcast(shares), "lang").where(F.col("turn") < F.col("share"))  # at most MOST_LANGS rows

    @F.arrow_udf("array<int>")
    def draw(text: pa.Array) -> pa.Array:
        return pa.array([_drawn(t).astype(np.int32) for t in texts(text)], pa.list_(pa.int32()))

    rows = picked.groupBy("key", "lang").agg(F.min("text").alias("text"))
    return written(rows.select("key", "lang", draw(F.col("text")).alias("bag")).where(F.size("bag") > 0), "language")


def train(rows: DataFrame) -> LanguageModel:
    """Fits and calibrates in one task (the rows are bounded)."""
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())  # at most MOST_LANGS

    def learn(batches):
        held = [x for b in batches for x in zip(*(b.column(i).to_pylist() for i in range(2)),
                                                [np.array(v, np.int64) for v in b.column(2).to_pylist()])]
        held.sort(key=lambda x: x[:2])
        apart = np.array([key % 5 == 0 for key, _, _ in held], bool)
        label, bags = np.array([langs.index(x) for _, x, _ in held], np.int64), [bag for _, _, bag in held]
        model = fit([b for b, a in zip(bags, apart) if not a], label[~apart], langs)
        calibrate(model, [b for b, a in zip(bags, apart) if a], label[apart])
        yield pa.RecordBatch.from_pydict({
            "embeddings": [model.embeddings.tobytes()], "weights": [model.weights.tobytes()],
            "temperature": [model.temperature], "least": [model.least]})

    got = rows.select("key", "lang", "bag").coalesce(1).mapInArrow(
        learn, "embeddings binary, weights binary, temperature double, least double").first()
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, DIM), np.float32), np.zeros((DIM, 0), np.float32))
    return LanguageModel(langs, np.frombuffer(got["embeddings"], np.float32).reshape(BUCKETS, DIM),
                         np.frombuffer(got["weights"], np.float32).reshape(DIM, -1), got["temperature"], got["least"])


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct (lang, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 MB and 64 bytes for each language

    @F.arrow_udf("struct<lang: string, score: double, rejected: boolean>")
    def language(text: pa.Array) -> pa.Array:
        lang, score, rejected = zip(*shared.value.predict(texts(text))) if len(text) else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["lang", "score", "rejected"])

    return docs.withColumn(out, language.asNondeterministic()(F.col(text_col)))
