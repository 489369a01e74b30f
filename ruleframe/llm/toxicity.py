"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed lower-case words.  The model scores it by
a bias, a weight per term and, for every pair of terms, the inner product of
their factor vectors, so a pair may mean more (or less) than its two words.

Statistics of the terms and the fit itself use at most ``TRAIN_ROWS``
labelled documents, picked by a hash of their id (a documented bound; every
document is scored).  Every term of ``LEAST_DOCUMENTS`` of them enters the
fit, also one that is as common in both classes: it may tell in a pair.  The
weight and factors of terms less than ``LEAST_Z`` standard errors apart
between the classes are drawn to zero, which only evidence withstands; terms
that end at zero add nothing and are left out of the model.

Defined results: a NULL or empty text has no terms and gets the bias; only
ids with a non-NULL label are learned from, repeated label rows count as one
(the larger label); without a toxic or a clean row the model is a constant;
repeated documents each get a row; other columns pass through, one named like
the output column is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import texts, written

TERM_BITS = 22
TRAIN_ROWS = 20_000
LEAST_DOCUMENTS = 4    # training documents of a term
LEAST_Z = 5.0          # standard errors between the classes' shares; below, a term is drawn to zero
PULL_WEIGHT, PULL_FACTORS = 6e-3, 1.5e-3  # how strongly, as a gradient
FACTORS = 4
EPOCHS = 40
WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> list[int]:
    """Distinct hashed words."""
    crc, mask = zlib.crc32, (1 << TERM_BITS) - 1
    return list({crc(w.encode("utf-8", "surrogatepass")) & mask for w in set(WORD.findall(text.lower()))})


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _towards_zero(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


@dataclass
class FactorizationMachine:
    """Terms by index: hash -> row of ``weight`` and ``factors``."""

    index: dict[int, int]
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def _sums(self, rows: list[np.ndarray]):
        flat = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        linear = np.bincount(owner, self.weight[flat], len(rows))
        total = np.stack([np.bincount(owner, f[flat], len(rows)) for f in self.factors.T], 1)
        square = np.bincount(owner, (self.factors[flat] ** 2).sum(axis=1), len(rows))
        return flat, owner, linear, total, square

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        _, _, linear, total, square = self._sums(rows)
        return _sigmoid(self.bias + linear + ((total ** 2).sum(axis=1) - square) / 2)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1,
            shrink: float = 1e-4, batch: int = 128, weak: np.ndarray | None = None) -> None:
        """Minibatch AdaGrad on the log loss; the same result for the same rows in the same order.

        Terms that ``weak`` names also take a proximal step towards zero.
        """
        weak = np.zeros(len(self.weight)) if weak is None else weak.astype(float)
        rng = np.random.default_rng(7)
        seen_w, seen_f, seen_b = (np.full(s, 1e-6) for s in (self.weight.shape, self.factors.shape, ()))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                own = [rows[i] for i in part]
                flat, owner, linear, total, square = self._sums(own)
                error = _sigmoid(self.bias + linear + ((total ** 2).sum(axis=1) - square) / 2) - labels[part]
                each = error[owner]
                used, at_used = np.unique(flat, return_inverse=True)
                n, pull = len(used), weak[used]
                grad_w = np.bincount(at_used, each, n) / len(part)
                grad_f = np.stack([np.bincount(at_used, each * (total[owner, k] - self.factors[flat, k]), n)
                                   for k in range(self.factors.shape[1])], 1) / len(part)
                grad_w += shrink * self.weight[used]
                grad_f += shrink * self.factors[used]
                grad_b = error.mean()
                seen_w[used] += grad_w ** 2
                seen_f[used] += grad_f ** 2
                seen_b = seen_b + grad_b ** 2
                step_w, step_f = rate / np.sqrt(seen_w[used]), rate * 0.3 / np.sqrt(seen_f[used])
                self.weight[used] = _towards_zero(self.weight[used] - step_w * grad_w, step_w * PULL_WEIGHT * pull)
                self.factors[used] = _towards_zero(self.factors[used] - step_f * grad_f,
                                                   step_f * PULL_FACTORS * pull[:, None])
                self.bias -= float(rate * grad_b / np.sqrt(seen_b))


def _term_sets(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    @F.arrow_udf("array<int>")
    def term_set(text: pa.Array) -> pa.Array:
        return pa.array([terms_of(t) for t in texts(text)], pa.list_(pa.int32()))

    return docs.withColumn(out, term_set.asNondeterministic()(F.col(text_col)))


def training_rows(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> DataFrame:
    """Rows (id, label, terms) of about ``most`` labelled documents at most; ``usable`` says which ids may be learned from."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isNotNull()).withColumnRenamed("id", id_col)
             .where(usable).groupBy(id_col).agg(F.max("label").alias("label")))
    share = min(1.0, most / max(1, known.count()))
    steps = 10**6 if share >= 1e-3 else 10**15  # fine enough for any number of labelled rows
    picked = known.where(F.pmod(F.xxhash64(id_col), F.lit(steps)) < int(share * steps))
    picked = picked.withColumnRenamed(id_col, "id")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "id")
    own = own.groupBy("id", "label").agg(F.max("text").alias("text"))  # one row for each id: keeps the bound
    return _term_sets(own, "text", "terms").select("id", "label", "terms")


def train(rows: DataFrame, factors: int = FACTORS) -> FactorizationMachine:
    """Compares the terms' classes with a distributed count, then fits in one task (the rows are bounded)."""
    rows = written(rows, "toxicity")
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"] or 0, totals["toxic"] or 0
    bias = float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    model = FactorizationMachine({}, bias, np.zeros(0), np.zeros((0, factors)))
    if not toxic or toxic == n:
        return model
    counts = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    pooled = (F.col("a") + F.col("b")) / n
    z = F.abs(F.col("a") / toxic - F.col("b") / (n - toxic)) / F.sqrt(
        pooled * (1 - pooled) * (1 / toxic + 1 / (n - toxic)) + 1e-12)
    terms = sorted(counts.where(F.col("a") + F.col("b") >= LEAST_DOCUMENTS)
                   .select("term", (z < LEAST_Z).alias("weak")).collect(), key=lambda r: r["term"])
    index = {r["term"]: i for i, r in enumerate(terms)}
    weak = np.array([r["weak"] for r in terms], bool)
    model = FactorizationMachine(index, bias, np.zeros(len(index)),
                                 np.random.default_rng(3).normal(0, 0.05, (len(index), factors)))

    def fit(batches):
        ids, labels, sets = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            sets += [np.array(sorted(index[t] for t in r if t in index), np.int64) for r in b.column(2).to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (str(ids[i]), sets[i].tobytes()))
        model.fit([sets[i] for i in order], np.array([labels[i] for i in order], float), weak=weak)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.bias]), pa.array([model.weight.tolist()]), pa.array([model.factors.ravel().tolist()])],
            names=["bias", "weight", "factors"])

    got = rows.coalesce(1).mapInArrow(fit, "bias double, weight array<double>, factors array<double>").first()
    weight, own = np.array(got["weight"]), np.array(got["factors"]).reshape(-1, factors)
    left = np.flatnonzero((weight != 0) | (own != 0).any(axis=1))
    at = {int(i): k for k, i in enumerate(left)}
    return FactorizationMachine({t: at[i] for t, i in index.items() if i in at}, got["bias"], weight[left], own[left])


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(text: pa.Array) -> pa.Array:
        m = shared.value
        rows = [np.array([m.index[x] for x in terms_of(t) if x in m.index], np.int64) for t in texts(text)]
        return pa.array(m.score(rows) if rows else [], pa.float64())

    return docs.withColumn(out, toxicity.asNondeterministic()(F.col(text_col)))
