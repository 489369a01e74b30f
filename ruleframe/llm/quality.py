"""Quality rules kept in a bitmask ledger.

Every rule is evaluated once per document.  The ledger row stores the
measurements and one failure bit per rule; a policy is a versioned pair of
masks applied to the stored bits, so a new policy or an ablation never reads
the texts again.

Defined results: a NULL text has no words; an empty table gives an empty
ledger; repeated rows give one ledger row each; columns other than the text
are passed through, except that one named like the ledger column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
NO_LETTERS = bytes(range(0x21, 0x41))  # ASCII marks and digits up to @

# Rule name -> failure condition over the measurements (SQL; integers only, so exact).  The bit is the position.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("few_letters", "10 * n_letter_words < 6 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is rejected if a ``reject`` bit is set, or at least ``max_soft`` of the ``soft`` bits."""

    version: int
    reject: int
    soft: int = 0
    max_soft: int = 64

    def rejects(self, mask: Column) -> Column:
        return (mask.bitwiseAND(F.lit(self.reject)) != 0) | (
            F.bit_count(mask.bitwiseAND(F.lit(self.soft))) >= self.max_soft)


def bits(*names: str) -> int:
    return sum(BIT[n] for n in names)


BASE = bits("few_words", "repeated_words")
POLICIES = (
    Policy(1, BASE),
    Policy(2, BASE | bits("symbols", "duplicate_lines"),
           bits("short_words", "long_words", "few_letters"), 1),
)


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    pair = a[:-2] * v + a[1:-1]
    if v >= 2_000_000:  # keeps the key below 2**63
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    _, inverse, count = np.unique(pair * v + a[2:], return_inverse=True, return_counts=True)
    hit = count[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= hit
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split: exactly space, \t, \n, \v, \f and \r
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), _repeated(words), len(lines),
            sum(1 for w in words if w[0] > 64 or w.translate(None, NO_LETTERS)))


def with_measures(docs: DataFrame, text_col: str = "text", out: str = "measures") -> DataFrame:
    """``docs`` with the struct of measurements; the only pass over the texts."""

    @F.arrow_udf(", ".join(f"{m} bigint" for m in MEASURES))
    def measures(text: pa.Array) -> pa.Array:
        rows = [measure(t) for t in texts(text)]
        columns = zip(*rows) if rows else [[]] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    # non-deterministic in name only: keeps a later filter from evaluating it twice
    return docs.withColumn(out, measures.asNondeterministic()(F.col(text_col)))


def ledger(docs: DataFrame, text_col: str = "text", out: str = "ledger") -> DataFrame:
    """``docs`` with a struct column: every measurement and ``failed``, one bit for each rule."""
    df = with_measures(docs, text_col, out)
    mask = F.lit(0).cast("bigint")
    for name, rule in RULES:
        text = rule
        for m in MEASURES:
            text = text.replace(m, f"{out}.{m}")
        mask = mask + F.when(F.expr(text), F.lit(BIT[name]).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    return df.withColumn(out, F.col(out).withField("failed", mask))


def kept(policy: Policy, failed: Column) -> Column:
    return ~policy.rejects(failed)


def ablation(ledgers: DataFrame, policies: tuple[Policy, ...] = POLICIES, out: str = "ledger") -> DataFrame:
    """Per policy and rule: documents rejected, and those that only this rule rejects.

    One aggregation by bitmask (at most 2**rules groups, partial in each
    task); everything else is bit arithmetic on the groups.
    """
    groups = ledgers.groupBy(F.col(f"{out}.failed").alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    picked = []
    for p in policies:
        now = p.rejects(F.col("failed"))
        for name, _ in RULES:
            without = p.rejects(F.col("failed").bitwiseAND(F.lit(~BIT[name])))
            picked.append(F.struct(
                F.lit(p.version).alias("version"), F.lit(name).alias("rule"),
                F.when(F.col("failed").bitwiseAND(F.lit(BIT[name])) != 0, F.col("n")).otherwise(0).alias("n_failed"),
                F.when(now, F.col("n")).otherwise(0).alias("n_rejected"),
                F.when(now & ~without, F.col("n")).otherwise(0).alias("n_only_this")))
    return (groups.select(F.inline(F.array(*picked))).groupBy("version", "rule")
            .agg(*[F.sum(c).alias(c) for c in ("n_failed", "n_rejected", "n_only_this")]))
