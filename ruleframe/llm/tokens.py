"""Token counts by a two-tier lookup on the map side.

The tokenizer's pieces never hold a space mark after another character, so a
text may be cut before every run of spaces and the token counts of the cuts
add up (checked when the model is loaded).  Tier one is a broadcast table of
the most frequent cuts (pre-tokens) with their lengths; tier two is a bounded
cache in each Python worker for the rest (at most CACHE_ROWS pre-tokens of
CACHE_CHARS characters; longer ones are encoded where they occur).  No pre-token of a document is
shuffled: the frequent ones are found from per-task summaries of bounded size.

Defined results: a NULL text counts as empty (0 tokens); repeated rows are
counted alike; other columns pass through, one named like the output column
is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import most_frequent, texts, written

MARK = "▁"
CUT = re.compile(" +[^ ]+| +$")
TABLE_ROWS = 32_768     # entries of the broadcast table
TABLE_CHARS = 48        # longest pre-token in it: the table stays below 10 MB
SUMMARY_ROWS = 8_192    # counters of one task's summary
CACHE_ROWS = 400_000    # pre-tokens in a worker's cache
CACHE_CHARS = 64        # longest pre-token kept in it: a text without spaces is one pre-token of any length


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("a piece spans a space: texts can't be counted by pre-token")
    return model


def cuts(text: str) -> list[str]:
    """Pre-tokens, each led by its spaces; the model sees one leading space before a text."""
    return CUT.findall(" " + text.replace(MARK, " ")) if text else []


class Lengths(dict):
    """Pre-token -> tokens; misses are encoded, and forgotten when there are too many."""

    def __init__(self, path: str, most: int = CACHE_ROWS):
        super().__init__()
        self.model, self.most = tokenizer(path), most

    def __missing__(self, cut: str) -> int:
        if len(self) >= self.most:
            self.clear()
        # the model adds one leading space itself, except to an empty text
        n = len(self.model.encode(cut[1:])) if len(cut) > 1 else 1
        if len(cut) <= CACHE_CHARS:
            self[cut] = n
        return n


@lru_cache(maxsize=4)
def worker_cache(path: str) -> Lengths:
    return Lengths(path)


def summarize(batches, counters: int = SUMMARY_ROWS):
    """One task's frequent pre-tokens: counters are thinned by the smallest kept count (Misra-Gries)."""
    count: Counter = Counter()
    for batch in batches:
        for text in texts(batch.column(0)):
            count.update(x for x in cuts(text) if len(x) <= TABLE_CHARS)
            if len(count) > 16 * counters:
                least = sorted(count.values(), reverse=True)[counters]
                count = Counter({k: v - least for k, v in count.items() if v > least})
    top = count.most_common(counters)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()),
                                      pa.array([v for _, v in top], pa.int64())], names=["cut", "n"])


def frequent(docs: DataFrame, path: str, text_col: str = "text", rows: int = TABLE_ROWS) -> dict[str, int]:
    """The broadcast table: the most frequent pre-tokens of all documents with their token counts.

    Each task hands on at most SUMMARY_ROWS rows; the driver receives at most ``rows``.
    """
    sums = written(docs.select(F.col(text_col)).mapInArrow(summarize, "cut string, n bigint")
                   .groupBy("cut").agg(F.sum("n").alias("n")), "cuts")
    top = most_frequent(sums, "cut", "n", rows)
    lengths = Lengths(path, rows + 1)
    return {r["cut"]: lengths[r["cut"]] for r in top}


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", out: str = "tokens",
                 table_rows: int = TABLE_ROWS) -> DataFrame:
    """``docs`` with a struct: n_bytes (UTF-8) and n_tokens of the whole text."""
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text_col, table_rows))

    @F.arrow_udf("n_bytes bigint, n_tokens bigint")
    def tokens(text: pa.Array) -> pa.Array:
        first, second = table.value, worker_cache(path)
        n_bytes, n_tokens = [], []
        for t in texts(text):
            n_bytes.append(len(t.encode("utf-8", "surrogatepass")))
            n_tokens.append(sum(first.get(x) or second[x] for x in cuts(t)))
        return pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())],
                                          names=["n_bytes", "n_tokens"])

    return docs.withColumn(out, tokens.asNondeterministic()(F.col(text_col)))
