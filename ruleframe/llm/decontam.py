"""Benchmark decontamination with an FM-index per shard of training text.

Each task indexes its documents shard by shard and looks every benchmark
window up in the index by backward search; occurrences are located through
sampled suffix positions and merged into removal spans per document.

The index is over word ids.  Words that no benchmark item uses can't be part
of an occurrence: they become a separator, and a run of them a single one.
Equal texts of a shard share their entry.  A shard takes at least
``SHARD_WORDS`` words unless the batch ends, and at most one more document.

The benchmark is taken in blocks of about ``BLOCK_BYTES``; one block is
broadcast at a time, and with several blocks the documents are passed once
for each.

Defined results: a NULL or wordless text has no words and no hits; NULL or
wordless items have no windows; items without an id are searched but not
listed; repeated items count once; repeated documents each get a row; other
columns pass through, one named like the output column is replaced; an empty
table on either side gives no hits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleframe.llm.common import fresh, texts, written
from ruleframe.llm.fmindex import FMIndex

WINDOW = 13
SHARD_WORDS = 1_000_000
BLOCK_BYTES = 4 << 20
# A-Z to a-z; every byte that is no word byte (0-9, a-z, 0x80 and up) to a space
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
                   for c in range(256))
HITS = "n_words bigint, spans array<struct<start: int, end: int>>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Phrases:
    """Benchmark windows as rows of word ids, by length, with the items they come from."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            k = min(window, len(ids))
            for at in range(len(ids) - k + 1 if k else 0):
                owners.setdefault(tuple(ids[at:at + k]), set()).update(() if item_id is None else {str(item_id)})
        self.by_length = {}
        for k in sorted({len(w) for w in owners}):
            rows = [w for w in owners if len(w) == k]
            self.by_length[k] = (np.array(rows, np.int64), [sorted(owners[w]) for w in rows])


def _search(ids: list[np.ndarray], phrases: Phrases) -> list[tuple[list, list]]:
    """For each document of a shard, given by word ids: merged spans of words, and items."""
    sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.zeros(starts[-1] + 1, np.int64)  # a separator after each document
    for s, x in zip(starts, ids):
        flat[s:s + len(x)] = x
    flat[-1] = 0
    place = np.flatnonzero((flat > 0) | np.concatenate([[True], flat[:-1] > 0]))
    index = FMIndex(flat[place], len(phrases.vocabulary) + 1)
    edge = np.zeros(len(flat) + 1, np.int64)
    items: list[set] = [set() for _ in ids]
    for k, (patterns, owners) in phrases.by_length.items():
        low, high = index.search(patterns)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        n = (high - low)[found]
        rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        at = place[index.locate(rows)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, np.repeat(found, n)], 1), axis=0).tolist():
            items[d].update(owners[w])
    hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    spans: list[list] = [[] for _ in ids]
    for b, e, d in zip(begin.tolist(), end.tolist(), (np.searchsorted(starts, begin, side="right") - 1).tolist()):
        spans[d].append({"start": b - int(starts[d]), "end": e - int(starts[d])})
    return [(s, sorted(i)) for s, i in zip(spans, items)]


def search_texts(all_texts, phrases: Phrases, shard_words: int = SHARD_WORDS) -> list[tuple[int, list, list]]:
    """(words, spans, items) of each text."""
    entry_of: dict[str, int] = {}
    entries: list[int] = []
    sizes: list[int] = []
    found: list[tuple[list, list]] = []
    shard: list[np.ndarray] = []
    waiting, get = 0, phrases.vocabulary.get
    for t in all_texts:
        if t not in entry_of:
            entry_of[t] = len(sizes)
            words = words_of(t)
            sizes.append(len(words))
            shard.append(np.array([get(w, 0) for w in words], np.int64))
            waiting += len(words)
        entries.append(entry_of[t])
        if waiting >= shard_words:
            found += _search(shard, phrases)
            shard, waiting = [], 0
    if shard:
        found += _search(shard, phrases)
    return [(sizes[e], *found[e]) for e in entries]


def _searcher(items: list[tuple], spark, shard_words: int):
    phrases = spark.sparkContext.broadcast(Phrases(items))

    @F.arrow_udf(HITS)
    def hits(text: pa.Array) -> pa.Array:
        rows = search_texts(texts(text), phrases.value, shard_words)
        columns = list(zip(*rows)) or [[], [], []]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], span), pa.array(columns[2], pa.list_(pa.string()))],
            names=["n_words", "spans", "items"])

    return hits.asNondeterministic()


def _merged(spans: Column) -> Column:
    """Union of sorted spans of words."""
    none = F.array().cast("array<struct<start: int, end: int>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = lambda acc, x: F.concat(
        F.slice(acc, 1, F.size(acc) - 1),
        F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    return F.aggregate(F.sort_array(spans), none,
                       lambda acc, x: F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]),
                                             joined(acc, x)).otherwise(F.concat(acc, F.array(x))))


def search(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits", item_col: str = "item_id",
           item_text: str = "text", block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with a struct: n_words, spans (of words, merged, end exclusive) and items that occur."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    block = lambda b: [tuple(r) for r in items.where(
        F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).collect()]
    if blocks == 1:
        return docs.withColumn(out, _searcher(block(0), spark, shard_words)(F.col(text_col)))
    h, s, found = (fresh(docs, n) for n in ("__h", "__s", "__found"))
    key = [F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(h),
           F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias(s)]
    parts = [written(docs.select(text_col).withColumn(out, _searcher(block(b), spark, shard_words)(F.col(text_col)))
                     .select(*key, f"{out}.*").distinct(), "hits") for b in range(blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    joined = every.groupBy(h, s).agg(
        F.struct(F.max("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).alias(found))
    own = docs.withColumns({h: key[0], s: key[1]})
    return own.join(joined, [h, s], "left").withColumn(out, F.col(found)).drop(h, s, found)


def n_hit(hits: str = "hits") -> Column:
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("bigint"), lambda n, s: n + (s["end"] - s["start"]))


def contaminated(hits: str = "hits") -> Column:
    """At least a twentieth of the words are hit."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))
