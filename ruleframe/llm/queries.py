"""One registered query per operator, over the driver's whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from ruleframe.llm import (decontam, language, linededup, lm, negatives, packing, pii, quality, simhash, tokens,
                           toxicity, urls, vectorcodes)
from ruleframe.llm.common import crc_mod, importable, table, written
from ruleframe.operators.joins import BROADCAST_BYTES, text_bytes

# Where the public tokenizer files are; None: the place that the public_tokenizers package names.
TOKENIZER_DIR = None
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    if TOKENIZER_DIR:
        return f"{TOKENIZER_DIR}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def registered(query):
    @wraps(query)
    def run(spark, sf_dir):
        importable(spark)
        return query(spark, sf_dir)

    QUERIES[query.__name__] = run
    return run


@registered
def op1_factorization_machine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), ~held_out))
    return toxicity.score(docs, model, out="score").select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@registered
def op2_simhash_pivots(spark, sf_dir):
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@registered
def op3_quality_ledger(spark, sf_dir):
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    failed = F.col("ledger.failed")
    return rows.select(
        "doc_id", *[F.col(f"ledger.{m}").alias(m) for m in quality.MEASURES[:5]],
        (failed.bitwiseAND(F.lit(quality.BASE)) != 0).alias("base_failed"),
        quality.kept(quality.POLICIES[-1], failed).alias("kept"), failed.alias("failed"))


@registered
def op4_url_automaton(spark, sf_dir):
    pages = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return pages.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


TOKEN_LIMIT = 4096


@registered
def op5_token_counts(spark, sf_dir):
    docs = tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"),
                               tokenizer_file("piece_bpe_32k.model"))
    return docs.select("doc_id", "tokens.n_bytes", "tokens.n_tokens",
                       (F.col("tokens.n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@registered
def op6_benchmark_fm_index(spark, sf_dir):
    docs = decontam.search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "hits.n_words", decontam.n_hit().alias("n_hit"),
                       F.size("hits.items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join(F.sort_array("hits.items"), ","), 256).alias("items_sha256"),
                       decontam.contaminated().alias("contaminated"))


@registered
def op7_personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.find(docs, model=pii.learn(docs))
    base = F.col("pii.base")
    return rows.select(
        "doc_id", *[pii.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.concat(base, "pii.added")).alias("spans"))


@registered
def op8_cutting_stock(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


@registered
def op9_class_ngrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    return lm.learn_and_score(docs, ~held_out, more=(held_out.alias("held_out"),))


@registered
def op10_line_chunks(spark, sf_dir):
    docs = linededup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


@registered
def op11_value_dictionaries(spark, sf_dir):
    rows = vectorcodes.integer_rows(table(spark, sf_dir, "embeddings"))
    books = vectorcodes.learn(rows)
    coded = written(vectorcodes.encode(rows, books), "codes")
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if text_bytes(total) <= BROADCAST_BYTES:
        total = F.broadcast(total)
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"), vectorcodes.hexadecimal(F.col("code")).alias("code"), "error", "label_error",
        F.lit(vectorcodes.digest(books)).alias("codebooks_sha256"))


@registered
def op12_strassen_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


@registered
def op13_subword_softmax(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language.train(language.training_rows(docs, ~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
        "language.rejected")


ORACLE["op3_quality_ledger"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM w) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM hit, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '[^\x21-\x40]')))::BIGINT AS n_letter_words
  FROM d LEFT JOIN covered USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
           + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
           + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
           + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
           + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END
           + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END
           + CASE WHEN 10 * n_letter_words < 6 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""

ORACLE["op4_url_automaton"] = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, host, path, verdict, h || p AS rule,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC) AS k
  FROM (SELECT DISTINCT * FROM u) JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT u.page_id, u.host, u.path, fit.rule,
       CASE WHEN fit.rule IS NOT NULL THEN fit.verdict
            WHEN regexp_matches(u.host, 'spam-farm|cheap-pills|casino|adult-|pokerstar|roulette|jackpot|betting|gambling'
                   || '|lottery|payday|viagra|cialis|replica-watch|porn|escort-|webcam-girls|hookup|torrent|warez|keygen'
                   || '|cracked-|free-iphone|get-rich|crypto-double|forex-signal|essay-writ|link-farm|linkfarm'
                   || '|doorway-page|clickbank|parked-domain|domain-for-sale|malware|phishing|doubleclick|adserver'
                   || '|adservice|googlesyndication|popunder')
              OR regexp_matches(u.host, '(^|[.-])(ads|adv|banner|bet|bets|slots|sex|xxx|nude|pills|loan|loans|track|tracker'
                   || '|tracking|pixel|telemetry|click|clicks|popup|promo|spam|scam|coupon)($|[.-])')
              OR regexp_matches(u.path, '/(wp-admin|wp-login|wp-json|cgi-bin|admin|login|signin|signup|register|logout|cart'
                   || '|checkout|basket|account|search|tag|tags|feed|trackback|print|share|redirect|oauth|api|ajax|captcha'
                   || '|unsubscribe|preview|embed|comment-page)/')
              OR regexp_matches(u.path, '[.](jpg|jpeg|png|gif|svg|webp|ico|bmp|mp3|mp4|avi|mov|wav|zip|gz|tar|rar|7z|exe|dmg'
                   || '|iso|apk|bin|css|js|woff|xls|xlsx|ppt|pptx)$')
            THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN fit ON fit.k = 1 AND u.page_id IS NOT DISTINCT FROM fit.page_id
                    AND u.host = fit.host AND u.path = fit.path
"""

ORACLE["op6_benchmark_fm_index"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(words[i:i + k - 1], ' ') AS w
       FROM (SELECT item_id, words, least(13, len(words)) AS k,
                    unnest(range(1, greatest(1, len(words) - 11) + 1)) AS i
             FROM b WHERE len(words) > 0)),
dw AS (SELECT rid, k, i, array_to_string(words[i:i + k - 1], ' ') AS w
       FROM (SELECT rid, words, k, unnest(range(1, len(words) - k + 2)) AS i
             FROM d, (SELECT DISTINCT k FROM bw) WHERE len(words) >= k)),
hit AS (SELECT rid, item_id, k, i FROM dw JOIN bw USING (k, w)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit
      FROM (SELECT DISTINCT rid, unnest(range(i, i + k)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""


def _codebook_rounds(rounds: int) -> str:
    """CTEs of the rounds: a<i> names each part's nearest entry (distance * 16 + entry), b<i> holds the moved entries."""
    square = "+".join(f"(x.w[{k}] - b.w[{k}]) * (x.w[{k}] - b.w[{k}])" for k in range(1, 9))
    out = []
    for i in range(1, rounds + 2):
        out.append(f"a{i} AS MATERIALIZED (SELECT rid, p, min(({square}) * 16 + e) AS m "
                   f"FROM x JOIN b{i - 1} b USING (p) GROUP BY rid, p)")
        if i <= rounds:
            sums = ", ".join(f"sum(w[{k}])::HUGEINT AS s{k}" for k in range(1, 9))
            floors = ", ".join(f"((s{k} - ((s{k} % n) + n) % n) // n)::BIGINT" for k in range(1, 9))
            out.append(f"m{i} AS (SELECT p, m % 16 AS e, count(*) AS n, {sums} FROM a{i} JOIN x USING (rid, p) GROUP BY ALL)")
            out.append(f"b{i} AS MATERIALIZED (SELECT p, e, CASE WHEN n IS NULL THEN w ELSE [{floors}] END AS w "
                       f"FROM b{i - 1} LEFT JOIN m{i} USING (p, e))")
    return ",\n".join(out)


ORACLE["op11_value_dictionaries"] = f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, label,
         list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT rid, p, v[8 * p + 1:8 * p + 8] AS w FROM kept, (SELECT unnest(range(8)) AS p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w
  FROM x JOIN (SELECT rid, vec_id FROM kept ORDER BY vec_id LIMIT 16) USING (rid)),
{_codebook_rounds(6)},
coded AS (SELECT rid, string_agg(printf('%02x', m % 16), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error
          FROM a7 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(array_to_string(flatten(list(w ORDER BY p, e)), ',')) FROM b6) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""

ORACLE["op12_strassen_negatives"] = """
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id AS id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS MATERIALIZED (
  SELECT a.rid AS aid, a.id AS anchor_id, c.rid, c.id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM kept a JOIN kept c ON a.rid <> c.rid WHERE a.id % 100 = 0),
positive AS (
  SELECT aid, anchor_id, rid AS pid, id AS positive_id, score AS positive_score
  FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY aid ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY aid, pid ORDER BY score DESC, id))::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (aid, anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY aid, pid ORDER BY score DESC, id) <= 5
"""
