"""Quality ledger, URL automaton and token counts against plain versions."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleframe.llm import quality, tokens, urls
from ruleframe.llm.queries import tokenizer_file

WORD = re.compile("[^\x20\x09-\x0D]+")


def _plain(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    hit = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(lines), sum(1 for w in words if any(not 0x21 <= ord(c) <= 0x40 for c in w)))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\t\x0b\x85\u3000é|1.", max_size=80))
def test_measures(text):
    assert quality.measure(text) == _plain(text)


def test_policies_and_ablation(spark):
    texts = ["word " * 60, "one two", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i} ###" for i in range(60)),
             None, "\n".join(["same line of text"] * 3 + [f"line {i} differs" for i in range(20)])]
    rows = quality.ledger(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"))
    kept = {r.doc_id: r.k for r in rows.select("doc_id", quality.kept(quality.POLICIES[-1], F.col("ledger.failed"))
                                               .alias("k")).collect()}
    assert kept == {0: False, 1: False, 2: True, 3: False, 4: False, 5: True}
    masks = [r.f for r in rows.select(F.col("ledger.failed").alias("f")).collect()]
    for r in quality.ablation(rows).collect():
        p = next(p for p in quality.POLICIES if p.version == r.version)
        bit = quality.BIT[r.rule]
        rejects = lambda m: bool(m & p.reject) or bin(m & p.soft).count("1") >= p.max_soft
        assert r.n_failed == sum(bool(m & bit) for m in masks)
        assert r.n_rejected == sum(map(rejects, masks))
        assert r.n_only_this == sum(rejects(m) and not rejects(m & ~bit) for m in masks)


def test_automaton_equals_regular_expressions():
    rng = random.Random(4)
    globs = [("".join(rng.choice("ab.*") for _ in range(rng.randint(0, 9))),
              "".join(rng.choice("/ab*") for _ in range(rng.randint(0, 30)))) for _ in range(60)]
    pairs = [("".join(rng.choice("ab.") for _ in range(rng.randint(0, 6))).encode(),
              "".join(rng.choice("/ab") for _ in range(rng.randint(0, 8))).encode()) for _ in range(400)]
    hit = urls.GlobAutomaton(globs).match(pairs)
    for g, (host, path) in enumerate(globs):
        r = [re.compile(re.escape(x).replace(r"\*", "(?s:.*)")) for x in (host, path)]
        for u, (h, p) in enumerate(pairs):
            assert hit[u, g] == bool(r[0].fullmatch(h.decode()) and r[1].fullmatch(p.decode())), (globs[g], pairs[u])


@pytest.mark.parametrize("url, want", [
    (None, ("", "", None, "allow")), ("no scheme", ("", "", None, "allow")), ("x://", ("", "", None, "allow")),
    ("HTTP://WWW.Example.ORG/es/A?b#c", ("www.example.org", "/es/A", "example.org/es/", "block")),
    ("http://example.org", ("example.org", "", None, "allow")), ("http://example.org/", ("example.org", "/", "org/", "allow")),
    ("a://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
    ("a://notexample.org/en/12", ("notexample.org", "/en/12", "org/", "allow")),
    ("a://x.com/de/1://y", ("x.com", "/de/1://y", "com/de/", "block")), ("a://cheap-pills.net#f", ("cheap-pills.net", "", None, "block")),
    ("a://x.net/spam-farm", ("x.net", "/spam-farm", None, "allow")), ("a://É.COM?/de/", ("É.com", "", None, "allow"))])
def test_urls(spark, url, want):
    r = urls.judge(spark.createDataFrame([(url,)], "url string")).first().judged
    assert tuple(r) == want


def test_rule_masks_beyond_one_word(spark):
    rules = tuple(urls.Rule("block", f"host{i}.example", f"/deep/path/{i}/") for i in range(50))
    df = spark.createDataFrame([(i, f"http://www.host{i}.example/deep/path/{i}/x") for i in range(60)], "i int, url string")
    for r in urls.judge(df, rules=rules).collect():
        assert (r.judged.verdict, r.judged.rule) == (("block", f"host{r.i}.example/deep/path/{r.i}/") if r.i < 50
                                                     else ("allow", None))


def test_token_counts_equal_the_tokenizer(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    rng = random.Random(8)
    pieces = [*"ab  \t\né▁ﬁ日1.\x00\u3000\u200b\r🙂", "the ", " and", "  ", "<s>", "</s>", "<unk>", "   "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", None, " ", "▁"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    model = tokens.tokenizer(path)
    for r in tokens.count_tokens(df, path, table_rows=20).collect():
        t = texts[r.doc_id] or ""
        assert (r.tokens.n_bytes, r.tokens.n_tokens) == (len(t.encode()), len(model.encode(t))), repr(t)


def test_worker_cache_forgets_but_counts_right():
    cache = tokens.Lengths(tokenizer_file("piece_bpe_32k.model"), most=3)
    assert [cache[f" w{i}"] for i in range(9)] == [len(cache.model.encode(f"w{i}")) for i in range(9)]
    assert len(cache) <= 3


def test_block_list():
    assert len(urls.BLOCK_GLOBS) == len(set(urls.BLOCK_GLOBS)) > 300
    automaton = urls.GlobAutomaton(list(urls.BLOCK_GLOBS))
    assert automaton.words > 40
    hit = {"www.best-casino1.com": "/", "ads.x.org": "/", "x.ads": "", "a-bet-b.net": "/p", "x.org": "/blog/tag/y", "y.org": "/i/a.jpg"}
    miss = {"adsx.org": "/", "xads.org": "/", "beta.org": "/", "z.org": "/tag", "w.org": "/tags", "v.org": "/a.jpg/b", "u.org": "/ajpg"}
    found = automaton.match([(h.encode(), p.encode()) for h, p in [*hit.items(), *miss.items()]]).any(axis=1)
    assert found.tolist() == [True] * len(hit) + [False] * len(miss)


def test_long_pre_tokens_are_not_cached():
    path = tokenizer_file("piece_bpe_32k.model")
    cache = tokens.Lengths(path)
    for text in ("x" * 100_000, "日本" * 40, "short"):
        cut, = tokens.cuts(text)
        assert cache[cut] == len(tokens.tokenizer(path).encode(text))
    assert list(cache) == [" short"]
