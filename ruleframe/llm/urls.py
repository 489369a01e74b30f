"""URL verdicts by one bit-parallel automaton over all patterns.

All glob patterns are packed into one multiword bit vector: a pattern with k
literal bytes takes k + 1 bits, bit j meaning "the first j literals are
matched".  For each byte of a URL all patterns advance at once by a shift, an
AND with the byte's mask and the self-loops of the wildcards (Shift-And).  A
batch of URLs advances together, column by column.

Canonical form: lower-case host, a separator that no byte equals, path.  In a
host ``*`` stops at the separator.

Defined results: a URL that is NULL or has no ``://`` has an empty host and
path (and so matches only patterns that fit an empty host); repeated rows are
judged alike; other columns pass through, one named like the output column is
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = 256
SYMBOLS = 257


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains when the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# --- fixed values: the rules of the query, and what URLs that no rule fits are blocked by ---
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
# anywhere in a host
HOST_TEXTS = ("spam-farm", "cheap-pills", "casino", "adult-", "pokerstar", "roulette", "jackpot", "betting", "gambling",
              "lottery", "payday", "viagra", "cialis", "replica-watch", "porn", "escort-", "webcam-girls", "hookup",
              "torrent", "warez", "keygen", "cracked-", "free-iphone", "get-rich", "crypto-double", "forex-signal",
              "essay-writ", "link-farm", "linkfarm", "doorway-page", "clickbank", "parked-domain", "domain-for-sale",
              "malware", "phishing", "doubleclick", "adserver", "adservice", "googlesyndication", "popunder")
# a whole part of a host, between dots and hyphens
HOST_PARTS = ("ads", "adv", "banner", "bet", "bets", "slots", "sex", "xxx", "nude", "pills", "loan", "loans", "track", "tracker",
              "tracking", "pixel", "telemetry", "click", "clicks", "popup", "promo", "spam", "scam", "coupon")
# a folder of a path
FOLDERS = ("wp-admin", "wp-login", "wp-json", "cgi-bin", "admin", "login", "signin", "signup", "register", "logout", "cart",
           "checkout", "basket", "account", "search", "tag", "tags", "feed", "trackback", "print", "share", "redirect",
           "oauth", "api", "ajax", "captcha", "unsubscribe", "preview", "embed", "comment-page")
# the end of a path
EXTENSIONS = ("jpg", "jpeg", "png", "gif", "svg", "webp", "ico", "bmp", "mp3", "mp4", "avi", "mov", "wav", "zip", "gz", "tar",
              "rar", "7z", "exe", "dmg", "iso", "apk", "bin", "css", "js", "woff", "xls", "xlsx", "ppt", "pptx")
# -------------------------------------------------------------------------------------------
# (host glob, path glob): 40 texts, 24 parts in 9 places, 30 folders, 30 extensions
BLOCK_GLOBS = (
    *((f"*{t}*", "*") for t in HOST_TEXTS),
    *((f"{a}{t}{z}", "*") for t in HOST_PARTS for a in ("", "*.", "*-") for z in ("", ".*", "-*")),
    *(("*", f"*/{t}/*") for t in FOLDERS),
    *(("*", f"*.{t}") for t in EXTENSIONS),
)


class GlobAutomaton:
    """Masks for all (host glob, path glob) pairs; ``match`` gives one hit row per URL."""

    def __init__(self, globs: list[tuple[str, str]]):
        states, literal, loops, self.final = 0, [], [], []
        first = []
        for host, path in globs:
            first.append(states)
            symbols = [*host.encode(), SEPARATOR, *path.encode()]
            in_path = False
            for s in symbols:
                if s == ord("*"):
                    loops.append((states, in_path))
                else:
                    states += 1
                    literal.append((states, s))
                    in_path |= s == SEPARATOR
            self.final.append(states)
            states += 1
        self.words = max(1, -(-states // 64))
        self.start = self._bits(first)
        self.advance = np.zeros((SYMBOLS, self.words), np.uint64)
        self.stay = np.zeros((SYMBOLS, self.words), np.uint64)
        for bit, s in literal:
            self.advance[s, bit // 64] |= np.uint64(1 << bit % 64)
        for bit, in_path in loops:
            self.stay[:SYMBOLS if in_path else SEPARATOR, bit // 64] |= np.uint64(1 << bit % 64)

    def _bits(self, positions: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for p in positions:
            out[p // 64] |= np.uint64(1 << p % 64)
        return out

    def match(self, urls: list[tuple[bytes, bytes]]) -> np.ndarray:
        """Boolean matrix: URL x glob."""
        n = len(urls)
        sizes = np.fromiter((len(h) + 1 + len(p) for h, p in urls), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        at = np.zeros(n + 1, np.int64)
        np.cumsum(sizes, out=at[1:])
        symbols = np.frombuffer(b"".join(h + b"\0" + p for h, p in urls), np.uint8).astype(np.int16)
        if n:
            symbols[at[:-1] + np.fromiter((len(h) for h, _ in urls), np.int64, n)] = SEPARATOR
        state = np.tile(self.start, (n, 1))
        ends, longest = -sizes[order], int(sizes.max(initial=0))
        begins = at[:-1][order]
        for t in range(longest):
            live = int(np.searchsorted(ends, -t, side="left"))  # URLs longer than t come first
            s = symbols[begins[:live] + t]
            now = state[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & self.advance[s] | now & self.stay[s]
        out = np.zeros((n, len(self.final)), bool)
        for g, bit in enumerate(self.final):
            out[order, g] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)
        return out


def parts(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path, of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), path


def judge(pages: DataFrame, url_col: str = "url", out: str = "judged", rules: tuple[Rule, ...] = RULES,
          block_globs: tuple[tuple[str, str], ...] = BLOCK_GLOBS) -> DataFrame:
    """``pages`` with a struct: host, path, rule (the longest that fits, else NULL) and verdict.

    Without a fitting rule the verdict is block if a (host, path) glob matches,
    else allow.  Rules of equal length: the first one listed.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text))
    globs = [g for r in ranked for g in ((r.host, f"{r.path}*"), (f"*.{r.host}", f"{r.path}*"))]
    automaton = GlobAutomaton(globs + list(block_globs))
    names = [r.text for r in ranked] + [None]
    verdicts = [r.verdict for r in ranked]

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def judged(url: pa.Array) -> pa.Array:
        split = [parts(u) for u in url.to_pylist()]
        hit = automaton.match([(h.encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass"))
                               for h, p in split])
        fits = hit[:, 0:2 * len(ranked):2] | hit[:, 1:2 * len(ranked):2]
        which = np.where(fits.any(axis=1), fits.argmax(axis=1) if ranked else 0, len(ranked))
        blocked = hit[:, 2 * len(ranked):].any(axis=1)
        rows = [(h, p, names[k], verdicts[k] if k < len(ranked) else "block" if b else "allow")
                for (h, p), k, b in zip(split, which.tolist(), blocked.tolist())]
        columns = zip(*rows) if rows else [[]] * 4
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns],
                                          names=["host", "path", "rule", "verdict"])

    return pages.withColumn(out, judged.asNondeterministic()(F.col(url_col)))
