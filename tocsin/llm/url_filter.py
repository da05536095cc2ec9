"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed, one state per bit, into the words of a Shift-And
mask.  A character moves every rule at once: ``D = (D << 1 & B[c]) | (D & S[c])``
with the carry passed from word to word; ``B`` has the states a character may
enter, ``S`` those it may stay in (the wildcards).  A batch of URLs is advanced
together, one character position at a time, with numpy.

Canonical URL: ``"." + host + path``; host is what follows the first ``://`` up
to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; path runs from there up
to ``?`` or ``#``.  A null URL or one without ``://`` has an empty host and path.
As a host holds no ``/`` and starts after a dot, the glob ``*.example.org/es/**``
is the host and its subdomains with that path prefix.

Globs: ``?`` one character other than ``/``, ``*`` a run without ``/``, ``**`` any
run; everything else stands for itself.

Host/path rules come first (the longest rule string wins, then the earlier);
URLs that none fits are judged by the method's globs: blocked if any of
``block_globs`` fits, else allowed.  Repeated and empty URLs, very long ones and
extra columns pass through; rows are neither added nor lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict); the rule is host + path prefix.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)
#: What no rule decides: advertising, tracking and spam hosts, login pages.
BLOCK_GLOBS = (
    "*.ads-**",
    "*.ads.**",
    "*.*track*.**",
    "*.*cheap-*.**",
    "*.*casino*.**",
    "**/wp-login.php",
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


class GlobAutomaton:
    """The packed masks of a list of globs."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        letters = sorted({ord(c) for steps in parsed for c, _ in steps if c and c != "?"} | {ord("/")})
        self.letters = np.array(letters, dtype=np.uint32)
        states = sum(len(steps) for steps in parsed)
        words = max(1, -(-states // 64))
        other = len(letters)  # the class of every character that no glob names
        enter = np.zeros((other + 1, words), dtype=np.uint64)
        stay = np.zeros_like(enter)
        self.start = np.zeros(words, dtype=np.uint64)
        self.final: list[tuple[int, int]] = []
        at = 0
        slash = letters.index(ord("/"))
        for steps in parsed:
            for k, (char, loop) in enumerate(steps):
                word, bit = divmod(at, 64)
                mask = np.uint64(1) << np.uint64(bit)
                if k == 0:
                    self.start[word] |= mask
                elif char == "?":
                    enter[:, word] |= mask
                    enter[slash, word] &= ~mask
                else:
                    enter[letters.index(ord(char)), word] |= mask
                if loop:
                    stay[:, word] |= mask
                    if loop == 1:
                        stay[slash, word] &= ~mask
                at += 1
            self.final.append(divmod(at - 1, 64))
        self.enter, self.stay = enter, stay

    @staticmethod
    def _parse(glob: str) -> list[tuple[str, int]]:
        """States of a glob: (character that enters it, 0 no loop, 1 loop but
        for ``/``, 2 loop on anything); the first state is where it starts."""
        steps, k = [("", 0)], 0
        while k < len(glob):
            if glob[k] == "*":
                wide = glob.startswith("**", k)
                steps[-1] = (steps[-1][0], 2 if wide else max(1, steps[-1][1]))
                k += 1 + wide
            else:
                steps.append((glob[k], 0))
                k += 1
        return steps

    def matches(self, strings: Sequence[str]) -> np.ndarray:
        """Boolean matrix: string by glob."""
        n = len(strings)
        lengths = np.fromiter(map(len, strings), dtype=np.int64, count=n)
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        place = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        classes = np.where(self.letters[place] == codes, place, len(self.letters))
        order = np.argsort(-lengths, kind="stable")
        starts = (np.cumsum(lengths) - lengths)[order]
        falling = -lengths[order]
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        for k in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(falling, -k, side="left"))  # strings longer than k
            c = classes[starts[:live] + k]
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:live] = (moved & self.enter[c]) | (now & self.stay[c])
        out = np.empty((n, len(self.final)), dtype=bool)
        for j, (word, bit) in enumerate(self.final):
            out[order, j] = (state[:, word] >> np.uint64(bit)) & one
        return out


def rule_globs(rules: Iterable[tuple[str, str]]) -> list[str]:
    """A rule as a glob: any subdomain before, any rest behind."""
    out = []
    for rule, _ in rules:
        if "*" in rule or "?" in rule:
            raise ValueError(f"a host/path rule holds no wildcard: {rule}")
        out.append(f"*.{rule}**")
    return out


def judge(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES,
          block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """``pages`` with host, path, rule, verdict and globs (those that fit); columns of these
    names that ``pages`` has already give way.  An empty table gives an empty one."""
    rules, block_globs = list(rules), list(block_globs)
    automaton = GlobAutomaton(rule_globs(rules) + block_globs)
    # later ones overwrite: the longest last, of equal ones the earliest
    ranked = sorted(range(len(rules)), key=lambda k: (len(rules[k][0]), -k))

    @F.pandas_udf("struct<rule:string,verdict:string,globs:array<string>>")
    def decide(canonical: pd.Series) -> pd.DataFrame:
        fits = automaton.matches(canonical.tolist())
        best = np.full(len(canonical), -1)
        for k in ranked:
            best[fits[:, k]] = k
        own = fits[:, len(rules):]
        by_glob = np.where(own.any(axis=1), "block", "allow") if own.shape[1] else np.full(len(canonical), "allow")
        return pd.DataFrame({
            "rule": [rules[k][0] if k >= 0 else None for k in best],
            "verdict": [rules[k][1] if k >= 0 else v for k, v in zip(best, by_glob)],
            "globs": [[block_globs[j] for j in np.flatnonzero(row)] for row in own],
        })

    added = ("host", "path", "rule", "verdict", "globs")
    kept = [c for c in pages.columns if c not in added]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host_of(F.col(url)).alias("host"),
                        path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("found", decide(F.concat(F.lit("."), "host", "path")))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path",
                       *[F.col("found").getField(c).alias(c) for c in added[2:]])


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(rule, rhost, rpath, says) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
m AS (
  SELECT u.*, (SELECT max_by(rule, length(rule)) FROM r
               WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
         regexp_matches('.' || host || path,
           '(?s)^([^/]*\.ads-.*|[^/]*\.ads\..*|[^/]*\.[^/]*track[^/]*\..*|[^/]*\.[^/]*cheap-[^/]*\..*|[^/]*\.[^/]*casino[^/]*\..*|.*/wp-login\.php)$') AS bad
  FROM u)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NOT NULL THEN (SELECT says FROM r WHERE r.rule = m.rule)
            WHEN bad THEN 'block' ELSE 'allow' END AS verdict
FROM m
"""
