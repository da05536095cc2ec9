"""Collocations against counting everything in plain Python."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tocsin.llm import collocations
from tocsin.llm.collocations import BITS, FREQUENT, PAIR_SLOTS, PREFIX, SETTLE, SUFFIX, count_grams, mine

SCHEMA = "doc_id long, text string, lang string, x string, a long, `_salt` int"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[\x20\x09]+", p) if w] for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def counts(rows):
    f = defaultdict(Counter)
    for text, lang in rows:
        for words in pieces(text):
            for k in (1, 2, 3):
                f[lang or "und" if lang is None else lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f


def brute(rows, least, top):
    out = []
    for lang, f in counts(rows).items():
        n = sum(a for g, a in f.items() if len(g) == 1)
        found = {}
        for g, a in f.items():
            if len(g) > 1 and a >= least:
                found[g] = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
        over = Counter()
        for g in found:
            if len(g) == 3:
                for part in (g[:2], g[1:]):
                    over[part] = max(over[part], f[g])
        kept = [(-s, -f[g], " ".join(g).encode(), g, k) for g, (s, k) in found.items() if 100 * over[g] < 50 * f[g]]
        for rank, (s, a, phrase, g, k) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, f[g[:k]], f[g[k:]], n, -s))
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "The", "of", "xé", "É", "q1", "lone\x1cgroup", "中", "z" * 30] + [f"w{k}" for k in range(40)]
    passages = [[f"p{k}{j}" for j in range(6)] for k in range(5)]
    rows = []
    for k in range(n):
        out = []
        for _ in range(rng.randint(0, 60)):
            out += rng.choice(passages) if rng.random() < 0.08 else [words[min(int(rng.expovariate(0.12)), len(words) - 1)]]
            out[-1] += rng.choice(["", "", "", "", ".", ",", "\n", "\t", "  "])
        rows.append((" ".join(out), rng.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), (" . ", "fr"), ("only one", "fr"), rows[0], rows[0]]


@pytest.mark.parametrize("least,top,first", [(3, 2_000, 2), (3, 12, 1), (10, 5, 1), (2, 1, 1)])
def test_like_counting_everything(table, least, top, first):
    rows = corpus(least)
    df = table([(k, t, lang, "x", 1, 2) for k, (t, lang) in enumerate(rows)], SCHEMA)
    got = mine(df, min_count=least, top=top, first=first)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, top)


def test_every_pair_covered_needs_deeper_rounds(table):
    """The best pairs all fall to longer phrases; the settled ones lie far below."""
    rows = [(f"u{k} v{k} t{k}", "en") for k in range(12) for _ in range(20)]
    rows += [(f"m{k} n{k}. m{k} o{k}. r{k} n{k}", "en") for k in range(9) for _ in range(5)]
    df = table([(k, t, lang, "x", 1, 2) for k, (t, lang) in enumerate(rows)], SCHEMA)
    assert sorted(map(tuple, mine(df, min_count=3, top=20, first=1).collect())) == brute(rows, 3, 20)


class Held:
    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("size", [2, 3])
def test_partial_counts_add_up(monkeypatch, size):
    """Small slices and limits: carried tails, flushes, new numbers."""
    for name, value in (("WORDS", 12), ("RAW", 40), ("HELD", 30), ("ROWS", 7)):
        monkeypatch.setattr(collocations, name, value)
    monkeypatch.setattr(collocations.slices, "__defaults__", (25,))
    rows = corpus(5, 60)
    every = Held(b"\xff" * (collocations.WORD_SLOTS // 8))
    flags = Held(np.full(PAIR_SLOTS // 16, -1, dtype=np.int64))
    batches = [pa.RecordBatch.from_arrays([pa.array([lang or "und" for _, lang in part]), pa.array([(t or "").encode() for t, _ in part])],
                                          names=["lang", "text"]) for part in (rows[:20], rows[20:21], rows[21:])]
    got = Counter()
    for b in count_grams(size, every, flags if size == 3 else None)(iter(batches)):
        for r in b.to_pylist():
            got[r["lang"], tuple(r[c] for c in "xyz"[:size])] += r["a"]
    want = Counter({(lang, g): a for lang, f in counts(rows).items() for g, a in f.items() if len(g) == size})
    assert got == want


def test_large_numbers_are_exact(spark):
    from pyspark.sql import functions as F
    a, left, right = 4_000_000_000_000, 4_000_000_000_001, 4_000_000_000_003
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert df.select(collocations.ratio("a", "l", "r")).first()[0] == 1_000_000 * a * a // (left * right)


def test_empty(table):
    assert mine(table([], "text string, lang string")).collect() == []
