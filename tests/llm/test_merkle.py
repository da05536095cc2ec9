"""The Merkle manifest against a plain recursive version."""
import hashlib
import random
import zlib

import pytest

from tocsin.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_range` int, `tree` string, `path` int, `size` int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, cut=False):
    doc_id, text, lang, source, n = row[:5]
    if cut and text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
        text = text.replace("\n", "")
    fields = (doc_id, source, lang, n, text)
    return H(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(digests):
    """Root, and for each leaf the (before, after) digests of every level."""
    paths = [[] for _ in digests]
    under = [[k] for k in range(len(digests))]
    while len(digests) > 1:
        up, above = [], []
        for at in range(0, len(digests), 3):
            run = digests[at:at + 3]
            for k in range(len(run)):
                for x in under[at + k]:
                    paths[x].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(H(*run))
            above.append([x for u in under[at:at + 3] for x in u])
        digests, under = up, above
    return digests[0], paths


def brute(rows):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources]
    trees = [tree([leaf(r) for r in g]) for g in groups]
    if not trees:
        return []
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), rest in zip(groups, trees, above):
        for r, path in zip(g, paths):
            node = leaf(r, cut=True)
            for before, after in path + rest:
                node = H(before, node, after)
            out.append((r[0], leaf(r), subroot, root, H(*[b + a for b, a in path + rest]), node, node == root))
    return out


def rows_of(n, sources, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice(["a\nb", "é\n", "", None, "x" * 50, "plain"]) if k % 5 else f"text {k}\n", rng.choice(["en", None]),
             sources[min(int(rng.expovariate(0.8)), len(sources) - 1)], k if k % 3 else None, 1, "t", 2, 3) for k in range(n)]


@pytest.mark.parametrize("n,sources,block", [(400, ["a", None, "", "b", "é", "z"], 7), (60, ["one"], 2187), (3, ["x", "y", "z"], 3),
                                             (25, [f"s{k}" for k in range(25)], 3), (1, ["a"], 9), (2, ["a"], 9)])
def test_like_a_plain_tree(table, monkeypatch, n, sources, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = rows_of(n, sources)
    if n > 100:  # repeated ids, repeated rows, null ids
        rows += [rows[5], rows[5], (5, "other", "en", rows[5][3], 1, 1, "t", 2, 3), (None, "n\n", "en", "a", 2, 1, "t", 2, 3),
                 (None, "m", "en", "a", 2, 1, "t", 2, 3), (9999, "line\n" * 40_000, "en", "a", 200_000, 1, "t", 2, 3)]
    got = merkle.verified(merkle.proofs(table(rows, SCHEMA)))
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def test_empty(table):
    assert merkle.verified(merkle.proofs(table([], SCHEMA))).collect() == []
