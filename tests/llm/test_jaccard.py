import random

import numpy as np
from brute import near_duplicates as brute
from tocsin.llm import jaccard as J


def variants(seed, groups=12, size=25, words=60):
    """Texts and edited copies of them, chains of copies of copies, shared passages."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcdefg") for _ in range(4))

    passage = [word() for _ in range(30)]
    out = []
    for g in range(groups):
        base = [word() for _ in range(rng.randint(6, words))]
        if g % 3 == 0:
            base += passage
        chain = base
        for k in range(size):
            source = chain if g % 2 else base
            copy = list(source)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            chain = copy
            out.append(" ".join(copy).title() if k % 5 == 0 else "  \t".join(copy))
    return out


def found(df):
    return sorted(map(repr, map(tuple, J.near_duplicates(df).collect())))


def test_like_brute_force(docs):
    texts = variants(1) + [None, "", " \n", "one", "One", "two words", "a b c d", "a b c d", "a b c d e", "x " * 5000, "x " * 6000]
    assert found(docs(texts, files=4)) == sorted(map(repr, brute(list(enumerate(texts)))))


def test_small_blocks_find_the_same(docs):
    texts = variants(3, groups=4, size=40)
    df = docs(texts, files=3)
    got = sorted(map(repr, map(tuple, J.near_duplicates(df, block=8).collect())))
    assert got == sorted(map(repr, brute(list(enumerate(texts)))))


def test_repeated_rows_and_null_ids(docs):
    texts = ["a b c d e f g"] * 4 + [None, "z"]
    df = docs(texts, ids=[5, 5, None, 3, None, None])
    assert found(df) == sorted(map(repr, [(5, 3, 3), (5, 3, 3), (None, 3, 3), (3, 3, 3), (None, 0, None), (None, 1, None)]))
    out = J.one_of_each(df)
    assert out.columns == df.columns
    # of the four copies one row stays; rows without text or without a copy do
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, [3, None, None]))


def test_rows_are_dropped_one_by_one(docs, spark):
    """An id that stands for two texts loses the copy only; of copies without ids one stays."""
    df = docs(["p q r s t u v", "a b c d e f g", "A b c d e f g", "x y z w v u", "x y  z w v u"], ids=[7, 7, 3, None, None])
    assert sorted((repr(r.doc_id), r.text.split()[0]) for r in J.one_of_each(df).collect()) == sorted(
        [("7", "p"), ("3", "A"), ("None", "x")])
    again = df.unionByName(df)  # no scan of files, every row twice
    assert J.one_of_each(again).count() == 3


def test_clashing_columns(docs):
    from pyspark.sql import functions as F
    df = docs(["a b c d e f g"] * 2 + ["z"]).withColumns({c: F.lit(1) for c in ("_metadata", "file", "row", "_all", "_dropped", "component")})
    assert J.one_of_each(df).columns == df.columns and J.one_of_each(df).count() == 2


def test_empty(table):
    df = table([], "doc_id long, text string")
    assert J.near_duplicates(df).collect() == []


def test_linked_sets_always_share_a_key():
    """The pigeonhole bound, on sets at the limit of the similarity."""
    rng = np.random.default_rng(4)
    for size in [4, 5, 6, 7, 9, 14, 21, 33, 50, 80, 200, 1000, 3000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            # drop some tokens, add others: 100 * shared >= 80 * union
            gone = int(rng.integers(0, size // 5 + 1))
            kept = a[np.sort(rng.permutation(len(a))[gone:])]
            most = int(len(kept) / 0.8 - len(a) + 1e-9)
            b = np.unique(np.concatenate([kept, rng.integers(0, 2**64, max(0, most), dtype=np.uint64)]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 80 * (len(a) + len(b) - shared):
                continue
            d = len(a) + len(b) - 2 * shared
            assert J.hamming(J.sketch(a), J.sketch(b)) <= d <= (len(a) + len(b)) // 9
            assert np.array_equal(a, b) or np.isin(J.part_keys(a), J.part_keys(b)).any()


def test_words_are_hashed_by_their_bytes():
    powers, rng = J.Powers(), random.Random(6)
    for _ in range(300):
        raw = "".join(rng.choice("ab \t\nÉ　\x1c") for _ in range(rng.randint(0, 60))).encode()
        words, hashes = raw.split(), J.word_hashes(raw, powers).tolist()
        assert len(words) == len(hashes)
        assert {(a, b) for a, b in zip(words, hashes)}.__len__() == len(set(words)) == len(set(hashes))
    long = b"y" * 700_000 + b" z " + b"w " * 300_000  # words across pieces
    hashes = J.word_hashes(long, powers)
    assert len(hashes) == 300_002 and len(set(hashes.tolist())) == 3
    assert hashes[1] == J.word_hashes(b"z", powers)[0]
