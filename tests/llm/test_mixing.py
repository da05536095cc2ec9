import math
import re
from collections import defaultdict

import pytest

from tocsin.llm import mixing
from tocsin.llm.mixing import fill


def brute_targets(sizes, weights, share=1.5, most=2.0):
    """The clamping, step by step."""
    total, open_, out = share * sum(sizes.values()), dict(weights), {}
    while open_:
        level = (total - sum(out.values())) / sum(open_.values())
        above = [s for s in open_ if level * open_[s] > most * sizes[s]]
        if not above:
            return out | {s: level * w for s, w in open_.items()}
        for s in above:
            out[s] = most * sizes[s]
            del open_[s]
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 300}, {"a": 0, "b": 5}, {"a": 1}, {"a": 100, "b": 1, "c": 1, "d": 70, None: 9},
    {f"s{i:02d}": (i * 37) % 101 + 1 for i in range(40)}])
def test_water_level(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in fill(mixing.cycled_weights(rows)).collect()}
    ranked = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weights = {s: float((3, 1, 2)[k % 3]) for k, s in enumerate(ranked)}
    assert {s: w for s, (w, _) in got.items()} == weights
    want = brute_targets(sizes, weights)
    assert all(math.isclose(got[s][1], want[s], abs_tol=1e-9) for s in sizes)


def test_taken_words(docs):
    texts = ["w " * (i % 23) for i in range(900)] + [None, "", "one\x0btwo\x1cthree"]
    df = docs(texts)
    rows = mixing.mix(df).collect()
    assert {r.doc_id: r.size for r in rows} == {
        k: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for k, t in enumerate(texts)}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken in (0, r.size, 2 * r.size) and r.source_size == sum(x.size for x in own) for r in own)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.mix(df).collect()}


def test_mixed_documents(docs):
    df = docs(["w " * (i % 9 + 1) for i in range(120)] + [None], ids=[*range(100), *range(20), None])
    copies = defaultdict(int)
    for r in mixing.mix(df).collect():
        copies[r.doc_id, r.source, r.size] += r.copies
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    found = defaultdict(int)
    for r in out.collect():
        found[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert found == {k: n for k, n in copies.items() if n}


def test_empty(table):
    df = table([], "doc_id long, text string, source string")
    assert mixing.mix(df).collect() == [] and mixing.mixed_documents(df).collect() == []


def test_sources_of_one_id_come_near_their_target(table):
    """Null ids, and one row many times."""
    rows = [(None, "w " * 20, "a")] * 20 + [(5, "v " * 10, "b")] * 30 + [(k, "u " * 7, "c") for k in range(40)]
    out = mixing.mix(table(rows, "doc_id long, text string, source string")).collect()
    for source in "abc":
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
