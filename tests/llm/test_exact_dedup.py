import hashlib
import re

import pytest

from tocsin.llm import exact_dedup
from tocsin.llm.exact_dedup import deduplicated

TEXTS = ["a b", "ab", " a\tb \n", "", None, " \r\n", "é", "e\u0301", "a\x1cb", "a b c" * 30_000, "abc" * 30_000, "z", "z"]


def brute(rows):
    """(doc_id, text) -> doc_id: (keep_id, size, sha)."""
    groups = {}
    for k, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), k))
    return {k: (min(groups[n := re.sub("[\x20\x09-\x0d]", "", t or "")])[1], len(groups[n]),
                hashlib.sha256(n.encode()).hexdigest()) for k, t in rows}


@pytest.mark.parametrize("chars", [64, 1])
def test_groups(docs, chars):
    """With one hex digit as key many digests collide: full bytes decide."""
    texts = TEXTS + [f"t{i % 20}" for i in range(60)]
    got = exact_dedup.exact_dedup(docs(texts, files=3), digest_chars=chars).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(list(enumerate(texts)))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_several_batches(docs):
    """State is kept from one micro-batch to the next."""
    texts = [f"t{i % 5}" for i in range(40)]
    got = exact_dedup.exact_dedup(docs(texts, files=4), batch_bytes=1).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == brute(list(enumerate(texts)))


def test_repeated_rows_and_null_ids(docs):
    got = exact_dedup.exact_dedup(docs(["x", "x", "x", "y", "y"], ids=[3, 3, None, None, None]))
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()]
    assert sum(r[3] for r in rows) == 2
    assert {r[1:3] for r in rows if r[1] == 3} == {(3, 3)}
    assert sorted((r[1] is None, r[2]) for r in rows if r[2] == 2) == [(True, 2), (True, 2)]


def test_deduplicated_keeps_columns(docs, spark):
    df = docs(["x", "x", "x", "y", None, ""], ids=[3, 3, 9, None, 1, 2])
    out = deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r.text or "") for r in out.collect()) == ["", "x", "y"]
    # a frame that is no scan of files
    assert deduplicated(df.unionByName(df)).count() == 3


def test_empty(docs, table):
    df = table([], "doc_id long, text string")
    assert exact_dedup.exact_dedup(df).collect() == []
    assert deduplicated(df).collect() == []


def test_runs_no_python(docs):
    plan = exact_dedup.exact_dedup(docs(["x", "y"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_clashing_columns(docs):
    from pyspark.sql import functions as F
    df = docs(["x", "x", "y"]).withColumns({c: F.lit(1) for c in ("_metadata", "file", "row", "all", "digest", "best")})
    out = deduplicated(df)
    assert out.columns == df.columns and sorted(r.text for r in out.collect()) == ["x", "y"]


def test_only_hits_are_compared(docs, monkeypatch):
    """The rows of digests that stand alone don't reach the comparison."""
    seen, real = [], exact_dedup.collided
    monkeypatch.setattr(exact_dedup, "collided", lambda docs, hits: seen.append(hits.count()) or real(docs, hits))
    exact_dedup.exact_dedup(docs([f"t{k}" for k in range(50)] + ["same"] * 3)).collect()
    assert seen == [3]
