import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK
from tocsin.llm import quality as Q


def test_isotonic_like_the_definition():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 60):
        s, w, m = np.sort(rng.random(n)), rng.integers(1, 5, n).astype(float), rng.random(n)
        x, y = Q.isotonic(s, w, m)
        assert (np.diff(y) >= -1e-12).all()
        # max-min formula of isotonic regression
        for k in range(n):
            want = max(min(np.average(m[a:b + 1], weights=w[a:b + 1]) for b in range(k, n)) for a in range(k + 1))
            assert abs(np.interp(s[k], x, y) - want) < 1e-9


def test_features_approximate_the_kernel():
    d = 6
    fourier = Q.Fourier(np.zeros(d), np.ones(d), features=20_000)
    x = np.random.default_rng(3).normal(size=(5, d))
    z = fourier(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * d))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_sums_of_partitions_like_one_matrix(spark):
    rng = np.random.default_rng(4)
    x, y, fold = rng.normal(size=(300, len(Q.NAMES))), rng.integers(0, 2, 300), rng.integers(1, 5, 300)
    fourier = Q.Fourier(x.mean(0), x.std(0), features=16)
    rows = spark.createDataFrame([(int(f), list(map(float, a)), float(b)) for f, a, b in zip(fold, x, y)],
                                 "fold int, x array<double>, y double").repartition(5)
    a, v = Q.normal_equations(rows, fourier, 5)
    z = fourier(x)
    for f in range(5):
        own = fold == f
        assert np.allclose(a[f], z[own].T @ z[own]) and np.allclose(v[f], z[own].T @ y[own])


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    return Q.classify(docs, labels).join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(judged):
    held = judged[judged.held_out & judged.y.notna()]
    assert len(held) > 40 and (held.predicted == held.y).mean() > 0.95
    good, bad = held[held.y == 1].score.to_numpy(), held[held.y == 0].score.to_numpy()
    assert np.mean([(good > b).mean() + (good == b).mean() / 2 for b in bad]) > 0.97


def test_contract(judged):
    assert judged.score.between(0, 1).all()
    assert (judged.predicted == (judged.score >= 0.3)).all()
    assert (judged.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in judged.doc_id]).all()


def test_labels_of_held_out_rows_are_not_used(docs, spark):
    own = ["a good plain text about things " * 3, "BAD!! LOUD!! WORDS!! HERE!!"] * 40 + [None, "", "x" * 100_000]
    df = docs(own)
    rows = [(k, 1 - k % 2) for k in range(80)]
    flipped = [(k, y if zlib.crc32(str(k).encode()) % 5 else 1 - y) for k, y in rows]
    a, b = (Q.classify(df, spark.createDataFrame(r, "doc_id long, y int")).orderBy("doc_id").collect() for r in (rows, flipped))
    assert [(r.doc_id, round(r.score, 9)) for r in a] == [(r.doc_id, round(r.score, 9)) for r in b]
    assert len(a) == len(own) and all(r.predicted == 1 - r.doc_id % 2 for r in a[:80])


def test_few_or_no_labels(docs, spark):
    df = docs(["some text", None, "", "TEXT!!"], ids=[1, None, 2, 2])
    for rows, want in (([], 0.5), ([(1, None), (None, 1)], 0.5), ([(2, 1)] * 3, 1.0)):
        got = Q.classify(df, spark.createDataFrame(rows, "doc_id long, y int")).collect()
        assert len(got) == 4 and {r.score for r in got} == {want}
    assert not [r for r in got if r.doc_id is None][0].held_out


def test_accepted_keeps_columns_and_rows(docs, spark):
    own = ["a good plain text about things " * 3, "BAD!! LOUD!! WORDS!! HERE!!"] * 40
    df = docs(own + own[:2])
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(80)], "doc_id long, y int")
    out = Q.accepted(df, labels)
    assert out.columns == df.columns and {r.text for r in out.collect()} == {own[0]} and out.count() == 41


def test_empty(table, spark):
    labels = spark.createDataFrame([], "doc_id long, y int")
    assert Q.classify(table([], "doc_id long, text string"), labels).collect() == []
