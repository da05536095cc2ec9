"""The stages against plain Python, each on what the one before kept."""
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from brute import near_duplicates
from conftest import SF_SMALL
from tocsin.llm import byte_bpe, mixing, quality
from tocsin.llm.common import stored


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after each stage."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF_SMALL), "test"))
    return out


def test_stages(stages, spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE"]
    raw, good, exact, near, mixed, encoded = stages
    assert all(s.columns == raw.columns for s in (good, exact, near, mixed))

    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    judged = {r.doc_id: r.predicted for r in quality.classify(raw, labels).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(k for k, p in judged.items() if p)

    best = {}
    for r in good.collect():
        key = "".join((r.text or "").translate({c: None for c in [0x20, *range(9, 14)]}))
        best[key] = min(best.get(key, (0, 1 << 62)), (-len(r.text or ""), r.doc_id))
    assert sorted(r.doc_id for r in exact.collect()) == sorted(b[1] for b in best.values())

    rows = [(r.doc_id, r.text) for r in exact.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, _, c in near_duplicates(rows) if d == c)

    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(k for k, n in copies.items() for _ in range(n))

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = []
    for r in mixed.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, encoded.collect())) == sorted(want)


def test_run_gives_the_same(stages, spark):
    got = corpus_pipeline.run(spark, SF_SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_awkward_rows_pass(spark, tmp_path):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x" * 90_000, None, "b", 1),
            (3, "some plain words here for all", "en", None, 5)] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 1, 2, 3} and any(r.doc_id == 3 for r in got)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
