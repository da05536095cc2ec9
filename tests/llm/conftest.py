"""Small tables for the training-data operators."""
import itertools

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

_N = itertools.count()
SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture
def table(spark, tmp_path):
    """Rows as a Parquet table, in several files."""
    def make(rows, schema, files=2):
        path = str(tmp_path / f"t{next(_N)}")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.parquet(path)
    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(table):
    """Documents with extra columns whose names operators might use."""
    def make(texts, files=2, ids=None):
        rows = [(k if ids is None else ids[k], t, "en", f"s{k % 3}" if k % 7 else None, len(t or ""), "x", 1)
                for k, t in enumerate(texts)]
        return table(rows, DOCS + ", `_hash` string, `key` int", files)
    return make
