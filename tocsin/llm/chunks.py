"""Long texts as rows of overlapping chunks, so that several tasks share one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import task_count, text_of

#: What names a text: its row's id, a hash and the length.  Repeated rows share it.
KEY = ("doc_id", "_hash", "_size")


def keyed(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """(doc_id, _hash, _size, text)."""
    body = text_of(text)
    return docs.select(F.col("doc_id"), F.xxhash64(body).alias("_hash"), F.char_length(body).alias("_size"),
                       body.alias("text"))


def chunked(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """Rows (key, no, text) of ``keyed`` rows: chunk ``no`` starts at ``no * size`` and
    runs ``overlap`` characters into the next.  The chunks of a text are spread
    over the tasks."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in batches:
            for doc_id, h, n, text in zip(b["doc_id"], b["_hash"], b["_size"], b["text"]):
                count = max(1, -(-len(text) // size))
                for first in range(0, count, 64):
                    numbers = range(first, min(count, first + 64))
                    yield pd.DataFrame({"doc_id": pd.Series([doc_id] * len(numbers), dtype=b["doc_id"].dtype),
                                        "_hash": h, "_size": n, "no": numbers,
                                        "text": [text[k * size:(k + 1) * size + overlap] for k in numbers]})

    schema = f"doc_id {kind}, _hash long, _size int, no int, text string"
    return rows.mapInPandas(cut, schema).repartition(task_count(rows.sparkSession), *KEY, "no")
