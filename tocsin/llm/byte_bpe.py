"""Byte-level BPE encoding and decoding, long texts in overlapping chunks.

Encoding a text: it is cut into chunks that overlap; each chunk is split into
pre-tokens by itself, in parallel.  A match of the pattern depends only on what
follows its start, so once two splits share a boundary they agree from there
on: neighbours are stitched at the first boundary of the overlap that both
have.  Where a chunk's last reliable boundary finds no partner (one pre-token
longer than the overlap), the split is carried on from that boundary.  The
pieces between the stitched boundaries are then encoded by lowest-rank merges.
Texts of one chunk take the same steps inside their own task, without shuffle.

Decoding joins the bytes of the ids; bytes need not be UTF-8 at any cut.

Ids are kept as little-endian unsigned 32-bit integers in one binary value.

Defined cases: null text counts as empty (no ids); texts of any length, with no
blank or only blanks, are split exactly; repeated rows and null ids keep their
number of rows; an id outside the vocabulary is an error on decoding; extra
columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import struct
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tocsin.llm.chunks import KEY, chunked, keyed
from tocsin.llm.merges import merged

CHUNK = 65_536
OVERLAP = 1_024
#: Characters behind a match that can still change it: a blank run's lookahead
#: and the two letters of a contraction.
LOOKAHEAD = 3
CACHE = 1 << 18
CACHED_PIECE = 64
ROWS_OUT = 1_000  # rows handed back at a time


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """Piece -> its ids as bytes; filled as pieces are met, emptied when full."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def encode(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        rank = self.ranks.get(raw)
        if rank is not None:
            return struct.pack("<I", rank)
        get = self.ranks.get
        parts = merged([raw[i:i + 1] for i in range(len(raw))], lambda a, b: get(a + b))
        return struct.pack(f"<{len(parts)}I", *map(self.ranks.__getitem__, parts))

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHED_PIECE:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


def boundaries(pattern, text: str) -> list[int]:
    """Ends of the pre-tokens; they leave no gaps."""
    return list(accumulate(map(len, pattern.findall(text))))


def stitched(pattern, chunks: list[str], ends: list[np.ndarray], size: int) -> tuple[str, list[int]]:
    """The whole text and its pre-token ends, from the chunks and their own ends."""
    text = "".join(c[:size] for c in chunks[:-1]) + chunks[-1]
    out: list[int] = []
    own = ends[0].tolist()  # ends that hold from where the chunk before was left
    for k in range(len(chunks)):
        if k == len(chunks) - 1:
            out += own
            break
        base, limit = (k + 1) * size, min(len(text), k * size + len(chunks[k])) - LOOKAHEAD
        if limit >= len(text) - LOOKAHEAD:  # the chunk sees the end of the text: all of its ends hold
            limit = len(text)
        sure = own[:bisect.bisect_right(own, limit)]
        right = (ends[k + 1] + base).tolist()
        partners = {base, *right[:bisect.bisect_right(right, limit)]}
        meet = next((e for e in sure[bisect.bisect_left(sure, base):] if e in partners), None)
        if meet is not None:
            out += sure[:bisect.bisect_right(sure, meet)]
            own = right[bisect.bisect_right(right, meet):]
            continue
        # No shared boundary: the next chunk is split anew from the last sure one.
        out += sure
        start = out[-1] if out else 0
        stop = min(len(text), base + len(chunks[k + 1]))
        own = [start + e for e in boundaries(pattern, text[start:stop])]
    return text, out


def _encoder(spark: SparkSession, ranks_path: str):
    return spark.sparkContext.broadcast(load_ranks(ranks_path))


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP,
           decoded: bool = False) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text); with ``decoded`` also
    the bytes of the ids, decoded by the task that has just encoded them."""
    if overlap <= LOOKAHEAD or overlap > chunk:
        raise ValueError("the overlap lies between the lookahead and the chunk")
    ranks = _encoder(docs.sparkSession, ranks_path)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = keyed(docs)

    def columns(ids: list[bytes]) -> dict[str, list[bytes]]:
        table = decode_table(ranks) if decoded else None
        return {"ids": ids} | ({"decoded": [decode_ids(x, table) for x in ids]} if decoded else {})

    def whole(batches):
        pieces, split = Pieces(ranks.value), regex.compile(pattern)
        for b in batches:
            for at in range(0, len(b), ROWS_OUT):
                part = b.iloc[at:at + ROWS_OUT]
                ids = [b"".join(map(pieces.__getitem__, split.findall(t))) for t in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"].array} | columns(ids))

    def pretokenised(batches):
        split = regex.compile(pattern)
        for b in batches:
            b["ends"] = [np.array(boundaries(split, t), dtype="<i4").tobytes() for t in b["text"]]
            yield b

    state: dict = {}

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        if not state:
            state.update(pieces=Pieces(ranks.value), split=regex.compile(pattern))
        copies = int((part["no"] == 0).sum())  # repeated rows bring their chunks along
        part = part.drop_duplicates("no").sort_values("no")
        text, ends = stitched(state["split"], part["text"].tolist(),
                              [np.frombuffer(e, dtype="<i4") for e in part["ends"]], chunk)
        get = state["pieces"].__getitem__
        ids = b"".join(get(text[a:b]) for a, b in zip([0, *ends[:-1]], ends))
        return pd.DataFrame({"doc_id": part["doc_id"].iloc[[0] * copies].array} | columns([ids] * copies))

    schema = f"doc_id {kind}, ids binary" + ", decoded binary" * decoded
    short = rows.where(F.col("_size") <= chunk).select("doc_id", "text").mapInPandas(whole, schema)
    parts = chunked(rows.where(F.col("_size") > chunk), chunk, overlap)
    ended = parts.mapInPandas(pretokenised, parts.schema.simpleString()[7:-1] + ",ends:binary")
    return short.unionByName(ended.groupBy(*KEY).applyInPandas(joined, schema))


def decode_ids(ids: bytes, table: list[bytes | None]) -> bytes:
    return b"".join(map(table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the bytes of its ids."""
    ranks = _encoder(encoded.sparkSession, ranks_path)

    @F.pandas_udf("binary")
    def bytes_of(batches: pd.Series) -> pd.Series:
        return batches.map(partial(decode_ids, table=decode_table(ranks)))

    return encoded.withColumn("decoded", bytes_of(F.col("ids")))


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows."""
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                          F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_TABLES: dict[tuple[int, int], list[bytes | None]] = {}


def decode_table(ranks) -> list[bytes | None]:
    """The bytes of each id, made once in each worker; None where no token has it."""
    key = len(ranks.value), id(ranks.value)
    if key not in _TABLES:
        _TABLES.clear()
        table: list[bytes | None] = [None] * (max(ranks.value.values()) + 1)
        for piece, rank in ranks.value.items():
            table[rank] = piece
        _TABLES[key] = table
    return _TABLES[key]
