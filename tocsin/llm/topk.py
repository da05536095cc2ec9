"""Exact top-k search in three phases with a uniform threshold.

Vectors become integers, floor(256 * x); the score of a pair is their inner
product.  The dimensions are cut into ``parts`` runs, each a source of local
scores whose sum is the score.  The rows are dealt into row blocks, the queries
into query blocks; a cell is one of each, worked on by one task with numpy.

1. Each cell gathers, for each of its queries and each run, the local list:
   the k rows with the highest local scores.  The totals of these rows bound
   the answer from below: the k-th highest total over all cells is a cutoff T
   that at least k rows reach.
2. The cutoff goes back to the queries.  A row whose total reaches T has a
   local score of T / parts or more in some run, so each cell collects the
   rows that do; all others are out.
3. The missing local scores of the collected rows are resolved exactly; rows
   whose total reaches T compete for the k places of the cell, and the cells'
   lists are merged.  Ties go to the smaller id.

A cell holds at most about ``block_rows`` rows and ``block_queries`` queries, whatever the size of
the table; rows travel once per query block and queries once per row block.
Nothing is broadcast.

Defined cases: rows without id, with a null vector, a null or non-finite
component, or a dimension other than ``dims`` (by default the most common one)
take no part; repeated rows (same id and vector) count once; a query's own id
is no candidate; fewer candidates than k give fewer rows; an empty table gives
an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import stored

BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096
STRIP = 256  # queries scored at a time inside a cell
CELL = "cell_r long, cell_q long"


def usable(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """(id, ints) of the rows that take part."""
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("id").isNotNull() & x.isNotNull() & fine)
            .select("id", F.transform(x, lambda c: F.floor(F.lit(scale) * c)).alias("ints")))


def _matrix(blobs: list[bytes], dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, dims)


def _unpack(df: pd.DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, vectors, cutoffs of the packed rows, repeated rows once, by id."""
    ids = np.frombuffer(b"".join(df["ids"]), dtype=np.int64)
    rows = _matrix(df["rows"], dims)
    cut = np.frombuffer(b"".join(df["cuts"]), dtype=np.int64) if "cuts" in df else np.zeros(len(ids), np.int64)
    order = np.lexsort((*rows.T, ids))
    ids, rows, cut = ids[order], rows[order], cut[order]
    if len(ids) > 1:
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
        ids, rows, cut = ids[new], rows[new], cut[new]
    return ids, rows, cut


def _exact_type(q: np.ndarray, r: np.ndarray) -> type:
    """The smallest float type in which every partial sum is exact, else int or
    Python's integers."""
    def norms(a):
        return np.sqrt((a.astype(float) ** 2).sum(axis=1)).max(initial=0)
    bound = norms(q) * norms(r) * 1.01
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


def _strips(q_ids, q_rows, r_ids, r_rows):
    kind = _exact_type(q_rows, r_rows)
    q, r = q_rows.astype(kind), r_rows.astype(kind)
    for at in range(0, len(q_ids), STRIP):
        yield slice(at, at + STRIP), q[at:at + STRIP], r


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def gather_lists(q, r, dims, parts, k):
    """Phase 1 in a cell: totals of the rows on the local lists."""
    (q_ids, q_rows, _), (r_ids, r_rows, _) = q, r
    runs = np.array_split(np.arange(dims), parts)
    out_q, out_s = [], []
    for at, qs, rs in _strips(q_ids, q_rows, r_ids, r_rows):
        local = [qs[:, run] @ rs[:, run].T for run in runs]
        own = q_ids[at][:, None] == r_ids[None, :]
        width = min(k + 1, len(r_ids))  # one more, as the query itself may be on the list
        for i in range(len(qs)):
            listed = np.unique(np.concatenate([np.argpartition(-part[i], width - 1)[:width] for part in local]))
            listed = listed[~own[i, listed]]
            total = sum(part[i, listed] for part in local)
            total = np.sort(total)[::-1][:k]
            out_q.append(np.full(len(total), q_ids[at][i]))
            out_s.append(total)
    return pd.DataFrame({"query_id": np.concatenate(out_q or [[]]).astype("int64"),
                         "score": np.concatenate(out_s or [[]]).astype("int64")})


def collect_and_resolve(q, r, dims, parts, k):
    """Phases 2 and 3 in a cell."""
    (q_ids, q_rows, cuts), (r_ids, r_rows, _) = q, r
    runs = np.array_split(np.arange(dims), parts)
    out = []
    for at, qs, rs in _strips(q_ids, q_rows, r_ids, r_rows):
        # local >= T / parts, in integers
        need = np.array([-(-int(c) // parts) for c in cuts[at]])[:, None]
        enough = np.zeros((len(qs), len(r_ids)), dtype=bool)
        for run in runs:
            enough |= qs[:, run] @ rs[:, run].T >= need
        enough &= q_ids[at][:, None] != r_ids[None, :]
        for i in np.flatnonzero(enough.any(axis=1)):
            held = np.flatnonzero(enough[i])
            total = rs[held] @ qs[i]
            reach = total >= cuts[at][i]
            held, total = held[reach], total[reach]
            top = _best(r_ids[held], total, k)
            out.append((np.full(len(top), q_ids[at][i]), r_ids[held[top]], total[top].astype("int64")))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, "int64")] * 3
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols)))


def packed(rows: DataFrame, blocks: int, dims: int, cut: bool) -> DataFrame:
    """Rows dealt into blocks by a hash of the id: (block, ids, rows[, cuts])."""
    names = ["ids", "rows"] + ["cuts"] * cut

    def pack(batches):
        for b in batches:
            for block, part in b.groupby("block"):
                values = {"ids": part["id"].to_numpy(np.int64).tobytes(),
                          "rows": np.stack(part["ints"].to_numpy()).astype(np.int64).tobytes()}
                if cut:
                    values["cuts"] = part["cut"].to_numpy(np.int64).tobytes()
                yield pd.DataFrame({"block": [block], **{n: [values[n]] for n in names}})

    return (rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
            .mapInPandas(pack, "block long, " + ", ".join(f"{n} binary" for n in names)))


def in_cells(queries: DataFrame, rows: DataFrame, q_blocks: int, r_blocks: int, dims: int, work, k: int, parts: int,
             schema: str, cut: bool) -> DataFrame:
    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    q = packed(queries, q_blocks, dims, cut).withColumnRenamed("block", "cell_q").withColumn("cell_r", every(r_blocks))
    r = packed(rows, r_blocks, dims, False).withColumnRenamed("block", "cell_r").withColumn("cell_q", every(q_blocks))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            names = [c.split()[0] for c in schema.split(", ")]
            return pd.DataFrame({n: np.zeros(0, "int64") for n in names})
        return work(_unpack(left, dims), _unpack(right, dims), dims, parts, k)

    keys = ["cell_r", "cell_q"]
    return q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(cell, schema)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
          dims: int | None = None, parts: int = 2, scale: float = 256.0, block_rows: int = BLOCK_ROWS,
          block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query;
    ``is_query`` is a condition on the column ``id``."""
    rows = stored(usable(vectors, vec_id, vector, scale), "topk-vectors")
    if dims is None:
        common = rows.groupBy(F.size("ints").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        dims = common["dims"] if common else 0
    rows = rows.where(F.size("ints") == dims)
    queries = rows.where(is_query)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n, m = rows.count(), queries.count()
    r_blocks, q_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(m / block_queries))
    parts = min(parts, dims)

    lists = in_cells(queries, rows, q_blocks, r_blocks, dims, gather_lists, k, parts, "query_id long, score long", False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    # The k-th highest total; with fewer than k candidates nothing may be cut.
    cutoff = (lists.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
              .groupBy("query_id").agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("held"))
              .select("query_id", F.when(F.col("held") >= k, F.col("low")).alias("cut")))
    cutoff = stored(cutoff, "topk-cutoffs")
    queries = (queries.join(cutoff, F.col("id") == F.col("query_id"), "left")
               .select("id", "ints", F.coalesce("cut", F.lit(-(2**62))).alias("cut")))
    found = in_cells(queries, rows, q_blocks, r_blocks, dims, collect_and_resolve, k, parts,
                     "query_id long, vec_id long, score long", True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, r.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM k WHERE n <= 5
"""
