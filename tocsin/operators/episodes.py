"""Alarm episodes.

An *episode* is a run of consecutive alarm rows (state 1) of a series.  The
episode starts at the first row of the run; it ends either when the alarm
clears (the last row of the run, O28) or, for the primary outcome, at the
first row of the run that carries a logged event, if that comes earlier (O29).
Only the first end of each (start, id) counts (O30).

Plan
----
The series is cut into time chunks per id (``chunk_seconds``), so a single
long or dense series is spread over many tasks instead of one window
partition.  The rows are shuffled once, on ``(id, chunk)``:

1. a running window inside each chunk marks every row with the last
   zero-state row at or before it (``lz``).  Alarm rows with the same mark
   belong to the same run;
2. in the same stage (no exchange: the grouping keys contain the partitioning
   keys) the rows are folded to *pieces*: one row per run fragment in a chunk
   plus one row per chunk for its zero-state rows;
3. a two-level prefix over the chunk table (one row per chunk) finds the last
   zero-state row before each chunk, which names the run of alarm rows that
   continue a run from an earlier chunk;
4. pieces are combined per (id, run) with associative aggregates.

Everything after step 2 runs on tables whose size is the number of runs plus
the number of chunks, not the number of rows.  The pieces table is persisted
(memory and disk; rebuilt from lineage if an executor is lost) because every
consumer -- the chunk table, the runs, the units of analysis and per-id row
sums -- reads it: the series rows are shuffled once per outcome.

Scope
-----
``scope="series"`` runs every series on its own: the row before the first is
treated as not alarming, the row after the last likewise.  ``scope="dataset"``
reproduces a walk over all series concatenated in id order: state leaks from
one series into the next, the very first row of all has no predecessor (a run
starting there has no start, and its duration is NULL) and the very last row
has no successor (a run ending there never clears).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.session import keep

DAY_SECONDS = 86_400


def prepare(df: DataFrame, state: Column, answered: Column | None = None, *, id_col: str = "id",
            ts_col: str = "datetime", tie_col: str | None = None,
            payload: Sequence[str] = ("randomization", "nurse"), measure: str | None = None,
            row_value: Column | None = None, chunk_seconds: int | None = DAY_SECONDS,
            rows_per_chunk: int = 1_000_000) -> DataFrame:
    """Rename the series to the operator's columns and hash it on (id, chunk).

    This is the only exchange of full series rows.  ``row_value`` is summed
    over every row of each id (see :func:`row_sums`).  ``chunk_seconds=None``
    picks a width per id so that a chunk holds about ``rows_per_chunk`` rows
    (see :func:`chunk_widths`).
    """
    tie = F.col(tie_col).cast("long") if tie_col else F.lit(0).cast("long")
    if answered is None:
        answered = F.lit(False)
    base = df.select(
        F.col(id_col).alias("_id"),
        F.col(ts_col).alias("_t"),
        tie.alias("_l"),
        F.coalesce(state == 1, F.lit(False)).alias("_one"),
        F.coalesce(answered, F.lit(False)).alias("_ev"),
        F.struct(*[F.col(c) for c in payload]).alias("_p"),
        (F.col(measure) if measure else F.lit(None).cast("int")).alias("_m"),
        (row_value if row_value is not None else F.lit(None).cast("long")).alias("_v"),
        F.unix_seconds(F.col(ts_col)).alias("_s"),
    )
    if chunk_seconds is None:
        widths = chunk_widths(base, rows_per_chunk)
        base = base.join(widths, "_id", "left")
        width = F.coalesce(F.col("_w"), F.lit(DAY_SECONDS))
    else:
        width = F.lit(chunk_seconds)
    base = base.withColumn("_c", F.floor(F.col("_s") / width)).drop("_s", "_w")
    return base.repartition("_id", "_c")


def pieces(prepared: DataFrame, scope: str = "series", persist: bool = True) -> DataFrame:
    """Fold the prepared rows into run pieces (one row per run fragment per
    chunk, plus one row per chunk for its zero-state rows)."""
    if scope == "series":
        order = F.struct(F.col("_t").alias("t"), F.col("_l").alias("l"))
    elif scope == "dataset":
        order = F.struct(F.col("_id").alias("i"), F.col("_t").alias("t"), F.col("_l").alias("l"))
    else:
        raise ValueError(f"unknown scope {scope!r}")
    base = prepared.withColumn("_o", order)

    one, o = F.col("_one"), F.col("_o")
    zero_mark = F.when(~one, o)
    w = (Window.partitionBy("_id", "_c").orderBy("_t", "_l")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = base.withColumn("_lz", F.max(zero_mark).over(w))
    # Zero-state rows of a chunk collapse into a single group (_z = true).
    marked = marked.withColumn("_z", ~one).withColumn("_g", F.when(one, F.col("_lz")))
    one_o = F.when(one, o)
    ans_o = F.when(one & F.col("_ev"), o)
    out = marked.groupBy("_id", "_c", "_z", "_g").agg(
        F.max(zero_mark).alias("zmax"),
        F.max(o).alias("omax"),
        F.min(one_o).alias("start"),
        F.max(one_o).alias("last"),
        F.min(ans_o).alias("ans"),
        F.max_by(F.col("_p"), one_o).alias("last_p"),
        F.min_by(F.col("_p"), ans_o).alias("ans_p"),
        F.max_by(F.col("_m"), one_o).alias("last_m"),
        F.min_by(F.col("_m"), ans_o).alias("ans_m"),
        F.collect_set(F.col("_p")).alias("units"),
        F.sum(F.col("_v")).alias("vsum"),
        F.min(o).alias("first_o"),
        F.min_by(F.col("_p"), o).alias("first_p"),
    )
    return keep(out) if persist else out


def chunk_widths(base: DataFrame, rows_per_chunk: int) -> DataFrame:
    """Per id, a chunk width (seconds, a power of two) giving about
    ``rows_per_chunk`` rows per chunk at the id's mean density.  Computed by
    a map-side-combined aggregate over two columns; how the table (one row per
    id) is joined is left to the planner."""
    per_id = base.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    span = F.greatest(F.col("hi") - F.col("lo") + 1, F.lit(1))
    raw = span * F.lit(float(rows_per_chunk)) / F.col("n")
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(raw, F.lit(1.0))))).cast("long")
    return per_id.select("_id", width.alias("_w"))


def units_of(piece_df: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct (id, payload) over all rows: the units of analysis."""
    return (piece_df.select(F.col("_id").alias(id_col), F.explode("units").alias("_u"))
            .select(id_col, "_u.*").distinct())


def row_sums(piece_df: DataFrame, id_col: str = "id") -> DataFrame:
    """Per id: sum of ``row_value`` over every row and the payload of the first row."""
    return piece_df.groupBy(F.col("_id").alias(id_col)).agg(
        F.sum("vsum").alias("vsum"), F.min_by("first_p", "first_o").alias("first_p"))


# Chunks per super-chunk in the two-level prefix over the chunks of one id.
SUPER_CHUNK = 1024


def _carry_over_chunks(chunks: DataFrame, size: int | None = None) -> DataFrame:
    """``carried``: the last zero-state mark of all earlier chunks of the same
    id.  Two levels -- inside super-chunks of ``size`` chunks, and over the
    super-chunks of the id -- so even a series spanning millions of chunks
    never puts its whole chunk table into one window partition."""
    size = size or SUPER_CHUNK
    chunks = chunks.withColumn("_sc", F.floor(F.col("_c") / F.lit(size)))
    tops = chunks.groupBy("_id", "_sc").agg(F.max("zmax").alias("sz"))
    ws = Window.partitionBy("_id").orderBy("_sc").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_id", "_sc", F.max("sz").over(ws).alias("s_prev"))
    wc = Window.partitionBy("_id", "_sc").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    inner = chunks.withColumn("in_prev", F.max("zmax").over(wc))
    return (inner.join(tops, ["_id", "_sc"])
            .select("_id", "_c", "zmax", "omax", F.coalesce("in_prev", "s_prev").alias("carried")))


def _previous_ids(ids: DataFrame, buckets: int | None = None) -> DataFrame:
    """For each series (in id order): the last zero-state mark of all earlier
    series (``prev_z``) and the last row of the whole frame (``frame_last``).

    A prefix over the sorted ids in two levels: ids are range-bucketed, the
    prefix runs inside each bucket and over the bucket maxima (``buckets``
    rows), so no task sees all series.  There are as many buckets as shuffle
    partitions, so they follow the size of the job.  The bucket assignment is
    written to the checkpoint folder, so both levels see the same buckets.
    """
    from tocsin.session import materialize

    buckets = buckets or int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(ids.repartitionByRange(buckets, "_id").withColumn("_b", F.spark_partition_id()),
                         "id-buckets")
    per_bucket = ranged.groupBy("_b").agg(F.max("id_z").alias("bz"), F.max("id_o").alias("bo"))
    wb = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = (per_bucket.withColumn("prev_bz", F.max("bz").over(wb))
                  .withColumn("frame_last", F.max("bo").over(Window.partitionBy())))
    wi = Window.partitionBy("_b").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("in_prev", F.max("id_z").over(wi))
    # one row per bucket: bounded by ``buckets``
    out = inside.join(F.broadcast(per_bucket.select("_b", "prev_bz", "frame_last")), "_b")
    return out.select("_id", F.coalesce("in_prev", "prev_bz").alias("prev_z"), "frame_last")


def run_parts(piece_df: DataFrame, scope: str = "series") -> DataFrame:
    """One row per (id, alarm run) with first row, last row and first answered row.

    In ``dataset`` scope a run may cross ids; there is then one row per id
    part of the run, and ``run_start``/``run_last``/``frame_last`` describe the
    whole run and the whole frame.
    """
    chunks = piece_df.groupBy("_id", "_c").agg(F.max("zmax").alias("zmax"), F.max("omax").alias("omax"))
    chunks = _carry_over_chunks(chunks)
    if scope == "dataset":
        ids = chunks.groupBy("_id").agg(F.max("zmax").alias("id_z"), F.max("omax").alias("id_o"))
        chunks = (chunks.join(_previous_ids(ids), "_id")
                  .withColumn("carried", F.coalesce("carried", "prev_z")).drop("prev_z"))
    else:
        chunks = chunks.withColumn("frame_last", F.col("omax"))

    ones = piece_df.filter(~F.col("_z")).join(chunks.select("_id", "_c", "carried", "frame_last"), ["_id", "_c"])
    ones = ones.withColumn("run", F.coalesce(F.col("_g"), F.col("carried")))
    parts = ones.groupBy("_id", "run").agg(
        F.min("start").alias("start"),
        F.max("last").alias("last"),
        F.min("ans").alias("ans"),
        F.max_by("last_p", "last").alias("last_p"),
        F.min_by("ans_p", "ans").alias("ans_p"),
        F.max_by("last_m", "last").alias("last_m"),
        F.min_by("ans_m", "ans").alias("ans_m"),
        F.max("frame_last").alias("frame_last"),
    )
    if scope == "series":
        return (parts.withColumn("run_start", F.col("start")).withColumn("run_last", F.col("last"))
                .withColumn("clears", F.lit(True)))
    runs = (parts.groupBy("run").agg(F.min("start").alias("run_start"), F.max("last").alias("run_last"))
            .withColumnRenamed("run", "_rk"))
    parts = parts.join(runs, F.col("run").eqNullSafe(F.col("_rk"))).drop("_rk")
    # The first run of the frame has no start; the last row of the frame has no successor.
    parts = parts.withColumn("run_start", F.when(F.col("run").isNotNull(), F.col("run_start")))
    parts = parts.withColumn("clears", F.col("last") == F.col("run_last"))
    parts = parts.withColumn("clears", F.col("clears") & (F.col("run_last") != F.col("frame_last")))
    return parts


def episodes(df: DataFrame, state: Column, answered: Column | None = None, *, end: str = "clear",
             id_col: str = "id", ts_col: str = "datetime", tie_col: str | None = None,
             payload: Sequence[str] = ("randomization", "nurse"), measure: str | None = None,
             chunk_seconds: int | None = DAY_SECONDS, scope: str = "series",
             rows_per_chunk: int = 1_000_000) -> DataFrame:
    """First end per (start, id) with its duration in seconds.

    ``end="clear"``: the alarm clears (O28).  ``end="answered"``: the alarm
    clears or a row carries an accepted event, whichever comes first (O29).
    Output: ``id, alarm_start, alarm_end, duration`` (seconds, NULL when the
    start is unknown), the ``payload`` columns and ``measure`` taken at the end
    row, and ``end_order`` (the position of the end row, for first-per-id
    choices).
    """
    prepared = prepare(df, state, answered, id_col=id_col, ts_col=ts_col, tie_col=tie_col, payload=payload,
                       measure=measure, chunk_seconds=chunk_seconds, rows_per_chunk=rows_per_chunk)
    return episodes_of(pieces(prepared, scope), end=end, id_col=id_col, payload=payload, measure=measure,
                       scope=scope)


def episodes_of(piece_df: DataFrame, *, end: str = "clear", id_col: str = "id",
                payload: Sequence[str] = ("randomization", "nurse"), measure: str | None = None,
                scope: str = "series") -> DataFrame:
    """Episodes from a pieces table (see :func:`episodes`)."""
    parts = run_parts(piece_df, scope)
    clear = F.when(F.col("clears"), F.col("last"))
    if end == "clear":
        end_o, end_p, end_m = clear, F.col("last_p"), F.col("last_m")
    elif end == "answered":
        end_o = F.least(F.col("ans"), clear)
        use_ans = F.col("ans").isNotNull() & (F.col("ans") == end_o)
        end_p = F.when(use_ans, F.col("ans_p")).otherwise(F.col("last_p"))
        end_m = F.when(use_ans, F.col("ans_m")).otherwise(F.col("last_m"))
    else:
        raise ValueError(f"unknown end rule {end!r}")
    out = parts.select(
        F.col("_id").alias(id_col),
        F.col("run_start")["t"].alias("alarm_start"),
        end_o["t"].alias("alarm_end"),
        end_o.alias("end_order"),
        end_p.alias("_p"),
        end_m.alias(measure) if measure else F.lit(None).alias("_nomeasure"),
    ).filter(F.col("end_order").isNotNull())
    out = out.withColumn("duration", F.unix_seconds("alarm_end") - F.unix_seconds("alarm_start"))
    cols = [id_col, "alarm_start", "alarm_end", "duration", "end_order"]
    cols += [F.col("_p")[c].alias(c) for c in payload]
    if measure:
        cols.append(measure)
    return out.select(*cols)
