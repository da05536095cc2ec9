"""Clock alignment and log attachment.

The tablet (observer) clock and the monitor clock differ by a few seconds.
Sync readings give pairs of clock times; their difference is carried over the
monitor rows (O09) to give every row a tablet time (O10), on which the nurse
log (O11) and the intervention log (O12) are attached.

Step fill
---------
A reading *matches* the rows whose time equals it to the second.  Each row
takes the value of the last matching reading at or before it; rows before
the first matching reading take a head value (the first reading of all for
the clock offset, the first matching reading for the nurse), and when nothing
matches the first unmatched reading is used.  This is the row-order fill of
the original ingest.

Rows and readings are hashed together by (recording, day of their time).
Matching and filling happen inside a day; what a day hands on to the next is
one row of a small table (one per recording and day) that is filled over the
days and joined back on the same hash.  So the rows move once and a long
recording is spread over its days; the moved rows are kept for the two reads,
nothing runs beforehand and nothing depends on a count.  The observer's events
share the nurse log's clock and travel with it.

``match="asof"`` is the corrected alternative: every reading counts from its
own time on, matching a row or not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tocsin.functions.timeparse import add_seconds
from tocsin.operators.episodes import DAY_SECONDS
from tocsin.session import keep


def clock_pairs(sync: DataFrame) -> DataFrame:
    """K-th reading of each device paired; diff = ipad - Capnostream (s).

    ``sync``: ``id, row, device, time`` (timestamp).  Output: ``id, sync,
    ipad, Capnostream, diff, datetime`` where ``datetime`` is the monitor
    (Capnostream) time of the pair.
    """
    w = Window.partitionBy("id", "device").orderBy("row")
    k = sync.withColumn("sync", F.row_number().over(w))
    pairs = k.groupBy("id", "sync").pivot("device", ["ipad", "Capnostream"]).agg(F.first("time"))
    return (pairs.withColumn("diff", F.unix_seconds("ipad") - F.unix_seconds("Capnostream"))
            .withColumn("datetime", F.col("Capnostream")))


def _per_second(readings: DataFrame, key: str, time: str, value: str, order: str | None) -> DataFrame:
    """One row per (recording, second): the first reading's value, the last
    present one (which later rows carry) and the first present one."""
    r = readings.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.col(value).alias("_v"),
                        (F.col(order) if order else F.lit(0)).alias("_o"))
    good = F.when(F.col("_v").isNotNull(), F.col("_o"))
    return r.groupBy("_k", "_t").agg(
        F.min_by("_v", "_o").alias("_at"), F.max_by("_v", good).alias("_after"), F.min_by("_v", good).alias("_good"))


def step_fill(rows: DataFrame, readings: DataFrame, *, key: str, row_time: str, reading_time: str,
              value: str, out: str, head_is_first_reading: bool, match: str = "exact",
              reading_order: str | None = None, events: DataFrame | None = None) -> DataFrame:
    """Carry reading values over rows (see module doc).  Adds column ``out``;
    with ``events`` (key, ``row_time``, event) also the event at the row's second."""
    if match not in ("exact", "asof"):
        raise ValueError(f"unknown match {match!r}")
    own = [c for c in rows.columns if not (events is not None and c == "event")]
    points = rows.select(F.col(key).alias("_k"), F.col(row_time).alias("_t"), F.struct(*own).alias("_row"))
    points = points.unionByName(_per_second(readings, key, reading_time, value, reading_order)
                                .withColumn("_reading", F.lit(True)), allowMissingColumns=True)
    if events is not None:
        points = points.unionByName(events.select(F.col(key).alias("_k"), F.col(row_time).alias("_t"),
                                                  F.col("event").alias("_event")), allowMissingColumns=True)
    day = F.coalesce(F.floor(F.unix_seconds("_t") / F.lit(DAY_SECONDS)), F.lit(-1))
    points = points.withColumn("_day", day).repartition("_k", "_day")

    is_row, timed = F.col("_row").isNotNull(), F.col("_t").isNotNull()
    second = Window.partitionBy("_k", "_day", "_t")
    before = (Window.partitionBy("_k", "_day").orderBy(F.unix_micros("_t"))
              .rangeBetween(Window.unboundedPreceding, -1))
    hit = timed if match == "asof" else F.max(is_row).over(second) & timed
    points = points.withColumn("_hit", F.col("_reading") & hit)
    # Several readings in one second: the row of that second keeps the first, the
    # rows after it carry the last value present; a missing value carries on.
    points = points.withColumn("_now", F.when(timed, F.max("_at").over(second)))
    points = points.withColumn("_carry", F.last(F.when(F.col("_hit"), F.col("_after")), ignorenulls=True).over(before))
    if events is not None:
        points = points.withColumn("_event", F.max("_event").over(second))

    # Read twice below: kept, so that the rows move once (freed with session.release).
    points = keep(points)

    has, time = F.col("_good").isNotNull(), F.struct(F.col("_t").isNull().alias("n"), F.col("_t").alias("t"))
    days = points.groupBy("_k", "_day").agg(
        F.max(is_row).alias("_rows"),
        F.max_by("_after", F.when(F.col("_hit") & F.col("_after").isNotNull(), F.col("_t"))).alias("_last"),
        F.min(F.when(F.col("_reading"), F.struct(time.alias("time"), F.col("_at").alias("v")))).alias("_first"),
        F.min(F.when(F.col("_hit") & has, F.struct(time.alias("time"), F.col("_good").alias("v")))).alias("_match"),
        F.min(F.when(F.col("_reading") & ~F.col("_hit") & has,
                     F.struct(time.alias("time"), F.col("_good").alias("v")))).alias("_other"),
        F.max(F.col("_hit")).alias("_any"))
    whole = Window.partitionBy("_k")
    earlier = whole.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    heads = ["_first"] * head_is_first_reading + ["_match", "_other"]
    days = days.select(
        "_k", "_day", "_rows", F.last("_last", ignorenulls=True).over(earlier).alias("_handed"),
        F.coalesce(*[F.min(h).over(whole)["v"] for h in heads]).alias("_head"),
        F.coalesce(F.max("_any").over(whole), F.lit(False)).alias("_matched"))
    days = days.where("_rows").select("_k", "_day", "_handed", "_head", "_matched")

    filled = points.where(is_row).join(days, ["_k", "_day"], "left")
    found = F.coalesce("_now", "_carry", "_handed", "_head")
    # A row without a time meets no reading: it has the head if nothing matches at all.
    found = F.when(timed, found).otherwise(F.when(~F.col("_matched"), F.col("_head")))
    attached = [F.col("_event").alias("event")] if events is not None else []
    return filled.select("_row.*", found.alias(out), *attached)


def clock_fill(rows: DataFrame, pairs: DataFrame, match: str = "exact") -> DataFrame:
    """O09 + O10: clock offset per monitor row and the tablet time."""
    filled = step_fill(rows, pairs.select("id", "datetime", "diff", "sync"), key="id", row_time="datetime",
                       reading_time="datetime", value="diff", out="diff", head_is_first_reading=True,
                       match=match, reading_order="sync")
    return filled.withColumn("time_corrected", add_seconds(F.col("datetime"), F.col("diff")))


def first_events(interventions: DataFrame) -> DataFrame:
    """The first logged event of each second."""
    return interventions.groupBy("id", "time_corrected").agg(F.min_by("event", "row").alias("event"))


def nurse_fill(rows: DataFrame, nurse_log: DataFrame, match: str = "exact",
               interventions: DataFrame | None = None) -> DataFrame:
    """Nurse per row from the nurse log (tablet time); with
    ``interventions`` also O12, in the same exchange."""
    log = nurse_log.select("id", F.col("time_corrected").alias("_nt"), "nurse", "row")
    events = first_events(interventions) if interventions is not None else None
    return step_fill(rows, log, key="id", row_time="time_corrected", reading_time="_nt", value="nurse",
                     out="nurse", head_is_first_reading=False, match=match, reading_order="row", events=events)


def event_attach(rows: DataFrame, interventions: DataFrame) -> DataFrame:
    """The logged event at the row's tablet second (first one if several);
    events between seconds on the grid of no row are dropped."""
    return rows.join(first_events(interventions), ["id", "time_corrected"], "left")
