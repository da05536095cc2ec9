import datetime as dt
import random

import pytest

from tocsin.operators.clock import clock_fill, clock_pairs, nurse_fill

T0 = dt.datetime(2024, 1, 1, 8, 0, 0)


def ts(s):
    return T0 + dt.timedelta(seconds=s)


def literal_fill(row_times, readings, head_added):
    """Join-then-fill walk.  ``readings``: [(time, value)] in reading order.
    A row matching several readings is repeated once per reading; after the
    fill (down, then up) the first copy of each row is kept."""
    frame, matched = [], set()
    if head_added and readings:
        t0 = readings[0][0]
        hits = [(k, v) for k, (rt, v) in enumerate(readings) if rt == t0]
        matched |= {k for k, _ in hits}
        frame += [{"v": v, "row": None} for _, v in hits]
    for i, t in enumerate(row_times):
        hits = [(k, v) for k, (rt, v) in enumerate(readings) if rt == t]
        matched |= {k for k, _ in hits}
        frame += [{"v": v, "row": i} for _, v in hits] or [{"v": None, "row": i}]
    frame += [{"v": v, "row": None} for k, (rt, v) in enumerate(readings) if k not in matched]
    last = None
    for f in frame:
        if f["v"] is not None:
            last = f["v"]
        f["d"] = last
    nxt = None
    for f in reversed(frame):
        if f["v"] is not None:
            nxt = f["v"]
        if f["d"] is None:
            f["d"] = nxt
    out = {}
    for f in frame:
        if f["row"] is not None and f["row"] not in out:
            out[f["row"]] = f["d"]
    return [out[i] for i in range(len(row_times))]


def _clock(spark, row_secs, pairs):
    rows = spark.createDataFrame([("A", ts(s)) for s in row_secs], "id string, datetime timestamp")
    sync = []
    r = 0
    for cap, diff in pairs:
        r += 1
        sync.append(("A", r, "Capnostream", ts(cap)))
        r += 1
        sync.append(("A", r, "ipad", ts(cap + diff) if diff is not None else None))
    sdf = spark.createDataFrame(sync, "id string, row int, device string, time timestamp")
    out = clock_fill(rows, clock_pairs(sdf)).orderBy("datetime").select("diff").collect()
    return [r["diff"] for r in out]


CASES = [
    ([0, 1, 2, 3, 4], [(0, 7), (3, 9)]),          # both on the grid
    ([0, 1, 2, 3, 4], [(-5, 7), (3, 9)]),         # first before the recording
    ([0, 1, 2, 3, 4], [(2, 7), (10, 9)]),         # second after the recording
    ([0, 1, 2, 3, 4], [(1.5, 7), (2.5, 9)]),      # none on the grid
    ([0, 1, 2, 3, 4], [(1, None), (3, 9)]),       # first pair without tablet time
    ([0, 1, 2, 3, 4], [(3, 9)]),
]


@pytest.mark.parametrize("row_secs,pairs", CASES)
def test_clock_fill_matches_literal(spark, row_secs, pairs):
    readings = sorted(((ts(c), d) for c, d in pairs), key=lambda r: r[0])  # stable: sheet order on ties
    assert _clock(spark, row_secs, pairs) == literal_fill([ts(s) for s in row_secs], readings, head_added=True)


def test_clock_fill_random(spark):
    rnd = random.Random(3)
    for _ in range(6):
        row_secs = sorted(rnd.sample(range(0, 60), rnd.randint(3, 12)))
        caps = sorted(rnd.choices(range(-10, 70), k=rnd.randint(1, 4)))  # repeats allowed
        pairs = [(c, rnd.choice([None, 5, 7, 11])) for c in caps]
        readings = sorted(((ts(c), d) for c, d in pairs), key=lambda r: r[0])  # stable: sheet order on ties
        assert _clock(spark, row_secs, pairs) == literal_fill([ts(s) for s in row_secs], readings, True)


def test_nurse_fill_prefers_matched_reading(spark):
    # nurse 1 logged before the recording (matches no row), nurse 2 during it:
    # every row gets nurse 2, as the join-then-fill rule does.
    rows = spark.createDataFrame([("A", ts(s), ts(s + 7)) for s in range(5)],
                                 "id string, datetime timestamp, time_corrected timestamp")
    log = spark.createDataFrame([("A", 1, "N01", ts(-100)), ("A", 2, "N02", ts(3 + 7))],
                                "id string, row int, nurse string, time_corrected timestamp")
    got = [r["nurse"] for r in nurse_fill(rows, log).orderBy("datetime").collect()]
    assert got == literal_fill([ts(s + 7) for s in range(5)], [(ts(-100), "N01"), (ts(10), "N02")], False)
    assert got == ["N02"] * 5
    asof = [r["nurse"] for r in nurse_fill(rows, log, match="asof").orderBy("datetime").collect()]
    assert asof == ["N01", "N01", "N01", "N02", "N02"]


def test_nurse_fill_skips_missing_values_and_takes_last_of_a_second(spark):
    rows = spark.createDataFrame([("A", ts(s), ts(s)) for s in range(6)],
                                 "id string, datetime timestamp, time_corrected timestamp")
    log = spark.createDataFrame([("A", 1, "N01", ts(1)), ("A", 2, None, ts(3)),
                                 ("A", 3, "N02", ts(4)), ("A", 4, "N03", ts(4))],
                                "id string, row int, nurse string, time_corrected timestamp")
    got = [r["nurse"] for r in nurse_fill(rows, log).orderBy("datetime").collect()]
    # second 0 takes the first reading from below; a missing value does not
    # reset the fill; two readings in one second: that second keeps the first,
    # the seconds after carry the last
    assert got == ["N01", "N01", "N01", "N01", "N02", "N03"]
    assert got == literal_fill([ts(s) for s in range(6)],
                               [(ts(1), "N01"), (ts(3), None), (ts(4), "N02"), (ts(4), "N03")], False)


def test_rows_of_other_recordings_untouched(spark):
    rows = spark.createDataFrame([("A", ts(0)), ("B", ts(0))], "id string, datetime timestamp")
    sync = spark.createDataFrame([("A", 1, "Capnostream", ts(0)), ("A", 2, "ipad", ts(5))],
                                 "id string, row int, device string, time timestamp")
    got = {r["id"]: r["diff"] for r in clock_fill(rows, clock_pairs(sync)).collect()}
    assert got == {"A": 5, "B": None}
