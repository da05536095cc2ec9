import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tocsin.operators.episodes import episodes
from walk import walk

EPOCH = dt.datetime(2024, 1, 1)


def _df(spark, rows):
    data = [(r["id"], EPOCH + dt.timedelta(seconds=r["t"]), r["state"], r.get("event"), r.get("nurse", "N01"),
             r.get("arm", "IPI enabled"), r.get("spo2")) for r in rows]
    return spark.createDataFrame(
        data, "id string, datetime timestamp, state int, event string, nurse string, randomization string, spo2 int")


def _run(spark, rows, scope, end, chunk, rows_per_chunk=1_000_000):
    df = _df(spark, rows)
    answered = F.col("event").isNotNull() if end == "answered" else None
    ep = episodes(df, F.col("state"), answered, end=end, scope=scope, chunk_seconds=chunk,
                  rows_per_chunk=rows_per_chunk)
    got = ep.select("id", F.unix_seconds("alarm_start").alias("s"), F.unix_seconds("alarm_end").alias("e"),
                    "duration").collect()
    base = int(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp())
    return sorted(((r["id"], None if r["s"] is None else r["s"] - base, r["e"] - base, r["duration"]) for r in got),
                  key=lambda e: (e[0], e[2]))


def _rows(spec):
    """spec: {id: "0110..."} with optional events {(id, pos): label}."""
    rows = []
    for i, (k, states) in enumerate(spec.items()):
        for p, ch in enumerate(states):
            rows.append({"id": k, "t": p * 60, "state": int(ch)})
    return rows


@pytest.mark.parametrize("scope", ["series", "dataset"])
@pytest.mark.parametrize("end", ["clear", "answered"])
@pytest.mark.parametrize("chunk", [86400, 120])
def test_golden(spark, scope, end, chunk):
    rows = _rows({"A": "0110", "B": "1", "C": "0001", "D": "1100111", "E": "000", "F": "1111"})
    for r in rows:
        if r["id"] == "D" and r["t"] == 60:
            r["event"] = "Oxygen"
        if r["id"] == "F" and r["t"] == 120:
            r["event"] = "Alarm silenced"
    assert _run(spark, rows, scope, end, chunk) == walk(rows, scope, end)


def test_single_row_alarm_lasts_zero(spark):
    rows = _rows({"A": "010"})
    assert _run(spark, rows, "series", "clear", 86400) == [("A", 60, 60, 0)]


def test_alarm_at_edges_series_scope(spark):
    rows = _rows({"A": "1001"})
    assert _run(spark, rows, "series", "clear", 86400) == [("A", 0, 0, 0), ("A", 180, 180, 0)]


def test_dataset_scope_leaks_and_null_start(spark):
    rows = _rows({"A": "11", "B": "10", "C": "01"})
    got = _run(spark, rows, "dataset", "clear", 86400)
    # the run starting at the very first row has no start; it ends in B;
    # the run at the very end never clears.
    assert got == walk(rows, "dataset", "clear")
    assert got[0][1] is None and got[0][0] == "B"
    assert all(e[0] != "C" for e in got)


@pytest.mark.parametrize("seed", range(6))
def test_random_series_match_literal_walk(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for k in range(rnd.randint(2, 6)):
        t = 0
        for _ in range(rnd.randint(1, 40)):
            t += rnd.choice([1, 1, 2, 60, 3600, 90000])
            rows.append({"id": f"E{k:02d}", "t": t, "state": rnd.choice([0, 0, 1]),
                         "event": rnd.choice([None, None, None, "Oxygen"])})
    rows.sort(key=lambda r: (r["id"], r["t"]))
    for scope in ("series", "dataset"):
        for end in ("clear", "answered"):
            chunk = rnd.choice([5, 3600, 86400])
            assert _run(spark, rows, scope, end, chunk) == walk(rows, scope, end), (scope, end, chunk)


@pytest.mark.parametrize("scope", ["series", "dataset"])
def test_hot_series_split_over_chunks(spark, scope, monkeypatch):
    import tocsin.operators.episodes as ep
    monkeypatch.setattr(ep, "SUPER_CHUNK", 4)  # many super-chunks too
    # One id holds almost all rows; 60-second chunks cut it into hundreds of
    # pieces that must stitch back into the same runs as the literal walk.
    rnd = random.Random(11)
    rows = []
    for k, n in (("A", 20), ("HOT", 4000), ("Z", 15)):
        t = 0
        state = 0
        for _ in range(n):
            t += 1
            if rnd.random() < 0.08:
                state = 1 - state
            rows.append({"id": k, "t": t, "state": state, "event": "Oxygen" if rnd.random() < 0.01 else None})
    for end in ("clear", "answered"):
        assert _run(spark, rows, scope, end, 60) == walk(rows, scope, end)


@pytest.mark.parametrize("scope", ["series", "dataset"])
def test_chunk_width_from_density(spark, scope):
    # chunk_seconds=None: about 64 rows per chunk for every id, however dense.
    rnd = random.Random(5)
    rows = []
    for k, n, step in (("A", 300, 1), ("B", 2000, 1), ("C", 200, 3600)):
        t, state = 0, 0
        for _ in range(n):
            t += step
            if rnd.random() < 0.1:
                state = 1 - state
            rows.append({"id": k, "t": t, "state": state, "event": None})
    for end in ("clear", "answered"):
        assert _run(spark, rows, scope, end, None, rows_per_chunk=64) == walk(rows, scope, end)
