"""Round trip: recordings and workbooks written as files, read back, ingested."""
import os
import tempfile
import zipfile

from pyspark.sql import functions as F

from tocsin.plans.ingest import ingest_folders
from tocsin.sources.dataset import read_series
from tocsin.sources.device_csv import DEVICE_COLUMNS, read_device_csv
from tocsin.sources.workbook import parse_xlsx, read_workbooks, sheet_frame, sheet_row_counts, workbook_files


def _cell(ref, v):
    return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def write_xlsx(path, sheets):
    """Minimal workbook writer (inline strings) for the tests."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        wb = ['<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
              'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>']
        rels = ['<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">']
        for i, (name, rows) in enumerate(sheets.items(), start=1):
            wb.append(f'<sheet name="{name}" sheetId="{i}" r:id="rId{i}"/>')
            rels.append(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml" '
                        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"/>')
            body = []
            for r, row in enumerate(rows, start=1):
                cells = "".join(_cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row) if v is not None)
                body.append(f'<row r="{r}">{cells}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml",
                       '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
                       + "".join(body) + "</sheetData></worksheet>")
        wb.append("</sheets></workbook>")
        rels.append("</Relationships>")
        z.writestr("xl/workbook.xml", "".join(wb))
        z.writestr("xl/_rels/workbook.xml.rels", "".join(rels))


def _csv_line(sec, flags, event=""):
    vals = {c: "0" for c in DEVICE_COLUMNS}
    vals.update(date="01/05/2024", time=f"10:00:{sec:02d}", spo2="88", ipi="--", events=event)
    vals.update(flags)
    return ",".join(vals[c] for c in DEVICE_COLUMNS)


def _make_folders(root):
    csv_dir, wb_dir = os.path.join(root, "csv_data"), os.path.join(root, "observation_data")
    os.makedirs(csv_dir)
    os.makedirs(wb_dir)
    lines = ["preamble"] * 6
    lines += [_csv_line(0, {}), _csv_line(0, {"spo2Low": "1"}), _csv_line(1, {"spo2Low": "1"}),
              _csv_line(2, {"spo2Low": "1"}), _csv_line(3, {}), "", _csv_line(4, {"ipiLow": "1"})]
    with open(os.path.join(csv_dir, "E01.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    write_xlsx(os.path.join(wb_dir, "E01.xlsx"), {
        "Sync times": [["device", "time"], ["Capnostream", "01/05/2024 10:00:00"], ["ipad", "01/05/2024 10:00:05"]],
        "Nurse ID": [["nurse", "time"], ["N01", "01/05/2024 10:00:05"]],
        "Interventions": [["event", "time"], ["Oxygen", "01/05/2024 10:00:07"]],
        "Adverse events": [["severity", "description"], [None, "desaturation"]],
        "Patient": [["patient", "age", "totalMidaz"], ["E01", "40", "1"]],
    })
    return csv_dir, wb_dir


def test_device_csv_scan(spark):
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    csv_dir, _ = _make_folders(root)
    df = read_device_csv(spark, csv_dir).orderBy("line").collect()
    assert len(df) == 6                      # preamble and blank line skipped
    assert df[0]["id"] == "E01" and df[0]["ipi"] is None and df[0]["spo2"] == 88.0
    assert [r["line"] for r in df] == sorted(r["line"] for r in df)
    assert df[0]["datetime"].second == 0 and df[1]["datetime"].second == 0


def test_workbook_scan(spark):
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    _, wb_dir = _make_folders(root)
    cells = read_workbooks(spark, wb_dir)
    sync = sheet_frame(cells, ["device", "time"], sheet="Sync times").orderBy("row").collect()
    assert [r["device"] for r in sync] == ["Capnostream", "ipad"]
    counts = {r["id"]: r["observed"] for r in sheet_row_counts(cells, workbook_files(spark, wb_dir), "Adverse events").collect()}
    assert counts == {"E01": 1}
    first = sheet_frame(cells, ["device"], sheet_index=1).count()
    assert first == 2


def test_parse_xlsx_shared_strings():
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    path = os.path.join(root, "x.xlsx")
    write_xlsx(path, {"S": [["a"], ["1"]]})
    assert parse_xlsx(open(path, "rb").read()) == [(1, "S", 1, 1, "a"), (1, "S", 2, 1, "1")]


def test_folder_ingest_round_trip(spark):
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    csv_dir, wb_dir = _make_folders(root)
    out = os.path.join(root, "monitor_data")
    ingest_folders(spark, csv_dir, wb_dir, out_dir=out)
    back = read_series(spark, out).orderBy("datetime").collect()
    assert len(back) == 5                                   # one row per second
    assert all(r["nurse"] == "N01" and r["randomization"] == "IPI enabled" for r in back)
    assert [r["event"] for r in back] == [None, None, "Oxygen", None, None]
    assert back[0]["spo2Low"] == 0                           # first line of second 0 kept
    assert (back[0]["time_corrected"] - back[0]["datetime"]).total_seconds() == 5
    assert os.path.isdir(os.path.join(out, "id=E01"))


def test_streaming_ingest_available_now(spark):
    from tocsin.streaming.ingest_stream import start_ingest_stream
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    csv_dir, wb_dir = _make_folders(root)
    out = os.path.join(root, "monitor_data")
    q = start_ingest_stream(spark, csv_dir, wb_dir, out, os.path.join(root, "stream-ckpt"), available_now=True)
    q.awaitTermination(120)
    first = read_series(spark, out).count()
    # a second run finds no new files and leaves the dataset as it is
    q = start_ingest_stream(spark, csv_dir, wb_dir, out, os.path.join(root, "stream-ckpt"), available_now=True)
    q.awaitTermination(120)
    assert first == 5 and read_series(spark, out).count() == 5


def test_trial_from_folders(spark):
    from tocsin.plans.trial import Trial
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    csv_dir, wb_dir = _make_folders(root)
    out = os.path.join(root, "monitor_data")
    ingest_folders(spark, csv_dir, wb_dir, out_dir=out)
    t = Trial.from_folders(spark, out, wb_dir)
    primary = {r["id"]: r["outcome"] for r in t.primary().collect()}
    # alarm at seconds 1-2 (answered by nothing) and at 4 (one row)
    assert primary == {"E01": 1}  # no unit that the caller did not name
    assert [r["adverseEvent"] for r in t.adverse().collect()] == [1]
    assert t.excluded().count() == 0


def test_read_series_keeps_numeric_looking_ids(spark):
    from tocsin.sources.dataset import write_series
    import datetime as dt
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    df = spark.createDataFrame([("007", dt.datetime(2024, 1, 1, 10, 0, 0), 1)], "id string, datetime timestamp, v int")
    write_series(df, os.path.join(root, "s"))
    assert [r["id"] for r in read_series(spark, os.path.join(root, "s")).collect()] == ["007"]


def test_device_csv_split_mode_matches_whole_files(spark):
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    csv_dir, _ = _make_folders(root)
    cols = [c for c in DEVICE_COLUMNS] + ["id", "datetime"]
    whole = read_device_csv(spark, csv_dir).orderBy("line").select(*cols).collect()
    split = read_device_csv(spark, csv_dir, split_files=True).orderBy("line").select(*cols).collect()
    assert whole == split


def test_device_csv_split_mode_many_blocks(spark):
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    csv_dir, _ = _make_folders(root)
    cols = [c for c in DEVICE_COLUMNS] + ["id", "datetime"]
    whole = read_device_csv(spark, csv_dir).orderBy("line").select(*cols).collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")  # the file spans several blocks
    try:
        df = read_device_csv(spark, csv_dir, split_files=True)
        assert df.rdd.getNumPartitions() > 1
        split = df.orderBy("line").select(*cols).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert whole == split


def test_workbook_findings_over_real_files(spark):
    from tocsin.plans.ingest import workbook_findings
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    _, wb_dir = _make_folders(root)
    # readings a day and ten minutes apart; a nurse too many; no other sheet; the first sheet under another name
    write_xlsx(os.path.join(wb_dir, "E02.xlsx"), {
        "Clock": [["device", "time"], ["Capnostream", "01/05/2024 23:55:00"], ["ipad", "01/06/2024 00:05:00"]],
        "Nurse ID": [["nurse", "time"], ["N01", "01/05/2024 10:00:05"], ["N02", "01/05/2024 10:00:06"]],
    })
    found = {(r["id"], r["check"], r["observed"], r["expected"]) for r in workbook_findings(spark, wb_dir).collect()}
    assert found == {("E01", "intervention_rows", 1.0, 0.0), ("E02", "nurse_rows", 2.0, 1.0),
                     ("E02", "adverse_rows", 0.0, 1.0), ("E02", "sync_not_same_day", 1.0, 0.0),
                     ("E02", "sync_gap_over_limit", 10.0, 5.0)}


def test_units_of_real_files_use_the_nurse_sheets(spark):
    from tocsin.plans.trial import Trial
    root = tempfile.mkdtemp(prefix="tocsin-test-")
    csv_dir, wb_dir = _make_folders(root)
    write_xlsx(os.path.join(wb_dir, "E02.xlsx"), {"Nurse ID": [["nurse", "time"], ["N02", "01/05/2024 10:00:05"]]})
    out = os.path.join(root, "monitor_data")
    ingest_folders(spark, csv_dir, wb_dir, out_dir=out)
    units = {tuple(r) for r in Trial.from_folders(spark, out, wb_dir).nurse_units().collect()}
    assert units == {("N01", "E01", "IPI enabled"), ("N02", None, "IPI disabled")}


def test_small_recordings_share_files(spark):
    """A thousand recordings and more in a few sorted files, with the ids as they were."""
    from tocsin.sources.dataset import write_series
    out = os.path.join(tempfile.mkdtemp(), "s")
    df = spark.sql("""SELECT CASE WHEN r = 7 THEN '' WHEN r = 8 THEN NULL ELSE printf('E%03d', r) END AS id,
                      timestamp_seconds(1704067200 + t * 40000) AS datetime, r * 100 + t AS line
                      FROM (SELECT explode(sequence(0, 1199)) AS r), (SELECT explode(sequence(0, 9)) AS t)""")
    write_series(df, out)
    files = [f for _, _, names in os.walk(out) for f in names if f.endswith(".parquet")]
    assert len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions")), len(files)
    back = read_series(spark, out)
    assert sorted(map(tuple, back.select("id", "datetime", "line").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert back.where("id = 'E042'").count() == 10
    spans = sorted((r["low"], r["high"]) for r in back.where("id IS NOT NULL").groupBy(F.input_file_name()).agg(
        F.min("id").alias("low"), F.max("id").alias("high")).collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])), spans
