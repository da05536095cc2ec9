"""Observer workbook scan.

A folder of ``.xlsx`` files, one per patient, each with the sheets ``Patient``,
``Nurse ID``, ``Interventions``, ``Adverse events`` and ``Sync times``.  The
files are read as binary rows and unpacked on the executors (an ``.xlsx`` is
a zip of XML parts) into one long table ``(id, sheet_index, sheet, row, col,
value)``; every sheet of every file becomes rows of the same table, so the
union of per-file frames comes for free.  ``sheet_frame`` turns one sheet into
a typed frame with declared columns (a pivot with a fixed value list, no
extra pass over the data).
"""

from __future__ import annotations

import io
import re
import zipfile
import xml.etree.ElementTree as ET
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PKG_REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"

LONG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("sheet_index", T.IntegerType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("row", T.IntegerType()),
    T.StructField("col", T.IntegerType()),
    T.StructField("value", T.StringType()),
])


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def parse_xlsx(content: bytes) -> list[tuple[int, str, int, int, str]]:
    """Cells of every sheet as ``(sheet_index, sheet, row, col, value)``."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        shared = [_text(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PKG_REL}Relationship")}
    out = []
    sheets = ET.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets")
    for idx, sh in enumerate(sheets, start=1):
        target = rels[sh.get(f"{_REL}id")].lstrip("/")
        part = target if target.startswith("xl/") else "xl/" + target
        ws = ET.fromstring(z.read(part))
        for rnum, row in enumerate(ws.iter(f"{_NS}row"), start=1):
            r = int(row.get("r", rnum))
            for ccount, c in enumerate(row.findall(f"{_NS}c"), start=1):
                ref = c.get("r")
                col = _col_index(ref) if ref else ccount
                kind = c.get("t")
                v = c.find(f"{_NS}v")
                if kind == "s" and v is not None:
                    value = shared[int(v.text)]
                elif kind == "inlineStr":
                    node = c.find(f"{_NS}is")
                    value = _text(node) if node is not None else None
                elif kind == "b" and v is not None:
                    value = "TRUE" if v.text == "1" else "FALSE"
                else:
                    value = v.text if v is not None else None
                if value is not None and value != "":
                    out.append((idx, sh.get("name"), r, col, value))
    return out


def _explode_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
            rows.extend((stem, *cell) for cell in parse_xlsx(bytes(content)))
        yield pd.DataFrame(rows, columns=[f.name for f in LONG_SCHEMA.fields])


def read_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Every cell of every sheet of every workbook under ``path`` (long form)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return files.mapInPandas(_explode_files, LONG_SCHEMA)


def workbook_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per workbook (``id``), without reading the contents."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
             .option("recursiveFileLookup", "true").load(path).select("path"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"))


def sheet_frame(cells: DataFrame, columns: Sequence[str], sheet: str | None = None,
                sheet_index: int | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """One sheet as a frame: the first row is the header; ``columns`` are kept
    (absent ones are NULL), typed by ``types`` (text by default).

    Output: ``id, row`` + ``columns``; ``row`` counts data rows from 1.
    """
    sel = cells.filter(F.col("sheet") == sheet) if sheet is not None else cells.filter(F.col("sheet_index") == sheet_index)
    header_row = sel.groupBy("id").agg(F.min("row").alias("_h"))
    sel = sel.join(header_row, "id")
    header = sel.filter(F.col("row") == F.col("_h")).select("id", "col", F.col("value").alias("_name"))
    body = sel.filter(F.col("row") > F.col("_h")).withColumn("row", F.col("row") - F.col("_h"))
    named = body.join(header, ["id", "col"]).filter(F.col("_name").isin(*columns))
    wide = named.groupBy("id", "row").pivot("_name", list(columns)).agg(F.first("value"))
    types = types or {}
    return wide.select("id", "row", *[F.col(c).cast(types.get(c, "string")).alias(c) for c in columns])


def sheet_header(cells: DataFrame, sheet: str) -> list[str]:
    """Column names of one sheet across all workbooks (the header row), in
    column order; a sheet is a few columns wide, so the list is small."""
    sel = cells.filter(F.col("sheet") == sheet)
    first = sel.groupBy("id").agg(F.min("row").alias("_h"))
    head = sel.join(first, "id").filter(F.col("row") == F.col("_h"))
    rows = head.groupBy("value").agg(F.min("col").alias("col")).orderBy("col", "value").collect()
    return [r["value"] for r in rows]


def sheet_row_counts(cells: DataFrame, files: DataFrame, sheet: str | None = None,
                     sheet_index: int | None = None) -> DataFrame:
    """Data rows per workbook for one sheet; a workbook with an empty sheet
    counts 0 (``id, observed``)."""
    sel = cells.filter(F.col("sheet") == sheet) if sheet is not None else cells.filter(F.col("sheet_index") == sheet_index)
    per = sel.groupBy("id").agg((F.countDistinct("row") - 1).alias("observed"))
    return files.join(per, "id", "left").select("id", F.coalesce("observed", F.lit(0)).cast("long").alias("observed"))


# The sheet that each row count looks at; clock readings stand on
# the first sheet, whatever its name.
COUNTED_SHEETS = {"Nurse ID": "nurse_rows", "Interventions": "intervention_rows", "Adverse events": "adverse_rows"}


def counted_rows(cells: DataFrame) -> DataFrame:
    """Data rows (``id, check, n``) of all checked sheets, in one aggregate."""
    names = F.create_map(*[F.lit(x) for pair in COUNTED_SHEETS.items() for x in pair])
    check = F.when(F.col("sheet_index") == 1, "sync_rows").otherwise(names[F.col("sheet")])
    return (cells.select("id", check.alias("check"), "row").where(F.col("check").isNotNull())
            .groupBy("id", "check").agg((F.countDistinct("row") - 1).alias("n")))
