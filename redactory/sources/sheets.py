"""Spreadsheets as cells (sheet, row_no, col_no, value): CSV or TSV by Spark's reader, workbooks a sheet a task."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.sources import xls

_CELL = "sheet string, row_no long, col_no long, value string"


def csv_cells(spark: SparkSession, path: str, sheet: str, sep: str = ",") -> DataFrame:
    """Cells of one CSV or TSV file that are not empty; quoted fields may hold separators and new lines.

    The file's lines are looked through for the most separators first, so that no column is lost. A file with quoted new
    lines cannot be split, so it is then one task, and a row's number in the task is its number.
    """
    width = spark.read.text(path).agg(F.coalesce(F.max(F.length("value") - F.length(F.replace("value", F.lit(sep), F.lit("")))), F.lit(0))).first()[0] + 1
    names = [f"c{i}" for i in range(width)]
    rows = spark.read.csv(path, ", ".join(f"{c} string" for c in names), sep=sep, quote='"', escape='"', multiLine=True, header=False, maxColumns=max(width, 20480))
    numbered = rows.select(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row_no"), F.array(*names).alias("cells"))
    return numbered.select("row_no", F.posexplode("cells").alias("col_no", "value")).where("value IS NOT NULL").select(F.lit(sheet).alias("sheet"), "row_no", F.col("col_no").cast("long").alias("col_no"), "value")


#: The sheet of each class.
SHEETS = {"el1": "EL 1", "el2d": "EL2 Daf", "el2h": "EL2 Hib", "pks": "PK Saf", "pkl": "PK Lav", "jrk": "Jr. Kindergarten", "kg": "Kindergarten"}
_HEAD = ["No", "Child name", "Start", "Return", "Last", "DOB", "Age", "Mon", "Tue", "Wed", "Thu", "Fri", "Lunch", "Nationality", "Parents"]


def sheet_cells(students: DataFrame) -> DataFrame:
    """Cells (sheet, row_no, col_no, value) as a school keeps them: two blocks a sheet, the later with the students, then totals.

    The later block is the second one, but for one sheet; a sheet without students and rows below the totals are there too.
    """
    spark = students.sparkSession
    table = F.create_map(*[F.lit(x) for pair in SHEETS.items() for x in pair])
    listed = students.where("centre = 'north' AND archived = 0").withColumn("sheet", F.try_element_at(table, F.col("class_id"))).where("sheet IS NOT NULL")
    listed = listed.withColumn("row_no", F.row_number().over(Window.partitionBy("sheet").orderBy("id")).cast("long") + 2)
    base = F.when(F.col("sheet") == "EL2 Daf", 0).otherwise(25)
    cell = lambda at, value: F.struct((base + at).cast("long").alias("col_no"), value.alias("value"))
    texts = [(1, "name"), (2, "start_date"), (5, "dob"), (7, "mon"), (8, "tue"), (9, "wed"), (10, "thu"), (11, "fri"), (13, "nationality"), (14, "parents"), (15, "email"), (17, "note")]
    marks = [cell(at, F.col(c)) for at, c in texts] + [cell(12, F.when(F.col("lunch") == 1, "yes").otherwise(""))]
    marks.append(F.struct((F.lit(26) - base).cast("long").alias("col_no"), F.concat(F.lit("Old "), "name").alias("value")))
    body = listed.select("sheet", "row_no", F.explode(F.array(*marks)).alias("c")).select("sheet", "row_no", "c.*").where("value <> ''")
    fixed = [("Age Calculator", 3, 1, "not a child")]
    for sheet in SHEETS.values():
        late, early = (0, 25) if sheet == "EL2 Daf" else (25, 0)
        fixed += [(sheet, 1, late + 1, "4 May - 1 June 2026"), (sheet, 1, early + 1, "1 April - 1 May 2026")]
        fixed += [(sheet, 2, b + i, h) for b in (0, 25) for i, h in enumerate(_HEAD)]
    ends = listed.groupBy("sheet").agg(F.max("row_no").alias("last"))
    below = ends.select("sheet", F.explode(F.array(*(F.struct((F.col("last") + i).alias("row_no"), (base + 1).cast("long").alias("col_no"), F.lit(v).alias("value")) for i, v in ((1, "123"), (2, "Total children"), (3, "Late Row"))))).alias("c")).select("sheet", "c.*")
    return body.unionByName(below).unionByName(spark.createDataFrame(fixed, _CELL))


def _column(reference: str) -> int:
    out = 0
    for c in re.match("[A-Z]+", reference).group():
        out = out * 26 + ord(c) - 64
    return out - 1


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _packed(z: zipfile.ZipFile, name: str) -> tuple[bytes, bool]:
    """A member as it lies in the file, and whether it is deflated."""
    info = z.getinfo(name)
    z.fp.seek(info.header_offset + 26)  # after the fixed part of its header: name, extra field, data
    skip = struct.unpack("<HH", z.fp.read(4))
    z.fp.seek(sum(skip), 1)
    return z.fp.read(info.compress_size), info.compress_type != zipfile.ZIP_STORED


def _rows(packed: bytes, deflated: bool, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one name of a packed XML file, one after another; what has been read is let go."""
    unpack = zlib.decompressobj(-15) if deflated else None
    parser = ElementTree.XMLPullParser(["start", "end"])
    root = None
    for at in range(0, len(packed) + 1, 1 << 16):
        part = packed[at : at + (1 << 16)]
        parser.feed(unpack.decompress(part) if unpack else part)
        for event, element in parser.read_events():
            if event == "start":
                root = element if root is None else root
            elif _tag(element) == tag:
                yield element
                element.clear()
                if tag == "row":
                    for parent in root:  # rows hang on the sheet's data
                        parent.clear() if _tag(parent) == "sheetData" else None


def workbook_sheets(content: bytes) -> list[tuple[str, int, bytes, bool | None, bytes, bool]]:
    """(sheet, number, packed rows, deflated, packed shared strings, deflated) for each sheet of a workbook, nothing unpacked.

    An older workbook (.xls) has records instead of packed rows, and no word on deflating.
    """
    if content.startswith(xls.MAGIC):
        return [(name, i, own, None, shared, False) for name, i, own, shared in xls.sheets(content)]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = _packed(z, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in names else (b"", False)
        book = [s.attrib for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _tag(s) == "sheet"]
        targets = {r.attrib["Id"]: r.attrib["Target"].lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        at = [targets[next(v for k, v in s.items() if k.endswith("}id"))] for s in book]
        return [(s["name"], i, *_packed(z, t if t.startswith("xl/") else f"xl/{t}"), *shared) for i, (s, t) in enumerate(zip(book, at))]


def cells_of(sheet: str, number: int, packed: bytes, deflated: bool | None, shared: bytes, shared_deflated: bool) -> Iterator[tuple[str, int, int, str]]:
    """The cells of one sheet as text, row by row; numbers as they are stored. Formulas give their stored results."""
    if deflated is None:
        yield from ((sheet, *cell) for cell in xls.cells(packed, shared))
        return
    strings = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in _rows(shared, shared_deflated, "si")] if shared else []
    for row in _rows(packed, deflated, "row"):
        for c in row:
            text = "".join(x.text or "" for x in c.iter() if _tag(x) in ("v", "t"))
            value = strings[int(text)] if c.attrib.get("t") == "s" and text else text
            yield sheet, int(re.search(r"\d+", c.attrib["r"]).group()) - 1, _column(c.attrib["r"]), value


def read_workbook(content: bytes) -> list[tuple[str, int, int, str]]:
    """All cells of all sheets of one workbook."""
    return [cell for sheet in workbook_sheets(content) for cell in cells_of(*sheet)]


_SHEET = "sheet string, number int, packed binary, deflated boolean, shared binary, shared_deflated boolean"


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells of all sheets of the workbooks (.xlsx or .xls) at a path, read by Spark's own reader wherever they are.

    One task opens a workbook and deals its sheets out, still packed; each sheet is then unpacked and read row by row in a task
    of its own, so that a workbook of many sheets is the work of many tasks and a large sheet is never whole in memory.
    """

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                yield pd.DataFrame(workbook_sheets(bytes(content)), columns=["sheet", "number", "packed", "deflated", "shared", "shared_deflated"])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples(index=False):
                cells = cells_of(row.sheet, row.number, bytes(row.packed), row.deflated, bytes(row.shared), row.shared_deflated)
                while part := list(islice(cells, 50_000)):
                    yield pd.DataFrame(part, columns=["sheet", "row_no", "col_no", "value"])

    sheets = spark.read.format("binaryFile").load(path).select("content").mapInPandas(deal, _SHEET)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return sheets.repartition(n, F.xxhash64("sheet", "number")).mapInPandas(read, _CELL)
