"""Older workbooks, written by hand record by record."""

import struct

import pytest

from redactory.sources import xls
from redactory.sources.sheets import read_workbook, workbook_cells


def record(number, data=b""):
    return struct.pack("<HH", number, len(data)) + data


def text16(s, wide):
    return struct.pack("<HB", len(s), wide) + s.encode("utf-16-le" if wide else "latin-1")


def compound(stream):
    """A compound file with one stream: in sectors of its own, or in the root's small ones if it is short."""
    small = len(stream) < 4096
    size = lambda n: -(-n // 512)
    n_data = size(max(len(stream), 1))
    n_fat = size(4 * (n_data + 8 + n_data // 100))
    # sectors: allocation table, directory, small allocation table, data
    first_dir, first_mini, first = n_fat, n_fat + 1, n_fat + 2
    fat = [0xFFFFFFFD] * n_fat + [0xFFFFFFFE, 0xFFFFFFFE] + [first + i + 1 for i in range(n_data - 1)] + [0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (n_fat * 128 - len(fat))
    n_mini = -(-len(stream) // 64)
    minis = ([i + 1 for i in range(n_mini - 1)] + [0xFFFFFFFE] + [0xFFFFFFFF] * 128)[:128] if small else [0xFFFFFFFF] * 128

    def entry(name, kind, start, length):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + bytes(49) + struct.pack("<II", start, length) + bytes(4)

    root = entry("Root Entry", 5, first if small else 0xFFFFFFFE, n_mini * 64 if small else 0)
    folder = root + entry("Workbook", 2, 0 if small else first, len(stream)) + bytes(256)
    header = xls.MAGIC + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<II", n_fat, first_dir) + bytes(4)
    header += struct.pack("<IIIII", 4096, first_mini if small else 0xFFFFFFFE, int(small), 0xFFFFFFFE, 0)
    header += struct.pack("<109I", *range(n_fat), *[0xFFFFFFFF] * (109 - n_fat))
    body = struct.pack(f"<{len(fat)}I", *fat) + folder + struct.pack("<128I", *minis) + stream.ljust(512 * n_data, b"\0")
    return header + body


def workbook(sheets, strings):
    """strings: records of shared strings; sheets: name -> records of cells."""
    bof = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    heads = [record(0x85, struct.pack("<IBBBB", 0, 0, 0, len(n), 0) + n.encode("latin-1")) for n in sheets]
    globals_ = bof + b"".join(heads) + strings + record(0x0A)
    at, bodies = len(globals_), []
    for n, cells in sheets.items():
        bodies.append((at, bof + cells + record(0x0A)))
        at += len(bodies[-1][1])
    heads = [record(0x85, struct.pack("<IBBBB", a, 0, 0, len(n), 0) + n.encode("latin-1")) for n, (a, _) in zip(sheets, bodies)]
    return compound(bof + b"".join(heads) + strings + record(0x0A) + b"".join(b for _, b in bodies))


def cell(number, row, column, data):
    return record(number, struct.pack("<HHH", row, column, 0) + data)


#: Two short strings, one with formatting runs, and a long one that goes on in another record with wider characters.
LONG = "x" * 20 + "é" * 10 + "ł" * 15
SST = record(0xFC, struct.pack("<II", 9, 3) + text16("Name", 0) + struct.pack("<HBH", 3, 8, 1) + b"abc" + bytes(4) + struct.pack("<HB", 45, 0) + LONG[:30].encode("latin-1")) + record(0x3C, b"\1" + LONG[30:].encode("utf-16-le"))
SHEET = (
    cell(0xFD, 0, 0, struct.pack("<I", 0)) + cell(0xFD, 0, 1, struct.pack("<I", 1)) + cell(0xFD, 300, 255, struct.pack("<I", 2)) + cell(0x203, 1, 0, struct.pack("<d", 46146.0)) + cell(0x203, 1, 1, struct.pack("<d", 1.25))
    + cell(0x27E, 2, 0, struct.pack("<I", (1234 << 2) | 3)) + cell(0x27E, 2, 1, struct.pack("<i", (-7 << 2) | 2)) + record(0xBD, struct.pack("<HHHIHIH", 3, 4, 0, (5 << 2) | 2, 0, (6 << 2) | 2, 5))
    + cell(0x204, 4, 0, text16("źle", 1)) + cell(0x205, 4, 1, b"\1\0") + cell(0x205, 4, 2, b"\x07\1") + cell(0x06, 5, 0, struct.pack("<d", 2.5) + bytes(8))
    + cell(0x06, 5, 1, b"\0" + bytes(5) + b"\xff\xff" + bytes(8)) + record(0x207, text16("made", 0)) + record(0x809, bytes(16)) + cell(0x203, 9, 9, struct.pack("<d", 1.0)) + record(0x0A)
)
WANT = [
    (0, 0, "Name"), (0, 1, "abc"), (300, 255, LONG), (1, 0, "46146"), (1, 1, "1.25"), (2, 0, "12.34"), (2, 1, "-7"), (3, 4, "5"), (3, 5, "6"), (4, 0, "źle"), (4, 1, "1"), (5, 0, "2.5"), (5, 1, "made"),
]


@pytest.mark.parametrize("filler", [0, 400, 20_000])
def test_cells_of_an_older_workbook(filler):
    """In small sectors, and in so many large ones that the allocation table takes several."""
    more = b"".join(cell(0x203, i, 0, struct.pack("<d", i)) for i in range(filler))
    got = read_workbook(workbook({"One": SHEET, "Empty": b"", "More": more}, SST))
    assert got == [("One", *c) for c in WANT] + [("More", i, 0, str(i)) for i in range(filler)]


def test_older_and_newer_workbooks_together(spark, tmp_path):
    from test_views import workbook as newer

    (tmp_path / "a.xls").write_bytes(workbook({"One": SHEET}, SST))
    (tmp_path / "b.xlsx").write_bytes(newer({"S": {1: {"A": "one"}}}))
    got = {tuple(r) for r in workbook_cells(spark, str(tmp_path)).collect()}
    assert got == {("One", *c) for c in WANT} | {("S", 0, 0, "one")}
