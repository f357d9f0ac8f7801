"""Cells of older workbooks: the records of each sheet, cut out of the compound file that holds them.

``sheets`` only finds where things are and cuts them out; ``cells`` reads one sheet's records, in a task of its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

#: The file's mark, record numbers, and chain ends.
MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
_BOF, _EOF, _SHEET, _SST, _CONTINUE, _LABEL_SST, _NUMBER, _RK, _MUL_RK, _FORMULA, _STRING, _LABEL, _BOOL = 0x809, 0x0A, 0x85, 0xFC, 0x3C, 0xFD, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x204, 0x205
_NO_SECTOR = 0xFFFFFFFA


def workbook_stream(content: bytes) -> bytes:
    """The workbook's stream in a compound file: its sectors follow one another by the allocation table."""
    shift, mini_shift = struct.unpack_from("<HH", content, 30)
    n_fat, first_dir = struct.unpack_from("<II", content, 44)
    cutoff, first_mini, _, next_list, _ = struct.unpack_from("<IIIII", content, 56)
    size = 1 << shift

    def sector(i: int) -> bytes:
        return content[(i + 1) << shift : (i + 2) << shift]

    listed = list(struct.unpack_from("<109I", content, 76))
    while next_list < _NO_SECTOR:  # further lists of where the allocation table lies
        more = struct.unpack(f"<{size // 4}I", sector(next_list))
        listed, next_list = listed + list(more[:-1]), more[-1]
    table = b"".join(sector(i) for i in listed[:n_fat])
    after = struct.unpack(f"<{len(table) // 4}I", table)

    def chain(i: int, follow, part) -> bytes:
        out, seen = [], 0
        while i < _NO_SECTOR and seen <= len(follow):
            out.append(part(i))
            i, seen = follow[i], seen + 1
        return b"".join(out)

    folder = chain(first_dir, after, sector)
    entries = {}
    for at in range(0, len(folder), 128):
        n, kind = struct.unpack_from("<HB", folder, at + 64)
        start, length = struct.unpack_from("<II", folder, at + 116)
        entries[5 if kind == 5 else folder[at : at + max(n - 2, 0)].decode("utf-16-le").lower()] = (start, length)
    start, length = entries["workbook"] if "workbook" in entries else entries["book"]
    if length >= cutoff:
        return chain(start, after, sector)[:length]
    small = chain(entries[5][0], after, sector)
    minis = chain(first_mini, after, sector)
    return chain(start, struct.unpack(f"<{len(minis) // 4}I", minis), lambda i: small[i << mini_shift : (i + 1) << mini_shift])[:length]


def records(stream: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(place, number, data) of records, to the end of the stream."""
    while at + 4 <= len(stream):
        number, n = struct.unpack_from("<HH", stream, at)
        yield at, number, stream[at + 4 : at + 4 + n]
        at += 4 + n


def _short(data: bytes, at: int, n: int) -> str:
    """n characters behind their flag."""
    wide = data[at] & 1
    return data[at + 1 : at + 1 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")


def sheets(content: bytes) -> list[tuple[str, int, bytes, bytes]]:
    """(sheet, number, its records, the records of the shared strings) for each sheet with cells."""
    stream = workbook_stream(content)
    places, shared, in_shared = [], [], False
    for at, number, data in records(stream):
        if number == _EOF:
            break
        in_shared = number == _SST or (in_shared and number == _CONTINUE)
        if in_shared:
            shared.append(stream[at : at + 4 + len(data)])
        if number == _SHEET and data[5] == 0:
            places.append((_short(data, 7, data[6]), struct.unpack_from("<I", data)[0]))
    out = []
    for i, (name, start) in enumerate(places):
        depth = 0
        for at, number, data in records(stream, start):
            depth += (number == _BOF) - (number == _EOF)
            if not depth:
                out.append((name, i, stream[start : at + 4 + len(data)], b"".join(shared)))
                break
    return out


def shared_strings(packed: bytes) -> list[str]:
    """All shared strings. One that goes on in another record has its flag there again."""
    parts = [data for _, _, data in records(packed)]
    if not parts:
        return []
    part, at, out = 0, 8, []
    for _ in range(struct.unpack_from("<I", parts[0], 4)[0]):
        if at >= len(parts[part]):
            part, at = part + 1, 0
        n, flags = struct.unpack_from("<HB", parts[part], at)
        at += 3
        runs, extra = 0, 0
        if flags & 8:
            runs, at = struct.unpack_from("<H", parts[part], at)[0], at + 2
        if flags & 4:
            extra, at = struct.unpack_from("<I", parts[part], at)[0], at + 4
        text = ""
        while n:
            if at >= len(parts[part]):
                part, at, flags = part + 1, 1, parts[part + 1][0]
            wide = flags & 1
            take = min(n, (len(parts[part]) - at) >> wide)
            text += parts[part][at : at + (take << wide)].decode("utf-16-le" if wide else "latin-1")
            n, at = n - take, at + (take << wide)
        out.append(text)
        skip = 4 * runs + extra
        while skip:
            if at >= len(parts[part]):
                part, at = part + 1, 0
            step = min(skip, len(parts[part]) - at)
            skip, at = skip - step, at + step
    return out


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _rk(packed: int) -> str:
    """A number in 30 bits: whole or the head of a double, and perhaps a hundredth of it."""
    value = (packed >> 2) - ((packed >> 31) << 30) if packed & 2 else struct.unpack("<d", struct.pack("<Q", (packed & ~3 & 0xFFFFFFFF) << 32))[0]
    return _number(value / 100 if packed & 1 else float(value))


def cells(packed: bytes, shared: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of one sheet's cells; numbers as they are stored, formulas by their stored results."""
    strings, waiting, depth = shared_strings(shared), None, 0
    for _, number, d in records(packed):
        depth += (number == _BOF) - (number == _EOF)
        if depth != 1 or len(d) < 4:
            continue  # a chart inside the sheet
        row, column = struct.unpack_from("<HH", d)
        if number == _LABEL_SST:
            yield row, column, strings[struct.unpack_from("<I", d, 6)[0]]
        elif number == _NUMBER:
            yield row, column, _number(struct.unpack_from("<d", d, 6)[0])
        elif number == _RK:
            yield row, column, _rk(struct.unpack_from("<I", d, 6)[0])
        elif number == _MUL_RK:
            for k in range((len(d) - 6) // 6):
                yield row, column + k, _rk(struct.unpack_from("<I", d, 6 + 6 * k)[0])
        elif number == _LABEL:
            yield row, column, _short(d, 8, struct.unpack_from("<H", d, 6)[0])
        elif number == _BOOL and not d[7]:
            yield row, column, str(d[6])
        elif number == _FORMULA:
            if d[12:14] != b"\xff\xff":
                yield row, column, _number(struct.unpack_from("<d", d, 6)[0])
            elif d[6] == 0:
                waiting = row, column
            elif d[6] == 1:
                yield row, column, str(d[8])
        elif number == _STRING and waiting:
            yield (*waiting, _short(d, 2, struct.unpack_from("<H", d)[0]))
            waiting = None
