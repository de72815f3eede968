"""Whether a file's inside is whole: PNG chunks and pixels, JPEG segments, the PDF's cross-reference."""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT, DAMAGED, NO_PIXELS = "the image is cut off", "the image is damaged", "the image has no pixels"
NO_END, NO_INDEX, BAD_INDEX = "the PDF has no end mark", "the PDF has no cross-reference", "the PDF's cross-reference is wrong"
STEP = 1 << 20
# Samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_fault(b: bytes) -> str | None:
    """Chunks one after the other, each with its checksum; the pixels unpack to the size that the header tells."""
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        return DAMAGED
    at, view, pixels, unpacked, header = 8, memoryview(b), zlib.decompressobj(), 0, None
    while at + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + size > len(b):
            return CUT
        data = view[at + 8 : at + 8 + size]
        if zlib.crc32(view[at + 4 : at + 8 + size]) != struct.unpack_from(">I", b, at + 8 + size)[0] or (header is None) != (kind == b"IHDR"):
            return DAMAGED
        if kind == b"IHDR":
            if size != 13:
                return DAMAGED
            header = struct.unpack(">IIBBBBB", data)
        if kind == b"IDAT":
            try:
                while data and not pixels.eof:
                    unpacked += len(pixels.decompress(data, STEP))
                    data = pixels.unconsumed_tail
            except zlib.error:
                return DAMAGED
        if kind == b"IEND":
            break
        at += 12 + size
    else:
        return CUT
    wide, high, bits, colour, _, _, laced = header
    whole = high * (1 + (wide * bits * SAMPLES.get(colour, 0) + 7) // 8)
    if unpacked == 0:
        return NO_PIXELS
    return None if pixels.eof and (laced or unpacked == whole) else DAMAGED


def jpeg_fault(b: bytes) -> str | None:
    """Segments one after the other up to the end mark, a frame before the first scan, restart marks in order. Pixels
    are not decoded: a scan without restart marks may have been altered."""
    if b[:2] != b"\xff\xd8":
        return DAMAGED
    at, framed, scanned = 2, False, False
    while at + 2 <= len(b):
        if b[at] != 0xFF:
            return DAMAGED
        mark, at = b[at + 1], at + (1 if b[at + 1] == 0xFF else 2)
        if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD7:
            continue
        if mark == 0xD9:
            return None if scanned else NO_PIXELS
        if at + 2 > len(b):
            return CUT
        size = struct.unpack_from(">H", b, at)[0]
        if size < 2:
            return DAMAGED
        if at + size > len(b):
            return CUT
        framed = framed or (0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC))
        at += size
        if mark == 0xDA:
            end = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]").search(b, at)
            if not framed:
                return DAMAGED
            if not end:
                return CUT
            turns = re.compile(rb"\xff([\xd0-\xd7])").finditer(b, at, end.start())
            if any(m.group(1)[0] != 0xD0 + i % 8 for i, m in enumerate(turns)):
                return DAMAGED
            at, scanned = end.start(), True
    return CUT


def pdf_fault(b: bytes) -> str | None:
    """From the last startxref through every earlier section: tables must point at the objects they name. Entries of
    packed tables (cross-reference streams) are not read, only that their object is there."""
    start = b.find(b"%PDF-", 0, 1024)
    if start < 0:
        return NO_INDEX
    if b.rfind(b"%%EOF") < len(b) - 2048 or b"%%EOF" not in b:
        return NO_END
    last = b.rfind(b"startxref")
    told = re.compile(rb"startxref\s+(\d+)").match(b, last) if last >= 0 else None
    if not told:
        return NO_INDEX
    if b.find(b"%%EOF", told.end()) < 0:
        return NO_END
    at, seen = int(told.group(1)), set()
    while at not in seen:
        seen.add(at)
        here = at + start
        if b[here : here + 4] == b"xref":
            rest = _table(b, here + 4, start)
        else:
            packed = re.compile(rb"\d+\s+\d+\s+obj\b").match(b, here)
            rest = packed.end() if packed else None
        if rest is None:
            return BAD_INDEX
        ends = [e for e in (b.find(b"startxref", rest), b.find(b"stream", rest)) if e >= 0]
        before = re.compile(rb"/Prev\s+(\d+)").search(b, rest, min(ends, default=len(b)))
        if before:
            at = int(before.group(1))
    return None


def _table(b: bytes, at: int, start: int) -> int | None:
    """Where the sections of a cross-reference table end, or None if one of them points wrong."""
    section, entry = re.compile(rb"\s*(\d+)\s+(\d+)\s*"), re.compile(rb"(\d{10}) (\d{5}) ([nf])\s{0,2}")
    while head := section.match(b, at):
        first, at = int(head.group(1)), head.end()
        for i in range(int(head.group(2))):
            row = entry.match(b, at)
            if not row:
                return None
            at = row.end()
            if row.group(3) == b"n" and not re.compile(rb"\s*%d\s+%d\s+obj\b" % (first + i, int(row.group(2)))).match(b, int(row.group(1)) + start):
                return None
    return at


FAULTS = {"png": png_fault, "jpg": jpeg_fault, "jpeg": jpeg_fault, "pdf": pdf_fault}


@F.pandas_udf(T.StringType())
def _fault(content: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([FAULTS[k](bytes(b)) if b is not None and k in FAULTS else None for b, k in zip(content, kind)], dtype=object)


def fault(content: Column, kind: Column) -> Column:
    """What is wrong inside a file, or null; null too for types that are not looked into and for null contents. Batches
    go to Python by bytes (spark.sql.execution.arrow.maxBytesPerBatch), so large files go few at a time."""
    return F.when(F.length(content) == 0, "the file is empty").when(kind.isin(*FAULTS), _fault(content, kind))
