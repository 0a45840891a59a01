"""Checks of media files by their bytes: what a WAV or PNG file that is delivered must hold."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The largest file, the farthest start of samples, the largest picture (side, pixels, bytes unpacked).
MAX_BYTES, MAX_HEADER = 16 << 20, 4096
MAX_SIDE, MAX_PIXELS, MAX_UNPACKED = 16384, 8 << 20, 32 << 20
#: PCM, mono, 48 kHz, 96,000 bytes a second, 2 bytes a frame, 16 bits.
WAV_FORM = (1, 1, 48_000, 96_000, 2, 16)
PNG_MARK = b"\x89PNG\r\n\x1a\n"
#: Channels and bit depths of a picture's colour types.
COLOURS = {0: (1, (1, 2, 4, 8, 16)), 2: (3, (8, 16)), 3: (1, (1, 2, 4, 8)), 4: (2, (8, 16)), 6: (4, (8, 16))}


class Broken(Exception):
    """A file breaks the rule that it is named after."""


def must(holds: bool, rule: str) -> None:
    if not holds:
        raise Broken(rule)


def _riff(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(name, where its content starts, content) of each chunk."""
    must(data[:4] == b"RIFF" and data[8:12] == b"WAVE", "form")
    must(int.from_bytes(data[4:8], "little") == len(data) - 8, "length")
    at = 12
    while at < len(data):
        must(at + 8 <= len(data), "chunk")
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        must(at + 8 + size + size % 2 <= len(data), "chunk")
        yield data[at : at + 4], at + 8, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2


def check_wav(data: bytes) -> None:
    """One format chunk of plain PCM as in WAV_FORM, then one of whole frames; no chunk twice, nothing behind the last."""
    must(44 <= len(data) <= MAX_BYTES, "size")
    parts: dict[bytes, bytes] = {}
    for name, start, content in _riff(data):
        must(name not in parts, "repeated")
        if name == b"fmt ":
            must(len(content) == 16 and struct.unpack("<HHIIHH", content) == WAV_FORM, "format")
        if name == b"data":
            must(b"fmt " in parts, "order")
            must(start <= MAX_HEADER, "header")
            must(len(content) > 0 and len(content) % 2 == 0, "frames")
        parts[name] = content
    must(b"data" in parts, "missing")


def _png(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, content) of each chunk whose checksum is right."""
    must(data.startswith(PNG_MARK), "form")
    at = len(PNG_MARK)
    while at < len(data):
        must(at + 12 <= len(data), "chunk")
        size, name = struct.unpack(">I4s", data[at : at + 8])
        must(name.isalpha() and at + 12 + size <= len(data), "chunk")
        content = data[at + 8 : at + 8 + size]
        must(int.from_bytes(data[at + 8 + size : at + 12 + size], "big") == zlib.crc32(name + content), "checksum")
        yield name, content
        at += 12 + size


def _unpacked(header: bytes) -> tuple[int, int]:
    """Bytes of a line, with its filter, and of the whole picture."""
    must(len(header) == 13, "header")
    width, height, depth, colour, *methods = struct.unpack(">IIBBBBB", header)
    must(1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE and width * height <= MAX_PIXELS, "header")
    must(colour in COLOURS and depth in COLOURS[colour][1] and methods == [0, 0, 0], "header")
    line = 1 + (width * COLOURS[colour][0] * depth + 7) // 8
    must(line * height <= MAX_UNPACKED, "header")
    return line, line * height


def check_png(data: bytes) -> None:
    """Header first and end last; a palette, if any, before the pixels, which are one run of chunks that unpack to the picture's lines; no other chunk that matters."""
    must(45 <= len(data) <= MAX_BYTES, "size")
    chunks = list(_png(data))
    names = [n for n, _ in chunks]
    must(names[0] == b"IHDR" and names.count(b"IHDR") == 1, "header")
    line, whole = _unpacked(chunks[0][1])
    must(names[-1] == b"IEND" and names.count(b"IEND") == 1 and not chunks[-1][1], "end")
    must(all(n[0] & 0x20 or n in (b"IHDR", b"PLTE", b"IDAT", b"IEND") for n in names), "unknown")
    pixels = [k for k, n in enumerate(names) if n == b"IDAT"]
    must(bool(pixels) and pixels == list(range(pixels[0], pixels[-1] + 1)) and all(chunks[k][1] for k in pixels), "pixels")
    depth, colour = chunks[0][1][8], chunks[0][1][9]
    palettes = [k for k, n in enumerate(names) if n == b"PLTE"]
    must(len(palettes) <= 1 and all(k < pixels[0] for k in palettes) and (colour != 3 or bool(palettes)), "palette")
    for k in palettes:
        size = len(chunks[k][1])
        must(colour in (2, 3, 6) and size % 3 == 0 and 0 < size <= 3 * (2**depth if colour == 3 else 256), "palette")
    unpack = zlib.decompressobj()
    try:
        lines = unpack.decompress(b"".join(chunks[k][1] for k in pixels), whole + 1)
    except zlib.error as e:
        raise Broken("packed") from e
    must(unpack.eof and not unpack.unused_data and len(lines) == whole, "packed")
    must(max(lines[::line]) <= 4, "filter")


CHECKS = {"wav": check_wav, "png": check_png}


def media_problem(kind: str, data: bytes | None) -> str | None:
    """The rule that a file of a kind (wav, png) breaks first; null if none."""
    if kind not in CHECKS:
        return "kind"
    try:
        CHECKS[kind](data or b"")
    except Broken as e:
        return str(e)
    return None


def check_media(files: DataFrame, key: str, kind: str = "kind", content: str = "content") -> DataFrame:
    """(key, kind, bytes, problem) of every file; problem: the rule that it breaks, null if none. Null files have no bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [None if x is None else bytes(x) for x in b["content"]]
            yield pd.DataFrame({key: b[key], "kind": b["kind"], "bytes": [len(x or b"") for x in data], "problem": [media_problem(k, x) for k, x in zip(b["kind"], data, strict=True)]})

    rows = files.select(key, F.col(kind).alias("kind"), F.col(content).alias("content"))
    return rows.mapInPandas(run, f"{key} {dict(files.dtypes)[key]}, kind string, bytes long, problem string")


def png_bytes(pixels: bytes, width: int) -> bytes:
    """A grey picture of 8 bits; pixels line by line."""

    def chunk(name: bytes, content: bytes) -> bytes:
        return struct.pack(">I", len(content)) + name + content + struct.pack(">I", zlib.crc32(name + content))

    lines = b"".join(b"\x00" + pixels[i : i + width] for i in range(0, len(pixels), width))
    return PNG_MARK + chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(pixels) // width, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
