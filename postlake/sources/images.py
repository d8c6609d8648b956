"""Colours of PNG images, read from their bytes in tasks.

Bit depths 1 to 16, all colour types, palettes; interlaced and broken files get
an error and no colours. Alpha is left out, as a conversion to RGB does.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Samples of one pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
COLOURS = "path string, width long, height long, r int, g int, b int, n long, error string"


def _chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(MAGIC)
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("chunk cut short")
        yield kind, body
        at += 12 + size


def _line(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """One line of bytes without its filter; ``step`` bytes make one pixel."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        # a sum along each byte of the pixel, modulo 256
        padded = np.concatenate([line, np.zeros(-len(line) % step, np.uint8)]).reshape(-1, step)
        return np.add.accumulate(padded, axis=0, dtype=np.uint8).reshape(-1)[: len(line)]
    if kind not in (3, 4):
        raise ValueError(f"filter {kind}")
    src, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for i, x in enumerate(src):
        left = out[i - step] if i >= step else 0
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            corner = up[i - step] if i >= step else 0
            near = left + up[i] - corner
            guess = min((left, up[i], corner), key=lambda v: abs(near - v))  # the first of equals
        out[i] = (x + guess) & 255
    return np.array(out, np.uint8)


def colours(raw: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Width, height, the different colours (rows r, g, b) and their pixel counts. Lines are taken one by one, so
    beyond the file's bytes memory holds its unpacked lines and the colours, at most 2**24 of them."""
    if not raw.startswith(MAGIC):
        raise ValueError("not a PNG file")
    head, palette, packed = None, None, []
    for kind, body in _chunks(raw):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or not packed:
        raise ValueError("no image data")
    width, height, depth, ctype, _, _, interlaced = head
    if interlaced or ctype not in _SAMPLES or (ctype == 3 and palette is None):
        raise ValueError("unsupported form")
    n = _SAMPLES[ctype]
    size = (width * n * depth + 7) // 8
    unpacked = zlib.decompress(b"".join(packed))
    if len(unpacked) < height * (size + 1):
        raise ValueError("image data cut short")
    above, counts = np.zeros(size, np.uint8), {}
    for y in range(height):
        at = y * (size + 1)
        above = _line(unpacked[at], np.frombuffer(unpacked, np.uint8, size, at + 1), above, max(1, n * depth // 8))
        if depth == 16:
            samples = above[::2]  # the high byte
        elif depth == 8:
            samples = above
        else:
            samples = np.packbits(np.unpackbits(above).reshape(-1, depth), axis=1)[:, 0] >> (8 - depth)
            samples = samples[: width * n]
            samples = samples if ctype == 3 else samples * (255 // (2**depth - 1))
        samples = samples.reshape(width, n)
        if ctype == 3:
            rgb = palette[samples[:, 0]]
        else:
            rgb = samples[:, :3] if n >= 3 else np.repeat(samples[:, :1], 3, axis=1)
        code = rgb.astype(np.uint32) @ np.array([65536, 256, 1], np.uint32)
        for c, k in zip(*np.unique(code, return_counts=True), strict=True):
            counts[int(c)] = counts.get(int(c), 0) + int(k)
    code = np.array(list(counts), np.int64)
    return width, height, np.stack([code >> 16, code >> 8 & 255, code & 255], axis=1), np.array(list(counts.values()), np.int64)


def png_colours(files: DataFrame) -> DataFrame:
    """Rows (path, width, height, r, g, b, n, error) of ``files`` (path, content): one row a colour with its pixel
    count, or one with null colours and an error. No file is seen by more than its own task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "width", "height", "r", "g", "b", "n", "error"]
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    w, h, rgb, n = colours(raw or b"")
                except (ValueError, IndexError, struct.error, zlib.error) as e:
                    yield pd.DataFrame([(path, None, None, None, None, None, None, str(e))], columns=names)
                    continue
                for at in range(0, len(n), 100_000):
                    part = slice(at, at + 100_000)
                    yield pd.DataFrame({"path": path, "width": w, "height": h, "r": rgb[part, 0], "g": rgb[part, 1], "b": rgb[part, 2], "n": n[part], "error": None}, columns=names)

    return files.select("path", "content").mapInPandas(run, COLOURS)


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """``png_colours`` of the .png files below ``path``."""
    return png_colours(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,PNG}").load(path))
