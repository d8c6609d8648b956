"""Colours of PNG bytes against the pixels they were written from."""

import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from postlake.operators import media
from postlake.sources import images


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(kind, line, above, step):
    out = bytearray()
    for i, x in enumerate(line):
        a, b, c = (line[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
        p = a + b - c
        near = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
        out.append((x - (0, a, b, (a + b) // 2, near)[kind]) & 255)
    return bytes(out)


def png(width, height, lines, depth, ctype, step, kinds=(0,), palette=None, interlaced=0):
    data, above = b"", bytes(len(lines[0]))
    for y, line in enumerate(lines):
        kind = kinds[y % len(kinds)]
        data += bytes([kind]) + filtered(kind, line, above, step)
        above = line
    packed = zlib.compress(data)
    half = len(packed) // 2
    body = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, ctype, 0, 0, interlaced))
    if palette is not None:
        body += chunk(b"PLTE", palette)
    return images.MAGIC + body + chunk(b"IDAT", packed[:half]) + chunk(b"IDAT", packed[half:]) + chunk(b"IEND", b"")


def rgb_png(pixels, kinds=(0, 1, 2, 3, 4)):
    h, w, n = pixels.shape
    return png(w, h, [bytes(r.tobytes()) for r in pixels], 8, 2 if n == 3 else 6, n, kinds)


def counted(raw):
    w, h, rgb, n = images.colours(raw)
    return (w, h), Counter({tuple(map(int, c)): int(k) for c, k in zip(rgb, n, strict=True)})


@pytest.mark.parametrize("samples", [3, 4])
def test_all_filters(samples):
    rng = np.random.default_rng(samples)
    px = rng.integers(0, 256, (11, 7, samples), dtype=np.uint8)
    for kinds in [(0,), (1,), (2,), (3,), (4,), (4, 3, 2, 1, 0)]:
        size, found = counted(rgb_png(px, kinds))
        assert size == (7, 11) and found == Counter(tuple(map(int, p[:3])) for p in px.reshape(-1, samples))


@pytest.mark.parametrize("depth", [1, 2, 4, 8])
@pytest.mark.parametrize("paletted", [False, True])
def test_packed_samples(depth, paletted):
    rng = np.random.default_rng(depth)
    px = rng.integers(0, 2**depth, (5, 9), dtype=np.uint8)
    bits = lambda r: "".join(f"{v:0{depth}b}" for v in r)
    lines = [int(bits(r).ljust(-(-9 * depth // 8) * 8, "0"), 2).to_bytes(-(-9 * depth // 8), "big") for r in px]
    palette = bytes(rng.integers(0, 256, 3 * 2**depth, dtype=np.uint8)) if paletted else None
    _, found = counted(png(9, 5, lines, depth, 3 if paletted else 0, 1, (0, 4), palette))
    colour = (lambda v: tuple(palette[3 * v : 3 * v + 3])) if paletted else (lambda v: (v * 255 // (2**depth - 1),) * 3)
    assert found == Counter(colour(int(v)) for v in px.reshape(-1))


def test_sixteen_bits_take_the_high_byte():
    line = bytes([10, 99, 20, 1, 30, 2])
    assert counted(png(1, 1, [line], 16, 2, 6))[1] == Counter({(10, 20, 30): 1})


def test_broken_files():
    good = rgb_png(np.zeros((2, 2, 3), np.uint8))
    for raw in [b"", b"GIF89a", good[:30], good[:-30], png(1, 1, [b"\0"], 8, 3, 1), png(1, 1, [b"\0\0\0"], 8, 2, 3, interlaced=1), png(1, 1, [b"\0\0\0"], 8, 2, 3, kinds=(0,)).replace(b"IDAT", b"XXXX")]:
        with pytest.raises((ValueError, zlib.error, struct.error, IndexError)):
            images.colours(raw)


def screen(colour, share, rest=(200, 200, 200)):
    px = np.full((20, 20, 3), rest, np.uint8)
    px.reshape(-1, 3)[: round(400 * share)] = colour
    return px


@pytest.fixture
def folder(tmp_path):
    shots = {"purple.png": screen((95, 37, 159), 0.05), "blue.PNG": screen((0, 185, 245), 0.1), "few.png": screen((95, 37, 159), 0.03), "dark.png": screen((10, 10, 10), 1.0)}
    (tmp_path / "deep").mkdir()
    for name, px in shots.items():
        (tmp_path / "deep" / name).write_bytes(rgb_png(px))
    (tmp_path / "broken.png").write_bytes(b"\x89PNG\r\n\x1a\nnothing")
    (tmp_path / "note.txt").write_text("The export is great")
    return tmp_path, shots


def test_signature_equals_that_of_known_pixels(spark, folder):
    path, shots = folder
    read = images.read_png(spark, str(path))
    assert [r.path.rsplit("/", 1)[1] for r in read.where("error IS NOT NULL").collect()] == ["broken.png"]
    got = {r.path.rsplit("/", 1)[1]: tuple(r)[1:] for r in media.pixel_signature(read.where("error IS NULL"), "path", "n").collect()}
    pixels = spark.createDataFrame([(k, *map(int, p)) for k, px in shots.items() for p in px.reshape(-1, 3)], "path string, r int, g int, b int")
    want = {r.path: tuple(r)[1:] for r in media.pixel_signature(pixels, "path").collect()}
    assert got == want
    assert want["purple.png"][3].startswith("PhonePe") and want["blue.PNG"][3].startswith("Paytm") and want["few.png"][3] is None and want["dark.png"][1]


def test_analysis_sees_payment_screens(spark, folder):
    path, _ = folder
    shown = {r.path.rsplit("/", 1)[-1]: r for r in media.analyze_files(spark, str(path), media.png_visual(spark, str(path))).collect()}
    plain = {r.path.rsplit("/", 1)[-1]: r for r in media.analyze_files(spark, str(path)).collect()}
    assert len(shown) == 6 and shown["note.txt"] == plain["note.txt"] and shown["broken.png"].tags == plain["broken.png"].tags
    differ = {k for k in shown if (shown[k].category, shown[k].tags) != (plain[k].category, plain[k].tags)}
    assert differ == {"purple.png", "blue.PNG"}
