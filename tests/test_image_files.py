"""PNG and tagged image files as pixel tables, of every filter and depth."""

import struct
import zlib

import numpy as np
import pytest

from lumentide.sources import images
from tests.test_containers import written


def png(a, colour, bits, filters, palette=None):
    """Every line with the next of the filters."""
    a = a.reshape(*a.shape[:2], -1)
    h, w, s = a.shape
    if bits == 16:
        raw = a.astype(">u2").tobytes()
    elif bits == 8:
        raw = a.astype("u1").tobytes()
    else:
        each = ((a[:, :, 0][:, :, None] >> np.arange(bits)[::-1]) & 1).reshape(h, -1).astype("u1")
        raw = np.packbits(each, axis=1).tobytes()
    line, step = -(-w * s * bits // 8), max(1, s * bits // 8)
    out, above = b"", bytes(line)
    for r in range(h):
        x, how = raw[r * line : (r + 1) * line], filters[r % len(filters)]
        coded = bytearray()
        for i in range(line):
            left, up, corner = x[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = left + up - corner
            nearest = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            coded.append((x[i] - (0, left, up, (left + up) // 2, nearest)[how]) & 255)
        out, above = out + bytes([how]) + coded, x
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    body = zlib.compress(out)
    extra = chunk(b"PLTE", palette.astype("u1").tobytes()) if palette is not None else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + extra + chunk(b"IDAT", body[:20]) + chunk(b"IDAT", body[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_png_of_every_filter(filters):
    r = np.random.default_rng(3)
    for colour, samples in ((0, 1), (2, 3), (4, 2), (6, 4)):
        for bits in (8, 16):
            a = r.integers(0, 1 << bits, (7, 5, samples))
            assert (images.decoded("x.png", png(a, colour, bits, filters)) == (a[:, :, 0] if samples == 1 else a)).all()
    for bits in (1, 2, 4):
        a = r.integers(0, 1 << bits, (6, 11))
        assert (images.decoded("x.png", png(a, 0, bits, filters)) == a).all()
    colours, a = r.integers(0, 256, (16, 3)), r.integers(0, 16, (4, 6))
    assert (images.decoded("x.png", png(a, 3, 4, filters, colours)) == colours[a]).all()


def test_files_of_several_kinds(spark, tmp_path):
    r = np.random.default_rng(4)
    grey, three = r.integers(0, 60000, (9, 8)).astype("u2"), r.integers(0, 255, (6, 7, 3)).astype("u1")
    (tmp_path / "a.png").write_bytes(png(grey, 0, 16, [4]))
    (tmp_path / "b.tif").write_bytes(written([grey, grey * 0], compression=8, predictor=2))
    got = {}
    for x in images.read_images(spark, str(tmp_path)).collect():
        got.setdefault(x.image_id, np.zeros(grey.shape))[x.row, x.col] = x.v
    assert set(got) == {"a", "b"} and all((g == grey).all() for g in got.values())
    (tmp_path / "rgb").mkdir()
    (tmp_path / "rgb" / "c.tiff").write_bytes(written([three], tile=(16, 16), planar=2))
    (tmp_path / "rgb" / "d.png").write_bytes(png(three, 2, 8, [3]))
    for i, name in enumerate(("red", "green", "blue")):
        rows = images.read_images(spark, str(tmp_path / "rgb"), name).collect()
        assert len(rows) == 2 * 42 and all(x.v == three[x.row, x.col, i] for x in rows)
    for raw in (b"not a png", png(grey, 0, 16, [0])[:-40].replace(b"\x00\x00\x00IEND", b"")):
        with pytest.raises((ValueError, zlib.error, struct.error)):
            images.decoded("x.png", raw[:30])
