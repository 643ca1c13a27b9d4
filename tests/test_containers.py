"""Tagged image files written here, read back bit for bit."""

import struct
import zlib

import numpy as np
import pytest

from lumentide.sources import containers as K


def packed_bytes(raw):
    out, i = bytearray(), 0
    while i < len(raw):
        n = 1
        while i + n < len(raw) and raw[i + n] == raw[i] and n < 128:
            n += 1
        out += bytes([257 - n if n > 1 else 0, raw[i]])
        i += n
    return bytes(out) + b"\x80"


def packed_words(raw):
    out = bits = 0
    pieces = []

    def put(code, width):
        nonlocal out, bits
        out, bits = (out << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            pieces.append(out >> bits)
            out &= (1 << bits) - 1

    table, width, now = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for b in raw:
        more = now + bytes([b])
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more] = len(table) + 2
        size = len(table) + 2
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        now = bytes([b])
    put(table[now], width)
    size = len(table) + 3
    put(257, 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12)
    put(0, 7)
    return bytes(pieces)


PACK = {1: bytes, 8: zlib.compress, 32773: packed_bytes, 5: packed_words}


def written(pages, order="<", large=False, compression=1, tile=None, strip=7, predictor=1, planar=1, tags=()):
    """pages: arrays (rows, columns[, samples])."""
    word, out = ("Q", bytearray(struct.pack(f"{order}HHHHQ", 0, 43, 8, 0, 16))) if large else ("I", bytearray(struct.pack(f"{order}HHI", 0, 42, 8)))
    out[:2] = b"II" if order == "<" else b"MM"
    link = 8 if large else 4
    for a in pages:
        a = a.reshape(*a.shape[:2], -1)
        h, w, s = a.shape
        kind = a.dtype.newbyteorder(order)
        planes = [a[:, :, i : i + 1] for i in range(s)] if planar == 2 else [a]
        offsets, sizes = [], []
        th, tw = tile or (strip, w)
        for p in planes:
            for r in range(0, h, th):
                for c in range(0, w, tw):
                    block = p[r : r + th, c : c + tw]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                    if predictor == 2:
                        block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                    raw = PACK[compression](block.astype(kind).tobytes())
                    offsets.append(len(out))
                    sizes.append(len(raw))
                    out += raw
        found = [(256, 3, (w,)), (257, 3, (h,)), (258, 3, (a.dtype.itemsize * 8,) * s), (259, 3, (compression,)), (262, 3, (1,)), (277, 3, (s,)), (284, 3, (planar,)), (317, 3, (predictor,)), (339, 3, ({"u": 1, "i": 2, "f": 3}[a.dtype.kind],) * s), *tags]
        found += [(322, 3, (tw,)), (323, 3, (th,)), (324, 4, tuple(offsets)), (325, 4, tuple(sizes))] if tile else [(273, 4, tuple(offsets)), (278, 3, (th,)), (279, 4, tuple(sizes))]
        fields = []
        for tag, what, values in sorted(found):
            code = {2: "s", 3: "H", 4: "I", 5: "I"}[what]
            raw = values + b"\0" if what == 2 else struct.pack(f"{order}{len(values)}{code}", *values)
            count = len(raw) if what == 2 else len(values) // (2 if what == 5 else 1)
            if len(raw) > struct.calcsize(word):
                at = len(out)
                out += raw
                raw = struct.pack(f"{order}{word}", at)
            fields.append(struct.pack(f"{order}HH{word}", tag, what, count) + raw.ljust(struct.calcsize(word), b"\0"))
        at = len(out)
        out[link : link + struct.calcsize(word)] = struct.pack(f"{order}{word}", at)
        out += struct.pack(f"{order}{'Q' if large else 'H'}", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0" * struct.calcsize(word)
    return bytes(out)


def arrays():
    r = np.random.default_rng(7)
    return {
        "plain": ([r.integers(0, 255, (33, 20)).astype("u1")], {}),
        "deflated": ([r.integers(0, 60000, (40, 31)).astype("u2") for _ in range(3)], {"compression": 8, "predictor": 2}),
        "runs": ([(r.random((25, 64)) < 0.1).astype("u1")], {"compression": 32773}),
        "words": ([r.integers(0, 4, (60, 90)).astype("u1"), r.integers(0, 255, (70, 80)).astype("u1")], {"compression": 5}),
        "tiled": ([r.integers(0, 255, (37, 45, 3)).astype("u1")], {"tile": (16, 32), "compression": 8, "order": ">"}),
        "planes": ([r.integers(-9, 9, (12, 15, 2)).astype("i2")], {"planar": 2, "large": True}),
        "large": ([r.normal(size=(20, 9)).astype("f4"), r.normal(size=(5, 5)).astype("f4")], {"large": True, "order": ">", "tile": (16, 16)}),
    }


def test_files_are_read_back_bit_for_bit(spark, tmp_path):
    made = arrays()
    for name, (pages, how) in made.items():
        (tmp_path / f"{name}.tif").write_bytes(written(pages, **how))
    got = K.read_tagged_images(spark, str(tmp_path)).toPandas()
    assert set(got.image_id) == set(made)
    for name, (pages, _) in made.items():
        for i, a in enumerate(pages):
            a = a.reshape(*a.shape[:2], -1)
            mine = got[(got.image_id == name) & (got.page == i)]
            back = np.full(a.shape, np.nan)
            back[mine.row, mine.col, mine.ch] = mine.v
            assert len(mine) == a.size and (back == a.astype(float)).all(), name
    pages = {(r.image_id, r.page): r for r in K.read_pages(spark, str(tmp_path)).collect()}
    assert len(pages) == sum(len(p) for p, _ in made.values())
    assert all((pages[n, i].height, pages[n, i].width) == a.shape[:2] and pages[n, i].um_x is None for n, (p, _) in made.items() for i, a in enumerate(p))


def test_pixel_sizes_and_broken_files(spark, tmp_path):
    a = [np.zeros((4, 4), "u1")]
    some = {
        "inch": [(282, 5, (25400, 1)), (283, 5, (12700, 1)), (296, 3, (2,))],
        "centimetre": [(282, 5, (20000, 1)), (283, 5, (20000, 1)), (296, 3, (3,))],
        "micron": [(270, 2, b"ImageJ=1.53\nunit=micron\n"), (282, 5, (5, 1)), (283, 5, (4, 1)), (296, 3, (1,))],
        "xml": [(270, 2, b'<Pixels PhysicalSizeX="0.25" PhysicalSizeY="0.5"/>')],
        "none": [(282, 5, (72, 1)), (283, 5, (72, 1)), (296, 3, (1,))],
    }
    for name, tags in some.items():
        (tmp_path / f"{name}.tiff").write_bytes(written(a, tags=tags))
    got = {r.image_id: (r.um_x, r.um_y) for r in K.read_pages(spark, str(tmp_path)).collect()}
    assert got == {"inch": (1.0, 2.0), "centimetre": (0.5, 0.5), "micron": (0.2, 0.25), "xml": (0.25, 0.5), "none": (None, None)}
    with pytest.raises(ValueError):
        list(K.directories(lambda at, n: b"PNG not tagged "[at : at + n]))
    looped = bytearray(written(a))
    looped[-4:] = looped[4:8]
    with pytest.raises(ValueError):
        list(K.directories(lambda at, n: bytes(looped[at : at + n])))
    with pytest.raises(ValueError):
        K.decoded_block(b"", {"order": "<", "compression": (7,), "bits": (8,)}, 1, 1)
