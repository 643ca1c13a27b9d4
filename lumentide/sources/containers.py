"""Tagged image files as pixel tables: directories are read first, then strips or tiles by their offsets, each by the task that has it.

So a stack of many planes, or a plane of many strips, is spread over tasks, and no file is one value. Files are opened by
`pyarrow.fs`, in the tasks; the driver lists them by Spark.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Read = Callable[[int, int], bytes]
#: Sizes and codes of a tag's types.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}
#: The tags that are read, by number.
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 262: "photometric", 270: "description", 273: "strips", 277: "samples", 278: "strip_rows", 279: "strip_bytes", 282: "x_resolution", 283: "y_resolution", 284: "planar", 296: "unit", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tiles", 325: "tile_bytes", 339: "format"}
_MICROMETRES = {2: 25_400.0, 3: 10_000.0}  # of an inch, of a centimetre


def directories(read: Read) -> Iterator[dict]:
    """The tags of each page, by name; classic and large files, of either byte order. A broken chain is an error."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(f"{order}H", head[2:4])[0] if order else None
    if kind not in (42, 43):
        raise ValueError("no tagged image file")
    large = kind == 43
    at = struct.unpack(f"{order}Q", head[8:16])[0] if large else struct.unpack(f"{order}I", head[4:8])[0]
    word, size, first = ("Q", 20, 8) if large else ("I", 12, 2)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise ValueError("pages that point at each other")
        seen.add(at)
        n = struct.unpack(f"{order}{'Q' if large else 'H'}", read(at, first))[0]
        raw = read(at + first, n * size + struct.calcsize(word))
        page: dict = {"order": order}
        for i in range(n):
            tag, what = struct.unpack(f"{order}HH", raw[i * size : i * size + 4])
            if tag not in _TAGS or what not in _TYPES:
                continue
            count = struct.unpack(f"{order}{word}", raw[i * size + 4 : i * size + 4 + struct.calcsize(word)])[0]
            code, each = _TYPES[what]
            field = raw[i * size + 4 + struct.calcsize(word) : (i + 1) * size]
            if count * each > len(field):
                field = read(struct.unpack(f"{order}{word}", field)[0], count * each)
            if what == 2:
                page[_TAGS[tag]] = field[:count].rstrip(b"\0").decode("utf-8", "replace")
            else:
                page[_TAGS[tag]] = struct.unpack(f"{order}{count * len(code)}{code[0]}", field[: count * each])
        yield page
        at = struct.unpack(f"{order}{word}", raw[n * size :])[0]


def _one(page: dict, name: str, default: int | None = None) -> int:
    if name not in page:
        if default is None:
            raise ValueError(f"a page lacks {name}")
        return default
    return page[name][0]


def pixel_sizes(page: dict) -> tuple[float | None, float | None]:
    """Micrometres of a pixel along x and y: of the resolution and its unit, else of a description's `unit` and `PhysicalSize`."""
    scale, out = _MICROMETRES.get(_one(page, "unit", 2)), []
    text = page.get("description", "")
    if "unit=micron" in text or "unit=um" in text:
        scale = 1.0
    for axis, name in (("X", "x_resolution"), ("Y", "y_resolution")):
        found = re.search(rf'PhysicalSize{axis}="([0-9.eE+-]+)"', text)
        top, bottom = page.get(name, (0, 1))[:2]
        out.append(float(found[1]) if found else scale * bottom / top if scale and top and bottom else None)
    return out[0], out[1]


def blocks_of(page: dict) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(offset, bytes, first row, first column, rows, columns, first sample) of each strip or tile."""
    width, height = _one(page, "width"), _one(page, "height")
    samples = _one(page, "samples", 1)
    planes = samples if _one(page, "planar", 1) == 2 else 1
    if "tiles" in page:
        w, h, offsets, sizes = _one(page, "tile_width"), _one(page, "tile_height"), page["tiles"], page["tile_bytes"]
    else:
        w, h, offsets, sizes = width, min(_one(page, "strip_rows", height), height), page["strips"], page["strip_bytes"]
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down * planes or len(sizes) < len(offsets):
        raise ValueError("a page has fewer strips or tiles than its size needs")
    for i in range(across * down * planes):
        plane, at = divmod(i, across * down)
        row, col = at // across * h, at % across * w
        yield offsets[i], sizes[i], row, col, h if "tiles" in page else min(h, height - row), w, plane


def _unpacked_bits(raw: bytes) -> bytes:
    """Runs of bytes: a count of n below 128 is followed by n + 1 bytes, one above by a byte that stands 257 - n times."""
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def _unpacked_words(raw: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bits first, into a table that grows by what was decoded; 256 clears it, 257 ends."""
    out, table, width, last = bytearray(), [], 9, b""
    held = bits = 0
    for byte in raw:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("packed words begin without a table")
        entry = table[code] if code < len(table) else last + last[:1]
        if code > len(table) or not entry:
            raise ValueError("packed words name an entry that isn't there")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def decoded_block(raw: bytes, page: dict, rows: int, columns: int) -> np.ndarray:
    """A strip or tile as (rows, columns, samples)."""
    how = _one(page, "compression", 1)
    if how in (8, 32946):
        raw = zlib.decompress(raw)
    elif how == 5:
        raw = _unpacked_words(raw)
    elif how == 32773:
        raw = _unpacked_bits(raw)
    elif how != 1:
        raise ValueError(f"compression {how} is not read")
    samples = 1 if _one(page, "planar", 1) == 2 else _one(page, "samples", 1)
    bits, form = page.get("bits", (1,)), _one(page, "format", 1)
    if len(set(bits)) > 1 or form not in (1, 2, 3):
        raise ValueError("samples of several sizes, or no numbers")
    if bits[0] == 1:
        line = -(-columns * samples // 8)
        a = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : columns * samples]
        return a.reshape(rows, columns, samples)
    kind = np.dtype(f"{page['order']}{'uif'[form - 1]}{bits[0] // 8}")
    a = np.frombuffer(raw, kind, rows * columns * samples).reshape(rows, columns, samples)
    if _one(page, "predictor", 1) == 2:
        a = np.cumsum(a.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    elif _one(page, "predictor", 1) != 1:
        raise ValueError("a predictor of floating point is not read")
    return a


def _opened(path: str) -> tuple[pa.NativeFile, Read]:
    store, at = fs.FileSystem.from_uri(path)
    file = store.open_input_file(at)

    def read(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    return file, read


_PAGE = "path string, image_id string, page int, width int, height int, samples int, bits int, compression int, um_x double, um_y double, description string"


def _listed(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").load(path).select("path")
    return files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:///")).withColumn("image_id", F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"\.[^.]+$", ""))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of every tagged image file below a path: their size, samples, bits, compression, micrometres of a pixel (null where untold) and description."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, read = _opened(p)
                with file:
                    rows = []
                    for i, page in enumerate(directories(read)):
                        x, y = pixel_sizes(page)
                        rows.append((p, name, i, _one(page, "width"), _one(page, "height"), _one(page, "samples", 1), _one(page, "bits", 1), _one(page, "compression", 1), x, y, page.get("description")))
                kinds = [pa.string(), pa.string(), *[pa.int32()] * 6, pa.float64(), pa.float64(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _PAGE.split(", ")])

    return _listed(spark, path).mapInArrow(run, _PAGE)


def read_tagged_images(spark: SparkSession, path: str, parallel: int | None = None) -> DataFrame:
    """The pixels of every tagged image file below a path: image_id (the stem), page, ch, row, col, v.

    Strips and tiles, plain, deflated, packed in runs of bytes or in words, of whole or floating-point numbers in either byte
    order. A task reads the strips or tiles dealt to it, not their files. Other compressions are errors.
    """
    kept = ["order", "width", "height", "bits", "compression", "samples", "planar", "predictor", "format"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, read = _opened(p)
                with file:
                    for i, page in enumerate(directories(read)):
                        found = list(blocks_of(page))
                        about = repr({k: page[k] for k in kept if k in page})
                        same = [pa.array([x] * len(found), t) for x, t in ((p, pa.string()), (name, pa.string()), (i, pa.int32()), (about, pa.string()))]
                        yield pa.RecordBatch.from_arrays([*same, *(pa.array([b[k] for b in found], pa.int64()) for k in range(7))], ["path", "image_id", "page", "about", "offset", "bytes", "row", "col", "rows", "columns", "plane"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ast import literal_eval

        for batch in batches:
            for x in batch.to_pylist():
                page = literal_eval(x["about"])
                file, read = _opened(x["path"])
                with file:
                    a = decoded_block(read(x["offset"], x["bytes"]), page, x["rows"], x["columns"])
                a = a[: _one(page, "height") - x["row"], : _one(page, "width") - x["col"]]  # tiles reach beyond the image
                row, col, ch = (i.ravel().astype(np.int32) for i in np.indices(a.shape))
                n = a.size
                yield pa.RecordBatch.from_arrays([pa.array([x["image_id"]] * n), pa.array(np.full(n, x["page"], np.int32)), pa.array(ch + np.int32(x["plane"])), pa.array(row + np.int32(x["row"])), pa.array(col + np.int32(x["col"])), pa.array(a.ravel().astype(np.float64))], ["image_id", "page", "ch", "row", "col", "v"])

    where = _listed(spark, path).mapInArrow(find, "path string, image_id string, page int, about string, offset long, bytes long, row long, col long, rows long, columns long, plane long")
    spread = where.repartition(parallel or int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "page", "offset")
    return spread.mapInArrow(load, "image_id string, page int, ch int, row int, col int, v double")
