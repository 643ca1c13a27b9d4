"""Images as pixel tables. Files come through binaryFile; each task decodes its own. NumPy, PNG, PGM/PPM and tagged image files (their first
page; see containers for the others) are read here; for others a decoder is given."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentide.sources.containers import blocks_of, decoded_block, directories

#: Pixels in one batch of rows.
PIXELS = 1 << 18


def decoded_png(raw: bytes) -> np.ndarray:
    """A PNG file of 1 to 16 bits, grey, colour or with a palette (then its colours), with or without alpha; not interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, data, palette = 8, b"", None
    width = height = bits = colour = 0
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if interlaced:
                raise ValueError("interlaced PNG files are not read")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
        at += n + 12
    samples = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    line, step = -(-width * samples * bits // 8), max(1, samples * bits // 8)
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, line + 1)
    out, above = np.zeros((height, line), np.uint8), np.zeros(line, np.int64)
    for r in range(height):
        how, x = lines[r, 0], lines[r, 1:].astype(np.int64)
        if how == 1:  # what is to the left was taken off: sums by each byte's place in a pixel
            padded = np.append(x, np.zeros(-line % step, np.int64)).reshape(-1, step)
            x = np.cumsum(padded, axis=0).ravel()[:line]
        elif how == 2:
            x = x + above
        elif how in (3, 4):
            for i in range(line):
                left, up, corner = x[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
                if how == 3:
                    x[i] = (x[i] + (left + up) // 2) & 255
                else:  # the neighbour nearest to left + up - corner
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    x[i] = (x[i] + (left if a <= b and a <= c else up if b <= c else corner)) & 255
        elif how > 4:
            raise ValueError("a PNG line with an unknown filter")
        out[r] = above = x & 255
    if bits == 16:
        a = out.view(">u2").astype(np.uint16).reshape(height, width, samples)
    elif bits == 8:
        a = out.reshape(height, width, samples)
    else:
        each = np.unpackbits(out, axis=1)[:, : width * bits].reshape(height, width, bits)
        a = (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, :, None]
    if palette is not None and colour == 3:
        return palette[a[:, :, 0]]
    return a[:, :, 0] if samples == 1 else a


def decoded(name: str, raw: bytes) -> np.ndarray:
    """The array in a .npy, .npz (labels, raw_labels or the only one), .png, tagged image (first page) or binary PGM/PPM file."""
    if name.endswith(".png"):
        return decoded_png(raw)
    if name.endswith((".tif", ".tiff")):
        page = next(directories(lambda at, n: raw[at : at + n]))
        out = None
        for offset, size, row, col, rows, columns, sample in blocks_of(page):
            a = decoded_block(raw[offset : offset + size], page, rows, columns)
            if out is None:
                out = np.zeros((page["height"][0], page["width"][0], page.get("samples", (1,))[0]), a.dtype.newbyteorder("="))
            a = a[: out.shape[0] - row, : out.shape[1] - col]
            out[row : row + a.shape[0], col : col + a.shape[1], sample : sample + a.shape[2]] = a
        return out[:, :, 0] if out.shape[2] == 1 else out
    if name.endswith(".npy"):
        return np.load(io.BytesIO(raw), allow_pickle=False)
    if name.endswith(".npz"):
        with np.load(io.BytesIO(raw), allow_pickle=False) as z:
            key = next((k for k in ("labels", "raw_labels") if k in z.files), None) or (z.files[0] if len(z.files) == 1 else None)
            if key is None:
                raise ValueError(f"{name} holds several arrays")
            return z[key]
    if m := re.match(rb"(P[56])\s+(?:#.*\s+)*(\d+)\s+(\d+)\s+(\d+)\s", raw):
        w, h, top, depth = int(m[2]), int(m[3]), int(m[4]), 3 if m[1] == b"P6" else 1
        a = np.frombuffer(raw, ">u2" if top > 255 else "u1", w * h * depth, m.end())
        return a.reshape((h, w, 3) if depth == 3 else (h, w))
    raise ValueError(f"no decoder for {name}")


def plane(a: np.ndarray, channel: int | str | None = None) -> np.ndarray:
    """One 2-D plane of a 2-D image, an HWC or a CHW one; red, green and blue are channels 0, 1, 2."""
    if a.ndim == 2:
        return a
    if a.ndim != 3:
        raise ValueError("an image has two or three dimensions")
    c = {"red": 0, "green": 1, "blue": 2}.get(channel, channel)
    if c is None:
        raise ValueError("an image of several channels needs one named")
    if a.shape[2] <= 4:
        return a[:, :, c]
    if a.shape[0] <= 4:
        return a[c]
    raise ValueError("neither the first nor the last axis looks like channels")


def _pixel_rows(name: str, stack: dict[tuple[int, int], np.ndarray], value: str) -> Iterator[pa.RecordBatch]:
    for (z, ch), p in stack.items():
        r, c = (x.ravel().astype(np.int32) for x in np.indices(p.shape))
        v = p.ravel()
        for i in range(0, len(v), PIXELS):
            j = min(len(v), i + PIXELS)
            cells = [pa.array([name] * (j - i)), pa.array(np.full(j - i, z, np.int32)), pa.array(np.full(j - i, ch, np.int32)), pa.array(r[i:j]), pa.array(c[i:j])]
            yield pa.RecordBatch.from_arrays([*cells, pa.array(v[i:j].astype(np.int32) if value == "label" else v[i:j].astype(float))], names=["image_id", "z", "ch", "row", "col", value])


def _scan(spark: SparkSession, path: str, value: str, arrays: Callable[[str, bytes], dict[tuple[int, int], np.ndarray]]) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _pixel_rows(re.sub(r"\.[^.]+$", "", p.rpartition("/")[2]), arrays(p.rpartition("/")[2].lower(), raw), value)

    return files.mapInArrow(run, f"image_id string, z int, ch int, row int, col int, {value} {'int' if value == 'label' else 'double'}")


def read_images(spark: SparkSession, path: str, channel: int | str | None = None, decode: Callable[[str, bytes], np.ndarray] = decoded) -> DataFrame:
    """One plane of every image below path: image_id (the stem), row, col, v."""
    return _scan(spark, path, "v", lambda n, raw: {(0, 0): plane(decode(n, raw), channel)}).drop("z", "ch")


def read_masks(spark: SparkSession, path: str, decode: Callable[[str, bytes], np.ndarray] = decoded) -> DataFrame:
    """Every label mask below path: image_id, row, col, label. Masks must be 2-D and non-negative integers."""

    def one(n: str, raw: bytes) -> dict[tuple[int, int], np.ndarray]:
        a = decode(n, raw)
        if a.ndim != 2 or not np.issubdtype(a.dtype, np.integer) or (a < 0).any():
            raise ValueError(f"{n} is no label mask")
        return {(0, 0): a}

    return _scan(spark, path, "label", one).drop("z", "ch")


def read_stacks(spark: SparkSession, path: str, axes: str = "ZCYX", decode: Callable[[str, bytes], np.ndarray] = decoded) -> DataFrame:
    """Every stack below path: image_id, z, ch, row, col, v; axes names the array's axes."""

    def planes(n: str, raw: bytes) -> dict[tuple[int, int], np.ndarray]:
        a = decode(n, raw)
        if a.ndim != len(axes):
            raise ValueError(f"{n} has {a.ndim} axes, not {axes}")
        a = a.reshape([*a.shape, *[1] * (4 - a.ndim)]).transpose([(axes + "".join(x for x in "ZCYX" if x not in axes)).index(x) for x in "ZCYX"])
        return {(z, c): a[z, c] for z in range(a.shape[0]) for c in range(a.shape[1])}

    return _scan(spark, path, "v", planes)


def stack_statistics(px: DataFrame, saturation: float = 4095.0) -> DataFrame:
    """For each stack and channel: shape, quantiles, maximum, shares of zero and saturated pixels."""
    q = F.percentile("v", F.array(F.lit(0.5), F.lit(0.99), F.lit(0.999)))
    share = lambda c: F.avg(c.cast("double"))
    return px.groupBy("image_id", "ch").agg((F.max("z") + 1).alias("planes"), (F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), F.get(q, F.lit(0)).alias("p50"), F.get(q, F.lit(1)).alias("p99"), F.get(q, F.lit(2)).alias("p999"), F.max("v").alias("most"), share(F.col("v") == 0).alias("zero"), share(F.col("v") >= saturation).alias("saturated"))


def same_shape(images: DataFrame, masks: DataFrame) -> None:
    """Raises if an image's mask has another shape, or none."""
    size = lambda df, n: df.groupBy("image_id").agg(F.max("row").alias(f"{n}r"), F.max("col").alias(f"{n}c"))
    bad = size(images, "a").join(size(masks, "b"), "image_id", "left").where(~(F.col("ar").eqNullSafe(F.col("br")) & F.col("ac").eqNullSafe(F.col("bc"))))
    if not bad.isEmpty():
        raise ValueError("a mask's shape differs from its image's")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The text XML of every word-processor file below path: path, xml."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xml = []
            for raw in batch.column(1).to_pylist():
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    xml.append(z.read("word/document.xml").decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(xml, pa.string())], names=["path", "xml"])

    return files.mapInArrow(run, "path string, xml string")
