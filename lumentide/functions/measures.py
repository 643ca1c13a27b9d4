"""Column functions of measurement tables: guarded ratios, shape measures, labels, bins."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """The value, or null for NaN and infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_div(n: Column, d: Column) -> Column:
    """n / d where d is a positive finite number, else null."""
    return F.when(finite(d) > 0, n / d)


def nonzero_div(n: Column, d: Column) -> Column:
    """n / d where d isn't zero, else null; negative divisors are allowed."""
    return F.when(d != 0, n / d)


def log2_ratio(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.log2(a / b))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q / (1 - q))


def circularity(area: Column, perimeter: Column) -> Column:
    return safe_div(4 * math.pi * area, perimeter * perimeter)


def transformed(x: Column, how: str) -> Column:
    """identity, log1p (x >= 0) or log (x > 0); null outside."""
    return {"identity": x, "log1p": F.when(x >= 0, F.log1p(x)), "log": F.when(x > 0, F.log(x))}[how]


def equal_width_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Right-closed bin 1 to n of [lo, hi], the least value in the first."""
    return F.least(F.greatest(F.ceil((v - lo) / ((hi - lo) / n)), F.lit(1)), F.lit(n)).cast("int")


def three_way(p: Column, low: float = 0.90, high: float = 0.995) -> Column:
    return F.when(p >= high, "cluster2").when(p <= low, "cluster1").otherwise("uncertain")


def deviation_score(p: Column, low: float = 0.90, high: float = 0.995) -> Column:
    """Piecewise linear: 0 to .5 up to low, .5 to .84 between, .84 to 1 from high on."""
    return F.when(p <= low, 0.5 * p / low).when(p < high, 0.5 + 0.34 * (p - low) / (high - low)).otherwise(0.84 + 0.16 * (p - high) / (1 - high))


def to_uint8(v: Column, lo: Column, hi: Column, even: bool = True, offset: float = 0.0, floor: float = 1e-6) -> Column:
    """Stretches lo..hi to 0..255, rounded half to even or cut."""
    x = F.least(F.greatest((v - lo) / F.greatest(hi - lo + offset, F.lit(floor)), F.lit(0.0)), F.lit(1.0)) * 255
    return (F.rint(x) if even else F.floor(x)).cast("int")


def aspect(major: Column, minor: Column) -> Column:
    return safe_div(major, minor)


def box_aspect(height: Column, width: Column) -> Column:
    """Longer side over shorter side."""
    return safe_div(F.greatest(height, width).cast("double"), F.least(height, width))


def positive_ratio(a: Column, b: Column) -> Column:
    """a / b where both are positive, else null."""
    return F.when((a > 0) & (b > 0), a / b)


def stretched(v: Column, lo: Column, hi: Column, least: Column, most: Column, gamma: float = 1.0) -> Column:
    """v stretched from lo..hi (reference quantiles) to 0..1 and raised to gamma; where these coincide, from least..most; else 0.5."""
    unit = lambda a, b: F.pow(F.least(F.greatest((v - a) / F.nullif(b - a, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), gamma)
    return F.when(lo.isNull(), F.lit(0.5)).when(hi > lo + 1e-12, unit(lo, hi)).when(most > least + 1e-12, unit(least, most)).otherwise(F.lit(0.5))


def state_label(dev: Column, undiff: Column, morph: Column, full_dev: float = 0.80, full_undiff: float = 0.65, rescue: tuple[float, float, float] = (0.62, 0.08, 0.52)) -> Column:
    """deviated, undifferentiated or uncertain from two probabilities; a third rescues clear cases of the first."""
    saved = (dev >= rescue[0]) & (dev - undiff >= rescue[1]) & F.coalesce(finite(morph) >= rescue[2], F.lit(False))
    return F.when(dev >= full_dev, "deviated").when(undiff >= full_undiff, "undifferentiated").when(saved, "deviated").otherwise("uncertain")


def edge_veto(before: Column, edge: Column, dev: Column, undiff: Column, morph: Column, keep: tuple[float, float] = (0.80, 0.52), promote: tuple[float, float] = (0.72, 0.40), downgrade: tuple[float, float] = (0.74, 0.35)) -> tuple[Column, Column]:
    """Label and reason of rows at the edge: a deviated one stays only with strong support by both models."""
    held = (dev >= keep[0]) & (morph >= keep[1])
    turned = (undiff >= promote[0]) & (morph <= promote[1])
    dense = (dev <= downgrade[0]) & (morph <= downgrade[1])
    red = before == "deviated"
    after = F.when(~edge, before).when(red & held, "deviated").when(red & turned, "undifferentiated").when(red, "uncertain").when(before == "undifferentiated", before).otherwise("uncertain")
    why = F.when(~edge, "unchanged").when(red & held, "edge_red_kept_dual_strong").when(red & turned, "edge_red_relabel_undiff_dual_support").when(red & dense, "edge_red_downgraded_density_like").when(red, "edge_red_downgraded_intermediate")
    return after, why.when(before == "undifferentiated", "edge_green_kept").otherwise("edge_uncertain_kept")


def mapped(c: Column, names: dict[str, str], other: str | None = None) -> Column:
    """A vocabulary map; what it lacks becomes `other` (null)."""
    out = F.lit(other)
    for a, b in names.items():
        out = F.when(c == a, b).otherwise(out)
    return out


def ramp(t: Column, colours: list[tuple[int, int, int]]) -> Column:
    """Red, green and blue of a two-segment linear ramp at t in 0..1."""
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    part = lambda i: F.when(t <= 0.5, colours[0][i] + (colours[1][i] - colours[0][i]) * 2 * t).otherwise(colours[1][i] + (colours[2][i] - colours[1][i]) * (2 * t - 1))
    return F.array(*(F.round(part(i)).cast("int") for i in range(3)))


def histogram_bin(v: Column, bins: int = 16) -> Column:
    """Bin 0 to bins - 1 of a value in 0..1, the last one closed."""
    return F.least(F.floor(v * bins), F.lit(bins - 1)).cast("int")


def stem_key(c: Column, suffixes: tuple[str, ...] = ("_mask", "_cp_masks", "_seg", "_labels")) -> Column:
    """A file's stem without folders, extension and (repeated) suffixes, lower-cased, other signs as single spaces."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(c), r"^.*[/\\]", ""), r"\.[a-z0-9]+$", "")
    stem = F.regexp_replace(stem, "(" + "|".join(suffixes) + ")+$", "")
    return F.trim(F.regexp_replace(stem, r"[^a-z0-9]+", " "))


def cell_id(image: Column, label: Column) -> Column:
    return F.format_string("%s__cell_%05d", image, label)


def integer_key(c: Column) -> Column:
    """`12.0`, ` 12` and `12` as 12; other text as it is, trimmed."""
    t = F.trim(c.cast("string"))
    return F.when(t.rlike(r"^[0-9]+(\.0+)?$"), F.regexp_replace(F.regexp_replace(t, r"\.0+$", ""), r"^0+(?=[0-9])", "")).otherwise(t)


def pixel_size_um(text: Column, unit: Column, resolution: Column, manual: Column) -> Column:
    """Micrometres a pixel: from the text, else from a resolution tag (pixels per inch or cm), else by hand; null if none."""
    named = F.nullif(F.regexp_extract(text, r"PhysicalSizeX=\"([0-9.]+)\"", 1), F.lit("")).cast("double")
    tagged = F.when((unit == 2) & (resolution > 0), 25400 / F.nullif(resolution, F.lit(0.0))).when((unit == 3) & (resolution > 0), 10000 / F.nullif(resolution, F.lit(0.0)))
    return F.coalesce(named, tagged, manual)


def in_micrometres(df: DataFrame, um: Column, keep: bool = False) -> DataFrame:
    """Columns in pixels (`_px`), square (`_px2`) or cubic pixels (`_px3`) as `_um`, `_um2` and `_um3`; null where the pixel's size is
    not known or not above 0. A converted column replaces one that has its name already."""
    powers = {c: int(c.rpartition("_px")[2] or 1) for c in df.columns if re.search("_px[23]?$", c)}
    known = F.when(um > 0, um)
    made = {re.sub("_px([23]?)$", r"_um\1", c): F.col(c) * F.pow(known, F.lit(p)) for c, p in powers.items()}
    return df.withColumns(made).drop(*([] if keep else powers))


def suffix_number(c: Column) -> Column:
    """The number at a name's end, for sorting `P 2` before `P 10`; null if none."""
    return F.nullif(F.regexp_extract(c, r"([0-9]+)$", 1), F.lit("")).cast("long")


def place_in(c: Column, order: list[str]) -> Column:
    """The place of a category in a fixed order, from 1; others come last."""
    at = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def stage_code(c: Column) -> tuple[Column, Column]:
    """Day and regimen of a code as D43D: the digits after the first D."""
    return F.regexp_extract(c, r"^D([0-9])([0-9])D$", 1).try_cast("int"), F.regexp_extract(c, r"^D([0-9])([0-9])D$", 2).try_cast("int")
