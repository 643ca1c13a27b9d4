"""Queries of label images, with their twins in DuckDB SQL. Each supplier is a disc in a block of 16 x 16 pixels: its nation
says how large, its balance how bright. So the image is as high as the table is long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentide.functions.cubes import CORNERS, cube_areas
from lumentide.operators import raster as X
from lumentide.operators import tiles as T
from lumentide.plans.catalogue import query

#: Pixels of a block's side, and blocks beside each other.
_BLOCK, _ACROSS = 16, 4
_WIDTH = _BLOCK * _ACROSS
#: Suppliers whose pixels a task makes.
_A_TASK = 500
_BASE = f"SELECT s_suppkey AS k, s_nationkey AS nation, CAST(floor(abs(s_acctbal)) AS BIGINT) % 5 AS more, CAST(s_suppkey // {_ACROSS} * {_BLOCK} + i // {_BLOCK} AS INTEGER) AS row, CAST(s_suppkey % {_ACROSS} * {_BLOCK} + i % {_BLOCK} AS INTEGER) AS col FROM supplier, (SELECT range AS i FROM range({_BLOCK * _BLOCK}))"
_DISC = "power(row % 16 - CASE WHEN row < 16 AND col < 16 THEN 2 ELSE 8 END, 2) + power(col % 16 - 8, 2)"
_IMG = f"SELECT 'f' AS image_id, row, col, CAST(CASE WHEN {_DISC} <= power(3 + nation % 3, 2) THEN k + 1 ELSE 0 END AS INTEGER) AS label, CAST((row * 7 + col * 13) % 50 + more + CASE WHEN {_DISC} <= power(3 + nation % 3, 2) THEN 100 ELSE 20 END AS DOUBLE) AS v, CAST((row * 3 + col) % 17 AS DOUBLE) AS v2 FROM ({_BASE})"


def _blocks(t: DataFrame) -> DataFrame:
    """Each supplier's pixels: k, nation, more, row, col and the squared distance from its disc's middle."""
    t = t.repartition(max(1, -(-t.count() // _A_TASK)), "s_suppkey")  # else the tasks are as few as the small table's files
    t = t.select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), (F.floor(F.abs("s_acctbal")) % 5).alias("more"), F.explode(F.sequence(F.lit(0), F.lit(_BLOCK * _BLOCK - 1))).alias("i"))
    row, col = F.expr(f"k div {_ACROSS} * {_BLOCK} + i div {_BLOCK}").cast("int"), (F.col("k") % _ACROSS * _BLOCK + F.col("i") % _BLOCK).cast("int")
    t = t.select("k", "nation", "more", row.alias("row"), col.alias("col"))
    middle = F.when((F.col("row") < _BLOCK) & (F.col("col") < _BLOCK), 2).otherwise(8)
    return t.withColumn("disc", F.pow(F.col("row") % _BLOCK - middle, 2) + F.pow(F.col("col") % _BLOCK - 8, 2))


def _height(t: DataFrame) -> int:
    return (t.agg(F.max("s_suppkey")).first()[0] // _ACROSS + 1) * _BLOCK


def _image(t: DataFrame) -> DataFrame:
    row, col = F.col("row"), F.col("col")
    inside = F.col("disc") <= F.pow(3 + F.col("nation") % 3, 2)
    v = (row * 7 + col * 13) % 50 + F.col("more") + F.when(inside, 100).otherwise(20)
    return _blocks(t).select(F.lit("f").alias("image_id"), "row", "col", F.when(inside, F.col("k") + 1).otherwise(0).cast("int").alias("label"), v.cast("double").alias("v"), ((row * 3 + col) % 17).cast("double").alias("v2"))


_BORDER = "b AS (SELECT p.* FROM p WHERE label > 0 AND (SELECT count(*) FROM p q WHERE q.label = p.label AND abs(q.row - p.row) + abs(q.col - p.col) = 1) < 4)"


@query(f"WITH p AS ({_IMG}), {_BORDER}, n AS (SELECT label, 1 + 2 * (SELECT count(*) FROM b q WHERE q.label = b.label AND abs(q.row - b.row) + abs(q.col - b.col) = 1) + 10 * (SELECT count(*) FROM b q WHERE q.label = b.label AND abs(q.row - b.row) = 1 AND abs(q.col - b.col) = 1) AS c FROM b), w AS (SELECT label, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM n GROUP BY 1), g AS (SELECT label, count(*) AS area, avg(row) AS cr, avg(col) AS cc, var_pop(row) + 1 / 12 AS a, var_pop(col) + 1 / 12 AS c, covar_pop(row, col) AS b, avg(v) AS mean, stddev_pop(v) AS sd, min(v) AS least, max(v) AS most FROM p WHERE label > 0 GROUP BY 1), e AS (SELECT *, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS big, (a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b) AS small FROM g) SELECT label, area, round(cr, 6) AS centroid_row, round(cc, 6) AS centroid_col, round(4 * sqrt(big), 6) AS major, round(4 * sqrt(small), 6) AS minor, round(sqrt(greatest(1 - small / big, 0)), 5) AS eccentricity, round(perimeter, 6) AS perimeter, round(sqrt(4 * area / pi()), 6) AS diameter, round(4 * pi() * area / power(perimeter, 2), 6) AS circularity, round(mean, 6) AS mean, round(sd, 6) AS sd FROM e JOIN w USING (label)", "supplier")
def shape_properties(t):
    s = X.shape_properties(_image(t))
    return s.select("label", "area", "centroid_row", "centroid_col", "major", "minor", F.round("eccentricity", 5).alias("eccentricity"), "perimeter", "diameter", "circularity", "mean", "sd")


@query(None, "supplier")
def solidity(t):
    return X.shape_properties(_image(t)).select("label", "area", "hull_area", "solidity")


_CORNERS = ", ".join(str((*c, 1 << i)) for i, c in enumerate(CORNERS))
_AREAS = ", ".join(f"({i}, {a!r}::double)" for i, a in enumerate(cube_areas(0.5, 0.2, 0.2)))
_VOX = f"SELECT 'f' AS image_id, z, row, col, CAST(CASE WHEN {_DISC} + 2 * power(z - 4, 2) <= power(3 + nation % 3, 2) THEN k + 1 ELSE 0 END AS INTEGER) AS label, CAST((row + col + z) % 11 AS DOUBLE) AS v FROM ({_BASE}), (SELECT CAST(range AS INTEGER) AS z FROM range(9))"


def _voxels(t: DataFrame) -> DataFrame:
    d = _blocks(t).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(8))))
    label = F.when(F.col("disc") + 2 * F.pow(F.col("z") - 4, 2) <= F.pow(3 + F.col("nation") % 3, 2), F.col("k") + 1).otherwise(0)
    return d.select(F.lit("f").alias("image_id"), "z", "row", "col", label.cast("int").alias("label"), ((F.col("row") + F.col("col") + F.col("z")) % 11).cast("double").alias("v"))


@query(f"WITH x AS (SELECT * FROM ({_VOX}) WHERE label > 0), s AS (SELECT label, max(n) AS s FROM (SELECT label, z, count(*) AS n FROM x GROUP BY ALL) GROUP BY 1), u AS (SELECT label, z - b.cz AS z, row - b.cr AS r, col - b.cc AS c, sum(bit) AS code FROM x, (VALUES {_CORNERS}) b(cz, cr, cc, bit) GROUP BY ALL), f AS (SELECT label, sum(area) AS surface FROM u JOIN (VALUES {_AREAS}) a(code, area) USING (code) GROUP BY 1), g AS (SELECT label, count(*) AS n, max(z) - min(z) + 1 AS h, covar_samp(z * 0.5, z * 0.5) + covar_samp(row * 0.2, row * 0.2) + covar_samp(col * 0.2, col * 0.2) AS trace FROM x GROUP BY 1) SELECT label, round(n * 2e-2, 6) AS volume, round(h * 5e-1, 6) AS height, round(s * 4e-2, 6) AS max_section, round(n * 2e-2 / (s * 4e-2), 6) AS thickness, round(surface, 6) AS surface, round(16 * trace, 6) AS trace, round(cbrt(6 * n * 2e-2 / pi()), 6) AS sphere_diameter FROM g JOIN s USING (label) JOIN f USING (label)", "supplier")
def solid_properties(t):
    s = X.solid_properties(_voxels(t), (0.5, 0.2, 0.2))
    trace = F.pow("axis_1", 2) + F.pow("axis_2", 2) + F.pow("axis_3", 2)  # of the covariance, times 16
    return s.select("label", "volume", "height", "max_section", "thickness", "surface", trace.alias("trace"), "sphere_diameter")


@query(f"WITH x AS (SELECT * FROM ({_VOX}) WHERE label > 0), n AS (SELECT label, z, count(*) AS area, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, z) AS k FROM x GROUP BY label, z) SELECT label, z, area, (SELECT count(*) FROM (SELECT DISTINCT row, col FROM x WHERE x.label = n.label)) AS projection FROM n WHERE k = 1", "supplier")
def sections(t):
    return X.sections(_voxels(t)).select("label", "z", "area", "projection")


@query(f"WITH p AS ({_IMG}), e AS (SELECT DISTINCT label FROM p WHERE row IN (0, (SELECT max(row) FROM p)) OR col IN (0, 63)) SELECT label, count(*) AS n FROM p WHERE label NOT IN (SELECT label FROM e) GROUP BY 1", "supplier")
def border_removed(t):
    return X.without_border(_image(t), _height(t), _WIDTH).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH x AS ({_VOX}), e AS (SELECT DISTINCT label FROM x WHERE z IN (0, 8) OR row IN (0, (SELECT max(row) FROM x)) OR col IN (0, 63)) SELECT label, count(*) AS n FROM x WHERE label NOT IN (SELECT label FROM e) GROUP BY 1", "supplier")
def faces_removed(t):
    return X.without_faces(_voxels(t), 9, _height(t), _WIDTH).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({_IMG}), a AS (SELECT label, count(*) * 0.25 AS um2 FROM p WHERE label > 0 GROUP BY 1 HAVING count(*) * 0.25 BETWEEN 8 AND 15) SELECT count(*) AS n, round(median(um2), 6) AS median, round(quantile_cont(um2, 0.25), 6) AS q25, round(quantile_cont(um2, 0.75), 6) AS q75 FROM a", "supplier")
def area_filter(t):
    return X.area_filter(_image(t), 0.5, 8, 15)[1].drop("image_id")


_NEAREST = "d AS (SELECT p.row, p.col, min(CAST(dr * dr + dc * dc AS BIGINT) * 1000000 + q.label) AS m FROM (SELECT q.*, dr, dc FROM p q, range(-{far}, {far} + 1) a(dr), range(-{far}, {far} + 1) b(dc) WHERE q.label > 0 AND dr * dr + dc * dc <= {far} * {far}) q JOIN p ON p.row = q.row + dr AND p.col = q.col + dc WHERE p.label = 0 GROUP BY ALL)"


@query(f"WITH p AS ({_IMG}), {_NEAREST.format(far=4)} SELECT row, col, CAST(m % 1000000 AS INTEGER) AS label FROM d WHERE m // 1000000 > 1", "supplier")
def ring_labels(t):
    return X.ring_labels(_image(t), 4, 1).select("row", "col", "label")


@query(f"WITH p AS ({_IMG}), {_NEAREST.format(far=5)}, f AS (SELECT v FROM p WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.row = p.row AND d.col = p.col)), m AS (SELECT count(*) AS n, median(v) AS bg FROM f) SELECT n AS pixels, n >= 100 AS adequate, round(bg, 6) AS background, round((SELECT greatest(1, 1.4826 * median(abs(v - bg))) FROM f), 6) AS noise FROM m", "supplier")
def background_estimate(t):
    return X.background(_image(t), 5).drop("image_id")


@query(f"WITH p AS ({_IMG}), {_NEAREST.format(far=5)}, f AS (SELECT v FROM p WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM d WHERE d.row = p.row AND d.col = p.col)), m AS (SELECT median(v) AS bg FROM f), z AS (SELECT greatest(1, 1.4826 * median(abs(v - bg))) AS noise FROM f, m), r AS (SELECT CAST(m % 1000000 AS INTEGER) AS label, count(*) AS ring_px, median(v) AS ring FROM d JOIN p USING (row, col) WHERE m // 1000000 <= 9 GROUP BY 1), n AS (SELECT label, count(*) AS nuclear_px, median(v) AS nuc FROM p WHERE label > 0 GROUP BY 1) SELECT n.label, nuclear_px, coalesce(ring_px, 0) AS ring_px, round(nuc / ring, 6) AS raw_ratio, round(CASE WHEN nuc > bg AND ring > bg THEN (nuc - bg) / (ring - bg) END, 6) AS ratio, round((nuc - bg) / noise, 6) AS nuclear_snr, nuc - bg > 2 * noise AND ring - bg > 2 * noise AS pass_snr_2, CASE WHEN NOT ring > bg THEN 'nonpositive_corrected_denominator' ELSE 'corrected_ratio_available_not_quality_validated' END AS qc_reasons FROM n LEFT JOIN r USING (label), m, z", "supplier")
def marker_ratios(t):
    return X.marker_ratios(_image(t), 3, 5).select("label", "nuclear_px", "ring_px", "raw_ratio", "ratio", "nuclear_snr", "pass_snr_2", "qc_reasons")


@query(f"WITH p AS ({_IMG}) SELECT label, count(*) AS area, round(avg(v), 6) AS one_mean, round(stddev_pop(v), 6) AS one_std, min(v) AS one_min, max(v) AS one_max, round(avg(v2), 6) AS two_mean, round(stddev_pop(v2), 6) AS two_std, min(v2) AS two_min, max(v2) AS two_max FROM p WHERE label > 0 GROUP BY 1", "supplier")
def two_channels(t):
    return X.two_channels(_image(t)).drop("image_id")


@query(f"WITH p AS ({_IMG}), c AS (SELECT label AS id, CAST(floor(avg(row)) AS INTEGER) AS r, CAST(floor(avg(col)) AS INTEGER) AS c FROM p WHERE label > 0 GROUP BY 1), n AS (SELECT count(*) AS n FROM range(-6, 7) a(x), range(-6, 7) b(y) WHERE x * x + y * y <= 36) SELECT id, round((SELECT count(*) FROM p WHERE p.label > 0 AND power(p.row - c.r, 2) + power(p.col - c.c, 2) <= 36) / n, 6) AS fraction FROM c, n", "supplier")
def local_fraction(t):
    p = _image(t)
    c = p.where("label > 0").groupBy("image_id", F.col("label").alias("id")).agg(F.floor(F.avg("row")).cast("int").alias("row"), F.floor(F.avg("col")).cast("int").alias("col"))
    return X.local_fraction(p, c, 6).select("id", "fraction")


@query(f"WITH x AS ({_VOX}), o AS MATERIALIZED (SELECT CAST(z + dz AS INTEGER) AS z, CAST(row + dr AS INTEGER) AS row, CAST(col + dc AS INTEGER) AS col, min(CAST(round((power(dz * 0.5, 2) + power(dr * 0.2, 2) + power(dc * 0.2, 2)) * 1e6) AS BIGINT) * 1000000 + label) AS m FROM x, range(-1, 2) i(dz), range(-3, 4) j(dr), range(-3, 4) k(dc) WHERE label > 0 GROUP BY ALL), d AS (SELECT o.z, o.row, o.col, m FROM o JOIN x USING (z, row, col) WHERE label = 0) SELECT CAST(m % 1000000 AS INTEGER) AS label, count(*) AS n, round(median(v), 6) AS median FROM d JOIN x USING (z, row, col) WHERE m // 1000000 BETWEEN 122500 AND 360000 GROUP BY 1", "supplier")
def shell_sampling(t):
    return X.shell(_voxels(t), (0.5, 0.2, 0.2), 0.35, 0.6).groupBy("label").agg(F.count("*").alias("n"), F.median("v").alias("median"))


@query(f"WITH p AS ({_IMG}) SELECT row, col, CAST(CASE WHEN label IN (6, 7, 10) THEN label ELSE 0 END AS INTEGER) AS label FROM p", "supplier")
def phenotype_mask(t):
    p = _image(t)
    return X.phenotype_mask(p, p.where("label in (6, 7, 10)"), _height(t), _WIDTH, 2).select("row", "col", "label")





@query(f"WITH RECURSIVE p AS ({_IMG}), m AS MATERIALIZED (SELECT row, col FROM p WHERE label > 0), r AS (SELECT row, col, CAST(row AS BIGINT) * 2147483648 + col AS id FROM m UNION SELECT m.row, m.col, r.id FROM r, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(a, b) JOIN m ON m.row = r.row + a AND m.col = r.col + b) SELECT row, col, min(id) AS component FROM r GROUP BY ALL", "supplier")
def tiled_components(t):
    return T.tiled_components(_image(t).where("label > 0"), tile=24).select("row", "col", "component")


@query(f"WITH p AS ({_IMG}), m AS MATERIALIZED (SELECT row, col FROM p WHERE label > 0) SELECT m.row, m.col, CAST(min(a * a + b * b) AS BIGINT) AS square FROM m, range(-7, 8) x(a), range(-7, 8) y(b) WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.row = m.row + a AND n.col = m.col + b) GROUP BY ALL", "supplier")
def distance_map(t):
    return T.distances(_image(t).where("label > 0"), stripe=8).select("row", "col", "square")


#: Sizes for discs in blocks of 16 pixels: neighbours of the larger ones grow together, over tiles.
_COLONY = {"dilate": 2, "close": 3, "holes": 40, "least": 100, "tile": 24}


@query(None, "supplier")
def colony_support(t):
    return T.colony_support(_image(t), **_COLONY).select("row", "col", "label", "inside")


@query(None, "supplier")
def edge_distances(t):
    return T.edge_distances(_image(t), 0.5, **_COLONY).drop("image_id")


@query(None, "supplier")
def skeleton_continuity(t):
    """Of the discs grown together, as a network of thick lines."""
    network = T.closed_mask(_image(t), 3, 2, tile=24).where("inside")
    return T.skeleton_continuity(network.select("image_id", "row", "col"), _image(t), tile=24).drop("image_id")
