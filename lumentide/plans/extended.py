"""Queries of filters, pairing, joins, summaries, comparisons and labels, with their twins in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentide.functions import measures as M
from lumentide.operators import compare as C
from lumentide.operators import joins as J
from lumentide.operators import pairing as A
from lumentide.operators import quality as Q
from lumentide.operators import summaries as S
from lumentide.operators.tables import dealt, stored
from lumentide.plans.catalogue import _FEATURES, _PIX, R, _pixels, query

# ---- filters ----


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = lower('BRAND#11') AND p_size > 5", "part")
def qc_filter(t):
    return Q.kept(t, F.col("p_size") > 5, F.lower("p_brand") == "brand#11").select("p_partkey")


_SIZES = "SELECT p_partkey, p_brand, (p_partkey * 37) % 500 AS min_row, (p_partkey * 61) % 500 AS min_col, (p_partkey * 37) % 500 + p_size AS max_row, (p_partkey * 61) % 500 + p_size AS max_col, CASE WHEN p_partkey % 3 = 0 THEN 500 END AS h1, 510 AS h2 FROM part"


@query(f"WITH c AS ({_SIZES}) SELECT p_partkey, min_row <= 1 OR min_col <= 1 OR max_row >= coalesce(h1, h2) - 1 OR max_col >= coalesce(h1, h2) - 1 AS border FROM c", "part")
def border_margin(t):
    r, c = F.col("p_partkey") * 37 % 500, F.col("p_partkey") * 61 % 500
    d = t.select("p_partkey", r.alias("min_row"), c.alias("min_col"), (r + F.col("p_size")).alias("max_row"), (c + F.col("p_size")).alias("max_col"), F.when(F.col("p_partkey") % 3 == 0, 500).alias("h1"), F.lit(510).alias("h2"))
    size = F.coalesce("h1", "h2")
    return d.select("p_partkey", Q.border_flag(size, size, 1).alias("border"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 AND p_retailprice BETWEEN 950 AND 1500", "part")
def box_limits(t):
    return Q.within_limits(t, {"p_size": (5, 30), "p_retailprice": (950, 1500)}).select("p_partkey")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN round(value, 6) END AS metric FROM events", "events")
def validity_mask(t):
    flag = F.when(F.col("event_type") == "click", "TRUE").when(F.col("event_type") == "view", "1").otherwise("false")
    return t.withColumn("ok", flag).select("event_id", Q.masked("value", "ok").alias("metric"))


@query("SELECT event_id FROM events WHERE value > 20 AND value < 100", "events")
def finite_range(t):
    return Q.finite_in(t, "value", 20, 100).select("event_id")


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND n_chars IS NOT NULL", "documents")
def complete_rows(t):
    return t.na.drop(subset=["text", "lang", "n_chars"]).select("doc_id")


@query("SELECT p_brand, p_partkey, (p_brand, p_size) IN (('Brand#11', 7), ('Brand#22', 9)) AS excluded FROM part", "part")
def known_duplicates(t):
    return Q.flag_known(t, ["p_brand", "p_size"], [("Brand#11", 7), ("Brand#22", 9)]).select("p_brand", "p_partkey", "excluded")


_WIDE = "SELECT l_quantity AS a, l_quantity + 0.0 AS b, ln(1 + l_quantity) AS c, l_extendedprice AS d, 5.0 AS e, CAST(NULL AS DOUBLE) AS f FROM lineitem"


def _wide(t):
    return t.select(F.col("l_quantity").alias("a"), (F.col("l_quantity") + 0.0).alias("b"), F.log1p("l_quantity").alias("c"), F.col("l_extendedprice").alias("d"), F.lit(5.0).alias("e"), F.lit(None).cast("double").alias("f"))


@query(f"WITH w AS ({_WIDE}) " + " UNION ALL ".join(f"SELECT '{f}' AS feature, count({f}) AS n, count(DISTINCT {f}) > 1 AS usable FROM w" for f in "abcdef"), "lineitem")
def prune_features(t):
    return Q.usable_features(_wide(t), list("abcdef"))


_NEAR = "coalesce(abs({b} - {a}) <= 1e-12 + 1e-9 * abs({a}), {a} IS NULL AND {b} IS NULL)"
_SAME = " UNION ALL ".join(f"SELECT '{b}' AS dropped, '{a}' AS kept FROM w HAVING bool_and({_NEAR.format(a=a, b=b)}) OR bool_and({_NEAR.format(a=f'(CASE WHEN {a} > -1 THEN ln(1 + {a}) END)', b=b)})" for i, b in enumerate("abcd") for a in "abcd"[:i])


@query(f"WITH w AS ({_WIDE}), s AS ({_SAME}) SELECT dropped, min(kept) AS kept FROM s GROUP BY 1", "lineitem")
def duplicate_features(t):
    return Q.duplicate_features(_wide(t), list("abcd"))


@query("SELECT p_brand, p_partkey, CAST(p_size AS DOUBLE) AS intensity_mean FROM part", "part")
def vertical_split(t):
    from lumentide.operators.schema import split_intensity

    return split_intensity(t.select("p_brand", "p_partkey", F.col("p_retailprice").alias("area"), F.col("p_size").cast("double").alias("intensity_mean")), ["p_brand", "p_partkey"])[1]


# ---- discovery ----

_NAMES = "SELECT p_partkey, ['Ctrl', 'HA1', 'HA2', 'HA3'][p_partkey % 4 + 1] || '-' || ['2_5', '5', '7_5', '10'][p_size % 4 + 1] || '-' || CASE WHEN p_partkey % 5 = 0 THEN '20' ELSE '40' END || '-Image Export-' || CAST(p_partkey AS VARCHAR) AS name FROM part"


def _names(t):
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return t.select("p_partkey", F.concat_ws("-", pick(["Ctrl", "HA1", "HA2", "HA3"], F.col("p_partkey") % 4), pick(["2_5", "5", "7_5", "10"], F.col("p_size") % 4), F.when(F.col("p_partkey") % 5 == 0, "20").otherwise("40"), F.lit("Image Export"), F.col("p_partkey").cast("string")).alias("name"))


_FOLDER = "^(Ctrl|HA1|HA2)-(2_5|5|7_5|10)-(40)-Image Export-([0-9]+)$"


@query(f"WITH n AS ({_NAMES}), p AS (SELECT *, regexp_matches(name, '{_FOLDER}') AS ok FROM n) SELECT p_partkey, CASE WHEN ok THEN regexp_extract(name, '{_FOLDER}', 1) END AS exposure, CASE WHEN ok THEN round(1000 * CAST(replace(regexp_extract(name, '{_FOLDER}', 2), '_', '.') AS DOUBLE), 6) END AS density, CASE WHEN ok THEN CAST(regexp_extract(name, '{_FOLDER}', 4) AS INTEGER) ELSE -1 END AS export_index, CASE WHEN ok THEN 'ok' ELSE 'unrecognised' END AS status FROM p", "part")
def sample_folders(t):
    return A.parse_folders(_names(t), "name").select("p_partkey", "exposure", "density", F.coalesce("export_index", F.lit(-1)).alias("export_index"), "status")


@query("WITH g AS (SELECT c_mktsegment AS group_name, CAST(count(*) AS DOUBLE) AS hours FROM customer GROUP BY 1) SELECT group_name, CAST(d AS DOUBLE) AS density, hours FROM g, (VALUES (2500), (5000), (7500), (10000)) b(d)", "customer")
def design_grid(t):
    groups = t.groupBy(F.col("c_mktsegment").alias("group_name")).agg(F.count("*").cast("double").alias("hours"))
    return A.design_grid(groups, [2500.0, 5000.0, 7500.0, 10000.0])


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD P%' THEN 'a' WHEN p_type LIKE 'STANDARD%' THEN 'b' WHEN p_type LIKE 'ECONOMY%' THEN 'c' ELSE 'unclassified' END AS category FROM part", "part")
def prefix_classify(t):
    return t.select("p_partkey", A.by_prefix(F.col("p_type"), [("STANDARD P", "a"), ("STANDARD", "b"), ("ECONOMY", "c")]).alias("category"))


@query("SELECT c_custkey, coalesce(s_suppkey, -1) AS partner, CASE WHEN s_suppkey IS NULL THEN 'missing_partner' ELSE 'ok' END AS status FROM customer LEFT JOIN supplier ON lower(replace(replace(c_name, 'Customer', ''), '#', '')) = lower(replace(replace(s_name, 'Supplier', ''), '#', ''))", "customer", "supplier")
def pairing_manifest(c, s):
    key = lambda x: F.lower(F.regexp_replace(x, "Customer|Supplier|#", ""))
    return A.paired(c.withColumn("key", key("c_name")), s.select(key("s_name").alias("key"), F.col("s_suppkey").alias("path")), "key").select("c_custkey", F.coalesce("partner", F.lit(-1)).alias("partner"), "status")


@query("WITH n AS (SELECT n_nationkey, lower(n_name) AS exact, substr(lower(n_name), 1, 2) AS key FROM nation), r AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN lower(n_name) END AS exact, substr(lower(n_name), 1, 2) AS key, n_nationkey AS path FROM nation WHERE n_nationkey % 2 = 0), e AS (SELECT exact, min(path) AS p FROM r WHERE exact IS NOT NULL GROUP BY 1), k AS (SELECT key, min(path) AS p FROM r GROUP BY 1) SELECT n_nationkey, coalesce(e.p, k.p) AS partner, CASE WHEN e.p IS NOT NULL THEN 'exact' WHEN k.p IS NOT NULL THEN 'key' ELSE 'missing' END AS status FROM n LEFT JOIN e USING (exact) LEFT JOIN k USING (key)", "nation")
def pairing_fallback(t):
    n = t.select("n_nationkey", F.lower("n_name").alias("exact"), F.substring(F.lower("n_name"), 1, 2).alias("key"))
    r = t.where("n_nationkey % 2 = 0").select(F.when(F.col("n_nationkey") % 4 == 0, F.lower("n_name")).alias("exact"), F.substring(F.lower("n_name"), 1, 2).alias("key"), F.col("n_nationkey").alias("path"))
    return A.paired_by_name_or_key(n, r, "exact", "key").select("n_nationkey", "partner", "status")


@query("WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE value IS NOT NULL), b AS (SELECT user_id, max(event_id) FILTER (k = 1) AS best, max(event_id) FILTER (k = 2) AS second, max(value) FILTER (k = 1) AS best_score, coalesce(max(value) FILTER (k = 2), 0) AS second_score FROM r WHERE k <= 2 GROUP BY 1), l AS (SELECT quantile_cont(best_score, 0.5) AS q FROM b) SELECT user_id, best, second, round(best_score / (second_score + 1e-12), 6) AS ratio, round(best_score - second_score, 6) AS diff, best_score >= q AND best_score / (second_score + 1e-12) >= 1.08 AND best_score - second_score >= 0.0005 AS keep FROM b, l", "events")
def best_focus(t):
    return A.best_focus(t.where("value IS NOT NULL"), ["user_id"], "event_id", "value").select("user_id", "best", "second", "ratio", "diff", "keep")


@query("WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'x PhysicalSizeX=\"0.25\"' END AS txt, CASE WHEN p_partkey % 4 = 1 THEN 2 WHEN p_partkey % 4 = 2 THEN 3 END AS unit, CAST(p_size AS DOUBLE) AS res FROM part) SELECT p_partkey, round(coalesce(CAST(nullif(regexp_extract(txt, 'PhysicalSizeX=\"([0-9.]+)\"', 1), '') AS DOUBLE), CASE unit WHEN 2 THEN 25400 / res WHEN 3 THEN 10000 / res END, 0.5), 6) AS um FROM x", "part")
def pixel_size(t):
    k = F.col("p_partkey") % 4
    return t.select("p_partkey", M.pixel_size_um(F.when(k == 0, 'x PhysicalSizeX="0.25"'), F.when(k == 1, 2).when(k == 2, 3), F.col("p_size").cast("double"), F.lit(0.5)).alias("um"))


@query("SELECT p_partkey, round(p_size * s, 6) AS width_um, round(p_retailprice * s * s, 6) AS area_um2 FROM (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN CAST(p_partkey % 3 * 0.25 AS DOUBLE) END AS s FROM part)", "part")
def micrometre_columns(t):
    d = t.select("p_partkey", F.col("p_size").alias("width_px"), F.col("p_retailprice").alias("area_px2"), (F.col("p_partkey") % 3 * 0.25).alias("s"))
    return M.in_micrometres(d, F.col("s")).drop("s")


@query("WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)(^| )(the|der|la)( |$)') AND NOT coalesce(regexp_matches(before, '\\?'), false) THEN 'hit' WHEN regexp_matches(text, '(?i)(^| )(the|der|la)( |$)') THEN 'exempt' ELSE 'none' END AS audit FROM p", "conversations")
def term_audit_context(t):
    from lumentide.operators.text import term_audit

    return term_audit(t, ["conv_id"], "turn", "text", "(?i)(^| )(the|der|la)( |$)", r"\?").select("conv_id", "turn", "audit")


# ---- joins ----


@query("WITH a AS (SELECT o_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT o.o_orderkey, coalesce(a.n, 0) AS n, round(a.q, 6) AS q FROM orders o LEFT JOIN a USING (o_orderkey)", "orders", "lineitem")
def left_join_one_to_one(o, li):
    a = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return J.left_join(o.select("o_orderkey"), a, ["o_orderkey"], "1:1").na.fill(0, ["n"])


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey * 2.0 AS area FROM nation", "nation")
def inner_join_rechecked(t):
    a = t.select("n_nationkey", "n_name", (F.col("n_nationkey") * 2.0).alias("area"))
    return A.checked_inner(a, t.select("n_nationkey", "n_regionkey", (F.col("n_nationkey") * 2.0 + 1e-12).alias("area")), ["n_nationkey"], "area").select("n_nationkey", "n_name", "n_regionkey", "area")


@query("WITH a AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, l_returnflag, sum(l_tax) AS tax FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) SELECT l_suppkey, l_returnflag, n, round(tax, 6) AS tax FROM a JOIN b USING (l_suppkey, l_returnflag)", "lineitem")
def inner_join_composite(t):
    k = ["l_suppkey", "l_returnflag"]
    return t.groupBy(*k).agg(F.count("*").alias("n")).join(t.where("l_linestatus = 'O'").groupBy(*k).agg(F.sum("l_tax").alias("tax")), k)


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal ELSE s_acctbal END, 6) AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey", "customer", "supplier")
def coalesced_sources(c, s):
    base = F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).when(F.col("c_custkey") % 3 == 1, F.lit(float("nan")))
    return J.coalesced(c.select(F.col("c_custkey"), base.alias("balance")), s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("balance")), ["c_custkey"], "balance")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", "supplier", "nation", "region")
def join_chain(s, n, r):
    return J.chained(s.select("s_suppkey", F.col("s_nationkey").alias("n_nationkey")), (n, ["n_nationkey"]), (r.withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"])).select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON regexp_replace(regexp_replace(lower(c_name), '^customer', ''), '[^a-z0-9]+', '', 'g') = regexp_replace(regexp_replace(lower(s_name), '^supplier', ''), '[^a-z0-9]+', '', 'g') || '' AND c_custkey % 2 = 1", "customer", "supplier")
def normalised_key_join(c, s):
    key = lambda x, i: F.concat_ws("||", M.stem_key(F.regexp_replace(F.concat(x, F.lit("_mask_mask.TIF")), "^(Customer|Supplier)", "/data/")), M.integer_key(i))
    a = c.where("c_custkey % 2 = 1").select("c_custkey", key(F.col("c_name"), F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("k"))
    return a.join(s.select("s_suppkey", key(F.col("s_name"), F.col("s_suppkey")).alias("k")), "k").select("c_custkey", "s_suppkey")


@query("WITH p AS (SELECT DISTINCT lower(p_type) AS k FROM part), q AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS k FROM part) SELECT p.k, (SELECT min(q.k) FROM q WHERE contains(q.k, p.k) OR contains(p.k, q.k)) AS path FROM p", "part")
def containment_join(t):
    left = t.select(F.lower("p_type").alias("k")).distinct()
    right = t.select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("k")).distinct()
    return A.contained(left, right.select("k", F.col("k").alias("path")), "k", "path").select("k", "path")


_TWO = f"a AS ({_PIX}), b AS (SELECT row, col, CASE WHEN row % 5 = 0 THEN 0 WHEN col % 8 < 3 THEN greatest(label - 1, 0) ELSE label END AS label FROM ({_PIX}))"


@query(f"WITH {_TWO}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, m) AS k FROM (SELECT a.label, b.label AS m, count(*) AS n FROM a JOIN b USING (row, col) WHERE a.label > 0 AND b.label > 0 GROUP BY a.label, b.label)), s AS (SELECT label, count(*) AS area FROM a WHERE label > 0 GROUP BY 1), c AS (SELECT label, count(*) AS cross_n FROM b WHERE label > 0 GROUP BY 1), j AS (SELECT s.label, coalesce(m, 0) AS match, coalesce(n / area, 0) AS fraction, coalesce(n / (area + cross_n - n), 0) AS iou FROM s LEFT JOIN o ON o.label = s.label AND k = 1 LEFT JOIN c ON c.label = m), w AS (SELECT *, CASE WHEN match = 0 THEN 'no_overlap' WHEN fraction < 0.3 THEN 'low_overlap_fraction' WHEN iou < 0.2 THEN 'low_iou' END AS r FROM j), d AS (SELECT *, row_number() OVER (PARTITION BY match, r IS NULL ORDER BY iou DESC, fraction DESC, label) AS i FROM w) SELECT label, CAST(match AS INTEGER) AS match, {R('fraction', 'iou')}, CASE WHEN r IS NULL AND i > 1 THEN 'duplicate_match' ELSE r END AS reason FROM d", "part")
def overlap_join(t):
    a = _pixels(t)
    b = a.withColumn("label", F.when(F.col("row") % 5 == 0, 0).when(F.col("col") % 8 < 3, F.greatest(F.col("label") - 1, F.lit(0))).otherwise(F.col("label")))
    return A.overlap_matches(a, b, ["image_id"], 0.3, 0.2).select("label", F.col("match").cast("int").alias("match"), "fraction", "iou", "reason")


@query("WITH p AS (SELECT p_partkey % 3 AS image, p_size % 10 AS row, p_partkey // 3 AS col, p_retailprice AS v FROM part), q AS (SELECT (l_linenumber) AS plane, l_orderkey AS o, l_quantity AS v FROM lineitem), x AS (SELECT image, col, v FROM p), r AS (SELECT image, plane, covar_pop(x.v, q.v) / nullif(stddev_pop(x.v) * stddev_pop(q.v), 0) AS r FROM x JOIN q ON x.col = q.o GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY round(r, 12) DESC, plane) AS k FROM r WHERE r IS NOT NULL) SELECT image, max(plane) FILTER (k = 1) AS best, round(max(r) FILTER (k = 1), 6) AS r, max(plane) FILTER (k = 2) AS second, round(max(r) FILTER (k = 1) - max(r) FILTER (k = 2), 6) AS margin FROM k WHERE k <= 2 GROUP BY 1", "part", "lineitem")
def best_plane(t, li):
    p = t.select((F.col("p_partkey") % 3).alias("image"), F.lit(0).alias("row"), F.floor(F.col("p_partkey") / 3).alias("col"), F.col("p_retailprice").alias("v"))
    return A.best_plane(p, li.select(F.col("l_linenumber").alias("plane"), F.lit(0).alias("row"), F.col("l_orderkey").alias("col"), F.col("l_quantity").alias("v")), "image", "plane")


@query("WITH b AS (SELECT user_id, CAST(least(floor(value / 20), 4) AS INTEGER) AS bin, value FROM events WHERE value IS NOT NULL), m AS (SELECT bin, median(value) AS m FROM b GROUP BY 1) SELECT user_id, round(max(m), 6) AS level FROM b JOIN m USING (bin) GROUP BY 1", "events")
def bin_map_join(t):
    b = t.where("value IS NOT NULL").select("user_id", F.least(F.floor(F.col("value") / 20), F.lit(4)).cast("int").alias("bin"), "value")
    return b.join(stored(b.groupBy("bin").agg(F.median("value").alias("m")), "bin-medians"), "bin").groupBy("user_id").agg(F.max("m").alias("level"))


@query("WITH a AS (SELECT l_suppkey, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, corr(l_quantity, l_discount) AS r FROM lineitem GROUP BY 1) SELECT l_suppkey, round(a.r, 6) AS old, round(b.r, 6) AS new, round(b.r - a.r, 6) AS change FROM a JOIN b USING (l_suppkey)", "lineitem")
def method_comparison(t):
    one = lambda y, n: t.groupBy("l_suppkey").agg(S.pearson("l_quantity", y).alias(n))
    return one("l_extendedprice", "old").join(one("l_discount", "new"), "l_suppkey").withColumn("change", F.col("new") - F.col("old"))


# ---- aggregates ----


@query(f"SELECT l_linestatus, count(*) AS n, {', '.join(f'round(avg({f}), 6) AS {f}_mean, round(stddev_samp({f}), 6) AS {f}_std, round(median({f}), 6) AS {f}_median' for f in _FEATURES)} FROM lineitem GROUP BY 1", "lineitem")
def group_feature_summary(t):
    return C.feature_summary(t, ["l_linestatus"], _FEATURES)


_WHY = "SELECT *, array_to_string(list_filter([CASE WHEN p_size < 10 THEN 'small' END, CASE WHEN p_retailprice > 1500 THEN 'bright' END], lambda x: x IS NOT NULL), ';') AS why FROM part"


def _why(t):
    return t.withColumn("why", F.concat_ws(";", F.when(F.col("p_size") < 10, "small"), F.when(F.col("p_retailprice") > 1500, "bright")))


@query(f"WITH w AS ({_WHY}) SELECT p_brand, count(*) AS n, CAST(sum(CASE WHEN why LIKE '%small%' THEN 1 ELSE 0 END) AS BIGINT) AS n_small, CAST(sum(CASE WHEN why LIKE '%bright%' THEN 1 ELSE 0 END) AS BIGINT) AS n_bright, CAST(sum(CASE WHEN why <> '' THEN 1 ELSE 0 END) AS BIGINT) AS n_removed, round(avg(CASE WHEN why <> '' THEN 1.0 ELSE 0.0 END), 6) AS removed_fraction, avg(CASE WHEN why <> '' THEN 1.0 ELSE 0.0 END) > 0.2 AS warning FROM w GROUP BY 1", "part")
def qc_reason_summary(t):
    return C.reason_summary(_why(t), "p_brand", "why", ["small", "bright"])


@query(f"WITH w AS ({_WHY}) SELECT p_brand, p_partkey, r.reason, CAST(r.i AS INTEGER) AS place FROM w, LATERAL (SELECT unnest(string_split(why, ';')) AS reason, unnest(range(len(string_split(why, ';')))) AS i) r WHERE why <> ''", "part")
def reason_split(t):
    return _why(t).where("why <> ''").select("p_brand", "p_partkey", F.posexplode(F.split("why", ";")).alias("place", "reason"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum((l_tax > 0.04)::INT) AS BIGINT) AS n_high, round(avg((l_tax > 0.04)::INT), 6) AS share_high, round(median(l_discount), 6) AS l_discount_median FROM lineitem GROUP BY ALL", "lineitem")
def technical_qc_summary(t):
    return C.technical_summary(t.withColumn("high", F.col("l_tax") > 0.04), ["l_returnflag", "no_such_key", "l_linestatus"], ["high"], ["l_discount"])


@query("SELECT o_orderstatus, " + ", ".join(f"round(count(*) FILTER (o_orderpriority = '{p}') / count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')), 6) AS \"share_{p}\"" for p in ("1-URGENT", "2-HIGH")) + " FROM orders GROUP BY 1", "orders")
def crosstab_rows(t):
    return C.crosstab(t, "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS fields, round(median(l_tax), 6) AS median, round(avg(l_tax), 6) AS mean, round(stddev_samp(l_tax), 6) AS sd, round(quantile_cont(l_tax, 0.1), 6) AS q10, round(quantile_cont(l_tax, 0.9), 6) AS q90, round(stddev_samp(l_tax) / avg(l_tax), 6) AS cv FROM lineitem GROUP BY 1", "lineitem")
def sample_summary(t):
    return C.sample_summary(t, "l_returnflag", "l_suppkey", "l_tax")


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {', '.join(f'round(quantile_cont({f}, {p}), 6) AS {f}_{n}' for f in _FEATURES for p, n in ((0.25, 'q25'), (0.5, 'median'), (0.75, 'q75')))} FROM lineitem GROUP BY ALL", "lineitem")
def condition_summary(t):
    return C.quartile_summary(t, ["l_returnflag", "l_linestatus"], _FEATURES)


@query("SELECT l_suppkey, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY 1", "lineitem")
def uniformity_cv(t):
    return C.variation(t, ["l_suppkey"], "l_quantity")


@query("WITH a AS (SELECT s_nationkey AS k, count(*) AS n_a, avg(s_acctbal) AS mean_a FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS k, count(*) AS n_b, avg(c_acctbal) AS mean_b FROM customer GROUP BY 1) SELECT k, n_a, round(mean_a, 6) AS mean_a, n_b, round(mean_b, 6) AS mean_b FROM a LEFT JOIN b USING (k)", "supplier", "customer")
def two_source_conditions(s, c):
    one = lambda df, k, v, n: df.groupBy(F.col(k).alias("k")).agg(F.count("*").alias(f"n_{n}"), F.avg(v).alias(f"mean_{n}"))
    return one(s, "s_nationkey", "s_acctbal", "a").join(one(c, "c_nationkey", "c_acctbal", "b"), "k", "left")


@query("SELECT event_type, round(avg((value >= 90)::INT), 6) AS saturated, round(avg((value >= 90)::INT) FILTER (value > 10), 6) AS saturated_signal, round(avg((value <= 10)::INT), 6) AS empty, round(count(*) FILTER (value > 10) * 10000.0 / 250000, 6) AS density, CAST(max(hour(ts)) - min(hour(ts)) + 1 AS INTEGER) AS span FROM events GROUP BY 1", "events")
def saturation_audit(t):
    from lumentide.operators.raster import saturation_audit as audit

    return audit(t.withColumn("z", F.hour("ts")), "event_type", "value", 90.0, 10.0, 250_000.0)


@query("WITH s AS (SELECT user_id, event_type, max(value) AS v, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS k FROM s) SELECT user_id, max(event_type) FILTER (k = 1) AS best, round(max(v) FILTER (k = 1), 6) AS best_score, round(max(v) FILTER (k = 2), 6) AS second_score, round(count(*) FILTER (v > 50) / count(*), 6) AS matched FROM r GROUP BY 1", "events")
def focus_match_summary(t):
    s = t.groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    return A.match_summary(s, "user_id", "event_type", "v", 50.0)


@query("SELECT l_returnflag, l_linestatus, round(median(l_quantity), 6) AS median, round(median(l_quantity) - quantile_cont(l_quantity, 0.25), 6) AS below, round(quantile_cont(l_quantity, 0.75) - median(l_quantity), 6) AS above FROM lineitem GROUP BY ALL", "lineitem")
def feature_trend(t):
    return C.trend(t, ["l_returnflag", "l_linestatus"], "l_quantity")


_EIGHTHS = "[" + ", ".join(f"quantile_cont(l_quantity, {i / 8})" for i in range(9)) + "]"


@query(f"WITH e AS (SELECT l_suppkey, list_distinct({_EIGHTHS}) AS e FROM lineitem GROUP BY 1), d AS (SELECT l.l_suppkey, l_quantity, l_extendedprice, CAST(greatest(len(list_filter(e, lambda x: x < l_quantity)), 1) AS INTEGER) AS bin FROM lineitem l JOIN e USING (l_suppkey) WHERE l_extendedprice > 0) SELECT l_suppkey, bin, count(*) AS n, round(median(l_quantity), 6) AS x, round(median(log2(l_extendedprice)), 6) AS y FROM d GROUP BY ALL", "lineitem")
def qcut_trend(t):
    return C.equal_count_trend(t, "l_suppkey", "l_quantity", "l_extendedprice")


@query("WITH m AS (SELECT l_returnflag, l_linenumber, median(l_extendedprice) AS v FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY v DESC, l_linenumber) AS h, row_number() OVER (PARTITION BY l_returnflag ORDER BY v, l_linenumber) AS l FROM m) SELECT l_returnflag, l_linenumber, round(v, 6) AS v, CASE WHEN h <= 2 THEN 'high' ELSE 'low' END AS \"end\" FROM r WHERE h <= 2 OR l <= 2", "lineitem")
def report_extremes(t):
    return C.extremes(t.groupBy("l_returnflag", "l_linenumber").agg(F.median("l_extendedprice").alias("v")), "l_returnflag", "l_linenumber", "v")


@query("SELECT round(min(l_quantity), 6) AS x0, round(max(l_quantity), 6) AS x1, round(min(l_tax), 6) AS y0, round(max(l_tax), 6) AS y1, round(0.55 * greatest(max(l_quantity) - min(l_quantity), max(l_tax) - min(l_tax)), 6) AS half FROM lineitem", "lineitem")
def axis_span(t):
    x, y = F.col("l_quantity"), F.col("l_tax")
    return t.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), (0.55 * F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y))).alias("half"))


_GAIN = "s AS (SELECT l_linestatus, l_returnflag, count(*) AS n, avg((l_tax > 0.01)::INT) AS valid, quantile_cont(v, 0.25) AS q25, median(v) AS median, quantile_cont(v, 0.75) AS q75 FROM (SELECT *, CASE WHEN l_tax > 0.01 THEN l_quantity END AS v FROM lineitem) GROUP BY ALL), m AS (SELECT l.l_linestatus, l.l_returnflag, median(abs(l_quantity - median)) AS mad FROM lineitem l JOIN s USING (l_linestatus, l_returnflag) WHERE l_tax > 0.01 GROUP BY ALL)"


@query(f"WITH {_GAIN}, g AS (SELECT * FROM (VALUES ('F'), ('O'), ('X')) a(l_linestatus), (VALUES ('A'), ('N'), ('R')) b(l_returnflag)) SELECT g.l_linestatus, g.l_returnflag, coalesce(n, 0) AS n, {R('valid', 'q25', 'median', 'q75')}, round(m.mad, 6) AS mad, round(CASE WHEN m.mad > 0 AND c.mad > 0 THEN -log2(m.mad / c.mad) END, 6) AS gain FROM g LEFT JOIN s USING (l_linestatus, l_returnflag) LEFT JOIN m ON m.l_linestatus = g.l_linestatus AND m.l_returnflag = g.l_returnflag LEFT JOIN m c ON c.l_linestatus = g.l_linestatus AND c.l_returnflag = 'A'", "lineitem")
def marker_dispersion_grid(t):
    grid = t.sparkSession.createDataFrame([(a, b) for a in "FOX" for b in "ANR"], "l_linestatus string, l_returnflag string")
    return C.marker_dispersion(t, grid, "l_linestatus", "l_returnflag", "l_quantity", F.col("l_tax") > 0.01, "A")


@query("WITH m AS (SELECT l_linestatus, l_returnflag, abs(l_extendedprice - median(l_extendedprice) OVER (PARTITION BY l_linestatus, l_returnflag)) d FROM lineitem), g AS (SELECT l_linestatus, l_returnflag, median(d) mad FROM m GROUP BY ALL), j AS (SELECT g.l_returnflag, -log2(g.mad / c.mad) AS gain FROM g JOIN g c ON c.l_linestatus = g.l_linestatus AND c.l_returnflag = 'A') SELECT l_returnflag, count(gain) AS n, count(*) FILTER (gain > 0) AS n_positive, round(median(gain), 6) AS median, round(min(gain), 6) AS least, round(max(gain), 6) AS most FROM j GROUP BY 1", "lineitem")
def uniformity_summary(t):
    return C.gain_summary(S.dispersion(t, "l_linestatus", "l_returnflag", "A", "l_extendedprice"), ["l_returnflag"])


@query("WITH s AS (SELECT l_linestatus, l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT s.l_linestatus, s.l_returnflag, round(s.m / c.m, 6) AS ratio, round(100 * (s.m / c.m - 1), 6) AS percent, round(log2(s.m / c.m), 6) AS log2 FROM s JOIN s c ON c.l_linestatus = s.l_linestatus AND c.l_returnflag = 'N'", "lineitem")
def relative_to_control(t):
    return C.against_control(t.groupBy("l_linestatus", "l_returnflag").agg(F.median("l_quantity").alias("m")), ["l_linestatus"], "l_returnflag", "N", "m")


@query("WITH s AS (SELECT l_linestatus, l_returnflag, median(l_tax) FILTER (l_quantity > 5) AS m FROM lineitem GROUP BY ALL) SELECT s.l_linestatus, s.l_returnflag, round(s.m - c.m, 6) AS effect FROM s JOIN s c ON c.l_linestatus = s.l_linestatus AND c.l_returnflag = 'A'", "lineitem")
def marker_effect(t):
    s = t.groupBy("l_linestatus", "l_returnflag").agg(F.median(F.when(F.col("l_quantity") > 5, F.col("l_tax"))).alias("m"))
    return S.contrast_with(s, "l_linestatus", "l_returnflag", "A", "m")


@query("WITH m AS (SELECT l_suppkey, l_quantity - median(l_quantity) OVER w AS x, l_extendedprice - median(l_extendedprice) OVER w AS y FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)), r AS (SELECT l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY x) + (count(*) OVER (PARTITION BY l_suppkey, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_suppkey ORDER BY y) + (count(*) OVER (PARTITION BY l_suppkey, y) - 1) / 2 AS ry FROM m) SELECT l_suppkey, count(*) AS n, round(covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0), 6) AS rho FROM r GROUP BY 1 HAVING count(*) >= 10", "lineitem")
def residual_spearman(t):
    return C.residual_spearman(t, "l_suppkey", "l_quantity", "l_extendedprice")


@query("WITH d AS (SELECT l_returnflag, round(l_quantity - 25, 0) AS v FROM lineitem WHERE round(l_quantity - 25, 0) <> 0), r AS (SELECT *, rank() OVER (PARTITION BY l_returnflag ORDER BY abs(v)) + (count(*) OVER (PARTITION BY l_returnflag, abs(v)) - 1) / 2 AS r FROM d), t AS (SELECT l_returnflag, sum(power(c, 3) - c) AS ties FROM (SELECT l_returnflag, abs(v), count(*) AS c FROM d GROUP BY ALL) GROUP BY 1), s AS (SELECT l_returnflag, count(*) AS n, sum(CASE WHEN v > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN v < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY 1) SELECT l_returnflag, n, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round((w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s JOIN t USING (l_returnflag)", "lineitem")
def signed_rank(t):
    return C.signed_rank(t.withColumn("v", F.round(F.col("l_quantity") - 25, 0)), "l_returnflag", "v").drop("p")


@query("WITH RECURSIVE d AS (SELECT s_suppkey // 8 AS g, s_suppkey, round((s_acctbal - 4500) / 1000, 0) AS v FROM supplier WHERE round((s_acctbal - 4500) / 1000, 0) <> 0), r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY s_suppkey) AS i, rank() OVER (PARTITION BY g ORDER BY abs(v)) + (count(*) OVER (PARTITION BY g, abs(v)) - 1) / 2 AS r FROM d), w AS (SELECT g, count(*) AS n, sum(CASE WHEN v > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN v < 0 THEN r ELSE 0 END) AS w_minus FROM r GROUP BY 1), e AS (SELECT g, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS s FROM w UNION ALL SELECT e.g, r.i, e.s + r.r * x.x FROM e JOIN r ON r.g = e.g AND r.i = e.i + 1, (VALUES (0), (1)) x(x)) SELECT w.g, any_value(n) AS n, round(any_value(w_plus), 6) AS w_plus, round(any_value(w_minus), 6) AS w_minus, round(least(1, 2 * least(avg(CASE WHEN s <= w_plus THEN 1.0 ELSE 0 END), avg(CASE WHEN s >= w_plus THEN 1.0 ELSE 0 END))), 6) AS p FROM e JOIN w ON w.g = e.g AND e.i = w.n GROUP BY 1", "supplier")
def signed_rank_exact(t):
    d = t.select(F.expr("s_suppkey div 8").alias("g"), F.round((F.col("s_acctbal") - 4500) / 1000, 0).alias("v"))
    return C.signed_rank(d, "g", "v").drop("z")


@query("WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round(-sum(p * ln(p)) / ln(5), 6) AS entropy, round(1 - sum(p * p), 6) AS simpson FROM p GROUP BY 1", "events")
def diversity(t):
    return C.diversity(t.where("event_type IS NOT NULL"), "user_id", "event_type", 5)


@query("WITH p AS (SELECT p_brand, p_size - 1 AS r, p_retailprice - 900 AS c, p_type FROM part), w AS (SELECT p_brand, p_type, n / sum(n) OVER (PARTITION BY p_brand) AS q FROM (SELECT p_brand, p_type, count(*) AS n FROM p GROUP BY ALL)), g AS (SELECT * FROM (SELECT DISTINCT p_brand FROM p), (SELECT CAST(range AS INTEGER) AS br FROM range(4)), (SELECT CAST(range AS INTEGER) AS bc FROM range(4)), (SELECT DISTINCT p_type FROM p)), k AS (SELECT p_brand, CAST(floor(r / 12.5) AS INTEGER) AS br, CAST(floor(c / 12.5) AS INTEGER) AS bc, p_type, count(*) AS k FROM p GROUP BY ALL), f AS (SELECT p_brand, br, bc, p_type, coalesce(k, 0) AS k, sum(coalesce(k, 0)) OVER b AS n, coalesce(q, 0) + 1e-9 AS q FROM g LEFT JOIN k USING (p_brand, br, bc, p_type) LEFT JOIN w USING (p_brand, p_type) WINDOW b AS (PARTITION BY p_brand, br, bc)), e AS (SELECT *, (CASE WHEN n > 0 THEN k / n ELSE 0 END) + 1e-9 AS p FROM f), h AS (SELECT *, p / sum(p) OVER b AS pp, q / sum(q) OVER b AS qq FROM e WINDOW b AS (PARTITION BY p_brand, br, bc)) SELECT p_brand, br AS block_row, bc AS block_col, CAST(any_value(n) AS BIGINT) AS n, round(sqrt(greatest(sum(pp * ln(pp / ((pp + qq) / 2)) + qq * ln(qq / ((pp + qq) / 2))) / 2, 0)), 6) AS distance FROM h GROUP BY ALL", "part")
def spatial_blocks_js(t):
    p = t.select("p_brand", (F.col("p_size") - 1).alias("r"), (F.col("p_retailprice") - 900).alias("c"), "p_type")
    return C.block_distances(p, "p_brand", "r", "c", "p_type", 12.5, 4)


@query("WITH m AS (SELECT l_returnflag, avg(l_quantity) q, avg(l_tax) t, avg(l_discount) d FROM lineitem GROUP BY 1), s AS (SELECT l_returnflag, (q - min(q) OVER ()) / greatest(max(q) OVER () - min(q) OVER (), 1e-12) + 0.7 * (t - min(t) OVER ()) / greatest(max(t) OVER () - min(t) OVER (), 1e-12) + 0.8 * (max(d) OVER () - d) / greatest(max(d) OVER () - min(d) OVER (), 1e-12) AS score FROM m) SELECT l_returnflag, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, l_returnflag) = 1 AS deviated FROM s", "lineitem")
def orientation_score(t):
    return C.orientation_scores(t, "l_returnflag", {"l_quantity": 1.0, "l_tax": 0.7}, {"l_discount": 0.8})


@query("SELECT name, coalesce(n, -1) AS n, declared, coalesce(n = declared, false) AS matches FROM (SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region) c FULL JOIN (VALUES ('nation', CAST(25 AS BIGINT)), ('region', CAST(6 AS BIGINT)), ('planet', CAST(1 AS BIGINT))) d(name, declared) USING (name)", "nation", "region")
def count_ledger(n, r):
    counts = n.agg(F.lit("nation").alias("name"), F.count("*").alias("n")).unionByName(r.agg(F.lit("region").alias("name"), F.count("*").alias("n")))
    return C.ledger(counts, {"nation": 25, "region": 6, "planet": 1}).na.fill(-1, ["n"])


@query("SELECT split_part(url, '/', 3) AS host, count(*) AS n, round(sum(strlen(html)) / 1e6, 6) AS mb, min(url) AS first FROM pages GROUP BY 1", "pages")
def category_sizes(t):
    from lumentide.sources.inventory import summary

    return summary(t.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("host"), F.col("url").alias("path"), F.octet_length("html").cast("long").alias("size_bytes")), "host")


_CLS = "SELECT doc_id, quality, CASE WHEN n_chars > 1500 THEN '1' WHEN n_chars < 600 THEN '0' ELSE 'uncertain' END AS p, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id)"


def _classified(labels, docs):
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").withColumn("p", F.when(F.col("n_chars") > 1500, "1").when(F.col("n_chars") < 600, "0").otherwise("uncertain")).withColumn("x", F.col("n_chars").cast("double"))


@query(f"WITH c AS ({_CLS}) SELECT quality, p, count(*) AS n FROM c WHERE p <> 'uncertain' GROUP BY ALL", "labels", "documents")
def confusion_excl_uncertain(labels, docs):
    return C.confusion(_classified(labels, docs), "quality", "p")[0]


@query(f"WITH c AS ({_CLS}) SELECT count(*) AS n, round(avg((p = 'uncertain')::INT), 6) AS uncertain_share FROM c", "labels", "documents")
def uncertain_share(labels, docs):
    return C.confusion(_classified(labels, docs), "quality", "p")[1]


@query(f"WITH c AS ({_CLS}), g AS (SELECT x, sum(quality) AS pos, count(*) AS n FROM c GROUP BY 1), k AS (SELECT *, sum(pos) OVER (ORDER BY x DESC) AS tp, sum(n) OVER (ORDER BY x DESC) AS seen, sum(pos) OVER () AS total FROM g) SELECT round(sum(pos / total * tp / seen), 6) AS average_precision FROM k", "labels", "documents")
def average_precision(labels, docs):
    from lumentide.operators.metrics import average_precision as ap

    return ap(_classified(labels, docs), "x", "quality")


@query("WITH c AS (SELECT label AS k, count(*) AS n, 100.0 - label * 3 AS bic, (label % 4) / 4.0 AS silhouette, label / 10.0 AS stability, CASE WHEN label = 2 THEN 0.01 ELSE 0.1 END AS least_share FROM embeddings GROUP BY 1), o AS (SELECT * FROM c WHERE least_share >= 0.03), r AS (SELECT k, rank() OVER (ORDER BY bic) + rank() OVER (ORDER BY silhouette DESC) + rank() OVER (ORDER BY stability DESC) AS s FROM o) SELECT k, CAST(s AS INTEGER) AS rank_sum, row_number() OVER (ORDER BY s, k) = 1 AS chosen FROM r", "embeddings")
def rank_sum_select(t):
    c = t.groupBy(F.col("label").alias("k")).agg(F.count("*").alias("n"))
    c = c.select("k", (100.0 - F.col("k") * 3).alias("bic"), (F.col("k") % 4 / 4).alias("silhouette"), (F.col("k") / 10).alias("stability"), F.when(F.col("k") == 2, 0.01).otherwise(0.1).alias("least_share"))
    return C.rank_selection(c)


# ---- windows, sorts, sets ----


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_linestatus FROM lineitem WHERE l_suppkey % 3 <> 0 OR l_quantity > 0), g AS (SELECT l_suppkey, median(l_quantity) AS m, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS i FROM w GROUP BY 1), o AS (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS i, stddev_pop(l_quantity) AS s FROM w) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / CASE WHEN g.i > 1e-9 THEN g.i WHEN o.i > 1e-9 THEN o.i WHEN o.s > 1e-9 THEN o.s ELSE 1.0 END, 6) AS scaled FROM w JOIN g USING (l_suppkey), o", "lineitem")
def robust_scale_fallback(t):
    return Q.robust_scale_or_global(t, "l_quantity", ["l_suppkey"], "scaled").select("l_orderkey", "l_linenumber", "scaled")


@query("SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS min_rank, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS INTEGER) AS dense FROM orders", "orders")
def min_dense_rank(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority")
    return t.select("o_orderkey", F.rank().over(w).alias("min_rank"), F.dense_rank().over(w).alias("dense"))


@query("WITH r AS (SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE list_contains([CAST(trunc(floor(0.12 * n) + (floor(0.88 * n) - floor(0.12 * n)) * k / 5) AS BIGINT) FOR k IN range(6)], i)", "lineitem")
def representative_picks(t):
    return Q.spread_picks(t, ["l_suppkey"], ["l_quantity", "l_orderkey", "l_linenumber"], 6).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("WITH r AS (SELECT o_orderstatus, o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS a, o_totalprice FROM orders), s AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS b FROM r WHERE a <= 2) SELECT o_orderstatus, o_orderpriority, o_orderkey FROM s WHERE b <= 8", "orders")
def confident_picks(t):
    d = J.top_per_key(t, ["o_orderstatus", "o_orderpriority"], [F.desc("o_totalprice"), "o_orderkey"], 2).drop("rank")
    return J.top_per_key(d, ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 8).select("o_orderstatus", "o_orderpriority", "o_orderkey")


@query("SELECT p_brand, n_removed, round(f, 6) AS removed_fraction FROM (SELECT p_brand, count(*) FILTER (p_size < 10) AS n_removed, avg((p_size < 10)::INT) AS f FROM part GROUP BY 1) ORDER BY round(f, 12) DESC, n_removed DESC, p_brand LIMIT 10", "part")
def preview_topk(t):
    s = t.groupBy("p_brand").agg(F.count_if(F.col("p_size") < 10).alias("n_removed"), F.avg((F.col("p_size") < 10).cast("double")).alias("removed_fraction"))
    return s.orderBy(F.desc(F.round("removed_fraction", 12)), F.desc("n_removed"), "p_brand").limit(10)


@query("WITH r AS (SELECT l_suppkey, (rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2) / count(*) OVER (PARTITION BY l_suppkey) AS a, (rank() OVER (PARTITION BY l_suppkey ORDER BY l_tax) + (count(*) OVER (PARTITION BY l_suppkey, l_tax) - 1) / 2) / count(*) OVER (PARTITION BY l_suppkey) AS b FROM lineitem) SELECT CAST(least(floor(a * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(b), 6) AS b FROM r GROUP BY 1", "lineitem")
def rank_pooling(t):
    from pyspark.sql import Window

    t = dealt(t.select("l_suppkey", "l_quantity", "l_tax"), "l_suppkey")
    n = F.count("*").over(Window.partitionBy("l_suppkey"))
    r = t.select((S.average_rank("l_quantity", "l_suppkey") / n).alias("a"), (S.average_rank("l_tax", "l_suppkey") / n).alias("b"))
    return r.groupBy(F.least(F.floor(F.col("a") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("b").alias("b"))


@query("SELECT s_name, CAST(row_number() OVER (ORDER BY CASE WHEN s_nationkey = 3 THEN 1 WHEN s_nationkey = 1 THEN 2 ELSE 3 END, abs(s_acctbal) DESC NULLS LAST, CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT)) AS INTEGER) AS place FROM supplier", "supplier")
def ordered_report(t):
    from pyspark.sql import Window

    order = [M.place_in(F.col("s_nationkey").cast("string"), ["3", "1"]), F.desc_nulls_last(F.abs("s_acctbal")), M.suffix_number(F.col("s_name"))]
    return t.select("s_name", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("place"))  # a report: a row for each supplier


@query("SELECT l_returnflag, round(min_by(l_extendedprice, l_orderkey * 10 + l_linenumber), 6) AS first_price, max_by(l_orderkey, l_extendedprice * 1000000 + l_linenumber) IS NOT NULL AS has_max FROM lineitem GROUP BY 1", "lineitem")
def argmin_argmax(t):
    return t.groupBy("l_returnflag").agg(F.min_by("l_extendedprice", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_price"), F.max_by("l_orderkey", F.col("l_extendedprice") * 1000000 + F.col("l_linenumber")).isNotNull().alias("has_max"))


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier", "customer", "supplier")
def union_all(c, s):
    return c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")).unionByName(s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 1", "part")
def duplicate_detect(t):
    return J.duplicates(t, ["p_brand", "p_size"])


@query("SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT n_nationkey, 'only' FROM nation EXCEPT SELECT s_nationkey, 'only' FROM supplier)", "customer", "supplier", "nation")
def set_operations(c, s, n):
    k = s.select(F.col("s_nationkey").alias("k"))
    both = c.select(F.col("c_nationkey").alias("k")).intersect(k).withColumn("side", F.lit("both"))
    return both.unionByName(n.select(F.col("n_nationkey").alias("k")).exceptAll(k.distinct()).withColumn("side", F.lit("only")))


@query("SELECT l_returnflag, round(median(l_quantity) FILTER (l_linestatus = 'F'), 6) AS \"F\", round(median(l_quantity) FILTER (l_linestatus = 'O'), 6) AS \"O\" FROM lineitem GROUP BY 1", "lineitem")
def pivot_medians(t):
    return t.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.median("l_quantity"))


# ---- functions ----


@query(f"WITH p AS (SELECT p_partkey, CAST(p_size * 2 AS DOUBLE) AS a, CAST(p_size - 25 AS DOUBLE) AS b, p_retailprice AS c FROM part) SELECT p_partkey, round(CASE WHEN b <> 0 THEN a / b END, 6) AS div, round(CASE WHEN b > 0 THEN a / b END, 6) AS safe, round(4 * pi() * a / (c * c), 6) AS circularity, round(greatest(a, c) / least(a, c), 6) AS box, round(CASE WHEN a > 0 AND b > 0 THEN a / b END, 6) AS ratio, round(CASE WHEN a > 0 AND b > 0 THEN log2(a / b) END, 6) AS log2, round(CASE WHEN b >= 0 THEN ln(1 + b) END, 6) AS log1p, round(CASE WHEN b > 0 THEN ln(b) END, 6) AS log, round(a * 0.25, 6) AS um, round(a * 0.25 * 0.25, 6) AS um2 FROM p", "part")
def shape_functions(t):
    p = t.select("p_partkey", (F.col("p_size") * 2.0).alias("a"), (F.col("p_size") - 25.0).alias("b"), F.col("p_retailprice").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return p.select("p_partkey", M.nonzero_div(a, b).alias("div"), M.safe_div(a, b).alias("safe"), M.circularity(a, c).alias("circularity"), M.box_aspect(a, c).alias("box"), M.positive_ratio(a, b).alias("ratio"), M.log2_ratio(a, b).alias("log2"), M.transformed(b, "log1p").alias("log1p"), M.transformed(b, "log").alias("log"), (a * 0.25).alias("um"), (a * 0.25 * 0.25).alias("um2"))


@query("WITH q AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, min(value) AS a, max(value) AS b FROM events) SELECT event_id, round(power(least(greatest((value - lo) / (hi - lo), 0), 1), 0.85), 6) AS unit, CAST(round_even(least(greatest((value - a) / greatest(b - a, 1e-6), 0), 1) * 255, 0) AS INTEGER) AS even, CAST(floor(least(greatest((value - a) / greatest(b - a, 1e-6), 0), 1) * 255) AS INTEGER) AS cut FROM events, q", "events")
def quantile_stretch(t):
    whole = F.percentile("value", F.array(F.lit(0.02), F.lit(0.98)))
    q = t.agg(F.get(whole, F.lit(0)).alias("lo"), F.get(whole, F.lit(1)).alias("hi"), F.min("value").alias("a"), F.max("value").alias("b"))
    v, lo, hi, a, b = (F.col(x) for x in ("value", "lo", "hi", "a", "b"))
    return t.crossJoin(F.broadcast(q)).select("event_id", M.stretched(v, lo, hi, a, b, 0.85).alias("unit"), M.to_uint8(v, a, b).alias("even"), M.to_uint8(v, a, b, even=False).alias("cut"))


_ST = "SELECT event_id, user_id % 3 = 0 AS edge, value / 100 AS d, 1 - value / 100 AS u, (event_id % 100) / 100.0 AS m FROM events WHERE value IS NOT NULL"


def _states(t):
    return t.where("value IS NOT NULL").select("event_id", (F.col("user_id") % 3 == 0).alias("edge"), (F.col("value") / 100).alias("d"), (1 - F.col("value") / 100).alias("u"), (F.col("event_id") % 100 / 100).alias("m"))


_STATE = "CASE WHEN d >= 0.80 THEN 'deviated' WHEN u >= 0.65 THEN 'undifferentiated' WHEN d >= 0.62 AND d - u >= 0.08 AND m >= 0.52 THEN 'deviated' ELSE 'uncertain' END"


@query(f"WITH s AS ({_ST}) SELECT event_id, {_STATE} AS state FROM s", "events")
def state_rules(t):
    return _states(t).select("event_id", M.state_label(F.col("d"), F.col("u"), F.col("m")).alias("state"))


@query(f"WITH s AS (SELECT *, {_STATE} AS b FROM ({_ST})), e AS (SELECT *, CASE WHEN NOT edge THEN b WHEN b = 'deviated' AND d >= 0.8 AND m >= 0.52 THEN 'deviated' WHEN b = 'deviated' AND u >= 0.72 AND m <= 0.4 THEN 'undifferentiated' WHEN b = 'deviated' THEN 'uncertain' ELSE b END AS a FROM s) SELECT event_id, a AS state, a <> b AS changed, CASE WHEN NOT edge THEN 'unchanged' WHEN b = 'deviated' AND d >= 0.8 AND m >= 0.52 THEN 'edge_red_kept_dual_strong' WHEN b = 'deviated' AND u >= 0.72 AND m <= 0.4 THEN 'edge_red_relabel_undiff_dual_support' WHEN b = 'deviated' AND d <= 0.74 AND m <= 0.35 THEN 'edge_red_downgraded_density_like' WHEN b = 'deviated' THEN 'edge_red_downgraded_intermediate' WHEN b = 'undifferentiated' THEN 'edge_green_kept' ELSE 'edge_uncertain_kept' END AS reason FROM e", "events")
def edge_veto(t):
    s = _states(t).withColumn("b", M.state_label(F.col("d"), F.col("u"), F.col("m")))
    after, why = M.edge_veto(F.col("b"), F.col("edge"), F.col("d"), F.col("u"), F.col("m"))
    return s.select("event_id", after.alias("state"), (after != F.col("b")).alias("changed"), why.alias("reason"))


@query(f"WITH s AS (SELECT *, {_STATE} AS b FROM ({_ST})) SELECT event_id, CASE b WHEN 'deviated' THEN 'cluster2' WHEN 'undifferentiated' THEN 'cluster1' ELSE 'uncertain' END AS label, CASE b WHEN 'deviated' THEN '1' WHEN 'undifferentiated' THEN '0' END AS binary, CAST(least(floor(least(greatest(d, 0), 1) * 16), 15) AS INTEGER) AS bin FROM s", "events")
def label_vocabulary(t):
    s = _states(t).withColumn("b", M.state_label(F.col("d"), F.col("u"), F.col("m")))
    return s.select("event_id", M.mapped(F.col("b"), {"deviated": "cluster2", "undifferentiated": "cluster1"}, "uncertain").alias("label"), M.mapped(F.col("b"), {"deviated": "1", "undifferentiated": "0"}).alias("binary"), M.histogram_bin(F.least(F.greatest(F.col("d"), F.lit(0.0)), F.lit(1.0))).alias("bin"))


@query("WITH s AS (SELECT event_id, least(greatest(value / 100, 0), 1) AS d FROM events WHERE value IS NOT NULL), r AS (SELECT event_id, d, CASE WHEN d <= 0.5 THEN 40 * 2 * d ELSE 40 + 160 * (2 * d - 1) END AS red, CASE WHEN d <= 0.5 THEN 160 - 60 * 2 * d ELSE 100 - 80 * (2 * d - 1) END AS green FROM s) SELECT event_id, CAST(round(red) AS INTEGER) AS red, CAST(round(green) AS INTEGER) AS green FROM r", "events")
def colour_ramp(t):
    c = M.ramp(F.col("value") / 100, [(0, 160, 0), (40, 100, 0), (200, 20, 0)])
    return t.where("value IS NOT NULL").select("event_id", c[0].alias("red"), c[1].alias("green"))


@query(f"WITH s AS (SELECT *, 1 AS resolved FROM ({_ST})) SELECT event_id, round(d, 6) AS deviated, round(u, 6) AS undifferentiated, round(d - u, 6) AS margin, CASE WHEN d >= 0.8 THEN 'cluster2' WHEN u >= 0.65 THEN 'cluster1' ELSE 'uncertain' END AS label FROM s", "events")
def orientation_relabel(t):
    s = _states(t).withColumn("p0", F.col("u")).withColumn("p1", F.col("d"))
    return S.oriented(s, F.lit(1), ["p0", "p1"]).select("event_id", "deviated", "undifferentiated", "margin", "label")


@query("SELECT user_id, round(-sum(p * log2(p)), 6) AS bits FROM (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM (SELECT user_id, least(floor(least(greatest(value / 100, 0), 1) * 16), 15) AS b, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL)) GROUP BY 1", "events")
def intensity_entropy(t):
    b = t.where("value IS NOT NULL").select("user_id", M.histogram_bin(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))).alias("b"))
    return C.shares(b, ["user_id"], "b").groupBy("user_id").agg((-F.sum(F.col("share") * F.log2("share"))).alias("bits"))


@query("WITH q AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.995) AS hi FROM events WHERE value > 0 GROUP BY 1) SELECT event_id, round(least(greatest((value - lo) / greatest(hi - lo, 1e-6), 0), 1), 6) AS unit FROM events JOIN q USING (event_type)", "events")
def positive_normalise(t):
    whole = F.percentile("value", F.array(F.lit(0.01), F.lit(0.995)))
    q = t.where("value > 0").groupBy("event_type").agg(F.get(whole, F.lit(0)).alias("lo"), F.get(whole, F.lit(1)).alias("hi"))
    x = (F.col("value") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    return t.join(stored(q, "stretch-ends"), "event_type").select("event_id", F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)).alias("unit"))


@query("WITH z AS (SELECT l_suppkey, (l_quantity - avg(l_quantity) OVER w) / nullif(stddev_pop(l_quantity) OVER w, 0) AS a, (l_tax - avg(l_tax) OVER w) / nullif(stddev_pop(l_tax) OVER w, 0) AS b FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)) SELECT l_suppkey, round(avg(a * b), 6) AS r FROM z GROUP BY 1", "lineitem")
def zscore_correlation(t):
    return t.groupBy("l_suppkey").agg(S.pearson("l_quantity", "l_tax").alias("r"))


@query("WITH m AS (SELECT p_brand, avg(p_size) AS mx, avg(p_retailprice) AS my, var_samp(p_size) AS a, var_samp(p_retailprice) AS c, covar_samp(p_size, p_retailprice) AS b FROM part GROUP BY 1), t AS (SELECT *, 0.5 * atan2(2 * b, a - c) AS th FROM m), s AS (SELECT *, CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN sign(cos(th)) ELSE sign(sin(th)) END AS g FROM t) SELECT p_partkey, round(g * ((p_size - mx) * cos(th) + (p_retailprice - my) * sin(th)), 6) AS u, round(g * (-(p_size - mx) * sin(th) + (p_retailprice - my) * cos(th)), 6) AS v FROM part JOIN s USING (p_brand)", "part")
def rigid_rotation(t):
    return S.rotated(t, ["p_brand"], "p_size", "p_retailprice").select("p_partkey", "u", "v")


@query("SELECT p_partkey, p_brand || '__cell_' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 5, '0') AS cell_id, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size % 10 AS INTEGER) ELSE -1 END AS day, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey % 10 AS INTEGER) ELSE -1 END AS regimen, ['low', 'mid', 'high'][p_size % 3 + 1] AS dose FROM part", "part")
def identifiers(t):
    code = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("D"), F.col("p_size") % 10, F.col("p_partkey") % 10, F.lit("D"))).otherwise("none")
    day, regimen = M.stage_code(code)
    return t.select("p_partkey", M.cell_id(F.col("p_brand"), F.col("p_partkey") % 10000).alias("cell_id"), F.coalesce(day, F.lit(-1)).alias("day"), F.coalesce(regimen, F.lit(-1)).alias("regimen"), M.mapped((F.col("p_size") % 3).cast("string"), {"0": "low", "1": "mid", "2": "high"}).alias("dose"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_extract_string(props, '$.none') IS NULL AS absent FROM events", "events")
def json_fields(t):
    return t.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").isNull().alias("absent"))


@query("WITH c AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1) SELECT CAST(CAST(arg_max(day, round(v, 6)) AS DATE) AS VARCHAR) AS peak, round(max(v) / sum(v), 6) AS share FROM c", "events")
def z_peak(t):
    d = t.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    return d.agg(F.max_by("day", F.round("v", 6)).cast("string").alias("peak"), (F.max("v") / F.sum("v")).alias("share"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((), (l_returnflag), (l_returnflag, l_linestatus))", "lineitem")
def grouping_sets(t):
    return t.groupingSets([[], ["l_returnflag"], ["l_returnflag", "l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean"))
