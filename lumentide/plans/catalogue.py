"""All queries of the measurement operators, with their twins in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumentide.functions import measures as M
from lumentide.operators import joins as J
from lumentide.operators import quality as Q
from lumentide.operators import raster as X
from lumentide.operators import spatial as P
from lumentide.operators import summaries as S
from lumentide.operators.quantiles import exact_quantiles, spread_quantiles, spread_ranks
from lumentide.operators.tables import dealt

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, as the oracles have them: sums may differ in their last bits by order."""
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None, *tables: str):
    """Registers a plan over some tables under its function's name, with its SQL."""

    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, d: _rounded(f(*(_table(spark, d, t) for t in tables)))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def R(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


def _pop(f: str) -> str:
    q = lambda p: f"quantile_cont({f}, {p})"
    out = f"count({f}) AS {f}_n, round(avg({f}), 6) AS {f}_mean, round(median({f}), 6) AS {f}_median, round(stddev_samp({f}), 6) AS {f}_std, round({q(0.75)} - {q(0.25)}, 6) AS {f}_iqr, round(stddev_samp({f}) / nullif(abs(avg({f})), 0), 6) AS {f}_cv"
    return out + "".join(f", round({q(p)}, 6) AS {f}_q{round(p * 100)}" for p in S.QUANTILES)


@query(f"SELECT l_returnflag, count(*) AS n_cells, {', '.join(map(_pop, _FEATURES))} FROM lineitem GROUP BY 1", "lineitem")
def population_summary(t):
    return S.population_summary(t, ["l_returnflag"], _FEATURES)


@query(f"SELECT l_returnflag, count(l_extendedprice) AS n, {', '.join(f'round(quantile_cont(l_extendedprice, {p}), 6) AS q{round(100 * p)}' for p in S.QUANTILES)} FROM lineitem GROUP BY 1", "lineitem")
def population_quantiles_spread(t):
    q = spread_quantiles(t, ["l_returnflag"], "l_extendedprice", S.QUANTILES)
    return q.select("l_returnflag", "n", *(F.col("q")[i].alias(f"q{round(100 * p)}") for i, p in enumerate(S.QUANTILES)))


@query(f"WITH n AS (SELECT user_id, event_type, count(*) n FROM events WHERE event_type IS NOT NULL GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM n), r AS (SELECT user_id, -sum(p * ln(p)) AS entropy, count(*) AS n_categories FROM p GROUP BY 1) SELECT user_id, n_categories, {R('entropy')} FROM r", "events")
def population_category_entropy(t):
    return S.category_entropy(t, "user_id", "event_type")


@query(f"SELECT l_suppkey, count(*) AS n, {', '.join(f'round(avg({f}), 6) AS {f}_mean, round(coalesce(stddev_samp({f}), 0), 6) AS {f}_std, round(median({f}), 6) AS {f}_median' for f in _FEATURES)}, round(count(*) / 2.5, 6) AS density FROM lineitem GROUP BY 1", "lineitem")
def image_level_summary(t):
    aggs = [e for f in _FEATURES for e in (F.avg(f).alias(f"{f}_mean"), F.coalesce(F.stddev_samp(f), F.lit(0.0)).alias(f"{f}_std"), F.median(f).alias(f"{f}_median"))]
    return t.groupBy("l_suppkey").agg(F.count("*").alias("n"), *aggs, M.safe_div(F.count("*").cast("double"), F.lit(2.5)).alias("density"))


@query("WITH m AS (SELECT median(l_extendedprice) m, quantile_cont(l_extendedprice, 0.95) q FROM lineitem), d AS (SELECT median(abs(l_extendedprice - m)) mad, any_value(m) m, any_value(q) q FROM lineitem, m) SELECT round(mad, 6) AS mad, round(CASE WHEN mad > 0 THEN m + 3 * mad ELSE q END, 6) AS threshold FROM d", "lineitem")
def robust_thresholds(t):
    return S.upper_threshold(t, "l_extendedprice")


_CELLS = "SELECT p_partkey, p_brand, (p_partkey * 37) % 500 AS min_row, (p_partkey * 61) % 500 AS min_col, (p_partkey * 37) % 500 + p_size AS max_row, (p_partkey * 61) % 500 + p_size AS max_col FROM part"


def _cells(part: DataFrame) -> DataFrame:
    r, c = F.col("p_partkey") * 37 % 500, F.col("p_partkey") * 61 % 500
    return part.select("p_partkey", "p_brand", r.alias("min_row"), c.alias("min_col"), (r + F.col("p_size")).alias("max_row"), (c + F.col("p_size")).alias("max_col"))


@query(f"WITH c AS ({_CELLS}), g AS (SELECT *, least(min_row, min_col, 500 - max_row, 500 - max_col) AS image_edge_gap_px FROM c) SELECT p_partkey, image_edge_gap_px, image_edge_gap_px <= 0 AS touches_border, image_edge_gap_px > 5 AS qc_keep, CASE WHEN image_edge_gap_px <= 0 THEN 'touches_border' WHEN image_edge_gap_px <= 5 THEN 'within_5px_image_edge' ELSE 'keep' END AS qc_reason FROM g", "part")
def edge_qc(t):
    return Q.edge_qc(_cells(t), 500, 500, 5).select("p_partkey", "image_edge_gap_px", "touches_border", "qc_keep", "qc_reason")


def _flags(part):
    rules = [(F.col("p_size") < 5, "too_small"), (F.col("p_size") > 45, "too_large"), (F.col("p_retailprice") > 1900, "bright"), (F.col("p_name").isNull(), "unnamed")]
    return part.select("p_partkey", "p_brand", Q.reasons(rules).alias("qc_reasons"))


_FLAGS = "SELECT p_partkey, p_brand, array_to_string(list_sort(list_filter([CASE WHEN p_size < 5 THEN 'too_small' END, CASE WHEN p_size > 45 THEN 'too_large' END, CASE WHEN p_retailprice > 1900 THEN 'bright' END, CASE WHEN p_name IS NULL THEN 'unnamed' END], lambda x: x IS NOT NULL)), ';') AS qc_reasons FROM part"


@query(f"WITH f AS ({_FLAGS}) SELECT p_partkey, qc_reasons, qc_reasons = '' AS qc_keep FROM f", "part")
def qc_flags(t):
    return _flags(t).select("p_partkey", "qc_reasons", (F.col("qc_reasons") == "").alias("qc_keep"))


@query(f"WITH f AS ({_FLAGS}) SELECT p_brand, count(*) AS n, count(*) FILTER (qc_reasons = '') AS n_kept, round(avg(CASE WHEN qc_reasons = '' THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM f GROUP BY 1", "part")
def qc_image_summary(t):
    return Q.keep_summary(_flags(t), ["p_brand"], F.col("qc_reasons") == "")


@query(f"WITH f AS ({_FLAGS}), e AS (SELECT p_brand, unnest(string_split(qc_reasons, ';')) AS reason FROM f WHERE qc_reasons <> '') SELECT p_brand, reason, count(*) AS n FROM e GROUP BY ALL", "part")
def qc_reason_counts(t):
    return Q.reason_counts(_flags(t), "p_brand", "qc_reasons")


@query("WITH q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.25) FILTER (l_linestatus <> 'O') q1, quantile_cont(l_quantity, 0.75) FILTER (l_linestatus <> 'O') q3 FROM lineitem GROUP BY 1), l AS (SELECT l_returnflag, greatest(2.0, q1 - 0.5 * (q3 - q1)) lo, least(45.0, q3 + 0.5 * (q3 - q1)) hi FROM q) SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'border' WHEN l_quantity < lo THEN 'small' WHEN l_quantity > hi THEN 'large' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem JOIN l USING (l_returnflag) GROUP BY ALL", "lineitem")
def tukey_limits(t):
    return Q.tukey_limits(t, "l_returnflag", "l_quantity", F.col("l_linestatus") == "O", 0.5, 0.5, 2, 45)


@query("WITH q AS (SELECT quantile_cont(c_acctbal, 0.25) a, quantile_cont(c_acctbal, 0.75) b FROM customer) SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal FROM customer, q WHERE c_acctbal BETWEEN a - 0.3 * (b - a) AND b + 0.3 * (b - a)", "customer")
def iqr_trim(t):
    return Q.iqr_trim(t, "c_acctbal", 0.3).select("c_custkey", "c_acctbal")


@query(f"WITH u AS (UNPIVOT (SELECT l_returnflag, {', '.join(_FEATURES)} FROM lineitem) ON {', '.join(_FEATURES)} INTO NAME metric VALUE value) SELECT l_returnflag, metric, count(value) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM u GROUP BY ALL", "lineitem")
def field_descriptive_long(t):
    return S.field_descriptive(t, ["l_returnflag"], _FEATURES)


_PAIRS = [("A", "N"), ("R", "N"), ("R", "A")]


@query("WITH s AS (SELECT l_linestatus, l_returnflag, median(l_extendedprice) v FROM lineitem GROUP BY ALL), w(treated, reference) AS (VALUES ('A', 'N'), ('R', 'N'), ('R', 'A')) SELECT a.l_linestatus, treated, reference, round(a.v - b.v, 6) AS difference, round(100 * (a.v - b.v) / nullif(abs(b.v), 0), 6) AS percent_change FROM w JOIN s a ON a.l_returnflag = treated JOIN s b ON b.l_returnflag = reference AND a.l_linestatus = b.l_linestatus", "lineitem")
def same_density_contrasts(t):
    s = t.groupBy("l_linestatus", "l_returnflag").agg(F.median("l_extendedprice").alias("v"))
    return S.contrasts(s, "l_linestatus", "l_returnflag", "v", _PAIRS)


@query("WITH n AS (SELECT p_brand, p_type, count(*) n FROM part GROUP BY ALL), t AS (SELECT p_brand, count(*) total FROM part GROUP BY 1), c AS (SELECT DISTINCT p_type FROM part) SELECT t.p_brand, c.p_type, coalesce(n, 0) AS n, round(coalesce(n, 0) / total, 6) AS fraction FROM t CROSS JOIN c LEFT JOIN n ON n.p_brand = t.p_brand AND n.p_type = c.p_type", "part")
def composition_zero_filled(t):
    return S.composition(t, ["p_brand"], "p_type")


@query("WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) n FROM orders GROUP BY ALL), f AS (SELECT *, n / sum(n) OVER (PARTITION BY o_orderstatus) AS f FROM n) SELECT a.o_orderpriority, 'F' AS treated, 'O' AS reference, round(a.f - b.f, 6) AS difference, round(100 * (a.f - b.f), 6) AS points FROM f a JOIN f b USING (o_orderpriority) WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'", "orders")
def composition_contrasts(t):
    c = S.composition(t, ["o_orderstatus"], "o_orderpriority")
    d = S.contrasts(c, "o_orderpriority", "o_orderstatus", "fraction", [("F", "O")])
    return d.select("o_orderpriority", "treated", "reference", "difference", (100 * F.col("difference")).alias("points"))


_EFFECT = "q AS (SELECT l_linestatus, l_returnflag, median({f}) m, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) i FROM lineitem GROUP BY ALL), e AS (SELECT q.l_linestatus, q.l_returnflag, (q.m - c.m) / CASE WHEN c.i > 1e-12 THEN c.i END AS effect FROM q JOIN q c ON c.l_linestatus = q.l_linestatus AND c.l_returnflag = 'A')"


@query(f"WITH {_EFFECT.format(f='l_extendedprice')} SELECT l_linestatus, l_returnflag, {R('effect')} FROM e", "lineitem")
def group_effects(t):
    return S.control_effects(t, "l_linestatus", "l_returnflag", "A", "l_extendedprice")


@query(f"WITH {_EFFECT.format(f='l_extendedprice')} SELECT l_returnflag, round(median(effect), 6) AS median, round(min(effect), 6) AS least, round(max(effect), 6) AS most, count(*) FILTER (effect < 0) AS n_negative, count(*) FILTER (effect > 0) AS n_positive FROM e GROUP BY 1", "lineitem")
def effects_across_strata(t):
    e = S.control_effects(t, "l_linestatus", "l_returnflag", "A", "l_extendedprice")
    return e.groupBy("l_returnflag").agg(F.median("effect").alias("median"), F.min("effect").alias("least"), F.max("effect").alias("most"), F.count_if(F.col("effect") < 0).alias("n_negative"), F.count_if(F.col("effect") > 0).alias("n_positive"))


@query("WITH " + ", ".join(_EFFECT.format(f=f).replace("q AS", f"q{i} AS").replace("FROM q ", f"FROM q{i} q ").replace("JOIN q c", f"JOIN q{i} c").replace("e AS", f"e{i} AS") for i, f in enumerate(_FEATURES)) + ", u AS (" + " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(len(_FEATURES))) + ") SELECT l_linestatus, l_returnflag, round(sqrt(avg(effect * effect)), 6) AS deviation FROM u GROUP BY ALL", "lineitem")
def condition_deviation(t):
    parts = [S.control_effects(t, "l_linestatus", "l_returnflag", "A", f) for f in _FEATURES]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return u.groupBy("l_linestatus", "l_returnflag").agg(F.sqrt(F.avg(F.col("effect") * F.col("effect"))).alias("deviation"))


def _mad_sql(f: str) -> str:
    return f"m AS (SELECT l_linestatus, l_returnflag, abs({f} - median({f}) OVER (PARTITION BY l_linestatus, l_returnflag)) d FROM lineitem), g AS (SELECT l_linestatus, l_returnflag, median(d) mad FROM m GROUP BY ALL)"


@query(f"WITH {_mad_sql('l_extendedprice')} SELECT g.l_linestatus, g.l_returnflag, round(g.mad, 6) AS mad, round(CASE WHEN g.mad > 0 AND c.mad > 0 THEN -log2(g.mad / c.mad) END, 6) AS gain FROM g LEFT JOIN g c ON c.l_linestatus = g.l_linestatus AND c.l_returnflag = 'A'", "lineitem")
def uniformity_feature(t):
    return S.dispersion(t, "l_linestatus", "l_returnflag", "A", "l_extendedprice")


def _multi_sql(features: list[str]) -> str:
    st = ", ".join(f"median({f}) m{i}, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) i{i}" for i, f in enumerate(features))
    sc = ", ".join(f"CASE WHEN i{i} > 1e-12 THEN ({f} - m{i}) / i{i} END z{i}" for i, f in enumerate(features))
    pt = ", ".join(f"power(z{i} - median(z{i}) OVER (PARTITION BY l_linestatus, l_returnflag), 2) p{i}" for i in range(len(features)))
    s, n = " + ".join(f"coalesce(p{i}, 0)" for i in range(len(features))), " + ".join(f"(p{i} IS NOT NULL)::INT" for i in range(len(features)))
    return f"s AS (SELECT l_linestatus, {st} FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), z AS (SELECT l_linestatus, l_returnflag, {sc} FROM lineitem JOIN s USING (l_linestatus)), p AS (SELECT l_linestatus, l_returnflag, {pt} FROM z), d AS (SELECT l_linestatus, l_returnflag, median(CASE WHEN {n} > 0 THEN sqrt(({s}) / ({n})) END) dispersion FROM p GROUP BY ALL), o AS (SELECT d.l_linestatus, d.l_returnflag, d.dispersion, CASE WHEN d.dispersion > 0 AND c.dispersion > 0 THEN -log2(d.dispersion / c.dispersion) END AS gain FROM d LEFT JOIN d c ON c.l_linestatus = d.l_linestatus AND c.l_returnflag = 'A')"


@query(f"WITH {_multi_sql(_FEATURES)} SELECT l_linestatus, l_returnflag, {R('dispersion', 'gain')} FROM o", "lineitem")
def uniformity_multivariate(t):
    return S.multivariate_dispersion(t, "l_linestatus", "l_returnflag", "A", _FEATURES)


@query(" UNION ALL ".join(f"(WITH {_multi_sql([g for g in _FEATURES if g != f])} SELECT '{f}' AS omitted, l_linestatus, l_returnflag, {R('dispersion', 'gain')} FROM o)" for f in _FEATURES), "lineitem")
def uniformity_leave_one_out(t):
    panels = {f: [g for g in _FEATURES if g != f] for f in _FEATURES}
    return S.panel_dispersions(t, "l_linestatus", "l_returnflag", "A", panels).withColumnRenamed("panel", "omitted")


_RANKS = "SELECT {by}l_quantity x, l_extendedprice y, rank() OVER ({p}ORDER BY l_quantity) + (count(*) OVER (PARTITION BY {by}l_quantity) - 1) / 2 rx, rank() OVER ({p}ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY {by}l_extendedprice) - 1) / 2 ry FROM lineitem"
_RHO = "CASE WHEN count(*) >= 3 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) END"


@query(f"WITH r AS ({_RANKS.format(by='', p='')}) SELECT count(*) AS n, round({_RHO}, 6) AS rho FROM r", "lineitem")
def spearman_pooled(t):
    d = t.select("l_quantity", "l_extendedprice").where("l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL")
    d = spread_ranks(spread_ranks(d, "l_quantity", "rx"), "l_extendedprice", "ry")  # ranks by ranges: no order over all rows in one task
    return d.agg(F.count("*").alias("n"), S.pearson("rx", "ry").alias("rho"))


@query(f"WITH r AS ({_RANKS.format(by='l_suppkey, ', p='PARTITION BY l_suppkey ')}), f AS (SELECT l_suppkey, count(*) n, {_RHO} rho FROM r GROUP BY 1 HAVING count(*) >= 20) SELECT count(*) AS n_fields, round(median(rho), 6) AS median_rho, round(quantile_cont(rho, 0.25), 6) AS q25, round(quantile_cont(rho, 0.75), 6) AS q75, round(avg(CASE WHEN rho > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive FROM f", "lineitem")
def spearman_within_field(t):
    f = S.spearman(t, ["l_suppkey"], "l_quantity", "l_extendedprice", 20)
    return f.agg(F.count("*").alias("n_fields"), F.median("rho").alias("median_rho"), F.percentile("rho", 0.25).alias("q25"), F.percentile("rho", 0.75).alias("q75"), F.avg(F.when(F.col("rho") > 0, 1.0).otherwise(0.0)).alias("positive"))


@query(f"WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) c FROM lineitem), r AS ({_RANKS.format(by='l_suppkey, ', p='PARTITION BY l_suppkey ').replace('FROM lineitem', ', c FROM c WHERE c >= 4')}), p AS (SELECT rx / c rx, ry / c ry FROM r) SELECT count(*) AS n, round({_RHO}, 6) AS rho FROM p", "lineitem")
def spearman_stratified(t):
    c = F.count("*").over(Window.partitionBy("l_suppkey"))
    d = dealt(t.select("l_suppkey", "l_quantity", "l_extendedprice"), "l_suppkey").withColumn("c", c).where("c >= 4").withColumn("rx", S.average_rank("l_quantity", "l_suppkey") / F.col("c")).withColumn("ry", S.average_rank("l_extendedprice", "l_suppkey") / F.col("c"))
    return d.agg(F.count("*").alias("n"), S.pearson("rx", "ry").alias("rho"))


@query(f"WITH r AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey) rx, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_suppkey) ry FROM lineitem) SELECT count(*) AS n, round({_RHO}, 6) AS r FROM r", "lineitem")
def pearson_centred(t):
    w = Window.partitionBy("l_suppkey")
    d = t.select((F.col("l_quantity") - F.avg("l_quantity").over(w)).alias("rx"), (F.col("l_extendedprice") - F.avg("l_extendedprice").over(w)).alias("ry"))
    return d.agg(F.count("*").alias("n"), S.pearson("rx", "ry").alias("r"))


@query("WITH d AS (SELECT l_returnflag, ln(l_quantity) lx, ln(l_extendedprice) ly FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0) SELECT l_returnflag, count(*) AS n, round(regr_slope(ly, lx), 6) AS slope, round(regr_intercept(ly, lx), 6) AS intercept, round(power(covar_pop(lx, ly), 2) / nullif(var_pop(lx) * var_pop(ly), 0), 6) AS r2 FROM d GROUP BY 1", "lineitem")
def log_log_ols(t):
    return S.log_log_fit(t, ["l_returnflag"], "l_quantity", "l_extendedprice")


@query("WITH m AS (SELECT min(value) lo, max(value) hi FROM events), b AS (SELECT CAST(least(greatest(ceil((value - lo) / ((hi - lo) / 10)), 1), 10) AS INTEGER) AS bin, event_type FROM events, m WHERE value IS NOT NULL) SELECT bin, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM b GROUP BY 1", "events")
def equal_width_fraction(t):
    m = t.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    b = t.where("value IS NOT NULL").crossJoin(F.broadcast(m)).withColumn("bin", M.equal_width_bin(F.col("value"), F.col("lo"), F.col("hi"), 10))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).alias("fraction"))


@query("WITH e AS (SELECT l_suppkey, " + ", ".join(f"quantile_cont(l_quantity, {p}) e{i}" for i, p in enumerate((0, 0.25, 0.5, 0.75, 1))) + " FROM lineitem GROUP BY 1), d AS (SELECT l.*, e1, e3 FROM lineitem l JOIN e USING (l_suppkey) WHERE e0 < e1 AND e1 < e2 AND e2 < e3 AND e3 < e4) SELECT l_suppkey, round(median(l_extendedprice) FILTER (l_quantity > e3) - median(l_extendedprice) FILTER (l_quantity <= e1), 6) AS difference FROM d GROUP BY 1", "lineitem")
def quartile_difference(t):
    return S.quartile_difference(t, "l_suppkey", "l_quantity", "l_extendedprice")


_POINTS = "SELECT p_brand AS field, p_partkey AS id, CAST((p_partkey * 7919) % 1009 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 1013 AS DOUBLE) AS y, p_retailprice AS value FROM part"


def _points(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_brand").alias("field"), F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 1009).cast("double").alias("x"), (F.col("p_partkey") * 104729 % 1013).cast("double").alias("y"), F.col("p_retailprice").alias("value"))


_NN = f"p AS ({_POINTS}), d AS (SELECT a.field, a.id AS i, b.id AS j, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d, b.value AS v FROM p a JOIN p b ON a.field = b.field AND a.id <> b.id), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY field, i ORDER BY d, j) AS INTEGER) AS rank FROM d QUALIFY rank <= 6)"


@query(f"WITH {_NN} SELECT field, i, j, rank, {R('d')} FROM n", "part")
def knn6(t):
    return P.k_nearest(_points(t), 6).select("field", "i", "j", "rank", "d")


_CELL_POINTS = f"SELECT *, CAST(3 * p_size + 10 AS DOUBLE) AS area, (p_size % 10) / 10.0 AS circularity, (id % 100) / 100.0 AS eccentricity, 20.0 + p_size % 7 AS diameter FROM ({_POINTS.replace('AS value', 'AS value, p_size')})"


def _cell_points(part: DataFrame) -> DataFrame:
    p = _points(part).join(part.select(F.col("p_partkey").alias("id"), "p_size"), "id")
    return p.withColumns({"area": (3 * F.col("p_size") + 10).cast("double"), "circularity": F.col("p_size") % 10 / 10, "eccentricity": F.col("id") % 100 / 100, "diameter": 20.0 + F.col("p_size") % 7})


_NEAR = f"p AS ({_CELL_POINTS}), d AS (SELECT a.field, a.id AS i, b.id AS j, b.x - a.x AS dx, b.y - a.y AS dy, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d, a.area AS ai, b.area AS aj, b.value AS v, sqrt(power(a.circularity - b.circularity, 2) + power(a.eccentricity - b.eccentricity, 2)) AS shape FROM p a JOIN p b ON a.field = b.field AND a.id <> b.id), o AS (SELECT *, row_number() OVER (PARTITION BY field, i ORDER BY d, j) AS rank FROM d), n AS (SELECT *, max(CASE WHEN rank <= 6 THEN d END) OVER (PARTITION BY field, i) AS r FROM o QUALIFY d <= r + 1e-8)"


@query(f"WITH {_NEAR} SELECT field, i, j, {R('d')} FROM n", "part")
def radius_neighbours(t):
    return P.nearest_pairs(_points(t), 6).select("field", "i", "j", "d")


@query(f"WITH {_NEAR}, a AS (SELECT field, i AS id, count(*) AS c, min(d) AS nn1, avg(d) FILTER (rank <= 6) AS knn_mean, CASE WHEN count(*) FILTER (rank <= 6) = 1 THEN 0 ELSE stddev_samp(d) FILTER (rank <= 6) END AS knn_std, CASE WHEN max(r) > 0 THEN count(*) / (pi() * power(max(r), 2)) END AS density, CASE WHEN max(r) > 0 THEN sum(aj) / (pi() * power(max(r), 2)) END AS area_fraction, median(abs(ln(aj / ai))) AS size_disagreement, median(shape) AS shape_disagreement, sqrt(power(avg(CASE WHEN d > 0 THEN dx / d END), 2) + power(avg(CASE WHEN d > 0 THEN dy / d END), 2)) AS asymmetry, avg(v) AS nb_value_mean, CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(v) END AS nb_value_std FROM n GROUP BY ALL), m AS (SELECT field, 2.5 * median(diameter) AS radius FROM p GROUP BY 1), w AS (SELECT d.field, i AS id, count(*) AS n FROM d JOIN m USING (field) WHERE d <= radius GROUP BY ALL) SELECT p.field, p.id, coalesce(c, 0) AS neighbours, {R('nn1', 'knn_mean', 'knn_std', 'density', 'area_fraction', 'size_disagreement', 'shape_disagreement', 'asymmetry', 'nb_value_mean', 'nb_value_std')}, coalesce(w.n, 0) AS within FROM p LEFT JOIN a USING (field, id) LEFT JOIN w USING (field, id)", "part")
def neighbour_features(t):
    return P.neighbour_features(_cell_points(t), 6, features=("value",))


@query(f"WITH c AS (SELECT *, median(area) OVER (PARTITION BY field) AS m FROM ({_CELL_POINTS})) SELECT id, round(ln(area / m), 6) AS size_log_ratio, round(ln(greatest(1 + p_size / 40.0, 1)), 6) AS elongation_log, round((area / 2) / (2 * sqrt(pi() * area)) - 1, 6) AS boundary_irregularity, round(1 - circularity, 6) AS convexity_deficit, round(4 / value, 6) AS intensity_cv, round(10 / value, 6) AS intensity_range_ratio, round(x / diameter, 6) AS spacing_units FROM c", "part")
def composite_features(t):
    c = _cell_points(t).withColumns({"aspect_ratio": 1 + F.col("p_size") / 40, "perimeter": F.col("area") / 2, "solidity": F.col("circularity"), "intensity_std": F.lit(4.0), "intensity_mean": F.col("value"), "intensity_range": F.lit(10.0), "nn1": F.col("x")})
    return P.composite_features(c, "field").select("id", "size_log_ratio", "elongation_log", "boundary_irregularity", "convexity_deficit", "intensity_cv", "intensity_range_ratio", "spacing_units")


@query(f"WITH p AS ({_POINTS}) SELECT a.field, a.id AS i, count(*) AS n FROM p a JOIN p b ON a.field = b.field AND a.id <> b.id AND sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 60 GROUP BY ALL", "part")
def fixed_radius_count(t):
    return P.within_radius(_points(t), 60.0).groupBy("field", "i").agg(F.count("*").alias("n"))


@query(f"WITH p AS ({_CELL_POINTS}), m AS (SELECT field, 2.5 * median(diameter) AS radius FROM p GROUP BY 1) SELECT a.field, a.id AS i, count(*) AS n FROM p a JOIN p b ON a.field = b.field AND a.id <> b.id JOIN m ON m.field = a.field WHERE sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= radius GROUP BY ALL", "part")
def field_radius_count(t):
    p = _cell_points(t)
    radii = p.groupBy("field").agg((2.5 * F.median("diameter")).alias("radius"))
    return P.within_field_radius(p, radii).groupBy("field", "i").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, median(l_quantity) OVER g m, quantile_cont(l_quantity, 0.75) OVER g - quantile_cont(l_quantity, 0.25) OVER g i FROM lineitem WINDOW g AS (PARTITION BY l_suppkey)) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / greatest(i, 1e-9), 6) AS scaled FROM w", "lineitem")
def group_robust_scale(t):
    return t.select("l_orderkey", "l_linenumber", Q.robust_scale("l_quantity", ["l_suppkey"]).alias("scaled"))


@query("SELECT l_orderkey, l_linenumber, round((rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_suppkey, l_quantity) - 1) / 2) / count(*) OVER (PARTITION BY l_suppkey), 6) AS pct FROM lineitem", "lineitem")
def pct_rank_in_group(t):
    return t.select("l_orderkey", "l_linenumber", (S.average_rank("l_quantity", "l_suppkey") / F.count("*").over(Window.partitionBy("l_suppkey"))).alias("pct"))


@query("SELECT o_orderstatus, o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders QUALIFY rank <= 10", "orders")
def topk_per_group(t):
    return J.top_per_key(t, ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"], 10).select("o_orderstatus", "o_orderkey", "rank")


@query("SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1", "orders", "customer")
def validated_left_join(o, c):
    return J.left_join(o, c.withColumnRenamed("c_custkey", "o_custkey"), ["o_custkey"]).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("WITH c AS (SELECT c_nationkey k, count(*) a FROM customer GROUP BY 1), s AS (SELECT s_nationkey k, count(*) b FROM supplier GROUP BY 1) SELECT coalesce(c.k, s.k) AS nationkey, a AS n_customers, b AS n_suppliers, coalesce(a, 0) - coalesce(b, 0) AS diff FROM c FULL JOIN s ON c.k = s.k", "customer", "supplier")
def full_outer_counts(c, s):
    a = c.groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    b = s.groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nationkey", "full_outer").withColumn("diff", F.coalesce("n_customers", F.lit(0)) - F.coalesce("n_suppliers", F.lit(0)))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "customer", "orders")
def semi_join(c, o):
    return c.join(o.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)", "customer", "orders")
def anti_join(c, o):
    return c.join(o.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/(en|de|fr|es)/([0-9]+)', 1) AS scheme, regexp_extract(url, '^(https?)://([^/]+)/(en|de|fr|es)/([0-9]+)', 2) AS host, regexp_extract(url, '^(https?)://([^/]+)/(en|de|fr|es)/([0-9]+)', 3) AS lang, CASE WHEN url LIKE '%?%' THEN 'query' WHEN url LIKE '%#%' THEN 'fragment' ELSE 'plain' END AS kind FROM pages", "pages")
def folder_parse(t):
    pattern = r"^(https?)://([^/]+)/(en|de|fr|es)/([0-9]+)"
    kind = F.when(F.col("url").contains("?"), "query").when(F.col("url").contains("#"), "fragment").otherwise("plain")
    return t.select("page_id", *(F.regexp_extract("url", pattern, i).alias(n) for i, n in ((1, "scheme"), (2, "host"), (3, "lang"))), kind.alias("kind"))


@query("WITH g AS (SELECT event_type, avg(value) m FROM events GROUP BY 1), o AS (SELECT avg(value) m, stddev_pop(value) s FROM events) SELECT event_type, round((g.m - o.m) / nullif(o.s, 0), 6) AS z FROM g, o", "events")
def z_heatmap(t):
    o = t.agg(F.avg("value").alias("om"), F.stddev_pop("value").alias("os"))
    return t.groupBy("event_type").agg(F.avg("value").alias("m")).crossJoin(F.broadcast(o)).select("event_type", ((F.col("m") - F.col("om")) / F.nullif(F.col("os"), F.lit(0.0))).alias("z"))


@query("WITH g AS (SELECT l_returnflag, median(l_extendedprice) m FROM lineitem GROUP BY 1), o AS (SELECT median(l_extendedprice) m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) i FROM lineitem) SELECT l_returnflag, round((g.m - o.m) / nullif(o.i, 0), 6) AS profile FROM g, o", "lineitem")
def robust_profile(t):
    price = {"q": F.col("l_extendedprice")}
    o = exact_quantiles(t, [], price, (0.25, 0.5, 0.75)).select(F.col("q")[1].alias("om"), (F.col("q")[2] - F.col("q")[0]).alias("oi"))
    return exact_quantiles(t, ["l_returnflag"], price, (0.5,)).select("l_returnflag", F.col("q")[0].alias("m")).crossJoin(F.broadcast(o)).select("l_returnflag", ((F.col("m") - F.col("om")) / F.nullif(F.col("oi"), F.lit(0.0))).alias("profile"))


_P = "WITH m AS (SELECT min(value) lo, max(value) hi FROM events), p AS (SELECT event_id, (value - lo) / (hi - lo) AS p FROM events, m) "


def _probability(t: DataFrame) -> DataFrame:
    m = t.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return t.crossJoin(F.broadcast(m)).select("event_id", ((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("p"))


@query(_P + "SELECT event_id, CASE WHEN p >= 0.995 THEN 'cluster2' WHEN p <= 0.9 THEN 'cluster1' ELSE 'uncertain' END AS label FROM p", "events")
def label_from_probability(t):
    return _probability(t).select("event_id", M.three_way(F.col("p")).alias("label"))


@query(_P + "SELECT event_id, round(CASE WHEN p <= 0.9 THEN 0.5 * p / 0.9 WHEN p < 0.995 THEN 0.5 + 0.34 * (p - 0.9) / (0.995 - 0.9) ELSE 0.84 + 0.16 * (p - 0.995) / (1 - 0.995) END, 6) AS score FROM p", "events")
def deviation_score(t):
    return _probability(t).select("event_id", M.deviation_score(F.col("p")).alias("score"))


@query(_P + "SELECT event_id, round(ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS logit FROM p", "events")
def logit_stretch(t):
    return _probability(t).select("event_id", M.logit(F.col("p")).alias("logit"))


@query("WITH c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) n FROM events GROUP BY ALL) SELECT day, event_type, n, round(n / sum(n) OVER (PARTITION BY day), 6) AS ratio FROM c", "events")
def timepoint_ratios(t):
    c = t.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    return c.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy("day")))


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) v FROM events GROUP BY 1), c AS (SELECT day, v, sum(v) OVER (ORDER BY day) / sum(v) OVER () AS share FROM d) SELECT min(day) FILTER (share >= 0.1) AS at10, min(day) FILTER (share >= 0.5) AS at50, min(day) FILTER (share >= 0.9) AS at90 FROM c", "events")
def z_cumulative_span(t):
    d = t.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))  # a row for each day
    w = Window.orderBy("day")
    c = d.withColumn("share", F.sum("v").over(w) / F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return c.agg(*(F.min(F.when(F.col("share") >= p, F.col("day"))).alias(n) for p, n in ((0.1, "at10"), (0.5, "at50"), (0.9, "at90"))))


_SCORED = "s AS (SELECT quality AS y, CAST(n_chars AS DOUBLE) AS x FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_SCORED}, g AS (SELECT x, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1), c AS (SELECT *, sum(neg) OVER (ORDER BY x) - neg AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auc FROM c", "labels", "documents")
def auc_by_ranks(labels, docs):
    g = labels.join(docs.select("doc_id", F.col("n_chars").cast("double").alias("x")), "doc_id").groupBy("x").agg(F.sum("quality").alias("pos"), (F.count("*") - F.sum("quality")).alias("neg"))
    # counts before a length, by blocks of lengths, so that no task holds all of them
    g = g.withColumn("b", F.floor(F.col("x") / 256).cast("long"))
    before = g.groupBy("b").agg(F.sum("neg").alias("s")).withColumn("o", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("b").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = g.withColumn("i", inside).join(before, "b")
    return c.agg((F.sum(F.col("pos") * (F.col("o") + F.col("i") + F.col("neg") / 2)) / F.nullif((F.sum("pos") * F.sum("neg")).cast("double"), F.lit(0.0))).alias("auc"))


@query("WITH t AS (SELECT label AS a, CAST(vec_id % 5 AS INTEGER) AS b, count(*) n FROM embeddings GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2.0) v FROM t), r AS (SELECT sum(s * (s - 1) / 2.0) v FROM (SELECT sum(n) s FROM t GROUP BY a)), c AS (SELECT sum(s * (s - 1) / 2.0) v FROM (SELECT sum(n) s FROM t GROUP BY b)), n AS (SELECT sum(n) * (sum(n) - 1) / 2.0 v FROM t) SELECT round((x.v - r.v * c.v / n.v) / nullif((r.v + c.v) / 2 - r.v * c.v / n.v, 0), 6) AS ari FROM x, r, c, n", "embeddings")
def ari_contingency(t):
    n = t.groupBy(F.col("label").alias("a"), (F.col("vec_id") % 5).alias("b")).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    x = n.agg(pairs("n").alias("x"), (F.sum("n") * (F.sum("n") - 1) / 2).alias("t"))
    r = n.groupBy("a").agg(F.sum("n").alias("s")).agg(pairs("s").alias("r"))
    c = n.groupBy("b").agg(F.sum("n").alias("s")).agg(pairs("s").alias("c"))
    e = F.col("r") * F.col("c") / F.col("t")
    return x.crossJoin(r).crossJoin(c).select(((F.col("x") - e) / F.nullif((F.col("r") + F.col("c")) / 2 - e, F.lit(0.0))).alias("ari"))  # single rows


@query("WITH n AS (SELECT event_type, count(*) n FROM events GROUP BY 1) SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS size_rank FROM n", "events")
def size_relabel(t):
    return t.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("size_rank", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))  # a row for each type


@query("WITH n AS (SELECT label, count(*) / sum(count(*)) OVER () f, count(*) OVER () k FROM embeddings GROUP BY 1) SELECT round(12 * greatest(0, any_value(k) - 5) + 250 * sum(greatest(0, 0.08 - f)) + 500 * sum(greatest(0, 0.05 - f)), 6) AS penalty FROM n", "embeddings")
def fragmentation_penalty(t):
    n = t.groupBy("label").agg(F.count("*").alias("n")).crossJoin(t.agg(F.count("*").alias("t"))).withColumn("f", F.col("n") / F.col("t"))
    lack = lambda x: F.sum(F.greatest(F.lit(0.0), x - F.col("f")))
    return n.agg((12 * F.greatest(F.lit(0), F.count("*") - 5) + 250 * lack(0.08) + 500 * lack(0.05)).alias("penalty"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, 'Licensed under|This work is licensed') THEN 'license' WHEN regexp_matches(text, '\\*\\*\\*|%%%|&&&') THEN 'symbols' ELSE 'none' END AS term FROM documents", "documents")
def doc_term_audit(t):
    return t.select("doc_id", F.when(F.col("text").rlike("Licensed under|This work is licensed"), "license").when(F.col("text").rlike(r"\*\*\*|%%%|&&&"), "symbols").otherwise("none").alias("term"))


_PIX = "SELECT CAST(p_partkey // 64 AS INTEGER) AS row, CAST(p_partkey % 64 AS INTEGER) AS col, CAST(CASE WHEN p_size > 25 THEN (p_partkey % 64) // 8 + 1 ELSE 0 END AS INTEGER) AS label, p_retailprice AS v FROM part"


def _pixels(part: DataFrame) -> DataFrame:
    c = (F.col("p_partkey") % 64).cast("int")
    return part.select(F.lit("f").alias("image_id"), F.floor(F.col("p_partkey") / 64).cast("int").alias("row"), c.alias("col"), F.when(F.col("p_size") > 25, F.floor(c / 8) + 1).otherwise(0).cast("int").alias("label"), F.col("p_retailprice").alias("v"))


@query(f"WITH p AS ({_PIX}) SELECT label, count(*) AS area, round(avg(row), 6) AS centroid_row, round(avg(col), 6) AS centroid_col, min(row) AS min_row, max(row) + 1 AS max_row, min(col) AS min_col, max(col) + 1 AS max_col, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(count(*) / ((max(row) - min(row) + 1) * (max(col) - min(col) + 1)), 6) AS extent, round(4 * sqrt((var_pop(row) + var_pop(col) + 1 / 6) / 2 + sqrt(power((var_pop(row) - var_pop(col)) / 2, 2) + power(covar_pop(row, col), 2))), 6) AS major, round(4 * sqrt((var_pop(row) + var_pop(col) + 1 / 6) / 2 - sqrt(power((var_pop(row) - var_pop(col)) / 2, 2) + power(covar_pop(row, col), 2))), 6) AS minor, round(sqrt(1 - ((var_pop(row) + var_pop(col) + 1 / 6) / 2 - sqrt(power((var_pop(row) - var_pop(col)) / 2, 2) + power(covar_pop(row, col), 2))) / ((var_pop(row) + var_pop(col) + 1 / 6) / 2 + sqrt(power((var_pop(row) - var_pop(col)) / 2, 2) + power(covar_pop(row, col), 2)))), 6) AS eccentricity FROM p WHERE label > 0 GROUP BY 1", "part")
def region_properties(t):
    return X.region_properties(_pixels(t)).drop("image_id")


@query(f"WITH p AS ({_PIX}) SELECT a.row, a.col, CASE WHEN EXISTS (SELECT 1 FROM p b WHERE abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND b.label > 0 AND a.label > 0 AND a.label <> b.label) THEN 0 ELSE a.label END AS label FROM p a", "part")
def separate_touching(t):
    return X.separate_touching(_pixels(t)).select("row", "col", "label")


@query(f"WITH p AS ({_PIX}) SELECT a.row, a.col FROM p a LEFT JOIN p d ON d.row = a.row + 1 AND d.col = a.col LEFT JOIN p r ON r.row = a.row AND r.col = a.col + 1 WHERE a.label <> d.label OR a.label <> r.label", "part")
def boundary4(t):
    return X.boundary(_pixels(t)).select("row", "col")


@query(f"WITH p AS ({_PIX}) SELECT row, col, CAST(CASE WHEN label > 0 THEN dense_rank() OVER (ORDER BY label) - (SELECT count(DISTINCT label) FROM p WHERE label = 0) ELSE 0 END AS INTEGER) AS label FROM p", "part")
def relabel(t):
    return X.relabel(_pixels(t)).select("row", "col", "label")
