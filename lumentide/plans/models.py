"""Queries of models, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentide.operators import metrics
from lumentide.operators.tables import new_path
from lumentide.plans.catalogue import ORACLES, QUERIES, R, query

_FS = ["l_quantity", "l_extendedprice"]
_MISS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice FROM lineitem"


@query(f"WITH x AS ({_MISS}), m AS (SELECT median(l_quantity) AS m FROM x), f AS (SELECT l_orderkey, l_linenumber, coalesce(l_quantity, m) AS a, l_extendedprice AS b FROM x, m), s AS (SELECT median(a) AS ma, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS ia, median(b) AS mb, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS ib FROM f) SELECT l_orderkey, l_linenumber, round((a - ma) / CASE WHEN ia > 0 THEN ia ELSE 1 END, 6) AS l_quantity, round((b - mb) / CASE WHEN ib > 0 THEN ib ELSE 1 END, 6) AS l_extendedprice FROM f, s", "lineitem")
def impute_scale(t):
    from lumentide.models.prepare import impute_scale as run

    d = t.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice")
    return run(d, _FS)


@query(None, "embeddings")
def pca_scores(t):
    from lumentide.models.prepare import principal_components

    pc = principal_components(t, "embedding", 5)
    return pc.transform(t, "embedding").select("vec_id", *(F.col("scores")[i].alias(f"pca_{i + 1}") for i in range(5)))


def _scores(t):
    from lumentide.models.prepare import principal_components
    from lumentide.operators.tables import stored

    return stored(principal_components(t, "embedding", 3).transform(t, "embedding").select("vec_id", F.col("scores").alias("x")), "scores")


@query(None, "embeddings")
def gmm_em(t):
    from lumentide.models.mixtures import assigned, search

    d = _scores(t)
    model, _ = search(d, "x", [2, 3, 4], 2)
    return assigned(d, "x", model).select("vec_id", "component", "max_posterior")


@query(None, "embeddings")
def gmm_two_states(t):
    from lumentide.models.mixtures import two_states

    return two_states(_scores(t), "vec_id", "x")


@query(None, "embeddings")
def kmeans(t):
    from lumentide.models.learners import kmeans as run

    return run(t, "embedding", 4, 3).select("vec_id", "cluster")


@query(None, "lineitem")
def basc_a(t):
    from lumentide.models.thresholds import binarised

    d = t.groupBy("l_returnflag", "l_suppkey").agg(F.median("l_extendedprice").alias("v"))
    return binarised(d, ["l_returnflag"], "l_suppkey", "v")


@query(None, "labels", "documents")
def gbt(labels, docs):
    from lumentide.models.learners import boosted_trees, scored

    d = labels.join(docs, "doc_id").select("doc_id", "quality", F.coalesce("n_chars", F.lit(0)).cast("double").alias("chars"), F.coalesce(F.length(F.regexp_replace("text", "[^,.;]", "")), F.lit(0)).cast("double").alias("marks"))
    return scored(d, boosted_trees(d, ["chars", "marks"], "quality", 5, 3), ["chars", "marks"]).select("doc_id", "probability")


def _quality_features(labels, docs):
    """Features of labelled documents; texts under 200 characters have no count of words, which is then missing."""
    marks, words = F.length(F.regexp_replace("text", "[^,.;]", "")), F.size(F.split("text", r"\s+"))
    d = labels.join(docs, "doc_id").where(F.col("quality").isNotNull())
    return d.select("doc_id", "quality", F.col("n_chars").cast("double").alias("chars"), marks.cast("double").alias("marks"), F.when(F.length("text") >= 200, words.cast("double")).alias("words"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held"))


def _quality_trees(d):
    from lumentide.models.boosting import fit

    return fit(d, ["chars", "marks", "words"], "quality", rounds=5, depth=3, held="held")


@query(None, "labels", "documents")
def tree_importances(labels, docs):
    from lumentide.models.boosting import importances

    d = _quality_features(labels, docs)
    return importances(d.sparkSession, _quality_trees(d))


@query(None, "labels", "documents")
def tree_attributions(labels, docs):
    from lumentide.models.boosting import attributions, scored

    d = _quality_features(labels, docs)
    model = _quality_trees(d)
    return attributions(d, model, ["doc_id"]).join(scored(d, model, ["doc_id"]), "doc_id")


@query(None, "labels", "documents")
def sobol(labels, docs):
    """Of the trees fitted on documents, over the middle nine tenths of each feature."""
    from lumentide.models.boosting import scored
    from lumentide.models.sensitivity import design, sensitivity

    d, names = _quality_features(labels, docs), ["chars", "marks", "words"]
    ends = d.agg(*(F.percentile_approx(f, [0.05, 0.95]).alias(f) for f in names)).first()
    points = design(d.sparkSession, {f: tuple(ends[f] or (0.0, 0.0)) for f in names}, 1024)
    return sensitivity(scored(points, _quality_trees(d), ["id", "block"]), names, "margin")


@query(None, "embeddings")
def panel_comparison(t):
    """Two panels of the vectors' first components, searched over two and three clusters."""
    from lumentide.models.mixtures import compare_panels

    names = [f"e{i}" for i in range(4)]
    d = t.select("vec_id", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    rows = compare_panels(d, "vec_id", {"all": names, "half": names[:2]}, [2, 3], 1, (7,))
    return t.sparkSession.createDataFrame([tuple(r.values()) for r in rows], "panel string, k int, least_share double, posterior double, stability double, silhouette double")


_V = "SELECT vec_id, label, embedding AS e FROM embeddings"


@query(f"WITH v AS ({_V}), c AS (SELECT label, i, avg(e[i]) AS c, count(*) AS n FROM v, range(1, 65) r(i) GROUP BY ALL), q AS (SELECT label, any_value(n) AS n, list(c ORDER BY i) AS c FROM c GROUP BY 1), y AS (SELECT label, avg(list_sum(list_transform(e, lambda a: CAST(a AS DOUBLE) * a))) AS yy FROM v GROUP BY 1), d AS (SELECT vec_id, v.label, q.label AS l, n, greatest(list_sum(list_transform(e, lambda a: CAST(a AS DOUBLE) * a)) - 2 * list_dot_product(CAST(e AS DOUBLE[]), c) + yy, 0) AS d FROM v, q JOIN y USING (label)), s AS (SELECT vec_id, max(CASE WHEN l = label AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN l <> label THEN d END) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 5) AS silhouette FROM s", "embeddings")
def silhouette_squared(t):
    return metrics.silhouette(t, "vec_id", "embedding", "label").select(F.round("silhouette", 5).alias("silhouette"))


@query("WITH v AS (SELECT vec_id, label, embedding AS e FROM embeddings), d AS (SELECT a.vec_id, a.label AS own, b.label AS l, sum(list_distance(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[]))) AS s, count(*) AS n FROM v a JOIN v b ON a.vec_id <> b.vec_id GROUP BY ALL), s AS (SELECT vec_id, max(CASE WHEN l = own THEN s / n END) AS a, min(CASE WHEN l <> own THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 5) AS silhouette FROM s", "embeddings")
def silhouette_small(t):
    return metrics.silhouette_exact(t, "embedding", "label").select(F.round("silhouette", 5).alias("silhouette"))


@query(None, "embeddings")
def dispersion_indices(t):
    from lumentide.models.learners import dispersion_indices as run

    return run(t, "embedding", "label")


@query("WITH u AS (UNPIVOT (SELECT l_discount - 0.05 AS discount, l_tax - 0.04 AS tax FROM lineitem) ON discount, tax INTO NAME feature VALUE v) SELECT feature, round(avg(abs(v)), 6) AS mean_abs, round(avg(v), 6) AS mean, round(stddev_pop(abs(v)), 6) AS std_abs FROM u GROUP BY 1", "lineitem")
def attribution_summary(t):
    from lumentide.models.learners import attribution_summary as run

    return run(t.select((F.col("l_discount") - 0.05).alias("discount"), (F.col("l_tax") - 0.04).alias("tax")), ["discount", "tax"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation", "nation")
def csv_round_trip(t):
    from lumentide.sources.tables import read_csv, write_csv

    path = new_path(t.sparkSession, "csv")
    write_csv(t.select("n_nationkey", "n_name", "n_regionkey"), path, mark=True)
    return read_csv(t.sparkSession, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT CAST(n_regionkey AS VARCHAR) AS sample, n_nationkey, n_name FROM nation", "nation")
def tagged_scan(t):
    from lumentide.sources.tables import read_tagged

    spark, path = t.sparkSession, new_path(t.sparkSession, "samples")
    t.select("n_nationkey", "n_name", F.col("n_regionkey").alias("sample")).write.option("header", "true").partitionBy("sample").csv(path)
    got = read_tagged(spark, f"{path}/*/*.csv", "sample", "n_nationkey int, n_name string")
    return got.withColumn("sample", F.regexp_extract("sample", "=(.*)$", 1))


def stream_label_ratios(spark, d):
    from lumentide.streaming.ratios import label_ratios

    kinds = ", ".join(f"`{n}` {t}" for n, t in spark.read.parquet(f"{d}/events.parquet").dtypes)
    got = label_ratios(spark, d, "events.parquet", kinds, "ts", "event_type")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("ratio", 6).alias("ratio"))


QUERIES["stream_label_ratios"] = stream_label_ratios
ORACLES["stream_label_ratios"] = f"WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY day) AS ratio FROM c) SELECT day, event_type, n, {R('ratio')} FROM s"
