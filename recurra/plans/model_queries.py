"""Queries over labelled feature tables: selection, classification, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import r6
from ..operators import classify, evaluate, pivots, selection, trees
from ..session import stage
from ..sources.results import classification_document
from ..sources.tables import table
from .common import FEATURES, features, report
from .registry import query, rounded, with_ctes

STATS = """stats AS (
  SELECT feature, label, count(value) AS n, avg(value) AS mean, var_samp(value) AS var FROM feat GROUP BY ALL)"""
ANOVA = """anova AS (
  SELECT feature, (sum(n * (mean - gm) * (mean - gm)) / (count(*) - 1)) / (sum((n - 1) * var) / (sum(n) - count(*))) AS f_score
  FROM (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS gm FROM stats) GROUP BY 1)"""
COHEN = """cohen AS (
  SELECT *, CASE WHEN abs(cohens_d) < 0.2 THEN 'trivial' WHEN abs(cohens_d) < 0.5 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size
  FROM (SELECT a.feature, (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) AS cohens_d
        FROM stats a JOIN stats b ON a.feature = b.feature AND a.label = 'Normal' AND b.label = 'Pathol'))"""
_SHIFT = " + ".join(f"1.0 / (n + {k})" for k in range(10))
PSI = f"""psi AS (
  SELECT n, ln(z) - 0.5 / z - 1.0 / (12 * z * z) + 1.0 / (120 * z ** 4) - 1.0 / (252 * z ** 6) - ({_SHIFT}) AS p
  FROM (SELECT CAST(g AS DOUBLE) AS n, CAST(g AS DOUBLE) + 10 AS z
        FROM (SELECT unnest(range(1, (SELECT count(*) + 1 FROM embeddings))) AS g)))"""
KNN_MI = """rad AS (
  SELECT row_id, feature, label, value, max(d) AS r, any_value(nc) AS nc, any_value(reach) AS reach FROM (
    SELECT a.row_id, a.feature, a.label, a.value, abs(a.value - b.value) AS d, a.nc, least(3, a.nc - 1) AS reach,
           row_number() OVER (PARTITION BY a.row_id, a.feature ORDER BY abs(a.value - b.value)) AS rn
    FROM (SELECT *, count(*) OVER (PARTITION BY feature, label) AS nc FROM feat) a
    JOIN feat b ON a.feature = b.feature AND a.label = b.label AND a.row_id <> b.row_id)
  WHERE rn <= reach GROUP BY ALL),
near AS (
  SELECT a.row_id, a.feature, a.nc, a.reach, count(*) AS m
  FROM rad a JOIN feat b ON a.feature = b.feature AND (abs(a.value - b.value) < a.r OR a.value = b.value) GROUP BY ALL),
info AS (
  SELECT feature, greatest(0, any_value(pt) + avg(pk.p) - avg(pc.p) - avg(pm.p)) AS mi_score
  FROM near JOIN psi pk ON pk.n = reach JOIN psi pc ON pc.n = nc JOIN psi pm ON pm.n = m
  JOIN (SELECT p AS pt FROM psi WHERE n = (SELECT count(*) FROM embeddings)) ON true GROUP BY 1)"""
RANKED = """norm AS (
  SELECT feature, f_score, mi_score,
         (f_score - min(f_score) OVER ()) / (max(f_score) OVER () - min(f_score) OVER ()) AS f_score_norm,
         (mi_score - min(mi_score) OVER ()) / (max(mi_score) OVER () - min(mi_score) OVER ()) AS mi_score_norm
  FROM anova JOIN info USING (feature)),
ranked AS MATERIALIZED (
  SELECT *, 0.7 * f_score_norm + 0.3 * mi_score_norm AS combined_score,
         row_number() OVER (ORDER BY 0.7 * f_score_norm + 0.3 * mi_score_norm DESC, feature) AS rank FROM norm)"""
CORR = """cor AS MATERIALIZED (
  SELECT a.feature AS a, b.feature AS b, corr(a.value, b.value) AS r FROM feat a JOIN feat b ON a.row_id = b.row_id GROUP BY ALL)"""


def _stats(spark, folder):
    return selection.class_stats(features(spark, folder))


def _vectors(spark, folder):
    """(row_id, label, x) straight from the array column."""
    return spark.read.parquet(f"{folder}/embeddings.parquet").select(
        F.col("vec_id").alias("row_id"),
        F.when(F.col("label") < 5, "Normal").otherwise("Pathol").alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


@query("class_stats", with_ctes(FEATURES, STATS, tail=f"SELECT feature, label, n, {rounded('mean', 'var')} FROM stats"))
def class_stats(spark, folder):
    return report(_stats(spark, folder), ["feature", "label", "n"], ["mean", "var"])


@query("anova_f", with_ctes(FEATURES, STATS, ANOVA, tail=f"SELECT feature, {rounded('f_score')} FROM anova"))
def anova_f(spark, folder):
    return report(selection.anova(_stats(spark, folder)), ["feature"], ["f_score"])


# Upper tail of F by the continued fraction of the incomplete beta function, one step per row.
TAIL = """args AS (
  SELECT feature, f_score, d2 / 2 AS a, d1 / 2 AS b, d2 / (d2 + d1 * f_score) AS x FROM anova
  JOIN (SELECT feature, CAST(count(*) - 1 AS DOUBLE) AS d1, CAST(sum(n) - count(*) AS DOUBLE) AS d2 FROM stats GROUP BY 1) USING (feature)),
side AS (
  SELECT feature, f_score, x >= (a + 1) / (a + b + 2) AS swap, CASE WHEN x >= (a + 1) / (a + b + 2) THEN b ELSE a END AS p,
         CASE WHEN x >= (a + 1) / (a + b + 2) THEN a ELSE b END AS q, CASE WHEN x >= (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS z FROM args),
frac(feature, m, c, d, h) AS (
  SELECT feature, 0, CAST(1 AS DOUBLE), 1 / (1 - (p + q) * z / (p + 1)), 1 / (1 - (p + q) * z / (p + 1)) FROM side UNION ALL
  SELECT feature, m, 1 + odd / c1, 1 / (1 + odd * d1), h * c1 * d1 * (1 + odd / c1) / (1 + odd * d1) FROM (
    SELECT *, 1 + even / c AS c1, 1 / (1 + even * d) AS d1 FROM (
      SELECT feature, m + 1 AS m, c, d, h, (m + 1) * (q - m - 1) * z / ((p + 2 * m + 1) * (p + 2 * m + 2)) AS even,
             -(p + m + 1) * (p + q + m + 1) * z / ((p + 2 * m + 2) * (p + 2 * m + 3)) AS odd
      FROM frac JOIN side USING (feature) WHERE m < 100))),
tail AS (
  SELECT feature, f_score, CASE WHEN swap THEN 1 - v ELSE v END AS p_value FROM (
    SELECT feature, f_score, swap, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(z) + q * ln(1 - z)) * h / p AS v
    FROM frac JOIN side USING (feature) WHERE m = 100))"""


@query("anova_p_value", with_ctes(FEATURES, STATS, ANOVA, TAIL, tail=f"SELECT feature, {rounded('f_score', 'p_value')} FROM tail").replace("WITH ", "WITH RECURSIVE ", 1))
def anova_p_value(spark, folder):
    return report(selection.anova(_stats(spark, folder)), ["feature"], ["f_score", "p_value"])


@query("anova_significant", with_ctes(FEATURES, STATS, ANOVA, TAIL, tail=f"SELECT feature, {rounded('f_score')} FROM tail WHERE p_value < 0.25").replace("WITH ", "WITH RECURSIVE ", 1))
def anova_significant(spark, folder):
    found = selection.significant(selection.anova(_stats(spark, folder)), alpha=0.25)
    return report(found, ["feature"], ["f_score"])


@query("rejected_features", with_ctes(FEATURES, STATS, ANOVA, TAIL, tail=f"""
SELECT feature, {rounded('p_value')}, CAST(row_number() OVER (ORDER BY p_value, feature) AS INTEGER) AS place
FROM tail WHERE p_value >= 0.05""").replace("WITH ", "WITH RECURSIVE ", 1))
def rejected_features(spark, folder):
    found = selection.rejected(selection.anova(_stats(spark, folder)))
    return report(found, ["feature", "place"], ["p_value"])


@query("cohens_d", with_ctes(FEATURES, STATS, COHEN, tail=f"SELECT feature, {rounded('cohens_d')}, effect_size FROM cohen"))
def cohens_d(spark, folder):
    found = selection.cohens_d(_stats(spark, folder))
    return report(found, ["feature", "effect_size"], ["cohens_d"])


@query("cohens_d_filter", with_ctes(FEATURES, STATS, COHEN, tail=f"SELECT feature, {rounded('cohens_d')} FROM cohen WHERE abs(cohens_d) >= 0.05"))
def cohens_d_filter(spark, folder):
    found = selection.cohens_d(_stats(spark, folder)).filter(F.abs("cohens_d") >= 0.05)
    return report(found, ["feature"], ["cohens_d"])


@query("effect_distribution", with_ctes(FEATURES, STATS, COHEN, tail="SELECT effect_size, count(*) AS c FROM cohen GROUP BY 1"))
def effect_distribution(spark, folder):
    return selection.effect_distribution(selection.cohens_d(_stats(spark, folder)))


@query("knn_information", with_ctes(FEATURES, PSI, KNN_MI, tail=f"SELECT feature, {rounded('mi_score')} FROM info"))
def knn_information(spark, folder):
    return report(selection.knn_information(features(spark, folder)), ["feature"], ["mi_score"])


@query("binned_information", with_ctes(FEATURES, """cells AS (
  SELECT feature, label, bin, CAST(count(*) AS DOUBLE) AS c FROM (
    SELECT feature, label, least(floor((value - lo) / (hi - lo) * 10), 9) AS bin
    FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM feat)) GROUP BY ALL)""", tail="""
SELECT feature, round(sum(c / n * ln(c * n / (cb * cl))), 6) + 0.0 AS mi_score FROM (
  SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, bin) AS cb,
         sum(c) OVER (PARTITION BY feature, label) AS cl FROM cells) GROUP BY 1"""))
def binned_information(spark, folder):
    return report(selection.binned_information(features(spark, folder)), ["feature"], ["mi_score"])


def _ranked(spark, folder):
    long = features(spark, folder)
    scores = selection.anova(selection.class_stats(long)).join(
        selection.knn_information(long), "feature"
    )
    return selection.combined_ranking(stage(scores))


@query("combined_ranking", with_ctes(FEATURES, STATS, ANOVA, PSI, KNN_MI, RANKED, tail=f"""
SELECT feature, CAST(rank AS INTEGER) AS rank, {rounded('f_score_norm', 'mi_score_norm', 'combined_score')} FROM ranked"""))
def combined_ranking(spark, folder):
    return report(_ranked(spark, folder), ["feature", "rank"], ["f_score_norm", "mi_score_norm", "combined_score"])


@query("correlation_matrix", with_ctes(FEATURES, CORR, tail=f"SELECT a, b, {rounded('r')} FROM cor"))
def correlation_matrix(spark, folder):
    return report(selection.correlation_matrix(_vectors(spark, folder)), ["a", "b"], ["r"])


@query("correlation_spearman", with_ctes("""feat0 AS (
  SELECT vec_id AS row_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature, unnest(embedding) AS value FROM embeddings)""",
    """feat AS (SELECT row_id, feature, rank() OVER (PARTITION BY feature ORDER BY value)
      + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS value FROM feat0)""", CORR,
    tail=f"SELECT a, b, {rounded('r')} FROM cor"))
def correlation_spearman(spark, folder):
    ranks = selection.average_ranks(features(spark, folder))
    return report(selection.correlation_matrix(stage(selection.as_vectors(ranks))), ["a", "b"], ["r"])


@query("correlation_kendall", """
WITH v AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
sg AS (
  SELECT list_transform(list_zip(p.x, q.x), lambda z: sign(z[1] - z[2])) AS s
  FROM v p JOIN v q ON p.row_id < q.row_id),
k AS (SELECT unnest(range((SELECT max(len(x)) FROM v))) AS k),
half AS (SELECT x.k AS a, y.k AS b, sum(s[x.k + 1] * s[y.k + 1]) AS c FROM sg, k x, k y WHERE x.k <= y.k GROUP BY ALL),
mirror AS (SELECT a, b, c FROM half UNION SELECT b, a, c FROM half)
SELECT CAST(m.a AS INTEGER) AS a, CAST(m.b AS INTEGER) AS b, round(m.c / sqrt(p.c * q.c), 6) + 0.0 AS r
FROM mirror m JOIN half p ON p.a = m.a AND p.b = m.a JOIN half q ON q.a = m.b AND q.b = m.b""")
def correlation_kendall(spark, folder):
    return report(selection.correlation_matrix(_vectors(spark, folder), "kendall"), ["a", "b"], ["r"])


THRESHOLD, LIMIT = 0.06, 15
FOLD = f"""tab AS MATERIALIZED (SELECT list(feature ORDER BY rank) AS names FROM ranked),
cmap AS MATERIALIZED (SELECT map(list(a * 1000 + b), list(abs(r))) AS m FROM cor),
fold(k, feature, kept, other, r, chosen) AS (
  SELECT 0, CAST(NULL AS INTEGER), false, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE), CAST([] AS INTEGER[]) UNION ALL
  SELECT k + 1, f, coalesce(best < {THRESHOLD}, true), CASE WHEN best >= {THRESHOLD} THEN chosen[list_position(rs, best)] END, best,
         CASE WHEN coalesce(best < {THRESHOLD}, true) THEN list_append(chosen, f) ELSE chosen END
  FROM (SELECT k, f, chosen, rs, list_max(rs) AS best FROM (
    SELECT k, names[k + 1] AS f, chosen, list_transform(chosen, lambda c: m[names[k + 1] * 1000 + c]) AS rs
    FROM fold JOIN tab ON true JOIN cmap ON true WHERE k < len(names) AND len(chosen) < {LIMIT})))"""


@query("drop_redundant", with_ctes(FEATURES, STATS, ANOVA, PSI, KNN_MI, RANKED, CORR, FOLD, tail="""
SELECT k AS rank, feature, kept, other AS correlated_with, CASE WHEN NOT kept THEN round(r, 6) END AS max_correlation
FROM fold WHERE k > 0""").replace("WITH ", "WITH RECURSIVE ", 1))
def drop_redundant(spark, folder):
    found = selection.drop_redundant(
        _ranked(spark, folder).select("rank", "feature"),
        stage(selection.correlation_matrix(_vectors(spark, folder))),
        LIMIT,
        THRESHOLD,
    )
    return found.select(
        "rank", F.col("feature").cast("int").alias("feature"), "kept",
        F.col("correlated_with").cast("int").alias("correlated_with"),
        F.when(~F.col("kept"), r6("max_correlation")).alias("max_correlation"),
    )


@query("z_scores", with_ctes(FEATURES, tail="""
SELECT row_id, label, feature, round((value - mu) / sd, 6) + 0.0 AS value FROM (
  SELECT *, avg(value) OVER (PARTITION BY feature) AS mu, stddev_pop(value) OVER (PARTITION BY feature) AS sd FROM feat)"""))
def z_scores(spark, folder):
    return report(selection.z_scores(features(spark, folder)), ["row_id", "label", "feature"], ["value"])


@query("pca_variance")
def pca_variance(spark, folder):
    found = selection.explained_variance(selection.correlation_matrix(_vectors(spark, folder)))
    return report(found, ["component"], ["share", "total"])


def _band_sql(score):
    cases = " ".join(f"WHEN {score} > {floor} THEN '{text}'" for floor, text in selection.SILHOUETTE_BANDS)
    return f"CASE {cases} ELSE '{selection.SILHOUETTE_POOR}' END"


@query("silhouette", with_ctes("""dist AS (
  SELECT a.vec_id AS row_id, a.label < 5 AS la, b.label < 5 AS lb, sum(list_distance(a.x, b.x)) AS s, count(*) AS c
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a
  JOIN (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) b ON a.vec_id <> b.vec_id GROUP BY ALL)""", tail="""
SELECT round(s, 6) + 0.0 AS silhouette_score, """ + _band_sql("s") + """ AS silhouette_interpretation FROM (
  SELECT avg((b - a) / greatest(a, b)) AS s FROM (
    SELECT row_id, max(s / c) FILTER (la = lb) AS a, min(s / c) FILTER (la <> lb) AS b FROM dist GROUP BY 1))"""))
def silhouette(spark, folder):
    return report(
        selection.silhouette(_vectors(spark, folder), 128), ["silhouette_interpretation"], ["silhouette_score"]
    )


@query("fisher_ratio", with_ctes(FEATURES, """cen AS (SELECT label, feature, avg(value) AS m FROM feat GROUP BY ALL),
inter AS (SELECT sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM cen a JOIN cen b ON a.feature = b.feature AND a.label < b.label),
intra AS (
  SELECT avg(w) AS w FROM (SELECT label, avg(d) AS w FROM (
    SELECT row_id, feat.label, sqrt(sum((value - m) * (value - m))) AS d FROM feat JOIN cen USING (label, feature) GROUP BY ALL) GROUP BY 1))""",
    tail="SELECT round(d, 6) AS inter_class_distance, round(w, 6) AS intra_class_distance, round(d / w, 6) AS fisher_ratio FROM inter, intra"))
def fisher_ratio(spark, folder):
    found = selection.fisher_ratio(_vectors(spark, folder))
    return report(found, [], ["inter_class_distance", "intra_class_distance", "fisher_ratio"])


@query("separability_check")
def separability_check(spark, folder):
    vectors = _vectors(spark, folder)
    pca = selection.explained_variance(selection.correlation_matrix(vectors)).agg(F.max("total")).scalar()
    sil = selection.silhouette(vectors, 128).select("silhouette_score").scalar()
    fisher = selection.fisher_ratio(vectors)
    return fisher.select(selection.separability(pca, sil, F.col("fisher_ratio")).alias("s")).select(
        r6(F.col("s.pca_variance.value")).alias("pca_variance"), r6(F.col("s.silhouette.value")).alias("silhouette"),
        r6(F.col("s.fisher_ratio.value")).alias("fisher_ratio"), "s.validation_passed",
    )


@query("justification", with_ctes(FEATURES, STATS, ANOVA, TAIL, COHEN, tail="""
SELECT feature,
       CASE WHEN p_value < 0.001 THEN 'altamente significativa (p<0.001)' WHEN p_value < 0.01 THEN 'muy significativa (p<0.01)' ELSE printf('significativa (p=%.3f)', p_value) END
       || printf(', efecto %s (|d|=%.2f), ', effect_size, abs(cohens_d))
       || CASE WHEN f_score > 10 THEN 'alto poder discriminativo' WHEN f_score > 5 THEN 'buen poder discriminativo' ELSE 'poder discriminativo moderado' END AS justification
FROM tail JOIN cohen USING (feature)""").replace("WITH ", "WITH RECURSIVE ", 1))
def justification(spark, folder):
    stats = _stats(spark, folder)
    both = selection.anova(stats).join(selection.cohens_d(stats), "feature")
    return both.select("feature", selection.justification(F.col("p_value"), F.col("cohens_d"), F.col("f_score")).alias("justification"))


@query("dataset_summary", """
SELECT CASE WHEN label < 5 THEN 'Normal' ELSE 'Pathol' END AS label, count(*) AS rows, CAST(max(len(embedding)) AS BIGINT) AS features
FROM embeddings GROUP BY 1""")
def dataset_summary(spark, folder):
    return selection.dataset_summary(features(spark, folder))


# --- classification ----------------------------------------------------------------------------

ORDER = """ord AS (
  SELECT vec_id AS row_id, CASE WHEN label < 5 THEN 'Normal' ELSE 'Pathol' END AS label,
         row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY label < 5) AS n
  FROM embeddings WINDOW w AS (PARTITION BY label < 5 ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id))"""
SPLIT = "split AS (SELECT row_id, label, i < round(n * 0.2) AS is_test FROM ord)"
VOTES = """vec AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
nn AS (
  SELECT row_id, label, n_label, d FROM (
    SELECT t.row_id, t.label, r.label AS n_label, list_distance(tv.x, rv.x) AS d,
           row_number() OVER (PARTITION BY t.row_id ORDER BY list_distance(tv.x, rv.x), r.row_id) AS rn
    FROM split t JOIN split r ON t.is_test AND NOT r.is_test
    JOIN vec tv ON tv.row_id = t.row_id JOIN vec rv ON rv.row_id = r.row_id) WHERE rn <= 5),
knn AS (
  SELECT row_id, label, arg_max(n_label, (w, n_label)) AS prediction, coalesce(sum(w) FILTER (n_label = 'Pathol'), 0) / sum(w) AS score FROM (
    SELECT row_id, label, n_label, sum(1 / d) AS w FROM nn GROUP BY ALL) GROUP BY ALL)"""
NB = """model AS (
  SELECT s.label, feature, avg(value) AS mu, var_pop(value) AS var FROM feat JOIN split s USING (row_id) WHERE NOT is_test GROUP BY ALL),
floor AS (SELECT max(v) * 1e-9 AS e FROM (SELECT feature, var_pop(value) AS v FROM feat JOIN split s USING (row_id) WHERE NOT is_test GROUP BY 1)),
prior AS (SELECT label, ln(count(*) / (SELECT count(*) FROM split WHERE NOT is_test)) AS p FROM split WHERE NOT is_test GROUP BY 1),
ll AS (
  SELECT f.row_id, s.label, m.label AS cls, any_value(p) + sum(-0.5 * ln(2 * pi() * (var + e)) - (value - mu) * (value - mu) / (2 * (var + e))) AS ll
  FROM feat f JOIN split s ON s.row_id = f.row_id AND is_test JOIN model m ON m.feature = f.feature JOIN prior ON prior.label = m.label JOIN floor ON true
  GROUP BY f.row_id, s.label, m.label),
pred AS (
  SELECT row_id, label, arg_max(cls, ll) AS prediction,
         exp(max(ll) FILTER (cls = 'Pathol') - max(ll)) / (exp(max(ll) FILTER (cls = 'Pathol') - max(ll)) + exp(max(ll) FILTER (cls = 'Normal') - max(ll))) AS score
  FROM ll GROUP BY ALL)"""
CONF = "conf AS (SELECT label, prediction, count(*) AS c FROM pred GROUP BY ALL)"
GROUPED = (FEATURES, ORDER, SPLIT, NB)


def _split(spark, folder):
    return classify.stratified_split(_vectors(spark, folder))


def _long(vectors):
    return vectors.select("row_id", "label", F.posexplode("x").alias("feature", "value"))


def _nb(spark, folder):
    rows = stage(_split(spark, folder))
    return classify.gaussian_nb(_long(rows.filter("NOT is_test")), _long(rows.filter("is_test")))


@query("stratified_split", with_ctes(ORDER, SPLIT, tail="SELECT row_id, label, is_test FROM split"))
def stratified_split(spark, folder):
    return _split(spark, folder).select("row_id", "label", "is_test")


@query("cv_folds", with_ctes(ORDER, tail="SELECT row_id, label, CAST(i % 10 AS INTEGER) AS fold FROM ord"))
def cv_folds(spark, folder):
    return classify.cv_folds(_vectors(spark, folder)).select("row_id", "label", "fold")


@query("class_weights", """
SELECT label, c, round(CAST(sum(c) OVER () AS DOUBLE) / (count(*) OVER () * c), 6) AS weight
FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY 1)""")
def class_weights(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return report(classify.class_weights(rows), ["label", "c"], ["weight"])


@query("feature_subsets", with_ctes(FEATURES, STATS, ANOVA, """
named AS (SELECT rank, CASE WHEN feature % 3 = 0 THEN 'glcm_' WHEN feature % 3 = 1 THEN 'lbp_' ELSE 'stat_' END || feature AS feature
  FROM (SELECT feature, row_number() OVER (ORDER BY f_score DESC, feature) AS rank FROM anova)),
t AS (SELECT rank, feature, unnest(['top_5', 'top_10', 'all_selected', split_part(feature, '_', 1) || '_only']) AS subset FROM named)""",
    tail="""
SELECT subset, count(*) AS n, string_agg(feature, ',' ORDER BY rank) AS names FROM t
WHERE (subset <> 'top_5' OR rank <= 5) AND (subset <> 'top_10' OR rank <= 10) GROUP BY 1"""))
def feature_subsets(spark, folder):
    """Vector components under family names, ranked by F."""
    k = F.col("feature")
    prefix = F.when(k % 3 == 0, "glcm_").when(k % 3 == 1, "lbp_").otherwise("stat_")
    scores = selection.anova(_stats(spark, folder))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("f_score"), "feature")
    ranked = scores.select(F.row_number().over(order).alias("rank"), F.concat(prefix, k).alias("feature"))
    found = classify.subsets(ranked)
    return found.select("subset", "n", F.concat_ws(",", "features").alias("names"))


@query("knn_classifier", with_ctes(ORDER, SPLIT, VOTES, tail=f"SELECT row_id, label, prediction, {rounded('score')} FROM knn"))
def knn_classifier(spark, folder):
    rows = stage(_split(spark, folder))
    near = classify.knn_neighbors(rows.filter("NOT is_test"), rows.filter("is_test"), size=128)
    return report(classify.knn_vote(stage(near)), ["row_id", "label", "prediction"], ["score"])


@query("pivot_neighbors", """
WITH p AS (SELECT p_partkey AS id, p_brand AS brand, p_size * CAST(10 AS DOUBLE) AS x, round(p_retailprice * 10) AS y FROM part)
SELECT row_id, n_id, n_label, d FROM (
  SELECT a.id AS row_id, b.id AS n_id, b.brand AS n_label, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d,
         row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.id) AS r
  FROM p a JOIN p b ON a.id <> b.id)
WHERE r <= 5""")
def pivot_neighbors(spark, folder):
    """The five nearest other parts by size and price."""
    size, price = F.col("p_size") * F.lit(10.0), F.round(F.col("p_retailprice") * 10)
    rows = table(spark, folder, "part").select(
        F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("label"), F.array(size, price).alias("x"), F.col("p_partkey").alias("own")
    )
    found = pivots.pivot_neighbors(rows, rows, 5, size=128, apart="own")
    return found.select("row_id", "n_id", "n_label", "d")


@query("gaussian_nb", with_ctes(*GROUPED, tail=f"SELECT row_id, label, prediction, {rounded('score')} FROM pred"))
def gaussian_nb(spark, folder):
    return report(_nb(spark, folder), ["row_id", "label", "prediction"], ["score"])


@query("confusion_matrix", with_ctes(*GROUPED, CONF, tail="SELECT label, prediction, c, round(c / sum(c) OVER (PARTITION BY label), 6) AS share FROM conf"))
def confusion_matrix(spark, folder):
    found = evaluate.row_normalized(evaluate.confusion(_nb(spark, folder)))
    return report(found, ["label", "prediction", "c"], ["share"])


@query("weighted_scores", with_ctes(*GROUPED, CONF, tail="""
SELECT round(sum(tp) / sum(s), 6) AS accuracy, round(sum(s * coalesce(tp / nullif(cl, 0), 0)) / sum(s), 6) AS precision,
       round(sum(s * tp / s) / sum(s), 6) AS recall, round(sum(s * 2 * tp / (s + cl)) / sum(s), 6) AS f1_score
FROM (SELECT k.label, (SELECT CAST(sum(c) AS DOUBLE) FROM conf WHERE label = k.label) AS s,
             coalesce((SELECT CAST(sum(c) AS DOUBLE) FROM conf WHERE prediction = k.label), 0) AS cl,
             coalesce((SELECT CAST(sum(c) AS DOUBLE) FROM conf WHERE label = k.label AND prediction = k.label), 0) AS tp
      FROM (SELECT DISTINCT label FROM conf) k)"""))
def weighted_scores(spark, folder):
    found = evaluate.weighted_scores(stage(evaluate.confusion(_nb(spark, folder))))
    return report(found, [], ["accuracy", "precision", "recall", "f1_score"])


@query("roc_auc", with_ctes(*GROUPED, tail="""
SELECT round(sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*), 6) AS roc_auc
FROM pred p JOIN pred q ON p.label = 'Pathol' AND q.label = 'Normal'"""))
def roc_auc(spark, folder):
    return report(evaluate.roc_auc(stage(_nb(spark, folder)), "Pathol"), [], ["roc_auc"])


@query("roc_points", with_ctes(*GROUPED, tail="""
SELECT round(score, 6) + 0.0 AS score, round(sum(CAST(label = 'Pathol' AS INTEGER)) OVER w / (SELECT count(*) FROM pred WHERE label = 'Pathol'), 6) + 0.0 AS tpr,
       round(sum(CAST(label = 'Normal' AS INTEGER)) OVER w / (SELECT count(*) FROM pred WHERE label = 'Normal'), 6) + 0.0 AS fpr
FROM pred WINDOW w AS (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) QUALIFY row_number() OVER (PARTITION BY score) = 1"""))
def roc_points(spark, folder):
    return report(evaluate.roc_points(stage(_nb(spark, folder)), "Pathol"), [], ["score", "tpr", "fpr"])


@query("best_by_group", """
SELECT subset, position, f1_score FROM (
  SELECT *, row_number() OVER (PARTITION BY subset ORDER BY f1_score DESC, position) AS rn FROM (
    SELECT l_returnflag AS subset, l_linenumber AS position, round(avg(l_discount), 6) AS f1_score FROM lineitem GROUP BY 1, 2)) WHERE rn = 1""")
def best_by_group(spark, folder):
    rows = spark.read.parquet(f"{folder}/lineitem.parquet")
    results = rows.groupBy(
        F.col("l_returnflag").alias("subset"), F.col("l_linenumber").alias("position")
    ).agg(F.round(F.avg("l_discount"), 6).alias("f1_score"))
    return evaluate.best_by_group(results, "subset")


def _fit(name, **options):
    def build(spark, folder):
        rows = stage(classify.stratified_split(stage(classify.standardized(stage(_vectors(spark, folder))))))
        train, test = rows.filter("NOT is_test").drop("is_test"), rows.filter("is_test").drop("is_test")
        scored, _ = classify.fit_predict(name, train, test, ("Normal", "Pathol"), **options)
        scores = evaluate.weighted_scores(evaluate.confusion(scored))
        area = evaluate.roc_auc(scored, "Pathol")
        metrics = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
        # two tables of one row each
        both = scores.withColumn("one", F.lit(1)).join(area.withColumn("one", F.lit(1)), "one")
        return both.select(F.lit(name).alias("model_name"), *[r6(c).alias(c) for c in metrics])

    return build


for _name, _options in {
    "logistic_regression": {}, "naive_bayes": {}, "decision_tree": {}, "svm": {},
    "random_forest": {}, "mlp": {}, "xgboost": {},
}.items():
    query(f"model_{_name}")(_fit(_name, **_options))


COARSE = """coarse AS (
  SELECT vec_id AS r, CASE WHEN label < 5 THEN 0 ELSE 1 END AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS k,
         floor(CAST(unnest(embedding) AS DOUBLE) * 8) AS v FROM embeddings)"""


def _tree_sql(depth, sums, gain, fits, least, is_open, value):
    """A tree level by level: sums of (s0, s1) per node, feature and value, the best split of each node, its children."""
    parts = [COARSE, *sums, "node0 AS MATERIALIZED (SELECT DISTINCT r, a, b, 1 AS heap FROM given)"]
    for d in range(depth + 1):
        parts.append(f"""total{d} AS MATERIALIZED (SELECT heap, sum(a) AS t0, sum(b) AS t1, count(*) AS tn FROM node{d} GROUP BY heap)""")
        if d == depth:
            parts.append(f"best{d} AS (SELECT 1 AS heap, 0 AS k, CAST(0 AS DOUBLE) AS v WHERE false)")
            break
        parts.append(f"""run{d} AS (
  SELECT heap, k, v, sum(s0) OVER w AS l0, sum(s1) OVER w AS l1, sum(sn) OVER w AS ln FROM (
    SELECT heap, k, v, sum(a) AS s0, sum(b) AS s1, count(*) AS sn FROM node{d} JOIN coarse USING (r) GROUP BY ALL)
  WINDOW w AS (PARTITION BY heap, k ORDER BY v))""")
        parts.append(f"""best{d} AS MATERIALIZED (
  SELECT heap, k, v FROM (
    SELECT heap, k, v, gain, row_number() OVER (PARTITION BY heap ORDER BY round(gain, 9) DESC, k, v) AS rn FROM (
      SELECT *, t0 - l0 AS r0, t1 - l1 AS r1, tn - ln AS rn, {gain} AS gain FROM run{d} JOIN total{d} USING (heap) WHERE {is_open})
    WHERE {fits}) WHERE rn = 1 AND gain > {least})""")
        parts.append(f"""node{d + 1} AS MATERIALIZED (
  SELECT r, a, b, 2 * heap + CAST(c.v > best{d}.v AS INTEGER) AS heap FROM node{d} JOIN best{d} USING (heap) JOIN coarse c USING (r, k))""")
    rows = " UNION ALL ".join(f"SELECT heap, coalesce(k, -1) AS feature, v AS threshold, t0, t1 FROM total{d} LEFT JOIN best{d} USING (heap)" for d in range(depth + 1))
    return with_ctes(*parts, tail=f"SELECT heap, feature, threshold, round({value}, 6) + 0.0 AS value FROM ({rows})")


def _soft(g):
    return f"(sign({g}) * greatest(abs({g}) - 0.1, 0))"


def _worth(g, h):
    return f"(CASE WHEN {h} + 1 > 0 THEN {_soft(g)} * {_soft(g)} / ({h} + 1) ELSE 0 END)"


def _loss(a, b):
    return f"(2 * {a} * {b} / greatest({a} + {b}, 1e-300))"


def _coarse_rows(spark, folder):
    """Vectors with few distinct values a component, so that bins are exact; all rows train fold 0."""
    rows = _vectors(spark, folder).withColumn("x", F.transform("x", lambda v: F.floor(v * 8).cast("double")))
    return stage(rows.withColumn("fold", F.lit(-1)))


def _nodes(model):
    return report(model, ["heap", "feature", "threshold"], ["value"])


@query("boosted_round", _tree_sql(
    3, ["given AS (SELECT r, CAST(0.5 - y AS DOUBLE) AS a, CAST(0.25 AS DOUBLE) AS b FROM (SELECT DISTINCT r, y FROM coarse))"],
    f"({_worth('l0', 'l1')} + {_worth('(t0 - l0)', '(t1 - l1)')} - {_worth('t0', 't1')}) / 2", "l1 >= 1 AND r1 >= 1 AND rn > 0", 1e-6,
    "t1 >= 2", f"-0.1 * {_soft('t0')} / (t1 + 1)"))
def boosted_round(spark, folder):
    """The first tree of the second-order booster on all rows, grown by one aggregation per level."""
    rule = trees.Boosting(trees=1, depth=3, rows=1.0, columns=1.0)
    return _nodes(trees.train(_coarse_rows(spark, folder), "Pathol", [0], rule, local_bytes=0, subtree_rows=0))


@query("impurity_tree", _tree_sql(
    3, ["""given AS (
  SELECT r, CASE WHEN y = 0 THEN n / (2 * (n - p)) ELSE 0 END AS a, CASE WHEN y = 1 THEN n / (2 * p) ELSE 0 END AS b
  FROM (SELECT r, y, CAST(count(*) OVER () AS DOUBLE) AS n, CAST(sum(y) OVER () AS DOUBLE) AS p FROM (SELECT DISTINCT r, y FROM coarse)))"""],
    f"{_loss('t0', 't1')} - {_loss('l0', 'l1')} - {_loss('(t0 - l0)', '(t1 - l1)')}", "ln >= 5 AND rn >= 5", -1e-9,
    "tn >= 10 AND least(t0, t1) > 1e-9", "t1 / (t0 + t1)"))
def impurity_tree(spark, folder):
    """A class-balanced decision tree of least impurity on all rows, grown by one aggregation per level."""
    rule = trees.Impurity(depth=3, min_split=10, min_leaf=5)
    return _nodes(trees.train(_coarse_rows(spark, folder), "Pathol", [0], rule, local_bytes=0, subtree_rows=0))


@query("out_of_bag")
def out_of_bag(spark, folder):
    """Accuracy of the full-size forest on the rows that each tree's bag leaves out: one row."""
    rows = stage(stage(classify.standardized(stage(_vectors(spark, folder)))).withColumn("fold", F.lit(-1)))
    rule = trees.rule_of("random_forest", classify.width_of(rows))
    scored = trees.out_of_bag(trees.train(rows, "Pathol", [0], rule), rows, rule, 0)
    right = ((F.col("score") > 0.5) == (F.col("label") == "Pathol")).cast("double")
    return scored.agg(F.count("score").alias("n_scored"), F.avg("trees").alias("trees_a_row"), r6(F.avg(right)).alias("oob_score"))


def _wide(spark, folder):
    """Vector components as feature columns under family names, and their names ranked by F."""
    k = F.col("feature")
    prefix = F.when(k % 3 == 0, "glcm_").when(k % 3 == 1, "lbp_").otherwise("stat_")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("f_score"), "feature")
    scores = selection.anova(_stats(spark, folder))
    ranked = stage(scores.select(F.row_number().over(order).alias("rank"), F.concat(prefix, k).alias("feature")))
    names = {int(r.feature.split("_")[1]): r.feature for r in ranked.collect()}  # one row per feature
    vectors = _vectors(spark, folder)
    return stage(vectors.select("row_id", "label", *[F.get("x", F.lit(i)).alias(name) for i, name in sorted(names.items())])), ranked


@query("model_comparison")
def model_comparison(spark, folder):
    """Two models on every feature subset, with the best of each subset and of all: one row per subset and model."""
    wide, ranked = _wide(spark, folder)
    subsets = {r.subset: list(r.features) for r in classify.subsets(ranked).collect()}
    records = classify.classify(wide, subsets, ("logistic_regression", "naive_bayes"))
    _, top = classify.best_results(records)
    each = stage(classification_document(spark, records)).select("subset", "best_model", F.explode("models").alias("m"))
    best = F.col("m.model_name") == F.col("best_model")
    first = (F.col("subset") == top["subset"]) & (F.col("m.model_name") == top["model_name"])
    metrics = ("accuracy", "precision", "recall", "f1_score", "roc_auc")
    return each.select("subset", "m.model_name", *[r6(F.col(f"m.{c}")).alias(c) for c in metrics], best.alias("is_best"), first.alias("is_top"))


@query("cross_validation")
def cross_validation(spark, folder):
    """Ten-fold weighted F1 of every model on standardised vectors, all folds of a model at once: one row per model."""
    vectors = stage(classify.standardized(stage(_vectors(spark, folder))))
    width, rows = classify.width_of(vectors), stage(classify.cv_folds(vectors))
    predicted = classify.predict_folds(classify.MODELS, rows, ("Normal", "Pathol"), width)
    each = [
        classify.fold_scores(predicted[name]).select(
            F.lit(name).alias("model_name"), r6("cv_f1_mean").alias("cv_f1_mean"), r6("cv_f1_std").alias("cv_f1_std")
        )
        for name in classify.MODELS
    ]
    return reduce(DataFrame.unionByName, each)
