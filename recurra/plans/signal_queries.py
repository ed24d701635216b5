"""Queries over time series: lag curves, delay and dimension choice, recurrence matrices."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import params, recurrence
from ..session import stage
from .common import CELL, DIM_MAX, IMAGE, M, PTS, SIG, TAU, TAU_MAX, images, report, series, signals
from .registry import query, rounded, with_ctes

CODES = """span AS (SELECT signal_id, min(y) AS lo, max(y) AS hi, avg(y) AS mu FROM sig GROUP BY 1),
codes AS (
  SELECT signal_id, i, n, y, CASE WHEN y >= hi THEN 10 ELSE {steps} END AS code
  FROM sig JOIN span USING (signal_id))""".format(
    steps=" + ".join(
        f"CAST(y >= lo + (hi - lo) / CAST(10 AS DOUBLE) * CAST({k} AS DOUBLE) AS INTEGER)"
        for k in range(1, 10)
    )
)
LAGS = f"lags AS (SELECT CAST(unnest(range(1, {TAU_MAX + 1})) AS INTEGER) AS lag)"
HX = """hx AS (
  SELECT signal_id, sum(-(c / n) * ln(c / n)) AS h FROM (
    SELECT signal_id, least(code, 9) AS code, CAST(count(*) AS DOUBLE) AS c, CAST(any_value(n) AS DOUBLE) AS n
    FROM codes GROUP BY 1, 2) GROUP BY 1)"""
MI = """joint0 AS (
  SELECT a.signal_id, lag, a.code AS x, b.code AS y, count(*) AS c
  FROM codes a JOIN lags ON true JOIN codes b ON a.signal_id = b.signal_id AND b.i = a.i + lag
  GROUP BY ALL),
joint1 AS (
  SELECT signal_id, lag, c,
         CASE WHEN min(x) OVER w = 0 AND max(x) OVER w = 10 THEN least(x, 9) ELSE x END AS x,
         CASE WHEN min(y) OVER w = 0 AND max(y) OVER w = 10 THEN least(y, 9) ELSE y END AS y
  FROM joint0 WINDOW w AS (PARTITION BY signal_id, lag)),
joint AS (SELECT signal_id, lag, x, y, CAST(sum(c) AS DOUBLE) AS c FROM joint1 GROUP BY ALL),
tot AS (SELECT signal_id, lag, sum(c) AS t FROM joint GROUP BY ALL),
hxy AS (SELECT signal_id, lag, sum(-(c / t) * ln(c / t)) AS h FROM joint JOIN tot USING (signal_id, lag) GROUP BY ALL),
hy AS (SELECT signal_id, lag, sum(-(c / t) * ln(c / t)) AS h
       FROM (SELECT signal_id, lag, y, sum(c) AS c FROM joint GROUP BY ALL) JOIN tot USING (signal_id, lag) GROUP BY ALL),
mi AS (SELECT hxy.signal_id, hxy.lag, hx.h + hy.h - hxy.h AS value
       FROM hxy JOIN hy USING (signal_id, lag) JOIN hx ON hx.signal_id = hxy.signal_id)"""
ACF = """acf AS (
  SELECT a.signal_id, lag, sum((a.y - mu) * (b.y - mu)) / any_value(whole) AS value
  FROM (SELECT sig.*, mu, sum((y - mu) * (y - mu)) OVER (PARTITION BY signal_id) AS whole
        FROM sig JOIN (SELECT signal_id, avg(y) AS mu FROM sig GROUP BY 1) USING (signal_id)) a
  JOIN lags ON true JOIN sig b ON a.signal_id = b.signal_id AND b.i = a.i + lag
  GROUP BY a.signal_id, lag)"""
LOCAL_MIN = """tau_mi AS (
  SELECT signal_id, CAST(coalesce(min(lag) FILTER (value < p AND value < q),
                                  arg_min(lag, (value, lag))) AS INTEGER) AS tau
  FROM (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS q FROM mi
        WINDOW w AS (PARTITION BY signal_id ORDER BY lag)) GROUP BY 1)"""
CROSS = """tau_acf AS (
  SELECT signal_id, CAST(min(lag) FILTER (sign(value) <> sign(q)) AS INTEGER) AS tau
  FROM (SELECT *, lead(value) OVER (PARTITION BY signal_id ORDER BY lag) AS q FROM acf) GROUP BY 1)"""
_COORD = ", ".join(f"lead(y, {k * TAU}) OVER w AS x{k}" for k in range(DIM_MAX + 1))


def _nearest(d: int) -> str:
    """arg_min skips NULL arguments, so the neighbour's next coordinate is looked up by index."""
    gap = " + ".join(f"(a.x{k} - b.x{k}) * (a.x{k} - b.x{k})" for k in range(d))
    return f"""SELECT {d} AS d, q.signal_id, q.i, q.dist, q.j, a.x{d} - b.x{d} AS step
    FROM (SELECT signal_id, i, m.d AS dist, m.j AS j FROM (
            SELECT a.signal_id, a.i, min({{'d': sqrt({gap}), 'j': b.i}}) AS m
            FROM emb a JOIN emb b ON a.signal_id = b.signal_id AND a.i <> b.i
            WHERE a.i < a.n - {(d - 1) * TAU} AND b.i < b.n - {(d - 1) * TAU}
            GROUP BY a.signal_id, a.i)) q
    JOIN emb a ON a.signal_id = q.signal_id AND a.i = q.i
    JOIN emb b ON b.signal_id = q.signal_id AND b.i = q.j"""


FNN = f"""emb AS (SELECT signal_id, i, n, {_COORD} FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY i)),
nn AS ({" UNION ALL ".join(_nearest(d) for d in range(1, DIM_MAX + 1))}),
dev AS (SELECT signal_id, stddev_pop(y) AS sd FROM sig GROUP BY 1),
rate AS (
  SELECT signal_id, d, 100.0 * avg(CASE WHEN (dist > 0 AND r1 / dist > 15) OR r1 > 2 * sd THEN 1.0 ELSE 0.0 END) AS value
  FROM (SELECT *, sqrt(dist * dist + step * step) AS r1 FROM nn WHERE step IS NOT NULL)
  JOIN dev USING (signal_id) GROUP BY ALL),
fnn AS (SELECT signal_id, CAST(g.d AS INTEGER) AS lag, coalesce(value, 100.0) AS value
        FROM dev JOIN (SELECT unnest(range(1, {DIM_MAX + 1})) AS d) g ON true LEFT JOIN rate USING (signal_id, d))"""


def _mi(spark, folder):
    return params.mutual_information(signals(spark, folder), TAU_MAX)


def _acf(spark, folder):
    return params.autocorrelation(signals(spark, folder), TAU_MAX)


def _fnn(spark, folder):
    return params.false_neighbors(signals(spark, folder), DIM_MAX, TAU)


@query("signal_index", with_ctes(SIG, tail=f"SELECT signal_id, i, n, {rounded('y')} FROM sig"))
def signal_index(spark, folder):
    return report(series(spark, folder), ["signal_id", "i", "n"], ["y"])


@query("bin_codes", with_ctes(SIG, CODES, tail="SELECT signal_id, i, code FROM codes"))
def bin_codes(spark, folder):
    return params.bin_codes(signals(spark, folder)).select("signal_id", "i", "code")


@query("series_entropy", with_ctes(SIG, CODES, HX, tail=f"SELECT signal_id, {rounded('h')} FROM hx"))
def series_entropy(spark, folder):
    return report(params.series_entropy(params.bin_codes(signals(spark, folder))), ["signal_id"], ["h"])


@query(
    "mutual_information",
    with_ctes(SIG, CODES, LAGS, HX, MI, tail=f"SELECT signal_id, lag, {rounded('value')} FROM mi"),
)
def mutual_information(spark, folder):
    return report(_mi(spark, folder), ["signal_id", "lag"], ["value"])


@query(
    "autocorrelation",
    with_ctes(SIG, LAGS, ACF, tail=f"SELECT signal_id, lag, {rounded('value')} FROM acf"),
)
def autocorrelation(spark, folder):
    return report(_acf(spark, folder), ["signal_id", "lag"], ["value"])


@query(
    "first_local_minimum",
    with_ctes(SIG, CODES, LAGS, HX, MI, LOCAL_MIN, tail="SELECT signal_id, tau FROM tau_mi"),
)
def first_local_minimum(spark, folder):
    return params.first_local_minimum(_mi(spark, folder))


@query(
    "first_zero_crossing",
    with_ctes(SIG, LAGS, ACF, CROSS, tail="SELECT signal_id, tau FROM tau_acf"),
)
def first_zero_crossing(spark, folder):
    return params.first_zero_crossing(_acf(spark, folder))


CHOICE = """choice AS (
  SELECT signal_id, m.tau AS tau_mi, a.tau AS tau_acf, coalesce(m.tau, a.tau, 1) AS tau
  FROM tau_mi m FULL JOIN tau_acf a USING (signal_id))"""
DIMS = f"""dims AS (
  SELECT signal_id, CAST(coalesce(min(lag) FILTER (value <= 5), {DIM_MAX}) AS INTEGER) AS dim
  FROM fnn GROUP BY 1)"""
LONG_ENOUGH = (DIM_MAX - 1) * TAU_MAX + 1


@query(
    "choose_delay",
    with_ctes(SIG, CODES, LAGS, HX, MI, LOCAL_MIN, ACF, CROSS, CHOICE,
              tail="SELECT signal_id, tau_mi, tau_acf, tau FROM choice"),
)
def choose_delay(spark, folder):
    return params.choose_delay(_mi(spark, folder), _acf(spark, folder))


@query("min_length_filter", with_ctes(SIG, tail=f"""
SELECT signal_id, count(*) AS samples FROM sig WHERE n >= {LONG_ENOUGH} GROUP BY 1"""))
def min_length_filter(spark, folder):
    kept = params.min_length(series(spark, folder), TAU_MAX, DIM_MAX)
    return kept.groupBy("signal_id").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "takens_embedding",
    with_ctes(SIG, PTS, tail=f"SELECT signal_id, i, {rounded('x0', 'x1', 'x2')} FROM pts"),
)
def takens_embedding(spark, folder):
    return report(
        params.takens(series(spark, folder), M, TAU), ["signal_id", "i"], ["x0", "x1", "x2"]
    )


@query(
    "nearest_neighbor",
    with_ctes(SIG, FNN, tail=f"SELECT signal_id, CAST(d AS INTEGER) AS d, i, j, {rounded('dist')} FROM nn"),
)
def nearest_neighbor(spark, folder):
    found = params.nearest_neighbors(signals(spark, folder), DIM_MAX, TAU)
    return report(found, ["signal_id", "d", "i", "j"], ["dist"])


@query(
    "false_neighbors",
    with_ctes(SIG, FNN, tail=f"SELECT signal_id, lag, {rounded('value')} FROM fnn"),
)
def false_neighbors(spark, folder):
    return report(_fnn(spark, folder), ["signal_id", "lag"], ["value"])


@query("choose_dimension", with_ctes(SIG, FNN, DIMS, tail="SELECT signal_id, dim FROM dims"))
def choose_dimension(spark, folder):
    return params.choose_dimension(_fnn(spark, folder), dim_max=DIM_MAX)


RECORDS = (SIG, CODES, LAGS, HX, MI, LOCAL_MIN, ACF, CROSS, CHOICE, FNN, DIMS, """records AS (
  SELECT signal_id, tau_mi, tau_acf, dim AS dim_fnn FROM choice JOIN dims USING (signal_id))""")


def _records(spark, folder):
    delays = params.choose_delay(_mi(spark, folder), _acf(spark, folder))
    dims = params.choose_dimension(_fnn(spark, folder), dim_max=DIM_MAX)
    return stage(
        delays.join(dims, "signal_id").select(
            "signal_id", "tau_mi", "tau_acf", F.col("dim").alias("dim_fnn")
        )
    )


@query("parameter_summary", with_ctes(*RECORDS, tail=f"""
SELECT parameter, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) + 0.0 AS mean, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) + 0.0 AS median
FROM (SELECT 'tau_mi' AS parameter, tau_mi AS value FROM records UNION ALL
      SELECT 'tau_acf', tau_acf FROM records UNION ALL SELECT 'dim_fnn', dim_fnn FROM records)
WHERE value IS NOT NULL GROUP BY 1"""))
def parameter_summary(spark, folder):
    return report(
        params.parameter_summary(_records(spark, folder)), ["parameter", "n"], ["mean", "median"]
    )


@query("parameter_spread", with_ctes(*RECORDS, tail=f"""
SELECT parameter, count(*) AS n, {rounded("least", "q1", "median", "q3", "most")} FROM (
  SELECT parameter, value, min(value) OVER w AS least, max(value) OVER w AS most, quantile_cont(value, 0.25) OVER w AS q1,
         quantile_cont(value, 0.5) OVER w AS median, quantile_cont(value, 0.75) OVER w AS q3
  FROM (SELECT 'tau_mi' AS parameter, CAST(tau_mi AS DOUBLE) AS value FROM records UNION ALL
        SELECT 'tau_acf', tau_acf FROM records UNION ALL SELECT 'dim_fnn', dim_fnn FROM records)
  WHERE value IS NOT NULL WINDOW w AS (PARTITION BY parameter)) GROUP BY ALL"""))
def parameter_spread(spark, folder):
    return report(params.parameter_spread(_records(spark, folder)), ["parameter", "n"], ["least", "q1", "median", "q3", "most"])


@query("parameter_modes", with_ctes(*RECORDS, tail="""
SELECT CAST(bucket AS BIGINT) AS bucket, tau AS mode, c FROM (
  SELECT *, max(c) OVER (PARTITION BY bucket) AS best FROM (
    SELECT dim_fnn AS bucket, tau_mi AS tau, count(*) AS c FROM records
    WHERE tau_mi IS NOT NULL GROUP BY ALL)) WHERE c = best"""))
def parameter_modes(spark, folder):
    found = params.modes(_records(spark, folder), "dim_fnn", "tau_mi")
    return found.select(F.col("dim_fnn").cast("long").alias("bucket"), "mode", "c")


@query("cumulative_coverage", with_ctes(*RECORDS, tail="""
SELECT grp, value, c, round(c / total, 6) + 0.0 AS share, round(run / total, 6) + 0.0 AS coverage FROM (
  SELECT grp, value, c, CAST(sum(c) OVER (PARTITION BY grp) AS DOUBLE) AS total,
         sum(c) OVER (PARTITION BY grp ORDER BY value) AS run
  FROM (SELECT tau_mi AS grp, dim_fnn AS value, count(*) AS c FROM records GROUP BY ALL))"""))
def cumulative_coverage(spark, folder):
    found = params.cumulative_coverage(_records(spark, folder), "tau_mi", "dim_fnn")
    return report(found.withColumnRenamed("tau_mi", "grp"), ["grp", "value", "c"], ["share", "coverage"])


@query("reprocess_set", with_ctes(SIG, LAGS, ACF, CROSS, tail="""
SELECT DISTINCT user_id AS signal_id FROM (
  SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT signal_id FROM tau_acf)
  UNION ALL SELECT signal_id FROM tau_acf WHERE tau IS NULL)"""))
def reprocess_set(spark, folder):
    processed = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_custkey").alias("signal_id")
    )
    results = params.first_zero_crossing(_acf(spark, folder))
    return params.needs_reprocessing(processed, results, "signal_id")


@query("parameter_records")
def parameter_records(spark, folder):
    """Per-signal delays feed the neighbour search, within the operator's own limits of 100 lags and 10 dimensions.

    Read from the long series; those of up to 900 samples have no record.
    """
    return params.parameter_records(long_signals(spark, folder))


@query("short_parameter_records")
def short_parameter_records(spark, folder):
    """The same for the users' short series, with limits so low that every series qualifies."""
    return params.parameter_records(signals(spark, folder), 8, 5)


PAIR = "pair AS (SELECT * FROM cell WHERE i < j)"


@query("rp_distance_summary", with_ctes(SIG, PTS, CELL, PAIR, tail=f"""
SELECT signal_id, pairs, {rounded('d_max', 'd_sum')} FROM (
  SELECT image_id AS signal_id, count(*) AS pairs, max(d) AS d_max, sum(d) AS d_sum FROM pair GROUP BY 1)"""))
def rp_distance_summary(spark, folder):
    found = recurrence.distance_summary(signals(spark, folder), M, TAU)
    return report(found, ["signal_id", "pairs"], ["d_max", "d_sum"])


EPS = """eps AS (
  SELECT image_id, count(*) AS n, quantile_cont(d, 0.1) AS eps FROM pair GROUP BY 1)"""


@query(
    "rp_epsilon",
    with_ctes(SIG, PTS, CELL, PAIR, EPS, tail=f"SELECT image_id AS signal_id, n, {rounded('eps')} FROM eps"),
)
def rp_epsilon(spark, folder):
    return report(
        recurrence.epsilon_percentile(signals(spark, folder), M, TAU), ["signal_id", "n"], ["eps"]
    )


@query("rp_binary_counts", with_ctes(SIG, PTS, CELL, PAIR, EPS, tail="""
SELECT image_id, CAST(CASE WHEN d <= eps + 1e-12 * eps THEN 0 ELSE 255 END AS INTEGER) AS v, count(*) AS c
FROM cell JOIN eps USING (image_id) GROUP BY ALL"""))
def rp_binary_counts(spark, folder):
    tiles = images(spark, folder, binary=True)
    return recurrence.gray_counts(tiles).select("image_id", "v", "c")


@query("rp_binary_fixed", with_ctes(SIG, PTS, CELL, tail="""
SELECT image_id, CAST(CASE WHEN d <= 40.0 THEN 0 ELSE 255 END AS INTEGER) AS v, count(*) AS c
FROM cell GROUP BY ALL"""))
def rp_binary_fixed(spark, folder):
    tiles = images(spark, folder, binary=True, epsilon=40.0)
    return recurrence.gray_counts(tiles).select("image_id", "v", "c")


@query("rp_gray_rows", with_ctes(*IMAGE, tail="""
SELECT image_id, r, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v * c) AS BIGINT) AS ws FROM img GROUP BY ALL"""))
def rp_gray_rows(spark, folder):
    return recurrence.image_rows(images(spark, folder))


@query("rp_unflipped_rows", with_ctes(*IMAGE, tail="""
SELECT image_id, i AS r, CAST(sum(v) AS BIGINT) AS s, CAST(sum(v * j) AS BIGINT) AS ws FROM gray GROUP BY ALL"""))
def rp_unflipped_rows(spark, folder):
    return recurrence.image_rows(images(spark, folder, flip=False))


@query("rp_image_name", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'n_' ELSE 'p_' END || CAST(doc_id AS VARCHAR) || '_rp_pure.png' AS name
FROM labels""")
def rp_image_name(spark, folder):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    label = F.when(F.col("quality") == 1, "Normal").otherwise("Pathol")
    return labels.select("doc_id", recurrence.image_name(label, F.col("doc_id").cast("string")).alias("name"))


@query("phase_space", with_ctes(SIG, tail=f"""
SELECT signal_id, i, {rounded('x0', 'x1')} FROM (
  SELECT signal_id, i, n, y AS x0, lead(y, {TAU}) OVER (PARTITION BY signal_id ORDER BY i) AS x1 FROM sig)
WHERE i < n - {TAU}"""))
def phase_space(spark, folder):
    """The phase portrait in two dimensions."""
    return report(recurrence.phase_space(series(spark, folder), 2, TAU), ["signal_id", "i"], ["x0", "x1"])


# --- long series: one per event type ------------------------------------------------------------

LONG = SIG.replace("user_id", "event_type")


def long_signals(spark, folder):
    return signals(spark, folder, key="event_type")


@query("long_parameters", with_ctes(LONG, CODES, LAGS, HX, MI, LOCAL_MIN, ACF, CROSS, CHOICE,
                                    tail="SELECT signal_id, tau_mi, tau_acf, tau FROM choice"))
def long_parameters(spark, folder):
    """Series of thousands of samples: several blocks each."""
    sig = long_signals(spark, folder)
    return params.choose_delay(
        params.mutual_information(sig, TAU_MAX), params.autocorrelation(sig, TAU_MAX)
    )


@query("long_false_neighbors", with_ctes(LONG, FNN, tail=f"SELECT signal_id, lag, {rounded('value')} FROM fnn"))
def long_false_neighbors(spark, folder):
    return report(
        params.false_neighbors(long_signals(spark, folder), DIM_MAX, TAU), ["signal_id", "lag"], ["value"]
    )


@query("long_gray_counts", with_ctes(LONG, PTS, CELL, """top AS (SELECT image_id, max(d) AS mx FROM cell GROUP BY 1),
cnt AS (SELECT image_id, CAST(trunc(d / mx * 255) AS INTEGER) AS v, count(*) AS c FROM cell JOIN top USING (image_id) GROUP BY ALL)""",
                                     tail="SELECT image_id, v, c FROM cnt"))
def long_gray_counts(spark, folder):
    return recurrence.gray_levels(long_signals(spark, folder), M, TAU)
