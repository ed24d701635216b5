"""Queries over plain tables and segment selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r6
from ..operators import eda, segment
from ..sources.tables import table
from .common import SIG, report, signals
from .registry import query, rounded, with_ctes

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

_PARTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS v FROM lineitem" for c in NUMBERS)


@query("describe", f"""
SELECT "column", "count", {rounded('mean', 'std', 'min', 'p25', 'p50', 'p75', 'max')} FROM (
  SELECT "column", count(v) AS "count", avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min,
         quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max
  FROM ({_PARTS}) GROUP BY 1)""")
def describe(spark, folder):
    found = eda.describe(table(spark, folder, "lineitem"), NUMBERS)
    return report(found, ["column", "count"], ["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("crosstab", """
SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O"
FROM lineitem GROUP BY 1""")
def crosstab(spark, folder):
    return eda.crosstab(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("distinct_counts", """
SELECT 'lang' AS "column", count(DISTINCT lang) AS n_unique, count(DISTINCT lang) > 1 AS varies FROM documents UNION ALL
SELECT 'source', count(DISTINCT source), count(DISTINCT source) > 1 FROM documents UNION ALL
SELECT 'n_chars', count(DISTINCT n_chars), count(DISTINCT n_chars) > 1 FROM documents""")
def distinct_counts(spark, folder):
    return eda.distinct_counts(table(spark, folder, "documents"), ["lang", "source", "n_chars"])


@query("histogram_by_class", """
SELECT CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, lang, count(*) AS c
FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS v FROM documents)
JOIN (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents) ON true GROUP BY ALL""")
def histogram_by_class(spark, folder):
    return eda.histogram_by(table(spark, folder, "documents"), "lang", "n_chars")


@query("density_by_class", """
SELECT lang, point, round(x, 6) + 0.0 AS x, round(density, 10) + 0.0 AS density FROM (
  SELECT d.lang, point, any_value(x) AS x, sum(exp(-0.5 * ((v - x) / h) * ((v - x) / h))) / any_value(n) / any_value(h) / sqrt(2 * pi()) AS density
  FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS v FROM documents) d
  JOIN (SELECT lang, count(*) AS n, stddev_samp(n_chars) * pow(count(*), -0.2) AS h FROM documents GROUP BY 1) s ON s.lang = d.lang
  JOIN (SELECT CAST(unnest(range(32)) AS INTEGER) AS point) g ON true
  JOIN (SELECT point AS p2, lo + (hi - lo) * point / 31 AS x FROM (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents)
        JOIN (SELECT CAST(unnest(range(32)) AS INTEGER) AS point) ON true) q ON q.p2 = g.point
  GROUP BY d.lang, point)""")
def density_by_class(spark, folder):
    found = eda.density_by(table(spark, folder, "documents"), "lang", "n_chars")
    return found.select("lang", "point", r6("x").alias("x"), r6("density", 10).alias("density"))


@query("count_by_class", "SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL")
def count_by_class(spark, folder):
    return table(spark, folder, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("c"))


# Settings for short series: frames of 8 with hop 2, windows of 32 samples, edges of 4.
FRAME, HOP, DB, TARGET, EDGE = 8, 2, 6.0, 32, 4

POWER = f"""hop AS (SELECT signal_id, i // {HOP} AS k, sum(y * y) AS e, any_value(n) AS n FROM sig GROUP BY ALL),
frame AS (
  SELECT signal_id, t, n, sum(e) / {FRAME} AS power FROM (
    SELECT signal_id, k + o - 1 AS t, n, e FROM hop JOIN (SELECT unnest(range({FRAME // HOP})) AS o) ON true)
  WHERE t >= 0 AND t <= n // {HOP} GROUP BY ALL),
loud AS (
  SELECT signal_id, t, n FROM (SELECT *, max(power) OVER (PARTITION BY signal_id) AS peak FROM frame)
  WHERE 10 * log10(greatest(power, 1e-10)) - 10 * log10(greatest(peak, 1e-10)) > -{DB}),
active AS (
  SELECT signal_id, min(t) * {HOP} AS s, least((max(t) + 1) * {HOP}, any_value(n)) AS e FROM (
    SELECT *, t - row_number() OVER (PARTITION BY signal_id ORDER BY t) AS g FROM loud) GROUP BY signal_id, g)"""
LONGEST = """longest AS (
  SELECT signal_id, s, e FROM (
    SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY e - s DESC, s) AS rn FROM active) WHERE rn = 1)"""
WINDOW = f"""side AS (
  SELECT signal_id, sum(y * y) FILTER (i < s + {EDGE}) AS head, sum(y * y) FILTER (i >= e - {EDGE}) AS tail
  FROM sig JOIN longest USING (signal_id) WHERE i >= s AND i < e GROUP BY 1),
base AS (
  SELECT signal_id, n, s, e, head, tail, CASE WHEN n < {TARGET} THEN 'short' WHEN s IS NULL THEN 'silent' WHEN e - s >= {TARGET} THEN 'trim' ELSE 'extend' END AS "case"
  FROM (SELECT signal_id, any_value(n) AS n FROM sig GROUP BY 1) LEFT JOIN longest USING (signal_id) LEFT JOIN side USING (signal_id)),
ext AS (
  SELECT *, b0 + least(s - b0, need - b0 - aft) AS bef FROM (
    SELECT *, least(n - e, need - b0) AS aft FROM (
      SELECT *, {TARGET} - (e - s) AS need, least(s, ({TARGET} - (e - s)) // 2) AS b0 FROM base))),
win AS (
  SELECT signal_id, n, "case", greatest({TARGET} - n, 0) AS pad,
         CASE WHEN "case" IN ('short', 'silent') THEN 0 WHEN "case" = 'extend' THEN s - bef WHEN head < tail THEN e - {TARGET} ELSE s END AS lo,
         CASE WHEN "case" = 'short' THEN n WHEN "case" = 'silent' THEN {TARGET} WHEN "case" = 'extend' THEN e + aft WHEN head < tail THEN e ELSE s + {TARGET} END AS hi
  FROM ext)"""
SEGMENT = """seg AS (
  SELECT signal_id, i - lo AS i, hi - lo + pad AS n, y FROM sig JOIN win USING (signal_id) WHERE i >= lo AND i < hi UNION ALL
  SELECT signal_id, unnest(range(hi - lo, hi - lo + pad)) AS i, hi - lo + pad AS n, 0.0 FROM win WHERE pad > 0)"""
PEAK = """norm AS (
  SELECT signal_id, i, n, CASE WHEN p > 0 THEN y / p ELSE y END AS y
  FROM (SELECT *, max(abs(y)) OVER (PARTITION BY signal_id) AS p FROM {src}))"""


def _active(spark, folder):
    return segment.active_intervals(signals(spark, folder), DB, FRAME, HOP)


def _window(spark, folder, target=TARGET):
    sig = signals(spark, folder)
    longest = segment.longest_interval(segment.active_intervals(sig, DB, FRAME, HOP))
    return segment.choose_window(sig, longest, target, EDGE)


@query("frame_power", with_ctes(SIG, POWER, tail="SELECT signal_id, t, n, round(power, 8) + 0.0 AS power FROM frame"))
def frame_power(spark, folder):
    found = segment.frame_power(signals(spark, folder), FRAME, HOP)
    return found.select("signal_id", "t", "n", r6("power", 8).alias("power"))


@query("active_intervals", with_ctes(SIG, POWER, tail="SELECT signal_id, s, e FROM active"))
def active_intervals(spark, folder):
    return _active(spark, folder)


@query("longest_interval", with_ctes(SIG, POWER, LONGEST, tail="SELECT signal_id, s, e FROM longest"))
def longest_interval(spark, folder):
    return segment.longest_interval(_active(spark, folder))


@query("silence_intervals", with_ctes(SIG, POWER, tail=f"""
SELECT signal_id, s, e, {rounded('start_s', 'end_s')} FROM (
  SELECT signal_id, e AS s, coalesce(nx, n) AS e, e / 25000.0 AS start_s, coalesce(nx, n) / 25000.0 AS end_s FROM (
    SELECT *, lead(s) OVER (PARTITION BY signal_id ORDER BY s) AS nx FROM (
      SELECT signal_id, s, e FROM active UNION ALL SELECT DISTINCT signal_id, -1, 0 FROM sig)
    JOIN (SELECT DISTINCT signal_id, n FROM sig) USING (signal_id))) WHERE e > s"""))
def silence_intervals(spark, folder):
    sig = signals(spark, folder)
    lengths = sig.groupBy("signal_id").agg(F.first("n").alias("n"))
    found = eda.silence_intervals(segment.active_intervals(sig, DB, FRAME, HOP), lengths)
    return report(found, ["signal_id", "s", "e"], ["start_s", "end_s"])


@query("segment_window", with_ctes(SIG, POWER, LONGEST, WINDOW, tail='SELECT signal_id, n, lo, hi, pad, "case" FROM win'))
def segment_window(spark, folder):
    return _window(spark, folder)


_PADDED = tuple(part.replace(str(TARGET), "70") for part in (WINDOW, SEGMENT))


@query("segment_zero_padded", with_ctes(SIG, POWER, LONGEST, *_PADDED, tail=f"""
SELECT signal_id, i, n, {rounded('y')} FROM seg"""))
def segment_zero_padded(spark, folder):
    """A target most series do not reach: they are padded with zeros."""
    found = segment.cut_segment(signals(spark, folder), _window(spark, folder, 70))
    return report(found, ["signal_id", "i", "n"], ["y"])


@query("peak_normalize", with_ctes(SIG, PEAK.format(src="sig"), tail=f"SELECT signal_id, i, n, {rounded('y')} FROM norm"))
def peak_normalize(spark, folder):
    return report(segment.peak_normalize(signals(spark, folder)), ["signal_id", "i", "n"], ["y"])


@query("quantize_pcm16", with_ctes(SIG, PEAK.format(src="sig"), tail=f"""
SELECT signal_id, i, n, CAST(pcm AS INTEGER) AS pcm, round(pcm / 32768.0, 6) + 0.0 AS y
FROM (SELECT *, greatest(least(round_even(y * 32767, 0), 32767), -32768) AS pcm FROM norm)"""))
def quantize_pcm16(spark, folder):
    found = segment.quantize_pcm16(segment.peak_normalize(signals(spark, folder)))
    return report(found, ["signal_id", "i", "n", "pcm"], ["y"])


@query("mono_mix", """
SELECT signal_id, i, round(avg(y), 6) + 0.0 AS y FROM (
  SELECT l_orderkey AS signal_id, l_linenumber AS i, y FROM lineitem, (SELECT unnest([0, 1]) AS ch),
  LATERAL (SELECT CASE WHEN ch = 0 THEN l_quantity ELSE l_discount END AS y)) GROUP BY ALL""")
def mono_mix(spark, folder):
    both = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("signal_id"),
        F.col("l_linenumber").alias("i"),
        F.lit(1).alias("n"),
        F.explode(F.array("l_quantity", "l_discount")).alias("y"),
    )
    return report(segment.mono(both), ["signal_id", "i"], ["y"])


@query("preprocess_segment", with_ctes(SIG, POWER, LONGEST, WINDOW, SEGMENT, PEAK.format(src="seg"), tail=f"""
SELECT signal_id, i, n, {rounded('y')} FROM norm"""))
def preprocess_segment(spark, folder):
    found = segment.preprocess(signals(spark, folder), TARGET, EDGE, DB, FRAME, HOP)
    return report(found, ["signal_id", "i", "n"], ["y"])


DOUBLED = """tap AS (SELECT unnest(range(-31, 33)) AS k),
pos AS (SELECT signal_id, n, i + p AS i FROM (SELECT signal_id, n, 2 * i AS i FROM sig), (SELECT unnest([0, 1]) AS p)),
res AS (
  SELECT pos.signal_id, pos.i, 2 * pos.n AS n,
         coalesce(sum(sig.y * CASE WHEN gap = 0 THEN 1 ELSE sin(pi() * gap) / (pi() * gap) END
                      * (0.5 + 0.5 * cos(pi() * gap / 32))), 0) AS y
  FROM (SELECT pos.signal_id, pos.i, pos.n, pos.i // 2 + k AS at, pos.i / 2.0 - (pos.i // 2 + k) AS gap FROM pos, tap) pos
  LEFT JOIN sig ON sig.signal_id = pos.signal_id AND sig.i = pos.at
  GROUP BY ALL)"""


@query("resample", with_ctes(SIG, DOUBLED, tail=f"SELECT signal_id, i, n, {rounded('y')} FROM res"))
def resample(spark, folder):
    """Doubled rate: every series comes out twice as long, in blocks shorter than the series."""
    found = segment.resample(signals(spark, folder).withColumn("sr", F.lit(12500)), size=32)
    return report(found, ["signal_id", "i", "n"], ["y"])


@query("outcome_counts", with_ctes(SIG, POWER, LONGEST, WINDOW, tail='SELECT "case", count(*) AS c FROM win GROUP BY 1'))
def outcome_counts(spark, folder):
    return segment.outcome_counts(_window(spark, folder), "case")
