"""Queries over filtered recurrence images: wavelets, Gabor bank, Tamura measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r6
from ..operators import gabor, recurrence, tamura, wavelet
from ..session import stage
from .common import IMAGE, images, report
from .registry import query, rounded, with_ctes


def _dwt(name: str, levels: int) -> str:
    """CTEs computing all subbands as coef(image_id, band, v)."""
    low, high = wavelet.filters(name)
    taps = ", ".join(f"({j}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE))" for j, (a, b) in enumerate(zip(map(float, low), map(float, high))))
    size = len(low)
    parts = [
        f"taps AS (SELECT * FROM (VALUES {taps}) t(j, lo, hi))",
        "lev0 AS (SELECT image_id, side AS n, r, c, CAST(v AS DOUBLE) AS v FROM img)",
    ]
    bands = []
    for k in range(1, levels + 1):
        parts += [
            f"""idx{k} AS (
  SELECT n, k, lo, hi, CASE WHEN t < 0 THEN -1 - t WHEN t >= n THEN 2 * n - 1 - t ELSE t END AS t
  FROM (SELECT n, k, lo, hi, 2 * k + 1 - j AS t
        FROM (SELECT n, unnest(range((n + {size} - 1) // 2)) AS k FROM (SELECT DISTINCT n FROM lev{k - 1})) q JOIN taps ON true))""",
            f"""down{k} AS (
  SELECT image_id, x.n, k AS r, c, sum(lo * v) AS a, sum(hi * v) AS d
  FROM lev{k - 1} x JOIN idx{k} i ON i.n = x.n AND i.t = x.r GROUP BY image_id, x.n, k, c)""",
            f"""both{k} AS (
  SELECT image_id, (x.n + {size} - 1) // 2 AS n, r, k AS c, sum(lo * a) AS aa, sum(hi * a) AS ad, sum(lo * d) AS da, sum(hi * d) AS dd
  FROM down{k} x JOIN idx{k} i ON i.n = x.n AND i.t = x.c GROUP BY image_id, x.n, r, k)""",
            f"lev{k} AS (SELECT image_id, n, r, c, aa AS v FROM both{k})",
        ]
        for tag, column in (("H", "da"), ("V", "ad"), ("D", "dd")):
            bands.append(f"SELECT image_id, 'detail_{tag}_L{k}' AS band, {column} AS v FROM both{k}")
    bands.append(f"SELECT image_id, 'approx_L{levels}', v FROM lev{levels}")
    parts.append(f"coef AS ({' UNION ALL '.join(bands)})")
    return ",\n".join(parts)


BAND = """band AS (
  SELECT image_id, band, count(*) AS n, sum(v * v) AS energy, avg(v) AS mean, stddev_pop(v) AS std,
         min(v) AS lo, max(v) AS hi, max(abs(v)) AS peak FROM coef GROUP BY ALL),
ent AS (
  SELECT image_id, band, sum(-h * log2(h)) AS entropy FROM (
    SELECT image_id, band, count(*) / (any_value(n) * any_value((hi - lo) / 64)) AS h
    FROM (SELECT coef.image_id, coef.band, n, lo, hi,
                 least(floor((v - lo) / (hi - lo) * 64), 63) AS bin
          FROM coef JOIN band USING (image_id, band)) GROUP BY image_id, band, bin) GROUP BY ALL)"""
RATIO = """ratio AS (
  SELECT image_id, a / (a + d) AS wavelet_ratio_approx_total, d / (a + d) AS wavelet_ratio_detail_total,
         eh / d AS wavelet_ratio_horizontal, ev / d AS wavelet_ratio_vertical, ed / d AS wavelet_ratio_diagonal
  FROM (SELECT image_id, sum(energy) FILTER (band LIKE 'approx%') AS a, sum(energy) FILTER (band LIKE 'detail%') AS d,
               sum(energy) FILTER (band LIKE 'detail_H%') AS eh, sum(energy) FILTER (band LIKE 'detail_V%') AS ev,
               sum(energy) FILTER (band LIKE 'detail_D%') AS ed FROM band GROUP BY 1))"""
RATIO_COLUMNS = [
    f"wavelet_ratio_{s}" for s in ("approx_total", "detail_total", "horizontal", "vertical", "diagonal")
]


def _wave_tiles(spark, folder, name, levels, **options):
    return stage(images(spark, folder, halo=wavelet.halo_for(name, levels), **options))


BAND_ITEMS = "round(energy, 2) AS energy, " + ", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in ("mean", "std", "peak"))


def _band_report(stats):
    return stats.select(
        "image_id", "band", "n", F.round("energy", 2).alias("energy"),
        *[r6(c, 8).alias(c) for c in ("mean", "std", "peak")],
    )


@query("dwt_subbands", with_ctes(*IMAGE, _dwt("db4", 3), BAND, tail=f"""
SELECT image_id, band, n, {BAND_ITEMS} FROM band"""))
def dwt_subbands(spark, folder):
    tiles = images(spark, folder, halo=wavelet.halo_for("db4", 3))
    return _band_report(wavelet.subband_stats(tiles, "db4", 3))


@query("dwt_haar", with_ctes(*IMAGE, _dwt("haar", 1), BAND, tail="""
SELECT image_id, band, n, round(energy, 2) AS energy, round(mean * n, 3) + 0.0 AS total, round(std, 6) AS std, round(peak, 6) AS peak FROM band"""))
def dwt_haar(spark, folder):
    tiles = images(spark, folder, halo=wavelet.halo_for("haar", 1), size=24)
    found = wavelet.subband_stats(tiles, "haar", 1).withColumn("total", F.col("mean") * F.col("n"))
    return found.select(
        "image_id", "band", "n", F.round("energy", 2).alias("energy"), r6("total", 3).alias("total"),
        r6("std").alias("std"), r6("peak").alias("peak"),
    )


@query("dwt_small_tiles", with_ctes(*IMAGE, _dwt("db4", 3), BAND, tail=f"""
SELECT image_id, band, n, {BAND_ITEMS} FROM band"""))
def dwt_small_tiles(spark, folder):
    """The same decomposition with every image cut into tiles."""
    tiles = images(spark, folder, halo=wavelet.halo_for("db4", 3), size=32)
    return _band_report(wavelet.subband_stats(tiles, "db4", 3))


@query("dwt_entropy", with_ctes(*IMAGE, _dwt("db4", 3), BAND, tail=f"SELECT image_id, band, {rounded('entropy')} FROM ent"))
def dwt_entropy(spark, folder):
    tiles = _wave_tiles(spark, folder, "db4", 3)
    found = wavelet.subband_entropy(tiles, stage(wavelet.subband_stats(tiles, "db4", 3)), "db4", 3)
    return report(found, ["image_id", "band"], ["entropy"])


@query("dwt_energy_ratios", with_ctes(*IMAGE, _dwt("db4", 3), BAND, RATIO, tail=f"SELECT image_id, {rounded(*RATIO_COLUMNS)} FROM ratio"))
def dwt_energy_ratios(spark, folder):
    tiles = images(spark, folder, halo=wavelet.halo_for("db4", 3))
    return report(wavelet.energy_ratios(wavelet.subband_stats(tiles, "db4", 3)), ["image_id"], RATIO_COLUMNS)


_KINDS = {"energy": "energy", "entropy": "entropy", "mean": "mean", "std": "std", "max": "peak", "n_coeffs": "n"}
_WIDE = {
    f"wavelet_{kind}_{band}": (column, band)
    for band in wavelet.subbands(3)
    for kind, column in _KINDS.items()
}


@query("wavelet_features", with_ctes(*IMAGE, _dwt("db4", 3), BAND, RATIO, tail="""
SELECT image_id, {}, {} FROM band JOIN ent USING (image_id, band) JOIN ratio USING (image_id) GROUP BY image_id""".format(
    ", ".join(f"round(CAST(any_value({c}) FILTER (band = '{b}') AS DOUBLE), 2) + 0.0 AS {n}" for n, (c, b) in _WIDE.items()),
    ", ".join(f"round(any_value({c}), 6) + 0.0 AS {c}" for c in RATIO_COLUMNS))))
def wavelet_features(spark, folder):
    found = wavelet.wavelet_features(_wave_tiles(spark, folder, "db4", 3))
    return found.selectExpr(
        "image_id",
        *[f"round({n}, 2) + 0D AS {n}" for n in _WIDE],
        *[f"round({n}, 6) + 0D AS {n}" for n in RATIO_COLUMNS],
    )


# --- Gabor -------------------------------------------------------------------------------------

_BANK = [(f, o) for f in gabor.FREQUENCIES for o in gabor.ORIENTATIONS]


def _gabor_sql() -> str:
    """The separable bank on lists: down the columns, then along the rows, with reflected ends."""

    def at(values, pos, o):
        t = f"({pos} - ({o}))"
        return f"{values}[CAST(CASE WHEN {t} < 0 THEN -1 - {t} WHEN {t} >= side THEN 2 * side - 1 - {t} ELSE {t} END AS BIGINT) + 1]"

    down, across = [], []
    for number, (f, o) in enumerate(_BANK):
        d, a = gabor.axis_taps(f, o, 1.0)
        reach = len(d) // 2
        for tag, part in (("re", d.real), ("im", d.imag)):
            down.append(
                " + ".join(f"CAST({float(w)!r} AS DOUBLE) * s[{j + 1}]" for j, w in enumerate(part))
                + f" AS d{number}_{tag}"
            )
        assert reach == 3
        re = " + ".join(
            f"(CAST({float(w.real)!r} AS DOUBLE) * {at(f'l{number}_re', 'c', j - 3)} - CAST({float(w.imag)!r} AS DOUBLE) * {at(f'l{number}_im', 'c', j - 3)})"
            for j, w in enumerate(a)
        )
        im = " + ".join(
            f"(CAST({float(w.real)!r} AS DOUBLE) * {at(f'l{number}_im', 'c', j - 3)} + CAST({float(w.imag)!r} AS DOUBLE) * {at(f'l{number}_re', 'c', j - 3)})"
            for j, w in enumerate(a)
        )
        across.append(
            f"SELECT image_id, 'f{f}_o{o}' AS filter, {re} AS re, {im} AS im FROM (SELECT image_id, side, l{number}_re, l{number}_im, unnest(range(side)) AS c FROM rowlist)"
        )
    lists = ", ".join(f"list(d{n}_{t} ORDER BY c) AS l{n}_{t}" for n in range(len(_BANK)) for t in ("re", "im"))
    sources = ", ".join(at("vs", "r", j - 3) for j in range(7))
    return f"""collist AS (SELECT image_id, side, c, list(v / CAST(255.0 AS DOUBLE) ORDER BY r) AS vs FROM img GROUP BY ALL),
seven AS (SELECT image_id, side, r, c, [{sources}] AS s FROM (SELECT *, unnest(range(side)) AS r FROM collist)),
downs AS (SELECT image_id, side, r, c, {", ".join(down)} FROM seven),
rowlist AS (SELECT image_id, side, r, {lists} FROM downs GROUP BY image_id, side, r),
resp AS ({" UNION ALL ".join(across)}),
gab AS (
  SELECT image_id, filter, count(*) AS n, avg(m) AS mag_mean, stddev_pop(m) AS mag_std, max(m) AS mag_max, min(m) AS mag_min,
         quantile_cont(m, 0.25) AS mag_q25, quantile_cont(m, 0.5) AS mag_median, quantile_cont(m, 0.75) AS mag_q75,
         sum(re * re) AS energy_real, sum(im * im) AS energy_imag, sum(re * re) + sum(im * im) AS energy_total,
         sum(re * re) / (sum(re * re) + sum(im * im)) AS energy_ratio,
         avg(re) AS real_mean, avg(im) AS imag_mean, stddev_pop(re) AS real_std, stddev_pop(im) AS imag_std,
         avg(p) AS phase_mean, stddev_pop(p) AS phase_std, sqrt(pow(avg(cos(p)), 2) + pow(avg(sin(p)), 2)) AS phase_coherence
  FROM (SELECT *, sqrt(re * re + im * im) AS m, atan2(im, re) AS p FROM resp) GROUP BY ALL)"""


GABOR = _gabor_sql()
_STATS = [k for k in gabor.GABOR_KINDS if not k.startswith(("mag_q", "mag_median"))]


@query("gabor_responses", with_ctes(*IMAGE, GABOR, tail=f"""
SELECT image_id, filter, n, {", ".join(f"round({k}, 5) + 0.0 AS {k}" for k in _STATS)} FROM gab"""))
def gabor_responses(spark, folder):
    found = gabor.response_stats(images(spark, folder, halo=gabor.halo_for()))
    return found.select("image_id", "filter", "n", *[r6(k, 5).alias(k) for k in _STATS])


@query("gabor_quartiles", with_ctes(*IMAGE, GABOR, tail=f"""
SELECT image_id, filter, {rounded("mag_q25", "mag_median", "mag_q75")} FROM gab"""))
def gabor_quartiles(spark, folder):
    tiles = stage(images(spark, folder, halo=gabor.halo_for()))
    found = gabor.magnitude_quartiles(tiles, stage(gabor.response_stats(tiles)))
    return found.select("image_id", "filter", *[r6(k).alias(f"mag_{k}") for k in gabor.QUARTILES])


@query("gabor_features", with_ctes(*IMAGE, GABOR, tail="""
SELECT image_id, {} FROM gab GROUP BY image_id""".format(", ".join(
    f"""round(any_value({k}) FILTER (filter = 'f{f}_o{o}'), 5) + 0.0 AS "gabor_{k}_f{f}_o{o}\""""
    for f, o in _BANK for k in gabor.GABOR_KINDS))))
def gabor_features(spark, folder):
    found = gabor.gabor_features(stage(images(spark, folder, halo=gabor.halo_for())))
    return found.selectExpr("image_id", *[f"round(`{c}`, 5) + 0D AS `{c}`" for c in found.columns[1:]])


@query("gabor_phase")
def gabor_phase(spark, folder):
    """No SQL: where a response is real and negative, rounding alone decides between both ends of the phase's range."""
    found = gabor.response_stats(images(spark, folder, halo=gabor.halo_for()))
    return found.select("image_id", "filter", *[r6(k, 4).alias(k) for k in gabor.PHASE_KINDS])


# --- Tamura ------------------------------------------------------------------------------------

GRAD = """mir AS (
  SELECT image_id, side, r, c, v FROM img UNION ALL
  SELECT image_id, side, -1, c, v FROM img WHERE r = 1 UNION ALL
  SELECT image_id, side, side, c, v FROM img WHERE r = side - 2),
ext AS (
  SELECT image_id, side, r, c, v FROM mir UNION ALL
  SELECT image_id, side, r, -1, v FROM mir WHERE c = 1 UNION ALL
  SELECT image_id, side, r, side, v FROM mir WHERE c = side - 2),
rowk AS (
  SELECT image_id, side, r, c, lead(v) OVER w - lag(v) OVER w AS dx, lag(v) OVER w + 2 * v + lead(v) OVER w AS sx
  FROM ext WINDOW w AS (PARTITION BY image_id, r ORDER BY c)),
grad AS (
  SELECT image_id, gx, gy, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) AS mag FROM (
    SELECT image_id, side, r, c, lag(dx) OVER w + 2 * dx + lead(dx) OVER w AS gx, lead(sx) OVER w - lag(sx) OVER w AS gy
    FROM rowk WHERE c >= 0 AND c < side WINDOW w AS (PARTITION BY image_id, c ORDER BY r))
  WHERE r >= 0 AND r < side),
dirh AS (
  SELECT image_id, bin, sum(mag) AS weight FROM (
    SELECT image_id, mag, CAST(least(floor(fmod(degrees(atan2(gy, gx)) + 360, 180) / 180 * 16), 15) AS INTEGER) AS bin
    FROM (SELECT *, max(mag) OVER (PARTITION BY image_id) AS top FROM grad) WHERE mag > 0.1 * top) GROUP BY ALL),
dirn AS (
  SELECT image_id, 1 - sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) / 4 AS directionality
  FROM (SELECT image_id, weight / sum(weight) OVER (PARTITION BY image_id) AS p FROM dirh) GROUP BY 1)"""
LINE = """off AS (SELECT d, o.dir, d * dy AS dr, d * dx AS dc FROM (SELECT unnest(range(1, 6)) AS d) q
  JOIN (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1)) t(dir, dy, dx)) o ON true),
moved AS MATERIALIZED (SELECT image_id, dir, d, r + dr AS r, c + dc AS c, v AS w FROM img JOIN off ON true),
lin AS (
  SELECT image_id, max(m) - min(m) AS linelikeness FROM (
    SELECT image_id, dir, avg(cr) AS m FROM (
      SELECT image_id, dir, d, corr(w, v) AS cr FROM moved JOIN img USING (image_id, r, c) GROUP BY ALL) GROUP BY ALL) GROUP BY 1)"""


def _coarse_sql() -> str:
    """Box sums of width 2, 4, 8 (sides of 45 to 95 have at most four scales) on reflected images."""
    return """pre AS (
  SELECT image_id, side, t AS r, c, v FROM (
    SELECT image_id, side, c, v, unnest([r, -1 - r, 2 * side - 1 - r]) AS t FROM img) WHERE t >= -24 AND t < side + 24),
wide AS (
  SELECT image_id, side, r, t AS c, v FROM (
    SELECT image_id, side, r, v, unnest([c, -1 - c, 2 * side - 1 - c]) AS t FROM pre) WHERE t >= -24 AND t < side + 24),
sc AS (SELECT image_id, side, CAST(greatest(1, least(6, floor(log2(side // 4)))) AS INTEGER) AS kk FROM img GROUP BY ALL),
rowsum AS (SELECT image_id, side, r, c, {rs} FROM wide WINDOW w AS (PARTITION BY image_id, r ORDER BY c)),
box AS (SELECT image_id, side, r, c, {bs} FROM rowsum WINDOW w AS (PARTITION BY image_id, c ORDER BY r)),
change AS (
  SELECT b.image_id, b.r, b.c, {es}
  FROM (SELECT *, {shifts} FROM box WINDOW h AS (PARTITION BY image_id, r ORDER BY c), g AS (PARTITION BY image_id, c ORDER BY r)) b
  JOIN sc USING (image_id) WHERE b.r >= 0 AND b.r < b.side AND b.c >= 0 AND b.c < b.side),
coarse AS (
  SELECT image_id, avg(CASE WHEN e0 >= e1 AND e0 >= e2 AND e0 >= e3 THEN 1 WHEN e1 >= e2 AND e1 >= e3 THEN 2 WHEN e2 >= e3 THEN 4 ELSE 8 END) AS coarseness
  FROM change GROUP BY 1)""".format(
        rs=", ".join(
            f"sum(v) OVER (PARTITION BY image_id, r ORDER BY c ROWS BETWEEN {2**k} PRECEDING AND {2**k - 1} FOLLOWING) AS s{k}"
            for k in range(4)
        ),
        bs=", ".join(
            f"sum(s{k}) OVER (PARTITION BY image_id, c ORDER BY r ROWS BETWEEN {2**k} PRECEDING AND {2**k - 1} FOLLOWING) AS b{k}"
            for k in range(4)
        ),
        shifts=", ".join(
            f"lead(b{k}, {2**k}) OVER h AS p{k}, lag(b{k}, {2**k}) OVER h AS q{k}, lead(b{k}, {2**k}) OVER g AS u{k}, lag(b{k}, {2**k}) OVER g AS w{k}"
            for k in range(4)
        ),
        es=", ".join(
            f"CASE WHEN kk > {k} AND {2 ** (k + 1)} <= b.side // 2 THEN greatest("
            f"CASE WHEN b.r >= {2**k} AND b.r < b.side - {2**k} THEN abs(u{k} - w{k}) ELSE 0 END, "
            f"CASE WHEN b.c >= {2**k} AND b.c < b.side - {2**k} THEN abs(p{k} - q{k}) ELSE 0 END) * {4 ** (5 - k)} ELSE -1 END AS e{k}"
            for k in range(4)
        ),
    ).replace(" WINDOW w AS (PARTITION BY image_id, r ORDER BY c)),\nbox", "),\nbox").replace(
        " WINDOW w AS (PARTITION BY image_id, c ORDER BY r)),\nchange", "),\nchange"
    )


COARSE = _coarse_sql()
CONTRAST = """con AS (
  SELECT image_id, sqrt(m2) / 255 / pow(CASE WHEN m2 > 0 AND m4 > 0 THEN m4 / (m2 * m2) ELSE 0.0001 END, 0.25) AS contrast
  FROM (SELECT image_id, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 4) AS m4
        FROM img JOIN (SELECT image_id, avg(v) AS mu FROM img GROUP BY 1) USING (image_id) GROUP BY 1))"""


def _tamura_tiles(spark, folder, **options):
    return images(spark, folder, halo=tamura.HALO, **options)


@query("tamura_contrast", with_ctes(*IMAGE, CONTRAST, tail=f"SELECT image_id, {rounded('contrast')} FROM con"))
def tamura_contrast(spark, folder):
    found = tamura.contrast(recurrence.gray_counts(images(spark, folder)))
    return report(found, ["image_id"], ["contrast"])


@query("tamura_directionality", with_ctes(*IMAGE, GRAD, tail=f"SELECT image_id, {rounded('directionality')} FROM dirn"))
def tamura_directionality(spark, folder):
    tiles = stage(images(spark, folder, halo=1))
    peaks = stage(tamura.tile_sums(tiles, 1).filter("what = 'grad'").select("image_id", "top"))
    found = tamura.directionality(tamura.direction_histogram(tiles, peaks))
    return report(found, ["image_id"], ["directionality"])


@query("tamura_linelikeness", with_ctes(*IMAGE, LINE, tail=f"SELECT image_id, {rounded('linelikeness')} FROM lin"))
def tamura_linelikeness(spark, folder):
    found = tamura.line_likeness(tamura.tile_sums(_tamura_tiles(spark, folder)))
    return report(found, ["image_id"], ["linelikeness"])


@query("tamura_coarseness", with_ctes(*IMAGE, COARSE, tail=f"SELECT image_id, {rounded('coarseness')} FROM coarse"))
def tamura_coarseness(spark, folder):
    tiles = _tamura_tiles(spark, folder, size=40)
    found = tamura.tile_sums(tiles).filter("what = 'coarse'")
    area = tiles.groupBy("image_id").agg((F.first("h") * F.first("w")).alias("area"))
    found = found.join(area, "image_id").withColumn("coarseness", F.col("total") / F.col("area"))
    return report(found, ["image_id"], ["coarseness"])


TAMURA_COLUMNS = [f"tamura_{n}_{s}" for n in tamura.NAMES for s in ("mean", "std")]


@query("tamura_features", with_ctes(*IMAGE, GRAD, LINE, COARSE, CONTRAST, tail="""
SELECT image_id, {} FROM coarse JOIN con USING (image_id) JOIN dirn USING (image_id) JOIN lin USING (image_id)""".format(
    ", ".join(f"round({n}, 6) + 0.0 AS tamura_{n}_mean, CAST(0.0 AS DOUBLE) AS tamura_{n}_std"
              for n in tamura.NAMES[:-1]) + ", round(coarseness + contrast, 6) + 0.0 AS tamura_roughness_mean, CAST(0.0 AS DOUBLE) AS tamura_roughness_std")))
def tamura_features(spark, folder):
    found = tamura.tamura_features(stage(_tamura_tiles(spark, folder)))
    return report(found, ["image_id"], TAMURA_COLUMNS)


@query("tamura_regions")
def tamura_regions(spark, folder):
    """Every image counts as large: cut into overlapping regions, measured one by one and averaged."""
    plain = stage(images(spark, folder))
    found = tamura.tamura_features(plain, threshold=0, size=32, overlap=8, smallest=16)
    return report(found, ["image_id"], TAMURA_COLUMNS)
