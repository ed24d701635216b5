"""Queries for extraction bookkeeping: missing work, manifests, combination, progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r6
from ..operators import framework, texture
from ..session import stage
from ..sources.tables import table
from . import descriptors
from .common import IMAGE, images, report
from .image_queries import LBP, LBP_COLUMNS, LBP_FEATURES, STAT_BASE
from .image_queries import MOMENTS, PCT, STAT
from .registry import query, rounded, with_ctes


@query("missing_work", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_work(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return framework.missing_work(docs, labels, ["doc_id"]).select("doc_id", "lang")


@query("only_missing", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def only_missing(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return framework.only_missing(docs, labels, "doc_id").select("doc_id", "lang")


@query("append_rows", """
SELECT doc_id, quality, CAST(NULL AS VARCHAR) AS lang FROM labels UNION ALL
SELECT doc_id, NULL, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def append_rows(spark, folder):
    done = table(spark, folder, "labels").select("doc_id", "quality")
    return framework.append_rows(done, missing_work(spark, folder))


@query("config_hash", """
SELECT doc_id, left(md5('{"lang":"' || lang || '","source":"' || source || '"}'), 8) AS hash FROM documents""")
def config_hash(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", framework.hash_columns(["source", "lang"]).alias("hash"))


@query("pending_images", """
SELECT doc_id AS filename FROM documents WHERE doc_id NOT IN (
  SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)""")
def pending_images(spark, folder):
    """Quality plays the descriptor and toxicity the configuration it was computed under."""
    inputs = table(spark, folder, "documents").select(F.col("doc_id").alias("filename"))
    done = table(spark, folder, "labels").select(
        F.col("doc_id").alias("filename"),
        F.col("quality").cast("string").alias("descriptor"),
        F.col("toxic").cast("string").alias("config_hash"),
    )
    return framework.pending_images(inputs, done, "1", "0")


@query("combine_features", with_ctes(*IMAGE, LBP, LBP_FEATURES, MOMENTS, PCT, STAT, tail=f"""
SELECT image_id, {rounded(*LBP_COLUMNS[:6], *STAT_BASE)} FROM lbph JOIN stat USING (image_id)"""))
def combine_features(spark, folder):
    tiles = stage(images(spark, folder, halo=1))
    joined = framework.combine([texture.lbp_features(tiles), texture.stat_features(tiles)], "image_id")
    return report(joined, ["image_id"], [*LBP_COLUMNS[:6], *STAT_BASE])


@query("manifest", """
SELECT lang AS descriptor, source AS config_hash, count(DISTINCT doc_id) AS total_images, max(n_chars) AS last_update
FROM documents GROUP BY ALL""")
def manifest(spark, folder):
    rows = table(spark, folder, "documents").select(
        F.col("lang").alias("descriptor"),
        F.col("source").alias("config_hash"),
        F.col("doc_id").alias("filename"),
        F.col("n_chars").alias("computed_at"),
    )
    return framework.manifest(rows)


@query("outdated_descriptors", """
SELECT descriptor, total_images, missing FROM (
  SELECT lang AS descriptor, count(*) AS total_images, max(count(*)) OVER () - count(*) AS missing FROM documents GROUP BY 1)
WHERE missing > 0""")
def outdated_descriptors(spark, folder):
    counts = table(spark, folder, "documents").groupBy(F.col("lang").alias("descriptor")).agg(
        F.count(F.lit(1)).alias("total_images")
    )
    return framework.outdated_descriptors(counts)


@query("checkpoint_rotation", """
SELECT user_id, event_id, CAST(rn AS INTEGER) AS position FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 3""")
def checkpoint_rotation(spark, folder):
    files = table(spark, folder, "events").select("user_id", "ts", "event_id")
    return framework.newest(files, "user_id", "ts").select("user_id", "event_id", "position")


@query("class_distribution", "SELECT quality AS label, count(*) AS c FROM labels GROUP BY 1")
def class_distribution(spark, folder):
    return table(spark, folder, "labels").groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("c"))


PROG = """prog AS (
  SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         value AS processed, epoch_us(ts) / 1000000.0 AS tm FROM events WHERE value IS NOT NULL)"""


def _progress(spark, folder):
    """The event value as the number processed so far."""
    from ..operators.chunks import hour_chunk, ordered_index

    rows = table(spark, folder, "events").filter("value is not null").select(
        F.col("user_id").alias("signal_id"), "ts", "event_id", F.col("value").alias("processed"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"),
    )
    return ordered_index(rows, "signal_id", ["ts", "event_id"], hour_chunk("ts"))


@query("moving_speed", with_ctes(PROG, tail="""
SELECT signal_id, i, round(CASE WHEN tm > a0 THEN (processed - p0) / (tm - a0) ELSE 0 END, 8) + 0.0 AS speed FROM (
  SELECT *, first_value(processed) OVER w AS p0, first_value(tm) OVER w AS a0 FROM prog
  WINDOW w AS (PARTITION BY signal_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""))
def moving_speed(spark, folder):
    found = framework.moving_speed(_progress(spark, folder), size=16)
    return found.select("signal_id", "i", r6("speed", 8).alias("speed"))


@query("smoothed_speed", """
WITH RECURSIVE base AS (
  SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS processed,
         epoch_us(ts) / 100000000000.0 AS tm FROM events WHERE value IS NOT NULL),
step AS MATERIALIZED (
  SELECT signal_id, i, processed - lag(processed) OVER w AS dp, tm - lag(tm) OVER w AS dt FROM base
  WINDOW w AS (PARTITION BY signal_id ORDER BY i)),
fold AS (
  SELECT signal_id, i, CAST(0.0 AS DOUBLE) AS speed FROM step WHERE i = 0 UNION ALL
  SELECT s.signal_id, s.i, CASE WHEN dt > 0 AND dp > 0 THEN round(CASE WHEN speed > 0 THEN 0.3 * speed + 0.7 * (dp / dt) ELSE dp / dt END, 2)
                                WHEN dp = 0 THEN speed ELSE 0.0 END
  FROM fold f JOIN step s ON s.signal_id = f.signal_id AND s.i = f.i + 1)
SELECT signal_id, i, CAST(speed AS DOUBLE) + 0.0 AS speed FROM fold""")
def smoothed_speed(spark, folder):
    """Time counted in units of 100 000 s, which keeps two decimals meaningful."""
    scaled = _progress(spark, folder).withColumn("at", F.col("at") / 100000.0)
    return framework.smoothed_speed(scaled, size=16)


@query("eta", """
SELECT doc_id, round(left_s, 6) + 0.0 AS seconds, round(percent, 6) + 0.0 AS percent,
       CASE WHEN left_s IS NULL OR left_s <= 0 THEN 'Calculando...' WHEN left_s >= 3600 THEN (CAST(left_s AS BIGINT) // 3600) || 'h ' || (CAST(floor(left_s) AS BIGINT) % 3600 // 60) || 'm'
            WHEN left_s >= 60 THEN (CAST(floor(left_s) AS BIGINT) // 60) || 'm ' || (CAST(floor(left_s) AS BIGINT) % 60) || 's'
            ELSE CAST(floor(left_s) AS BIGINT) || 's' END AS text
FROM (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN (100000 - n_chars) / (doc_id % 7) END AS left_s, n_chars / 100000.0 * 100 AS percent FROM documents)""".replace("(CAST(left_s AS BIGINT) // 3600)", "(CAST(floor(left_s) AS BIGINT) // 3600)").replace("(100000 - n_chars) / (doc_id % 7)", "CAST(100000 - n_chars AS DOUBLE) / (doc_id % 7)"))
def eta(spark, folder):
    docs = table(spark, folder, "documents")
    found = framework.eta(F.col("n_chars"), F.lit(100000), F.col("doc_id") % 7)
    return docs.select("doc_id", found.alias("e")).select(
        "doc_id", r6(F.col("e.seconds")).alias("seconds"), r6(F.col("e.percent")).alias("percent"), "e.text"
    )


@query("staleness", """
SELECT event_id FROM events WHERE epoch_us(TIMESTAMP '2024-01-30 23:59:59') / 1000000.0 - epoch_us(ts) / 1000000.0 <= 86400""")
def staleness(spark, folder):
    now = F.lit("2024-01-30 23:59:59")
    return framework.fresh(table(spark, folder, "events"), "ts", now, 86400).select("event_id")


@query("normalize_range", """
SELECT signal_id, event_id, uniform, round(CASE WHEN lo < 0 OR hi > 255 THEN (value - lo) / (hi - lo) * 255 ELSE value END, 6) + 0.0 AS value
FROM (SELECT user_id AS signal_id, event_id, value, min(value) OVER w AS lo, max(value) OVER w AS hi, min(value) OVER w = max(value) OVER w AS uniform
      FROM events WINDOW w AS (PARTITION BY user_id))""")
def normalize_range(spark, folder):
    rows = table(spark, folder, "events").select(F.col("user_id").alias("signal_id"), "event_id", "value")
    return report(framework.normalize_range(rows, "signal_id", "value"), ["signal_id", "event_id", "uniform"], ["value"])


@query("stretch_to_uint8", """
SELECT l_orderkey, l_linenumber, CAST(least(greatest(floor(l_discount * 255), 0), 255) AS INTEGER) AS l_discount FROM lineitem""")
def stretch_to_uint8(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return framework.stretch_to_uint8(rows, "l_orderkey", "l_discount").select("l_orderkey", "l_linenumber", "l_discount")


@query("to_gray", """
SELECT l_orderkey, l_linenumber, CAST(floor((l_partkey % 256 + l_suppkey % 256 + l_orderkey % 256) / 3) AS INTEGER) AS gray FROM lineitem""")
def to_gray(spark, folder):
    channels = [F.col(c) % 256 for c in ("l_partkey", "l_suppkey", "l_orderkey")]
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", framework.to_gray(channels).alias("gray"))


@query("rescale_shape", """
SELECT doc_id, CAST(floor((n_chars + 1) * s) AS INTEGER) AS h, CAST(floor((doc_id + 1) * s) AS INTEGER) AS w
FROM (SELECT doc_id, n_chars, least(1000.0 / (doc_id + 1), 1000.0 / (n_chars + 1), 1.0) AS s FROM (SELECT CAST(doc_id AS DOUBLE) AS doc_id0, doc_id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents))""")
def rescale_shape(spark, folder):
    docs = table(spark, folder, "documents")
    shape = framework.rescale_shape(F.col("n_chars") + 1, F.col("doc_id") + 1, 1000)
    return docs.select("doc_id", shape.alias("s")).select("doc_id", "s.h", "s.w")


@query("size_filter", "SELECT doc_id FROM documents WHERE n_chars >= 500 AND length(text) >= 500")
def size_filter(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("n_chars").alias("h"), F.length("text").alias("w"))
    return framework.size_filter(docs, 500).select("doc_id")


@query("load_stats", """
SELECT count(*) AS total, count(*) FILTER (quality = 1) AS loaded, count(*) FILTER (quality <> 1) AS failed,
       round(count(*) FILTER (quality = 1) / count(*), 6) AS success_rate FROM labels""")
def load_stats(spark, folder):
    loads = table(spark, folder, "labels").withColumn("status", F.when(F.col("quality") == 1, "ok").otherwise("failed"))
    return report(framework.load_stats(loads), ["total", "loaded", "failed"], ["success_rate"])


@query("fail_after", """
WITH loads AS (SELECT doc_id, coalesce(length(text), 0) > 0 AS ok FROM documents)
SELECT doc_id FROM loads WHERE (SELECT count(*) FILTER (NOT ok) FROM loads) <= (SELECT count(*) // 2 FROM loads)""")
def fail_after(spark, folder):
    """Documents without text count as failed loads; half of all may fail."""
    empty = F.coalesce(F.length("text"), F.lit(0)) == 0
    loads = table(spark, folder, "documents").select("doc_id", F.when(empty, "failed").otherwise("ok").alias("status"))
    return framework.fail_after(loads, loads.count() // 2).select("doc_id")


@query("validate_features", """
SELECT l_orderkey, l_linenumber, l_discount > 0 AS valid FROM lineitem""")
def validate_features(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_tax", F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("ratio")
    )
    return framework.validate_features(rows, ["ratio", "l_tax"]).select("l_orderkey", "l_linenumber", "valid")


@query("published_features")
def published_features(spark, folder):
    """The 181 published features of every series' recurrence image."""
    names = descriptors.PUBLISHED
    tiles = stage(images(spark, folder, halo=descriptors.halo_needed(names)))
    return descriptors.extract(tiles, names)


