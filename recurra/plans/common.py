"""Inputs shared by the catalogues, in both languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import r6
from ..operators import recurrence
from ..session import stage
from ..sources.tables import signal_from_events, table, vector_features

# Settings of the registered queries: the table's series are short (45 to 99 samples).
M, TAU = 3, 2
TAU_MAX, DIM_MAX = 20, 5


def series(spark, folder, key="user_id"):
    """The ordered series, for queries that read it along one branch."""
    return signal_from_events(table(spark, folder, "events"), key=key)


def signals(spark, folder, key="user_id"):
    """The ordered series, written once for queries that read it along several branches."""
    return stage(series(spark, folder, key))


def images(spark, folder, halo=0, **options):
    return recurrence.recurrence_tiles(signals(spark, folder), M, TAU, halo=halo, **options)


def features(spark, folder):
    """Vectors of the classes below 5 against the rest, as a long two-class feature table."""
    vectors = table(spark, folder, "embeddings").withColumn(
        "cls", F.when(F.col("label") < 5, "Normal").otherwise("Pathol")
    )
    return vector_features(vectors, "vec_id", "embedding", "cls")


def report(df, keys, values):
    """Project keys as they are and values rounded to six digits."""
    return df.select(*keys, *[r6(F.col(v)).alias(v) for v in values])


SIG = """sig AS (
  SELECT user_id AS signal_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
         count(*) OVER (PARTITION BY user_id) AS n, value AS y
  FROM events WHERE value IS NOT NULL)"""

PTS = f"""pts AS (
  SELECT * FROM (
    SELECT signal_id, i, n, y AS x0, lead(y, {TAU}) OVER w AS x1, lead(y, {2 * TAU}) OVER w AS x2
    FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY i)) WHERE i < n - {(M - 1) * TAU})"""

CELL = f"""cell AS (
  SELECT a.signal_id AS image_id, a.n - {(M - 1) * TAU} AS side, a.i, b.i AS j,
         sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1)
              + (a.x2 - b.x2) * (a.x2 - b.x2)) AS d
  FROM pts a JOIN pts b ON a.signal_id = b.signal_id)"""

GRAY = """gray AS (
  SELECT image_id, side, i, j,
         CAST(trunc(CASE WHEN mx > 0 THEN d / mx * 255 ELSE 0 END) AS INTEGER) AS v
  FROM (SELECT *, max(d) OVER (PARTITION BY image_id) AS mx FROM cell))"""

IMG = "img AS (SELECT image_id, side, side - 1 - i AS r, j AS c, v FROM gray)"

IMAGE = (SIG, PTS, CELL, GRAY, IMG)

FEATURES = """feat AS (
  SELECT vec_id AS row_id, CASE WHEN label < 5 THEN 'Normal' ELSE 'Pathol' END AS label,
         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature,
         CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings)"""
