"""Registered queries: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage, work_folder
from . import ann, chat, decontam, licenses, merkle, neardup, packing, quality, secrets, token_counts, toxicity, warc, whitening
from .registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents", "doc_id", "text"))


PROBE = "</s>[INST] ok [/INST]"

CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + length(role || text)
                + length(regexp_replace(role || text, '[^\\<>]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op10_chat_formatting", CHAT_SQL)
def chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.sql(
        f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(v.turn AS BIGINT) AS turn, v.role, '{PROBE}' AS text "
        "FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)"
    )
    turns = table(spark, folder, "conversations", "conv_id", "turn", "role", "text").unionByName(probe)
    read = chat.read_back(chat.format_conversations(chat.log_of_turns(turns)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op7_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents", "doc_id", "text"), size=4)


DECONTAM_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, len(w[i : i + 9]) AS n, array_to_string(w[i : i + 9], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.t = bw.t AND dw.n = bw.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (
  SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ks, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""


@query("op4_benchmark_decontamination", DECONTAM_SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "benchmark", "item_id", "text")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_documents(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "quality")
    )


@query("op8_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(
        table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "labels", "doc_id", "toxic")
    )


@query("op2_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents", "doc_id", "text"))
    names = F.array(*[F.lit(kind) for kind in secrets.KINDS])

    def written(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ","
        )

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )


@query("op6_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(table(spark, folder, "embeddings", "vec_id", "embedding"))


@query("op1_token_counts")
def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four batches: all documents arrive, copies of a text but the first go, every remaining document is
    counted anew with an end token, and the second batch is sent again, which must change nothing."""
    counts = stage(token_counts.token_counts(table(spark, folder, "documents", "doc_id", "text", "source", "lang")))
    rollup = token_counts.TokenRollup(spark, f"{work_folder(spark).rstrip('/')}/token-rollup-{uuid.uuid4().hex}")
    rollup.commit("load", counts.withColumn("change", F.lit("insert")))
    firsts = counts.groupBy("text_key", "tokenizer").agg(F.min("doc_id").alias("first"))
    marked = counts.join(firsts, ["text_key", "tokenizer"])
    copies = marked.filter("doc_id > first").withColumn("change", F.lit("delete"))
    rollup.commit("copies", copies)
    rest = marked.filter("doc_id = first").withColumn("change", F.lit("revise"))
    rollup.commit("end token", rest.withColumn("n_tokens", F.col("n_tokens") + 1))
    rollup.commit("copies", copies)
    return rollup.totals()


TEMPLATE_VALUES = ",\n".join("('%s', '%s')" % (name, text.replace("'", "''")) for name, text in licenses.TEMPLATES)

def _words_sql(text: str) -> str:
    return (
        f"regexp_extract_all(replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
        " 'licence', 'license'), '[a-z0-9]+')"
    )


LICENSE_TABLES = rf"""t AS (SELECT row_number() OVER () AS tid, name, {_words_sql("txt")} AS w FROM (VALUES {TEMPLATE_VALUES}) v(name, txt)),
tb AS (SELECT DISTINCT tid, name, w[i] || ' ' || w[i + 1] AS g FROM (SELECT tid, name, w, unnest(range(1, len(w))) AS i FROM t)),
ts AS (SELECT tid, name, count(*) AS n, count(*) * ratio AS least, count(*) / ratio AS most
       FROM tb, (SELECT CAST({licenses.THRESHOLD / (2 - licenses.THRESHOLD)!r} AS DOUBLE) AS ratio) GROUP BY tid, name, ratio),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"""

SEGMENT_TABLES = rf"""seg AS (
  SELECT r, doc_id, 'line' AS unit, i - 1 AS place, l[i] AS s
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT r, doc_id, string_split(text, chr(10)) AS l FROM d))
  UNION ALL
  SELECT r, doc_id, 'block', i - 1, l[i]
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT r, doc_id, string_split(text, chr(10) || chr(10)) AS l FROM d))
  WHERE contains(l[i], chr(10))),
sw AS (SELECT r, doc_id, unit, place, {_words_sql("s")} AS w FROM seg),
sb AS (
  SELECT DISTINCT r, doc_id, unit, place, w[i] || ' ' || w[i + 1] AS g
  FROM (SELECT r, doc_id, unit, place, w, unnest(range(1, len(w))) AS i FROM sw WHERE len(w) > 1)),
ss AS (SELECT r, unit, place, count(*) AS n FROM sb GROUP BY ALL),
hit AS (SELECT r, doc_id, unit, place, tid, name, count(*) AS c FROM sb JOIN tb USING (g) GROUP BY ALL),
sc AS (
  SELECT hit.*, round(2.0 * c / (ss.n + ts.n), 6) AS dice
  FROM hit JOIN ss USING (r, unit, place) JOIN ts USING (tid))"""

SEGMENT_ROWS = """SELECT doc_id, unit, place, name AS license, dice
FROM (SELECT *, row_number() OVER (PARTITION BY r, unit, place ORDER BY dice DESC, name) AS k FROM sc WHERE dice >= 0.7)
WHERE k = 1"""

# Runs grow word by word from every bigram of a template; then the best of each text is taken, then the best beside it.
PASSAGE_TABLES = rf"""pw AS (SELECT r, {_words_sql("text")} AS w FROM d),
pos AS MATERIALIZED (
  SELECT r, p, g, coalesce(lag(p) OVER same, -1) AS before, coalesce(lead(p) OVER same, 1000000000) AS again
  FROM (SELECT r, i - 1 AS p, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM pw WHERE len(w) > 1))
  WINDOW same AS (PARTITION BY r, g ORDER BY p)),
cand AS MATERIALIZED (
  SELECT r, tid, least, most, n FROM pos JOIN tb USING (g) JOIN ts USING (tid)
  GROUP BY ALL HAVING count(DISTINCT g) >= ceil(least - 1e-9)),
near AS MATERIALIZED (SELECT pos.*, tid FROM pos JOIN (SELECT r, tid FROM cand) USING (r)),
grow AS MATERIALIZED (SELECT near.r, near.p, near.before, near.again, near.tid, tb.g IS NOT NULL AS own FROM near LEFT JOIN tb ON tb.tid = near.tid AND tb.g = near.g),
run AS (
  SELECT r, tid, p AS first, p AS last, again AS stop, 1 AS seen, 1 AS shared, true AS own FROM grow WHERE grow.own
  UNION ALL
  SELECT run.r, run.tid, first, grow.p, stop, seen + CAST(before < first AS INTEGER), shared + CAST(before < first AND grow.own AS INTEGER), before < first AND grow.own
  FROM run JOIN grow ON grow.r = run.r AND grow.tid = run.tid AND grow.p = last + 1 JOIN cand ON cand.r = run.r AND cand.tid = run.tid
  WHERE grow.p < stop AND seen + CAST(before < first AS INTEGER) <= most + 1e-9),
fit AS (
  SELECT r, name, first, last, dice FROM (
    SELECT r, tid, first, last, dice, row_number() OVER (PARTITION BY r, tid, first ORDER BY dice DESC, last) AS k
    FROM (SELECT r, tid, first, last, round(2.0 * shared / (seen + n), 6) AS dice FROM run JOIN cand USING (r, tid) WHERE own)
    WHERE dice >= {licenses.THRESHOLD}) JOIN ts USING (tid) WHERE k = 1),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY dice DESC, name, first, last) AS k FROM fit),
taken AS (
  SELECT r, k, true AS ok, [{{'a': first, 'b': last + 1}}] AS kept FROM ranked WHERE k = 1
  UNION ALL
  SELECT r, k, ok, CASE WHEN ok THEN list_append(kept, {{'a': first, 'b': last + 1}}) ELSE kept END
  FROM (SELECT x.r, x.k, x.first, x.last, kept, len(list_filter(kept, lambda o: o.a <= x.last + 1 AND o.b >= x.first)) = 0 AS ok
        FROM taken JOIN ranked x ON x.r = taken.r AND x.k = taken.k + 1))"""

PASSAGE_ROWS = """SELECT doc_id, 'passage' AS unit, first AS place, name AS license, dice
FROM (SELECT r, k FROM taken WHERE ok) JOIN ranked USING (r, k) JOIN d USING (r)"""


@query("op3_license_scan", f"""
WITH RECURSIVE {LICENSE_TABLES},
{SEGMENT_TABLES},
{PASSAGE_TABLES}
{SEGMENT_ROWS} UNION ALL {PASSAGE_ROWS}""")
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents", "doc_id", "text"), units=licenses.UNITS)


@query("license_passages", f"""
WITH RECURSIVE {LICENSE_TABLES},
{PASSAGE_TABLES}
{PASSAGE_ROWS}""")
def license_passages(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_passages(table(spark, folder, "documents", "doc_id", "text"))


def _merkle_sql(levels: int = 7, source_levels: int = 5) -> str:
    def field(e: str) -> str:
        return f"coalesce(CAST(strlen(CAST({e} AS VARCHAR)) AS VARCHAR) || ':' || CAST({e} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"

    def climb(p: str, depth: int) -> list[str]:
        """From {p}0(k, pos, n, digest): levels {p}K, groups {p}gK; folding {p}fK of {p}f0(r, k, pos, n, cur, proof)."""
        out = []
        for i in range(depth):
            out.append(f"""{p}g{i} AS MATERIALIZED (
  SELECT k, pos // 16 AS pos, any_value(n) AS n, list(digest ORDER BY pos) AS kids FROM {p}{i} WHERE n > 1 GROUP BY k, pos // 16)""")
            out.append(f"""{p}{i + 1} AS MATERIALIZED (
  SELECT k, pos, (n + 15) // 16 AS n, sha256(array_to_string(kids, '')) AS digest FROM {p}g{i})""")
        tops = " UNION ALL ".join(f"SELECT k, digest FROM {p}{i} WHERE n = 1" for i in range(depth + 1))
        return [*out, f"{p}top AS MATERIALIZED ({tops})"]

    def fold(p: str, depth: int) -> list[str]:
        out = []
        for i in range(depth):
            left, right = f"array_to_string(kids[1:{p}f{i}.pos % 16], '')", f"array_to_string(kids[{p}f{i}.pos % 16 + 2:], '')"
            out.append(f"""{p}f{i + 1} AS MATERIALIZED (
  SELECT r, {p}f{i}.k, {p}f{i}.pos // 16 AS pos, CASE WHEN kids IS NULL THEN cur ELSE sha256({left} || cur || {right}) END AS cur,
         CASE WHEN kids IS NULL THEN proof ELSE proof || {left} || {right} END AS proof
  FROM {p}f{i} LEFT JOIN {p}g{i} ON {p}g{i}.k = {p}f{i}.k AND {p}g{i}.pos = {p}f{i}.pos // 16)""")
        return out

    parts = [
        """crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) AS c FROM (SELECT unnest(range(256)) AS b)))""",
        f"""d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce('g' || source, '') AS k, {leaf("text")} AS leaf,
         CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                                   lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 5 = 0
              THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents, crc)""",
        """placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d)""",
        "l0 AS (SELECT k, pos, n, leaf AS digest FROM placed)",
        *climb("l", levels),
        "s0 AS MATERIALIZED (SELECT '' AS k, k AS name, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, digest FROM ltop)",
        *climb("s", source_levels),
        "lf0 AS (SELECT r, k, pos, coalesce(changed, leaf) AS cur, '' AS proof FROM placed)",
        *fold("l", levels),
        f"sf0 AS (SELECT r, '' AS k, s0.pos, cur, proof FROM lf{levels} JOIN s0 ON s0.name = lf{levels}.k)",
        *fold("s", source_levels),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, ltop.digest AS subroot, stop.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
       cur = stop.digest AS verified
FROM placed JOIN sf{source_levels} USING (r) JOIN ltop ON ltop.k = placed.k CROSS JOIN stop"""


@query("op13_merkle_manifest", _merkle_sql())
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.manifest(table(spark, folder, "documents", "doc_id", "source", "lang", "n_chars", "text"))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings", "vec_id", "embedding"))


# A digest's 160 bits are eight groups of 20, each four letters of the alphabet.
WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
m AS (
  SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS k,
         first_value(page_id) OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS top FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS BIGINT) >> (15 - i % 4 * 5)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to
FROM m"""


@query("op11_warc_archives", WARC_SQL)
def warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", "page_id", "url", "html")
    packages = warc.write_archives(pages, warc.archive_folder(pages))
    found = warc.read_archives(packages, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
