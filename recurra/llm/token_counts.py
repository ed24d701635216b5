"""Token totals by source, language and tokenizer version, kept up to date by batches of signed deltas.

A batch brings inserts, deletes and revised counts. A ledger holds the last known count of every document and
tokenizer version, so a batch becomes signed rows: plus what holds now, minus what held before. These are summed per
group before they are stored, and totals are sums over the stored groups: no batch rereads the corpus. The ledger lies in
buckets of doc_id, and a batch reads those buckets only that hold its documents. compact() folds all batches so far into
one base, with the last state of each living document and one row per group, so later batches and totals read no more
than the base and what came after it. It deletes nothing: files before the base stay for readers that still use them.

A batch is committed once, by a marker written last. Replaying a committed batch changes nothing; a batch that was
interrupted before its marker is overwritten when it is sent again, and is invisible until then.

* Null sources, languages and versions are groups of their own; a null count is 0.
* A row without doc_id cannot be found again: its insert counts, later changes of it have nothing to act on.
* Rows that repeat a doc_id and version within a batch are one change, the one with the largest count.
* Deleting an unknown document changes nothing; inserting a known one revises it. Empty batches commit.
* The number of buckets is that of the first batch; a folder keeps it. An interrupted compaction is invisible.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import byte_encoder, encode, vocabulary

GROUP = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, tokenizer string, alive boolean, source string, lang string, n_tokens long, seq long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, seq long"
COMMITS = "batch string, seq long, buckets long"
BASES = "seq long"
BUCKETS = 64


def token_counts(docs: DataFrame, ranks_path: str | None = None, version: str = "byte_bpe_50k") -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens, text_key): counts of whole texts by a byte-level vocabulary and by words.

    text_key tells equal texts; a null text counts as an empty one.
    """
    path = ranks_path or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column("text")]
            out = batch.select(["doc_id", "source", "lang", "text_key"])
            out = out.append_column("tokens", pa.array([len(encode(t, encoder)) for t in texts], pa.int64()))
            yield out.append_column("words", pa.array([len(t.split()) for t in texts], pa.int64()))

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text"
    )
    counted = rows.mapInArrow(run, "doc_id long, source string, lang string, text_key long, tokens long, words long")
    both = F.explode(F.array(
        F.struct(F.lit(version).alias("tokenizer"), F.col("tokens").alias("n_tokens")),
        F.struct(F.lit("words").alias("tokenizer"), F.col("words").alias("n_tokens")),
    ))
    return counted.select("doc_id", "source", "lang", "text_key", both.alias("c")).select(
        "doc_id", "source", "lang", "c.tokenizer", "c.n_tokens", "text_key"
    )


class TokenRollup:
    """A rollup in a folder that driver and executors share, with one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _names(self, folder: str) -> list[str]:
        """Names in a folder, none where it does not exist."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def _markers(self, kind: str, schema: str) -> DataFrame:
        if not self._names(f"{self.folder}/{kind}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{kind}/*")

    def commits(self) -> DataFrame:
        """(batch, seq, buckets) of the committed batches."""
        return self._markers("commits", COMMITS)

    def _parts(self, kind: str) -> list[str]:
        """Folders of the last base and of the batches committed after it."""
        base = max((row.seq for row in self._markers("bases", BASES).collect()), default=0)
        later = sorted(row.seq for row in self.commits().collect() if row.seq > base)  # one small row per batch
        return [f"{self.folder}/base/{kind}/{base}"] * (base > 0) + [f"{self.folder}/{kind}/{seq}" for seq in later]

    def _deltas(self) -> DataFrame:
        parts = self._parts("deltas")
        return self.spark.read.schema(DELTAS).parquet(*parts) if parts else self.spark.createDataFrame([], DELTAS)

    def ledger(self, buckets: set[int] | None = None) -> DataFrame:
        """Changes of the documents in the buckets, or in all; files of other buckets are not read."""
        held = [(part, name) for part in self._parts("ledger") for name in self._names(part) if name.startswith("bucket=")]
        paths = [f"{part}/{name}" for part, name in held if buckets is None or int(name[len("bucket="):]) in buckets]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)

    def _write_ledger(self, rows: DataFrame, path: str, buckets: int) -> None:
        placed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
        placed.repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply changes(doc_id, change, source, lang, tokenizer, n_tokens) unless the batch was committed before.

        change: insert, revise or delete. The sequence number is that of the batch, so a retry finds its own files.
        """
        known = {row.batch: row for row in self.commits().collect()}
        if batch in known:
            return False
        seq = max((row.seq for row in known.values()), default=0) + 1
        buckets = max((row.buckets for row in known.values()), default=self.buckets)
        rows = changes.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.col("change") != "delete").alias("alive"),
            *GROUP, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        )
        last = F.max(F.struct("n_tokens", "alive", "source", "lang")).alias("c")
        named = rows.filter("doc_id is not null").groupBy("doc_id", "tokenizer").agg(last).select(
            "doc_id", "tokenizer", "c.alive", "c.source", "c.lang", "c.n_tokens", F.lit(seq).cast("long").alias("seq")
        )
        path = f"{self.folder}/ledger/{seq}"
        self._write_ledger(named, path, buckets)
        mine = {int(name[len("bucket="):]) for name in self._names(path) if name.startswith("bucket=")}
        named = self.spark.read.schema(LEDGER).parquet(path) if mine else self.spark.createDataFrame([], LEDGER)

        touched = named.select("doc_id", F.col("tokenizer").alias("t"))
        history = self.ledger(mine).join(touched.select("doc_id"), ["doc_id"], "left_semi")
        before = last_state(history)
        match = (before["doc_id"] == touched["doc_id"]) & before["tokenizer"].eqNullSafe(touched["t"])
        before = before.join(touched, match, "left_semi").filter("alive")

        plus = named.filter("alive").select(*GROUP, F.lit(1).alias("sign"), "n_tokens")
        unnamed = rows.filter("doc_id is null and alive").select(*GROUP, F.lit(1).alias("sign"), "n_tokens")
        minus = before.select(*GROUP, F.lit(-1).alias("sign"), "n_tokens")
        summed = plus.union(unnamed).union(minus).groupBy(*GROUP).agg(
            F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens")
        )
        summed.withColumn("seq", F.lit(seq).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/deltas/{seq}")
        marker = self.spark.range(1).select(
            F.lit(batch).alias("batch"), F.lit(seq).cast("long").alias("seq"), F.lit(buckets).cast("long").alias("buckets")
        )
        marker.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{seq}")
        return True

    def compact(self) -> None:
        """Fold everything committed so far into a base."""
        last = self.commits().agg(F.max("seq").alias("seq"), F.max("buckets").alias("buckets")).first()
        if last.seq is None or str(last.seq) in self._names(f"{self.folder}/bases"):
            return
        seq = F.lit(last.seq).cast("long").alias("seq")
        living = last_state(self.ledger()).filter("alive").select(
            "doc_id", "tokenizer", "alive", "source", "lang", "n_tokens", seq
        )
        self._write_ledger(living, f"{self.folder}/base/ledger/{last.seq}", last.buckets)
        groups = self.totals().select(*GROUP, "n_docs", "n_tokens", seq)
        groups.write.mode("overwrite").parquet(f"{self.folder}/base/deltas/{last.seq}")
        self.spark.range(1).select(seq).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/bases/{last.seq}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the groups that still hold documents."""
        summed = self._deltas().groupBy(*GROUP).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        )
        return summed.filter("n_docs <> 0")


def last_state(history: DataFrame) -> DataFrame:
    """The newest change of every document and version: (doc_id, tokenizer, alive, source, lang, n_tokens)."""
    state = F.max_by(F.struct("alive", "source", "lang", "n_tokens"), "seq").alias("c")
    return history.groupBy("doc_id", "tokenizer").agg(state).select("doc_id", "tokenizer", "c.*")
