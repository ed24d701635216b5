"""Benchmark decontamination by winnowing, with DataFrame functions only.

A span of `span` words is found through one fingerprint: of every `span - gram + 1` consecutive word-gram hashes the
smallest is kept, so equal spans keep equal fingerprints wherever they stand. Fingerprints of documents meet those of
the test items in an equi-join; hits are extended to the spans they stand for and compared word by word.

Items of fewer words than `span` are one window of their own length. Winnowing over that length keeps every gram of
that many words (a window of one hash), so these are found for certain, too.

* Null texts have no words: such documents are clean, such items match nothing.
* Rows are told apart by doc_id and text, so rows that repeat an id with other texts are judged by their own text.
* A null item_id marks words as hit, but is not listed. Repeated items are listed once. Empty tables are fine.
* Texts are processed whole; the longest row bounds memory.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

# Characters that end a word: all of ASCII but digits and letters.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def word_array(text: Column) -> Column:
    """Words of a text, A-Z as a-z; other characters beyond ASCII belong to words."""
    plain = F.translate(
        F.coalesce(text, F.lit("")), string.ascii_uppercase + BREAKS, string.ascii_lowercase + " " * len(BREAKS)
    )
    return F.array_remove(F.split(F.trim(plain), " +"), "")


def with_words(rows: DataFrame) -> DataFrame:
    """Add `words` and `n_words` to rows that have a text."""
    found = rows.withColumn("words", word_array(F.col("text")))
    return found.withColumn("n_words", F.size("words").cast("long"))


def winnowed(rows: DataFrame, gram: int, window: int, *keep: str) -> DataFrame:
    """(*keep, fingerprint, start, stop) of rows with words: spans that start in [start, stop) share the fingerprint.

    Every array is a column of its own that later steps name twice, and nothing is filtered between them: so the
    optimizer computes each once, outside the lambdas. Shorter rows end as one null, dropped at the end.
    """
    hashed = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    found = hashed.select(*keep, F.transform(
        _count_from(0, F.size("h") - gram), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(gram)])
    ).alias("g"))
    if window > 1:
        least = F.transform(_count_from(1, F.size("g") - (window - 1)), lambda i: F.array_min(F.slice("g", i, window)))
        found = found.select(*keep, least.alias("g"))
    starts = F.filter(_count_from(0, F.size("g") - 1), lambda i: (i == 0) | (F.get("g", i) != F.get("g", i - 1)))
    stops = F.transform("s", lambda s, k: F.struct(
        F.get("g", s).alias("fingerprint"), s.alias("start"), F.coalesce(F.get("s", k + 1), F.size("g")).alias("stop")
    ))
    runs = found.select(*keep, "g", starts.alias("s")).select(*keep, F.explode_outer(stops).alias("r"))
    return runs.select(*keep, "r.fingerprint", "r.start", "r.stop").filter("start is not null")


def _count_from(first: int, last: Column) -> Column:
    """The integers from first to last, none if last is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, span: int) -> DataFrame:
    """(item_id, words, n_words, window) of items(item_id, text): one row per window, `words` its words."""
    found = with_words(items).filter("n_words > 0").select("item_id", "words", "n_words")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (span - 1)))
    cut = found.select("item_id", F.explode(starts).alias("at"), "words").select(
        "item_id", F.slice("words", F.col("at"), span).alias("words")
    )
    return cut.select("item_id", "words", F.size("words").cast("long").alias("n_words"), F.array_join("words", " ").alias("window"))


def hits(docs: DataFrame, windows: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, length, start, stop) of document spans that share a fingerprint with a window.

    docs: (key, text); windows: of item_windows, read once per length that occurs, at most `span` of them.
    """
    lengths = sorted(row.n_words for row in windows.select("n_words").distinct().collect())
    words = with_words(docs)
    out = None
    for length in lengths:
        k, w = (gram, span - gram + 1) if length == span else (length, 1)
        marks = winnowed(windows.filter(F.col("n_words") == length), k, w).select("fingerprint").distinct()
        found = winnowed(words, k, w, "key").join(marks, "fingerprint")
        found = found.select("key", F.lit(length).cast("int").alias("length"), "start", "stop")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5) -> DataFrame:
    """(key, n_hit, item_ids) of contaminated documents; key = row_key(docs).

    docs: (key, text) and items: (item_id, text), both read more than once.
    """
    windows = stage(item_windows(items, span))
    found = hits(docs, windows, span, gram)
    if found is None:
        return docs.limit(0).select("key", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))
    runs = stage(found.groupBy("key").agg(F.collect_set(F.struct("length", "start", "stop")).alias("runs")))
    # Keys alone first: as long as the list is small, Spark sends it to the texts, not the texts through a shuffle.
    named = docs.join(stage(runs.select("key")), "key", "left_semi")
    spans = named.join(runs, "key").withColumn("words", word_array(F.col("text")))
    starts = F.flatten(F.transform("runs", lambda r: F.transform(
        F.sequence(r["start"], r["stop"] - 1), lambda s: F.struct(s.alias("start"), r["length"].alias("length"))
    )))
    spans = spans.select("key", "words", F.explode(starts).alias("at")).select(
        "key", "at.start", "at.length", F.array_join(F.slice("words", F.col("at.start") + 1, F.col("at.length")), " ").alias("window")
    )
    texts = windows.select("window").distinct()
    exact = spans.join(texts, "window").select("key", "start", "length", F.xxhash64("window").alias("mark"))
    covered = F.flatten(F.transform("at", lambda a: F.sequence(a["start"], a["start"] + a["length"] - 1)))
    by_doc = exact.groupBy("key").agg(
        F.collect_set(F.struct("start", "length")).alias("at"), F.array_sort(F.collect_set("mark")).alias("marks")
    )
    by_doc = stage(by_doc.select(
        "key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), "marks",
        F.sha2(F.array_join(F.transform("marks", lambda m: m.cast("string")), ","), 256).alias("kind"),
    ))
    # Documents that hold the same windows share one list of items.
    kinds = by_doc.select("kind", "marks").dropDuplicates(["kind"]).select("kind", F.explode("marks").alias("mark"))
    of = windows.select(F.xxhash64("window").alias("mark"), F.col("item_id").cast("string").alias("item_id")).distinct()
    lists = kinds.join(of, "mark").groupBy("kind").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return by_doc.join(lists, "kind").select("key", "n_hit", "item_ids")


def row_key(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a key that tells rows apart by both."""
    return docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def contamination(docs: DataFrame, items: DataFrame, span: int = 10, gram: int = 5) -> DataFrame:
    """(doc_id, n_words, n_hit, item_ids) of every row of docs(doc_id, text)."""
    keyed = row_key(docs)
    found = decontaminate(keyed.select("key", "text"), items.select("item_id", "text"), span, gram)
    return with_words(keyed).select("key", "doc_id", "n_words").join(found, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
