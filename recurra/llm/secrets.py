"""Secret scan: fixed patterns, and novelty measured by a dictionary-primed compressor.

A candidate is a pattern's match, or another long string of key characters just after a sensitive word. Its novelty
is the number of bytes it adds to the compressed text around it. The compressor is primed on the parts of the corpus's
own words and identifiers, split at case changes and at everything that is no letter, and counted over all texts but
for what stands in candidates: a key cannot vouch for itself, however often it is copied. Names made of known parts add
little; keys add nearly their entropy. Matches are always reported, other candidates when they are hard to compress.

* A candidate that reaches beyond a match is measured and reported beside it; one inside a match is not.
* A name whose parts appear nowhere else in the corpus is as novel as a key and is reported.
* A null text is an empty one. A null doc_id is carried through. Repeated rows are reported each; empty tables work.
  Only doc_id and text are read, other columns of whatever names are carried by ``redact``.
* Very long texts are searched whole, one at a time. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

# Kinds in reporting order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the least length can be part of the pattern
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Candidates beyond the patterns: strings of key characters near a sensitive word.
KEY_STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"(?ai)pass|pwd|secret|token|key|auth|credential|bearer|private|signature")
SENSITIVE_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "private", "signature")
REACH = 48

BEFORE, AFTER = 96, 32
PART = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")  # a word, or the piece of an identifier between changes of case
LONGEST_PART = 24
DICTIONARY = 16_384  # parts that the compressor knows, the most frequent ones
BORDER = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[A-Z][a-z]|[0-9])|(?<=[0-9])(?=[A-Za-z])|[_/=+-]+")
PADDING = 128  # bytes of the dictionary that stand before the surroundings, so that these are never too short to compress
LEAST_NOVELTY, LEAST_SHARE = 10, 0.67

FOUND = "array<struct<kind:int,start:int,stop:int,value:string,before:string,after:string>>"
SPANS = "array<struct<kind:int,start:int,stop:int,novelty:int>>"


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the patterns' matches, leftmost and without overlap within a kind."""
    out = []
    lower = text.lower()
    if any(hint in lower for hint in ASSIGN_HINTS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def near_sensitive(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Other strings of key characters that follow a sensitive word within REACH and do not lie inside a match."""
    lower = text.lower()
    if not any(hint in lower for hint in SENSITIVE_HINTS):
        return []
    out, reached, k = [], 0, 0
    for end in (m.end() for m in SENSITIVE.finditer(text)):
        at, last = max(end, reached), end + REACH
        while at <= last and (first := KEY_STRING.search(text, at, last + 16)):
            whole = KEY_STRING.match(text, first.start())
            start, at = whole.span()
            reached = at
            while k < len(known) and known[k][2] <= start:
                k += 1
            inside, n = False, k
            while n < len(known) and known[n][1] <= start and not inside:
                inside = at <= known[n][2]
                n += 1
            if not inside:
                out.append((3, start, at))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    known = matches(text)
    return sorted(known + near_sensitive(text, known), key=lambda s: (s[1], s[0]))


def around(text: str, start: int, stop: int) -> tuple[str, str]:
    return text[max(0, start - BEFORE) : start], text[stop : stop + AFTER]


@functools.lru_cache(maxsize=2)
def compressor(parts: bytes):
    import zstandard

    # Fixed settings: those that a level stands for change with the length of the text, and marginal bytes with them.
    settings = zstandard.ZstdCompressionParameters(
        window_log=18, hash_log=16, chain_log=16, search_log=7, min_match=4, target_length=24,
        strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    primed = zstandard.ZstdCompressionDict(parts or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=primed)


def novelty(value: str, before: str, after: str, parts: bytes) -> int:
    """Bytes that the value adds to its compressed surroundings: as written, or as the dictionary writes names, in lower
    case with or without gaps between the parts, whichever adds least."""
    packer, added, low = compressor(parts), [], (before.lower(), after.lower())
    lead = parts[-PADDING:]
    for v, b, a in {(value, before, after), (value.lower(), *low), (BORDER.sub(" ", value).lower(), *low)}:
        with_value = packer.compress(lead + (b + v + a).encode("utf-8", "replace"))
        added.append(len(with_value) - len(packer.compress(lead + (b + a).encode("utf-8", "replace"))))
    return min(added)


def is_secret(kind: int, length: int, added: int) -> bool:
    return kind < 3 or added >= max(LEAST_NOVELTY, LEAST_SHARE * length)


def parts_outside(text: str, places: list[tuple[int, int, int]]) -> list[str]:
    """The parts of a text's words and identifiers, without what stands in candidates."""
    if places:
        pieces, at = [], 0
        for _, start, stop in places:
            if start > at:
                pieces.append(text[at:start])
            at = max(at, stop)
        text = "\n".join([*pieces, text[at:]])
    return PART.findall(text)


def found_in(docs: DataFrame) -> DataFrame:
    """(doc_id, found, parts): the candidates of every row of docs(doc_id, text), with what stands around them.

    Each batch of rows is followed by one row without candidates that counts its parts; its ``parts`` is not null.
    """
    fields = [("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]
    fields += [("value", pa.string()), ("before", pa.string()), ("after", pa.string())]
    kind, counted = pa.list_(pa.struct(fields)), pa.map_(pa.string(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [name for name, _ in fields]
        for batch in batches:
            rows, counts = [], Counter()
            for text in batch.column("text"):
                text = text.as_py() or ""
                places = candidates(text)
                counts.update(parts_outside(text, places))
                rows.append([dict(zip(names, (k, s, e, text[s:e], *around(text, s, e)))) for k, s, e in places])
            lower = Counter()
            for part, n in counts.items():
                lower[part.lower()[:LONGEST_PART]] += n
            ids = pa.concat_arrays([batch.column("doc_id"), pa.nulls(1, pa.int64())])
            parts = pa.array([None] * len(rows) + [list(lower.items())], counted)
            yield pa.RecordBatch.from_arrays([ids, pa.array([*rows, []], kind), parts], ["doc_id", "found", "parts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, f"doc_id long, found {FOUND}, parts map<string,bigint>")


def part_dictionary(found: DataFrame, size: int = DICTIONARY) -> bytes:
    """The most frequent parts, the most frequent last, where a compressor finds them cheapest.

    At most `size` of at most LONGEST_PART letters reach the driver; a part must be seen twice.
    """
    each = found.filter(F.col("parts").isNotNull()).select(F.explode("parts").alias("w", "n"))
    top = each.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "w").limit(size).collect()
    return " ".join(row.w for row in reversed(top)).encode()


def scan(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """(doc_id, spans) of every row of docs(doc_id, text): secrets by start, then kind, with their novelty."""
    found = stage(found_in(docs))
    parts = part_dictionary(found, dictionary)
    kind = pa.list_(pa.struct([(name, pa.int32()) for name in ("kind", "start", "stop", "novelty")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for places in batch.column("found").to_pylist():
                kept = []
                for c in places:
                    added = novelty(c["value"], c["before"], c["after"], parts)
                    if is_secret(c["kind"], c["stop"] - c["start"], added):
                        kept.append({"kind": c["kind"], "start": c["start"], "stop": c["stop"], "novelty": added})
                rows.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    return found.filter(F.col("parts").isNull()).drop("parts").mapInArrow(run, f"doc_id long, spans {SPANS}")


def hide(text: str, parts: bytes, mark: str = "[SECRET]") -> str:
    """The text with every secret, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for kind, start, stop in candidates(text):
        if kind == 3 and not is_secret(kind, stop - start, novelty(text[start:stop], *around(text, start, stop), parts)):
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, dictionary: int = DICTIONARY) -> DataFrame:
    """All rows and columns of docs, secrets hidden; n_chars, if there, is the length of the new text. Null stays null."""
    parts = part_dictionary(found_in(docs), dictionary)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else hide(t, parts) for t in batch.column("text").to_pylist()]
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                old = columns["n_chars"]
                lengths = [o if t is None else len(t) for t, o in zip(texts, old.to_pylist())]
                columns["n_chars"] = pa.array(lengths, old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)
