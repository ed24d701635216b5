"""Best-fit packing by exact complements: few sequences of bounded length for many documents.

Which lengths share a sequence depends on how many pieces of each length there are, so the plan is made
from the histogram of lengths, which has at most `capacity` entries however large the corpus is. Pieces
are then numbered within their length, in bounded chunks, and look their place up in the plan.

* A null text is an empty one: it still holds the end id. A null doc_id is carried through.
* Repeated rows are pieces of their own. An empty table gives an empty result.
* Very long texts are tokenised whole, then cut; only pieces leave the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .tokens import byte_encoder, id_array, vocabulary

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
PACKED = PIECES + ", sequence_id long, offset long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after a shorter first one if n needs it."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    spans = [(0, first)] if first else []
    return spans + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """Tokenised documents as pieces of at most `capacity` ids, each with the checksum of its ids."""
    path = ranks_path or vocabulary("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = id_array(text.as_py(), encoder, end_id)
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length])))
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, kind) for values, kind in zip(columns, PIECE_TYPES)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class Stock:
    """Pieces still to be placed, by length, and the combinations of up to three that fill a gap exactly."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def exact(self, gap: int) -> list[int] | None:
        """Lengths, longest first, of one, two or three available pieces that sum to the gap."""
        if gap <= 0:
            return None
        if self.left[gap]:
            return [gap]
        pair = self.pair(gap)
        if pair:
            return pair
        for longest in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.left[longest]:
                self.left[longest] -= 1
                rest = self.pair(gap - longest)
                self.left[longest] += 1
                if rest and rest[0] <= longest:
                    return [longest, *rest]
        return None

    def pair(self, gap: int) -> list[int] | None:
        small = np.arange(1, gap // 2 + 1)
        both = (self.left[small] > 0) & (self.left[gap - small] > (small * 2 == gap))
        at = int(both.argmax()) if len(both) else 0
        return [gap - int(small[at]), int(small[at])] if len(both) and both[at] else None

    def largest(self, most: int) -> int:
        """The longest available piece that fits, 0 if none does."""
        fits = np.flatnonzero(self.left[: most + 1])
        return int(fits[-1]) if len(fits) else 0


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a sequence, number of such sequences) until every piece is placed.

    counts[n] is the number of pieces of n ids. The longest piece opens a sequence. Its gap is filled exactly if
    one, two or three available pieces allow it, otherwise by the longest that fits, and so on. Each combination is
    repeated as often as the counts allow, so steps grow with the number of lengths, not of pieces.
    """
    stock = Stock(counts)
    out: list[tuple[list[int], int]] = []
    while top := stock.largest(capacity):
        chosen = [top]
        stock.left[top] -= 1
        gap = capacity - top
        while gap:
            filled = stock.exact(gap)
            if filled is None:
                best = stock.largest(gap)
                if not best:
                    break
                filled = [best]
            for length in filled:
                stock.left[length] -= 1
            chosen += filled
            gap -= sum(filled)
        lengths, uses = np.unique(chosen, return_counts=True)
        more = int((stock.left[lengths] // uses).min())
        stock.left[lengths] -= more * uses
        out.append((chosen, 1 + more))
    return out


def places(steps: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ordered by rank."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, times in steps:
        at = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.setdefault(length, []).append((rank, first, at))
            used[length] = rank + times
            at += length
        first += times
    return {length: np.array(found, dtype=np.int64) for length, found in rows.items()}


def pack(cut: DataFrame, capacity: int = 2048, chunks: int = 2000, least: int = 200) -> DataFrame:
    """Sequence and offset of every piece.

    cut: pieces, read more than once, so a written table serves best. A length that holds many pieces, a third of
    all say, is numbered in chunks of max(least, n / chunks) rows; at most chunks + capacity of them exist.
    """
    found = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in found:
        counts[row.length] = row.n
    rows = max(least, -(-int(counts.sum()) // chunks))
    split = [max(1, -(-int(n) // rows)) for n in counts]
    parts = F.element_at(F.array(*[F.lit(n) for n in split]), (F.col("length") + 1).cast("int"))
    chunk = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), parts.cast("long"))
    dealt = cut.withColumn("_chunk", chunk)
    sizes: dict[int, np.ndarray] = {n: np.zeros(split[n] + 1, dtype=np.int64) for n in range(capacity + 1)}
    for row in dealt.groupBy("length", "_chunk").agg(F.count("*").alias("n")).collect():  # bounded, see above
        sizes[row.length][row._chunk + 1] = row.n
    before = {n: np.cumsum(v) for n, v in sizes.items() if counts[n]}
    place = places(plan(counts, capacity))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, part, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_chunk", "_rank"))
            sequence, offset = np.zeros(len(of), dtype=np.int64), np.zeros(len(of), dtype=np.int64)
            for length in np.unique(of):
                rows = np.flatnonzero(of == length)
                at = rank[rows] - 1 + before[length][part[rows]]
                slot = place[length][np.searchsorted(place[length][:, 0], at, side="right") - 1]
                sequence[rows], offset[rows] = slot[:, 1] + at - slot[:, 0], slot[:, 2]
            kept = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    order = Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(order).cast("long"))
    return ranked.mapInArrow(look_up, PACKED)


def pack_documents(docs: DataFrame, capacity: int = 2048, ranks_path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack documents(doc_id, text)."""
    return pack(stage(pieces(docs, capacity, ranks_path=ranks_path)), capacity)
