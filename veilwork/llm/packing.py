"""Bounded-space online best-fit packing of documents into sequences of a fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.tokens import chunks, split_words

CAPACITY = 2048
OPEN_BINS = 64
SHARD_DOCUMENTS = 1 << 16

Piece = tuple[int, int, int]
BINS = "shard int, bin long, doc_ids array<long>, starts array<int>, lengths array<int>, n_words int"


class BestFit:
    """At most `open_bins` open bins; a bitset has bit f where an open bin has f words free.

    A piece goes to the fullest bin that has room: the lowest bit at its length or above. Where none has room, it opens a
    bin, and the fullest bin closes first if there are open_bins. Of bins with equal space the one that came to that space
    last is used. A bin without space closes at once.
    """

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open = 0, 0
        self.by_free: dict[int, list[list[Piece]]] = {}

    def _take(self, free: int) -> list[Piece]:
        stack = self.by_free[free]
        pieces = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return pieces

    def add(self, piece: Piece) -> list[list[Piece]]:
        """Places a piece (doc_id, first word, words); returns the bins that close."""
        closed, length = [], piece[2]
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            pieces = self._take(free)
        else:
            if self.open == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, pieces = self.capacity, []
        pieces.append(piece)
        free -= length
        if free:
            self.by_free.setdefault(free, []).append(pieces)
            self.bits |= 1 << free
            self.open += 1
        else:
            closed.append(pieces)
        return closed

    def close(self) -> list[list[Piece]]:
        """The bins that are open, the fullest first."""
        closed = []
        while self.bits:
            closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
        return closed


def packed(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs the words of each document into bins of `capacity` words.

    Only (doc_id, words) is shuffled. Documents are divided by hash into shards of about SHARD_DOCUMENTS, each packed in the
    order of doc_id, so the result depends neither on files nor on the cluster. A document longer than a bin is cut into
    pieces of `capacity` words and a rest.

    Returns (shard, bin, doc_ids, starts, lengths, n_words), a row for each bin: piece i has lengths[i] words of doc_ids[i]
    from word starts[i] (see tokens.split_words). Every word of every row is in one bin. Texts without words, null ones
    too, and rows without doc_id are in no bin; repeated rows are packed each time. An empty table gives an empty result.
    Columns other than doc_id and text are ignored.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    shards = max(1, -(-docs.count() // SHARD_DOCUMENTS))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            count = np.diff(split_words(batch.column("text")).first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count)], ["doc_id", "words"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, bins, rows = None, 0, BestFit(capacity, open_bins), []

        def keep(closed: list[list[Piece]]) -> None:
            nonlocal number
            for pieces in closed:
                ids, starts, lengths = (list(x) for x in zip(*pieces))
                rows.append((shard, number, ids, starts, lengths, sum(lengths)))
                number += 1

        def emit() -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32())
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["shard", "bin", "doc_ids", "starts", "lengths", "n_words"])
            rows.clear()
            return batch

        for batch in batches:
            for s, doc, words in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    keep(bins.close())
                    shard, number, bins = s, 0, BestFit(capacity, open_bins)
                for start in range(0, words, capacity):
                    keep(bins.add((doc, start, min(capacity, words - start))))
            if rows:
                yield emit()
        keep(bins.close())
        if rows:
            yield emit()

    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(measure, "doc_id long, words long")
    sharded = sizes.select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "words").where("words > 0")
    return sharded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "words").mapInArrow(pack, BINS)
