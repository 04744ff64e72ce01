"""Runs of fixed-length word windows that share a content-selected position, and spans of words built from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.exchange import pack, packed_rows, spread, unpack
from veilwork.llm.tokens import U64, chunks, sliding_min, split_words, windows

SPAN_WORDS = 50
ANCHOR_WORDS = 8
FLUSH_WINDOWS = 1 << 21


@dataclass
class Runs:
    """Runs of consecutive windows with the same minimiser position.

    doc_id, start (word of the document at which the first window begins), size (windows), anchor (hash of the minimiser),
    before and after (hash of the window next to the run in its document, 0 if there is none); hashes of all windows.
    """

    doc_id: np.ndarray
    start: np.ndarray
    size: np.ndarray
    anchor: np.ndarray
    before: np.ndarray
    after: np.ndarray
    hashes: np.ndarray


def runs_of(batch: pa.RecordBatch, length: int) -> Runs:
    """The runs of a batch of (doc_id, text); each window of `length` words is in exactly one run."""
    words = split_words(batch.column("text"))
    hashes, at = windows(words, length)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return Runs(none, none, none, none.view(U64), none.view(U64), none.view(U64), hashes)
    total = len(words.hashes)
    small, small_at = windows(words, min(ANCHOR_WORDS, length))
    low = U64((1 << max(22, total.bit_length())) - 1)
    keyed = np.full(total, ~U64(0))
    keyed[small_at] = (small & ~low) | small_at.astype(U64)
    place = (sliding_min(keyed, length - min(ANCHOR_WORDS, length) + 1)[at] & low).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), np.maximum(np.diff(words.first) - length + 1, 0))
    fresh = np.empty(len(at), bool)
    fresh[0] = True
    fresh[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(at))
    anchor = np.zeros(total, U64)
    anchor[small_at] = small
    own = doc[begin]
    left = np.where((begin > 0) & (doc[np.maximum(begin - 1, 0)] == own), hashes[np.maximum(begin - 1, 0)], U64(0))
    right_at = np.minimum(end, len(at) - 1)
    right = np.where((end < len(at)) & (doc[right_at] == own), hashes[right_at], U64(0))
    return Runs(ids[own], at[begin] - words.first[own], end - begin, anchor[place[begin]], left, right, hashes)


def send_runs(length: int, parts: int, neighbours: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs runs by the partition that their minimiser's hash selects, so equal windows meet."""

    def flush(held: list[Runs]) -> pa.RecordBatch:
        doc_id, start, size, anchor, before, after, hashes = (np.concatenate([getattr(r, f) for r in held]) for f in Runs.__dataclass_fields__)
        order, edges = spread(anchor, parts)
        at = (np.cumsum(size) - size)[order]
        size = size[order]
        ends = np.cumsum(size)
        hashes = hashes[np.repeat(at - (ends - size), size) + np.arange(ends[-1])]
        ends = np.append(0, ends)
        doc_id, start, size = doc_id[order], start[order].astype(np.int32), size.astype(np.int32)
        more = (before[order], after[order]) if neighbours else ()
        return packed_rows((p, pack(doc_id[a:b], start[a:b], size[a:b], hashes[ends[a] : ends[b]], *(x[a:b] for x in more))) for p in range(parts) for a, b in [(edges[p], edges[p + 1])] if b > a)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in chunks(batches):
            runs = runs_of(batch, length)
            if len(runs.hashes):
                held.append(runs)
                count += len(runs.hashes)
            if count >= FLUSH_WINDOWS:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)

    return send


@dataclass
class Repeats:
    """Windows that occur at two places or more, in the order in which they came.

    at (index of the window), run (of the window), group (number of the equal windows), doc_id, pos (first word), first
    (the least place at which this window occurs), source (document of that place); hashes by group.
    """

    at: np.ndarray
    run: np.ndarray
    group: np.ndarray
    doc_id: np.ndarray
    pos: np.ndarray
    first: np.ndarray
    source: np.ndarray
    hashes: np.ndarray


def gather_runs(payloads: Iterator[bytes]) -> list[np.ndarray] | None:
    pieces = [unpack(p) for p in payloads]
    return [np.concatenate(x) for x in zip(*pieces)] if pieces else None


def find_repeats(doc_id: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> Repeats:
    """Sorts the windows and compares neighbours: equal ones at two different places (doc_id, word) are repeats."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    keep = np.zeros(len(ranked), bool)
    keep[1:] |= same
    keep[:-1] |= same
    at = np.sort(order[keep])
    run = np.repeat(np.arange(len(size)), size)[at]
    pos = start[run].astype(np.int64) + (at - (np.cumsum(size) - size)[run])
    doc = doc_id[run]
    by = np.lexsort((pos, doc, hashes[at]))
    h, d, p = hashes[at][by], doc[by], pos[by]
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    number = np.cumsum(np.append(True, h[1:] != h[:-1])) - 1 if len(h) else head
    tail = np.append(head[1:], len(h)) - 1 if len(h) else head
    two = ((d[head] != d[tail]) | (p[head] != p[tail]))[number]
    first = (d == d[head][number]) & (p == p[head][number])
    back = np.empty(len(by), np.int64)
    back[by] = np.arange(len(by))
    two, first, number, source = two[back], first[back], number[back], d[head][number][back]
    used, group = np.unique(number[two], return_inverse=True)
    return Repeats(at[two], run[two], group, doc[two], pos[two], first[two], source[two], h[head][used] if len(h) else h)


PLACES = "doc_id long, path long, start int, end int, is_copy boolean, source_doc_id long"


def stretches(found: Repeats, length: int, path: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Repeats that follow each other in a run, with equal flags, as stretches of words."""
    path = np.zeros(len(found.at), np.int64) if path is None else path
    fresh = np.ones(len(found.at), bool)
    fresh[1:] = (np.diff(found.at) != 1) | (np.diff(found.run) != 0) | (found.first[1:] != found.first[:-1]) | (found.source[1:] != found.source[:-1]) | (path[1:] != path[:-1])
    a = np.flatnonzero(fresh)
    b = np.append(a[1:], len(fresh)) - 1 if len(a) else a
    return {"doc_id": found.doc_id[a], "path": path[a], "start": found.pos[a].astype(np.int32), "end": (found.pos[b] + length).astype(np.int32), "is_copy": ~found.first[a], "source_doc_id": found.source[a]}


SPANS = "doc_id long, start_word int, end_word int, n_words int, is_copy boolean, source_doc_id long, paths array<long>"


def merged(places: DataFrame, parts: int) -> DataFrame:
    """Stretches of one document and flag that touch or overlap become one span; paths: theirs, in order, each once."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        doc, path, start, end, copy, source = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in table]) for i in range(6))
        by = np.lexsort((path, start, copy, doc))
        doc, path, start, end, copy, source = (x[by] for x in (doc, path, start.astype(np.int64), end.astype(np.int64), copy, source))
        group = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1])))
        wide = np.int64(1) << 32
        reach = np.maximum.accumulate(group * wide + end)
        fresh = np.append(True, (group[1:] != group[:-1]) | (group[1:] * wide + start[1:] > reach[:-1]))
        a = np.flatnonzero(fresh)
        b = np.append(a[1:], len(fresh)) - 1
        first, last = start[a], reach[b] - group[b] * wide
        span = np.cumsum(fresh) - 1
        seen = np.lexsort((np.arange(len(path)), path, span))
        one = np.sort(seen[np.append(True, (np.diff(span[seen]) != 0) | (np.diff(path[seen]) != 0))])
        edges = np.searchsorted(span[one], np.arange(len(a) + 1)).astype(np.int32)
        columns = [doc[a], first.astype(np.int32), last.astype(np.int32), (last - first).astype(np.int32), copy[a], np.minimum.reduceat(source, a)]
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(path[one]))
        for k in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_arrays([*[pa.array(c[k : k + (1 << 16)]) for c in columns], lists.slice(k, 1 << 16)], ["doc_id", "start_word", "end_word", "n_words", "is_copy", "source_doc_id", "paths"])

    return places.repartition(parts, "doc_id").mapInArrow(merge, SPANS)


def readable(docs: DataFrame) -> DataFrame:
    """doc_id and text of the rows that have both."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
