"""Repeated passages by compaction of the De Bruijn graph of word k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.exchange import dropped, exchange, partitions, written
from veilwork.llm.spans import SPAN_WORDS, find_repeats, gather_runs, merged, readable, send_runs, stretches
from veilwork.llm.tokens import U64, split_words

GRAPH = "kind int, path long, other long, doc_id long, start int, end int, is_copy boolean, source_doc_id long"
PATH, LINK, PLACE = range(3)


def chain(succ: np.ndarray) -> np.ndarray:
    """Head of each node's chain, given each node's only successor or -1; a cycle is cut before its least node."""
    n = len(succ)
    pred = np.arange(n)
    has = np.flatnonzero(succ >= 0)
    pred[succ[has]] = has
    while True:
        head, least = pred, np.minimum(np.arange(n), pred)
        for _ in range(max(1, n.bit_length())):
            least = np.minimum(least, least[head])
            head = head[head]
        loop = np.flatnonzero(pred[head] != head)
        if not len(loop):
            return head
        cut = loop[least[loop] == loop]
        pred = pred.copy()
        pred[cut] = cut


def local_paths(found, size: np.ndarray, hashes: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Head of the path of each repeated k-mer (by group), and the links (path, k-mer) that leave tails.

    Equal k-mers have equal minimisers, so all places of a k-mer are here. A step to the next k-mer is inside a path if
    that is the only repeated one that follows, and this the only one that precedes it; a neighbour in another
    partition may be repeated, so it ends the path and is left to the joins.
    """
    n = len(found.hashes)
    at, run, group = found.at, found.run, found.group
    begin = (np.cumsum(size) - size)[run]
    here = np.full(len(hashes), -1, np.int64)
    here[at] = group
    last, none = at == begin + size[run] - 1, at == begin
    ahead = np.where(last, -1, here[np.minimum(at + 1, len(hashes) - 1)])
    behind = np.where(none, -1, here[np.maximum(at - 1, 0)])
    step = np.where(last, after[run], np.where(ahead >= 0, hashes[np.minimum(at + 1, len(hashes) - 1)], U64(0)))
    back = np.where(none, before[run], np.where(behind >= 0, hashes[np.maximum(at - 1, 0)], U64(0)))

    def only(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(n, ~U64(0)), np.zeros(n, U64)
        np.minimum.at(low, group, np.where(value == 0, ~U64(0), value))
        np.maximum.at(high, group, value)
        return (low == high) & (high > 0), high

    one_out, out = only(step)
    one_in, into = only(back)
    succ = np.full(n, -1, np.int64)
    inner = ahead >= 0
    succ[group[inner]] = ahead[inner]
    good = np.flatnonzero((succ >= 0) & one_out)
    good = good[(out[good] == found.hashes[succ[good]]) & one_in[succ[good]] & (into[succ[good]] == found.hashes[good])]
    kept = np.full(n, -1, np.int64)
    kept[good] = succ[good]
    head = chain(kept)
    # a tail is a node whose step isn't inside its path; a cut cycle's last node leads to its own head
    inside = (kept >= 0) & (head[np.maximum(kept, 0)] == head) & (kept != head)
    tail = ~inside[group] & (step != 0)
    links = np.unique(np.stack([found.hashes[head[group[tail]]], step[tail]]), axis=1) if tail.any() else np.zeros((2, 0), U64)
    return head, links[0], links[1]


def compacted(paths: DataFrame, links: DataFrame) -> DataFrame:
    """(path, unitig) of the paths that join others: nonbranching links by pointer doubling in Spark joins."""
    heads = paths.select(F.col("path").alias("b"))
    joined = links.select(F.col("path").alias("a"), F.col("other").alias("b")).distinct().join(heads, "b")
    ins = joined.groupBy("b").agg(F.count(F.lit(1)).alias("n_in"), F.min("a").alias("a"))
    outs = joined.groupBy("a").agg(F.count(F.lit(1)).alias("n_out"))
    single = ins.where("n_in = 1").join(outs.where("n_out = 1"), "a").where("a <> b")
    state = written(single.select(F.col("b").alias("path"), F.col("a").alias("up"), F.least("a", "b").alias("least"), F.lit(False).alias("over")), "chain")
    count, rounds = state.count(), 0
    while state.where("NOT over").limit(1).count() and (1 << rounds) < 2 * count + 2:
        above = state.select(F.col("path").alias("up"), F.col("up").alias("up2"), F.col("least").alias("least2"), F.col("over").alias("over2"))
        rest = state.where("NOT over").join(above, "up", "left")
        moved = rest.select("path", F.coalesce("up2", "up").alias("up"), F.least("least", "least2").alias("least"), (F.col("up2").isNull() | F.col("over2")).alias("over"))
        fresh = written(state.where("over").unionByName(moved), "chain")
        dropped(state)
        state, rounds = fresh, rounds + 1
    # what isn't over after that many rounds is on a cycle, which its least path names
    return state.select("path", F.when(F.col("over"), F.col("up")).otherwise(F.col("least")).alias("unitig"))


def repeated_spans(docs: DataFrame, k: int = SPAN_WORDS) -> DataFrame:
    """Long repeated spans as unitigs of the De Bruijn graph whose edges are k-mers of words.

    Each k-mer goes to the partition of its minimiser. k-mers at two places or more are the graph's edges; steps in which
    one repeated k-mer has one successor, which has no other predecessor, are compacted there, and paths that meet across
    partitions by pointer doubling in Spark joins. Source coordinates (doc_id, word) of the k-mers then verify each span:
    it is a stretch of the document in which every k-mer follows the last by one word.

    Returns (doc_id, start_word, end_word, n_words, is_copy, source_doc_id, unitigs): for each document the maximal stretches
    of words (end is exclusive) that repeated k-mers cover, and the unitigs that they run through, in order, each once.
    k-mers that occur at a smaller (doc_id, word) too are is_copy; source_doc_id is the least document in which one of them
    occurs. A unitig's name is the hash of a k-mer. So the rows are as many as the repeats, however often other documents
    that join or leave a passage divide it into unitigs.

    Rows without doc_id or text and texts of fewer than k words give nothing. Rows with equal doc_id and equal text are one
    document. Repeats inside one document count. An empty table gives an empty result; other columns are ignored.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    parts = partitions(docs.sparkSession)

    def receive(payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        arrays = gather_runs(payloads)
        if arrays is None:
            return
        doc_id, start, size, hashes, before, after = arrays
        found = find_repeats(doc_id, start, size, hashes)
        if not len(found.at):
            return
        head, link_from, link_to = local_paths(found, size, hashes, before, after)
        names = found.hashes[head].view(np.int64)
        paths = np.unique(names)
        spans = stretches(found, k, names[found.group])

        def rows(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
            of = lambda name, t: pa.array(columns[name], t) if name in columns else pa.nulls(n, t)
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(n, kind, np.int32)), **{c: of(c, t) for c, t in (("path", pa.int64()), ("other", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("is_copy", pa.bool_()), ("source_doc_id", pa.int64()))}})

        yield rows(PATH, len(paths), path=paths)
        yield rows(LINK, len(link_from), path=link_from.view(np.int64), other=link_to.view(np.int64))
        yield rows(PLACE, len(spans["doc_id"]), **spans)

    graph = written(exchange(readable(docs), send_runs(k, parts, neighbours=True), receive, GRAPH, parts), "graph")
    unitigs = compacted(graph.where(F.col("kind") == PATH), graph.where(F.col("kind") == LINK))
    places = graph.where(F.col("kind") == PLACE).select("doc_id", "path", "start", "end", "is_copy", "source_doc_id")
    named = places.join(unitigs, "path", "left").select("doc_id", F.coalesce("unitig", "path").alias("path"), "start", "end", "is_copy", "source_doc_id")
    return merged(named, parts).withColumnRenamed("paths", "unitigs")


def without_copies(docs: DataFrame, k: int = SPAN_WORDS) -> DataFrame:
    """docs without the words of repeated spans that occur at a smaller (doc_id, word) too.

    Each cut goes from the first byte of its first word to the last of its last; cuts of one document that touch are one.
    The first place of each passage stays. All rows and columns stay; a text that is cut gets a fresh n_chars where docs
    has that column. Rows without doc_id or text are returned as they are.
    """
    spans = repeated_spans(docs, k).where("is_copy")
    cuts = spans.groupBy(F.col("doc_id").alias("cut_id_")).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts_"))
    schema = docs.schema
    names = schema.names
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names of docs can't clash with those of the cuts
    joined = numbered.join(cuts, F.col(f"c{names.index('doc_id')}").cast("long") == F.col("cut_id_"), "left").drop("cut_id_")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(len(names))
            todo = np.flatnonzero(pc.is_valid(marks).to_numpy(zero_copy_only=False))
            columns = list(batch.columns[: len(names)])
            if len(todo):
                i = names.index("text")
                texts = columns[i].to_pylist()
                for row in todo.tolist():
                    if texts[row] is None:
                        continue
                    words = split_words(pa.array([texts[row]]))
                    raw, out, at = texts[row].encode(), [], 0
                    for mark in marks[row].as_py():
                        a, b = int(words.start[mark["start_word"]]), int(words.end[mark["end_word"] - 1])
                        out.append(raw[at : max(a, at)])
                        at = max(at, b)
                    texts[row] = b"".join([*out, raw[at:]]).decode()
                columns[i] = pa.array(texts, columns[i].type)
                if "n_chars" in names:
                    j = names.index("n_chars")
                    changed = np.zeros(batch.num_rows, bool)
                    changed[todo] = True
                    columns[j] = pc.if_else(pa.array(changed), pc.utf8_length(columns[i]).cast(columns[j].type), columns[j])
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(cut, schema)
