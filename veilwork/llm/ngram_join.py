"""Exact Jaccard join of documents on sets of word n-grams, as a join in a metric space."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from veilwork.llm.exchange import dropped, exchange, pack, packed_rows, partitions, spread, unpack, written
from veilwork.llm.spans import readable
from veilwork.llm.tokens import U64, chunks, mix, split_words, windows

NGRAM = 3
THRESHOLD = 0.6
#: Counters of the frequency sketch: its size is fixed, and its errors change the cost of the join, never its result.
SKETCH_BITS = 22
#: Regions that hold more than this share of all n-grams are spread over all partitions.
HOT_SHARE = 1 / 16384
#: Sets of a region that one task compares with each other; larger regions are cut into blocks.
LARGE = 4096
#: Most documents that are broadcast with the regions of their sets; beyond it they are joined by a shuffle.
BROADCAST_SETS = 1 << 18
LEAST_BITS = 64
FLUSH_GRAMS = 1 << 21
MEET_BYTES = 1 << 23
LEAF = 64
PIVOTS = 8


@dataclass
class Sets:
    """Distinct n-grams of some documents: doc_id, size and set_id by document, grams by document and rank."""

    doc_id: np.ndarray
    size: np.ndarray
    set_id: np.ndarray
    grams: np.ndarray


def sets_of(batch: pa.RecordBatch, n: int, rank: np.ndarray | None = None) -> Sets:
    """n-gram sets of a batch of (doc_id, text), in the order of `rank` (by sketch counter), then of hash.

    A text of fewer than n words, but one at least, has one n-gram, of all its words; a text without words isn't there.
    """
    words = split_words(batch.column("text"))
    hashes, at = windows(words, n)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    count = np.diff(words.first)
    doc = np.repeat(np.arange(len(ids)), np.maximum(count - n + 1, 0))
    for m in range(1, n):
        few = np.flatnonzero(count == m)
        if len(few):
            value = np.zeros(len(few), U64)
            for j in range(m):
                value = mix(value * U64(31) + words.hashes[words.first[few] + j] + U64(m))
            hashes, doc = np.append(hashes, value), np.append(doc, few)
    level = rank[(hashes >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) << U64(56) if rank is not None else U64(0)
    # the hash's low bits break ties, so that n-grams in one counter are in no order that depends on it
    key = level | (hashes & U64((1 << 56) - 1))
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    hashes, doc = hashes[order], doc[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[fresh], doc[fresh]
    size = np.bincount(doc, minlength=len(ids))
    sums = np.append(U64(0), np.cumsum(mix(hashes + U64(7))))
    ends = np.append(0, np.cumsum(size))
    set_id = mix(sums[ends[1:]] - sums[ends[:-1]] + size.astype(U64))
    used = size > 0
    return Sets(ids[used], size[used], set_id[used].view(np.int64), hashes)


def parity_bits(found: Sets) -> list[bytes]:
    """For each set its size, and bits that say whether an even or odd number of its n-grams fall on each.

    There are at least twice as many bits as n-grams, a power of two. n-grams that two sets have in common cancel out in the
    exclusive or of their bits, so the number of ones there is at most the number of n-grams that only one of them has.
    """
    width = np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(2 * found.size)).astype(np.int64))
    ends = np.cumsum(width)
    begin, mask = np.repeat(ends - width, found.size), np.repeat(width - 1, found.size)
    at = begin + (found.grams.astype(np.int64) & mask)
    packed = np.packbits((np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1).astype(np.uint8)).tobytes()
    edges = np.append(0, ends // 8).tolist()
    return [np.int64(n).tobytes() + packed[a:b] for n, a, b in zip(found.size, edges[:-1], edges[1:])]


class Parity:
    """Sets by size and parity bits."""

    def __init__(self, bits: list[bytes]) -> None:
        self.size = np.array([np.frombuffer(b, np.int64, 1)[0] for b in bits], np.int64)
        self.rows = [np.frombuffer(b, np.uint8, offset=8) for b in bits]
        self.width = np.array([len(r) for r in self.rows], np.int64)

    def possible(self, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs of sets (indices) can reach the threshold by their bits; a pair that does reach it always can."""
        good = np.zeros(len(left), bool)
        least = np.minimum(self.width[left], self.width[right])
        for w in np.unique(least):
            own = np.flatnonzero(least == w)
            used, place = np.unique(np.append(left[own], right[own]), return_inverse=True)
            folded = np.stack([np.bitwise_xor.reduce(self.rows[i].reshape(-1, w), axis=0) for i in used])
            if w % 8 == 0:
                folded = folded.view(U64)
            for k in range(0, len(own), step := max(1, (1 << 22) // int(w))):
                part = own[k : k + step]
                ones = np.bitwise_count(folded[place[k : k + len(part)]] ^ folded[place[len(own) + k : len(own) + k + len(part)]]).sum(1, dtype=np.int64)
                both = self.size[left[part]] + self.size[right[part]]
                good[part] = ones <= (1 - threshold) / (1 + threshold) * both + 1e-6
        return good


@dataclass
class Ranks:
    """level: a byte for each counter of the sketch; n-grams of counters at `hot` or above are common (see send_prefixes)."""

    level: np.ndarray
    hot: int


SCAN = "doc_id long, set_id long, bits binary, part int, payload binary"


def scan(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """set_id and parity bits of each document, and slices of a saturating count of n-grams by hash prefix."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in chunks(batches):
            found = sets_of(batch, n)
            counts += np.bincount((found.grams >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            k = len(found.doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(found.doc_id), pa.array(found.set_id), pa.array(parity_bits(found), pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "set_id", "bits", "part", "payload"])
        slices = np.array_split(np.minimum(counts, 255).astype(np.uint8), parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.int64()), pa.nulls(parts, pa.binary()), pa.array(range(parts), pa.int32()), pa.array([s.tobytes() for s in slices], pa.binary())], ["doc_id", "set_id", "bits", "part", "payload"])

    return docs.mapInArrow(send, SCAN)


def ranks(scanned: DataFrame, parts: int) -> Ranks:
    """Steps of an eighth of a power of two of the summed counts: one byte for each counter, 4 MB whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = np.frombuffer(value.as_py(), np.uint8).astype(np.int64)
                sums[part] = sums[part] + counts if part in sums else counts
        for part, counts in sums.items():
            level = np.minimum(np.log2(counts + 1) * 8, 255).astype(np.uint8)
            yield packed_rows([(part, level.tobytes())])

    rows = scanned.where("part IS NOT NULL").select("part", "payload").repartitionById(parts, F.col("part")).mapInArrow(add, "part int, payload binary").collect()
    if not rows:
        return Ranks(np.zeros(1 << SKETCH_BITS, np.uint8), 256)
    level = np.concatenate([np.frombuffer(r.payload, np.uint8) for r in sorted(rows, key=lambda r: r.part)])
    most = max(LARGE, (np.bincount(level, minlength=256) * (2.0 ** (np.arange(256) / 8) - 1)).sum() * HOT_SHARE)
    return Ranks(level, int(np.ceil(np.log2(most + 1) * 8)))


def level_of(grams: np.ndarray, ranks_: Ranks) -> np.ndarray:
    return ranks_.level[(grams >> U64(64 - SKETCH_BITS)).astype(np.int64)]


def send_prefixes(n: int, threshold: float, rank, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends each set to the regions in which a partner can be.

    The singleton set of an n-gram is a pivot: it is at 1 - 1/|x| from a set x that holds it and at 1 from others, so a
    set's nearest pivots are its own n-grams. A set's home is its rarest one. A set within distance e = 1 - threshold of x
    misses at most e|x| of x's n-grams; so with pivots in one order, rarest first, the first e|x| + 1 of x's are a window
    in which both have one in common, and x is replicated to all of them.

    What is sent of a set to a pivot is 16 bytes and not the set. All that goes to one pivot meets in one partition, but for
    pivots that hold more than HOT_SHARE of all n-grams: theirs is spread by set, as each certainly has members.
    """

    def flush(held: list[Sets]) -> pa.RecordBatch:
        size, set_id, grams = (np.concatenate([getattr(s, f) for s in held]) for f in ("size", "set_id", "grams"))
        begin = np.cumsum(size) - size
        _, one = np.unique(set_id, return_index=True)  # equal sets go once
        size, set_id, begin = size[one], set_id[one], begin[one]
        take = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
        ends = np.cumsum(take)
        index = np.repeat(begin - (ends - take), take) + np.arange(ends[-1])
        key = grams[index]
        prev = np.append(U64(0), key[:-1]).astype(np.uint32)
        prev[ends - take] = 0
        doc = np.repeat(np.arange(len(take), dtype=np.uint32), take)
        place = np.arange(ends[-1]) - np.repeat(ends - take, take)
        place = place.astype(np.uint16 if take.max() <= 65536 else np.uint32)
        to = mix(key)
        if (common := level_of(key, rank.value) >= rank.value.hot).any():
            to[common] = mix(set_id[doc[common]].view(U64))
        order, edges = spread(to, parts)
        key, prev, doc, place = key[order], prev[order], doc[order], place[order]

        def piece(a: int, b: int) -> bytes:
            own, local = np.unique(doc[a:b], return_inverse=True)
            return pack(key[a:b], prev[a:b], place[a:b], local.astype(np.uint16 if len(own) < 65536 else np.uint32), set_id[own], size[own].astype(np.int32))

        return packed_rows((p, piece(edges[p], edges[p + 1])) for p in range(parts) if edges[p + 1] > edges[p])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in chunks(batches):
            found = sets_of(batch, n, rank.value.level)
            if len(found.doc_id):
                held.append(found)
                count += len(found.grams)
            if count >= FLUSH_GRAMS:
                yield flush(held)
                held, count = [], 0
        if held:
            yield flush(held)

    return send


@dataclass
class Members:
    """Sets in regions: key (the pivot's n-gram), prev (the low bits of the n-gram before it in the set's order), place (of the
    n-gram in that order), set_id, size; side is None, or 1 and 2 where only sets of different sides meet, and 0 where all do."""

    key: np.ndarray
    prev: np.ndarray
    place: np.ndarray
    set_id: np.ndarray
    size: np.ndarray
    side: np.ndarray | None = None

    def __getitem__(self, at: np.ndarray) -> Members:
        return Members(*(None if x is None else x[at] for x in (self.key, self.prev, self.place, self.set_id, self.size, self.side)))

    def once(self) -> np.ndarray:
        """Where each (key, set_id) is first, in their order, of the keys that have several entries."""
        order = np.argsort(self.key, kind="stable")
        ranked = self.key[order]
        keep = np.zeros(len(ranked), bool)
        same = ranked[1:] == ranked[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        order = order[keep]
        order = order[np.lexsort((self.set_id[order], self.key[order]))]
        key, set_id = self.key[order], self.set_id[order]
        return order[np.append(True, (key[1:] != key[:-1]) | (set_id[1:] != set_id[:-1]))] if len(order) else order


def meetings(members: Members, region: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices) of sets in one region that can reach the threshold; members are in the order of `region`.

    Two sets that have the same n-gram before this one in their windows meet in its region too and are left to that. Where
    they meet first, they have in common this n-gram and at most those after it, so a pair goes on only if its sizes, and
    the places of this n-gram in both, leave room for the least overlap.
    """
    prev, place, size, side = members.prev, members.place.astype(np.int64), members.size.astype(np.int64), members.side
    begin = np.flatnonzero(np.append(True, region[1:] != region[:-1])) if len(region) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(region)))

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        good = ((prev[i] != prev[j]) | (prev[i] == 0)) & (small >= threshold * large - 1e-9)
        good &= np.minimum(size[i] - place[i], size[j] - place[j]) >= threshold / (1 + threshold) * (small + large) - 1e-9
        if side is not None:
            good &= (side[i] == 0) | (side[i] != side[j])
        return i[good], j[good]

    for m in np.unique(count):
        if m < 2:
            continue
        own = begin[count == m]
        if m <= 64:
            a, b = np.triu_indices(m, 1)
            for k in range(0, len(own), step := max(1, (1 << 20) // len(a))):
                part = own[k : k + step, None]
                yield kept((part + a).ravel(), (part + b).ravel())
            continue
        for s in own.tolist():
            # sorted by size, each set only meets a window of sets; by the n-gram before, only other classes
            by = s + np.argsort(size[s : s + m], kind="stable")
            if (prev[by] == prev[by[0]]).all() and prev[by[0]] != 0:
                continue
            reach = np.searchsorted(size[by], np.floor(size[by] / threshold + 1e-9), side="right")
            for k in range(0, m, 256):
                rows = np.arange(k, min(k + 256, m))
                width = np.maximum(reach[rows] - rows - 1, 0)
                if not width.sum():
                    continue
                i = np.repeat(rows, width)
                j = i + 1 + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                yield kept(by[i], by[j])


MEMBERS = "region long, set_id long"


def member_batches(region: np.ndarray, set_id: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(region):
        return
    order = np.lexsort((set_id, region))
    region, set_id = region[order], set_id[order]
    fresh = np.append(True, (region[1:] != region[:-1]) | (set_id[1:] != set_id[:-1]))
    region, set_id = region[fresh], set_id[fresh]
    for k in range(0, len(region), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(region[k : k + (1 << 16)]), pa.array(set_id[k : k + (1 << 16)])], ["region", "set_id"])


def region_members(docs: DataFrame, n: int, threshold: float, rank, parts: int) -> DataFrame:
    """(region, set_id), distinct: the sets that meet another at an n-gram, without the pairs themselves.

    A region is named by the least of its sets, so that copies with a few changes, which meet at nearly all of their
    n-grams, meet in few regions. Of an n-gram with more than LARGE sets all are returned, so that the work here is never
    quadratic in a large one; one that is spread over the partitions names its region itself.
    """

    def receive(payloads: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        pieces = []
        for payload in payloads:
            key, prev, place, local, set_id, size = unpack(payload)
            pieces.append((key, prev, place, set_id[local], size[local]))
        if not pieces:
            return
        every = Members(*(np.concatenate(x) for x in zip(*pieces)))
        del pieces
        common = level_of(every.key, rank.value) >= rank.value.hot
        if common.any():
            at = np.flatnonzero(common)
            yield from member_batches(every.key[at].view(np.int64), every.set_id[at])
            every = every[np.flatnonzero(~common)]
        own = every[every.once()]
        if not len(own.key):
            return
        keep = np.zeros(len(own.key), bool)
        begin = np.flatnonzero(np.append(True, own.key[1:] != own.key[:-1]))
        count = np.diff(np.append(begin, len(own.key)))
        large = np.repeat(count > LARGE, count)
        keep[large] = True
        few = np.flatnonzero(~large)
        part = own[few]
        for i, j in meetings(part, part.key, threshold):
            keep[few[i]] = keep[few[j]] = True
        least = np.minimum.reduceat(np.where(keep, own.set_id, np.iinfo(np.int64).max), begin)
        yield from member_batches(np.repeat(least, count)[keep], own.set_id[keep])

    return exchange(docs, send_prefixes(n, threshold, rank, parts), receive, MEMBERS, parts).distinct()


def jaccard_to(pivot: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Jaccard similarity of one sorted set with each of several that lie one after the other."""
    at = np.minimum(np.searchsorted(pivot, grams), len(pivot) - 1)
    hits = np.append(0, np.cumsum(pivot[at] == grams))
    both = hits[ends[1:]] - hits[ends[:-1]]
    return both / (len(pivot) + np.diff(ends) - both)


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of indices (left, right) reach the threshold, and their similarity.

    Regions join recursively: sets get the nearest of a few pivots, pairs inside one Voronoi cell go down with it, and a
    pair across two cells is dropped where the triangle inequality puts it further apart than the threshold, and else
    replicated to the cell of its left set.
    """
    limit = 1 - threshold + 1e-9
    good, value = np.zeros(len(left), bool), np.zeros(len(left))

    def solve(rows: np.ndarray) -> None:
        order = rows[np.argsort(left[rows], kind="stable")]
        cuts = np.flatnonzero(np.diff(left[order])) + 1
        for own in np.split(order, cuts):
            others = [sets[j] for j in right[own]]
            ends = np.append(0, np.cumsum([len(x) for x in others]))
            value[own] = jaccard_to(sets[left[own[0]]], np.concatenate(others), ends)
            good[own] = value[own] >= threshold - 1e-9

    todo = [np.arange(len(left))] if len(left) else []
    while todo:
        rows = todo.pop()
        members = np.unique(np.append(left[rows], right[rows]))
        if len(members) <= LEAF or len(rows) <= 4 * len(members):
            solve(rows)
            continue
        grams = np.concatenate([sets[i] for i in members])
        ends = np.append(0, np.cumsum([len(sets[i]) for i in members]))
        far, near = [], np.full(len(members), np.inf)
        place = np.searchsorted(members, left[rows]), np.searchsorted(members, right[rows])
        keep, pick = np.ones(len(rows), bool), 0
        for _ in range(PIVOTS):  # each pivot is the set furthest from those before it
            d = 1 - jaccard_to(sets[members[pick]], grams, ends)
            keep &= np.abs(d[place[0]] - d[place[1]]) <= limit
            far.append(d)
            near = np.minimum(near, d)
            pick = int(np.argmax(near))
        cell = np.argmin(np.stack(far), axis=0)[place[0]]
        cells = [rows[keep & (cell == c)] for c in range(PIVOTS)]
        for part in cells:
            if len(part) == len(rows):
                solve(part)
            elif len(part):
                todo.append(part)
    return good, value


def in_blocks(members: DataFrame) -> DataFrame:
    """(region, i, j, own, set_id): a region of more than LARGE sets is cut into blocks by hash of set_id, and each two blocks
    are a region of their own, in which sets of one block meet those of the other. So no task has more than twice LARGE."""
    large = members.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("region", F.ceil(F.col("n") / F.lit(float(LARGE))).cast("int").alias("blocks"))
    if not large.limit(1).count():
        return members.select("region", *[F.lit(0).cast("int").alias(c) for c in ("i", "j", "own")], "set_id")
    split = members.join(large, "region", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    split = split.withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return split.select("region", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), "own", "set_id")


CANDIDATES = "a long, b long"


def likely_pairs(members: DataFrame, sets: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b), a < b, distinct: the pairs of a region that parity bits don't refute. Nearly all that share a few n-grams by
    chance are refuted here, and their sets are never shuffled."""
    rows = in_blocks(members).join(sets.select("set_id", "bits"), "set_id").select("region", "i", "j", "own", "set_id", "bits")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def finish(over: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            table = pa.Table.from_batches(held).combine_chunks()
            names = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("region", "i", "j")])
            fresh = np.append(True, (names[:, 1:] != names[:, :-1]).any(0))
            end = table.num_rows if over else int(np.flatnonzero(fresh)[-1])  # the last region may go on
            held, size = ([] if end == table.num_rows else table.slice(end).to_batches()), 0
            if not end:
                return
            region, set_id = np.cumsum(fresh[:end]), table.column("set_id").to_numpy()[:end]
            parity = Parity(table.column("bits").slice(0, end).to_pylist())
            i, j, own = names[1, :end], names[2, :end], table.column("own").to_numpy()[:end]
            none = np.zeros(end, np.int64)
            members_ = Members(region, none, none, set_id, parity.size, np.where(i == j, 0, np.where(own == i, 1, 2)))
            for x, y in meetings(members_, region, threshold):
                good = parity.possible(x, y, threshold)
                a, b = set_id[x[good]], set_id[y[good]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
                if size >= MEET_BYTES:
                    yield from finish(False)
        if held:
            yield from finish(True)

    key = ["region", "i", "j"]
    return rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(join, CANDIDATES).distinct()


SIMILAR = "a long, b long, jaccard double, links long"
#: Pairs of a region that go to one task; regions with more are divided by the first set of a pair.
MOST_PAIRS = 1 << 18


def spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of the nodes that pairs connect, without the roots: each group's least."""
    nodes, place = np.unique(np.append(left, right), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        fresh = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(fresh, at, low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            own = np.flatnonzero(root != np.arange(len(nodes)))
            return nodes[own], nodes[root[own]]
        root = fresh


def with_regions(pairs: DataFrame, name: str) -> DataFrame:
    """(a, b, region): a set's pivot is the least of itself and its candidates; a pair is in the region of its lesser set's,
    or, where that has more than MOST_PAIRS pairs, in one of the regions into which these are divided by `a`."""
    pivot = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("pivot"))
    placed = written(pairs.join(pivot, "a", "left").select("a", "b", F.coalesce("pivot", "a").alias("region")), name)
    large = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_PAIRS).select("region", F.ceil(F.col("n") / F.lit(float(MOST_PAIRS))).alias("blocks"))
    if not large.limit(1).count():
        return placed
    divided = placed.join(large, "region", "left").withColumn("region", F.when(F.col("blocks").isNull(), F.col("region")).otherwise(F.xxhash64("region", F.pmod(F.xxhash64("a"), F.col("blocks")))))
    return divided.select("a", "b", "region")


def members_of(placed: DataFrame) -> DataFrame:
    """(region, set_id): sets are replicated to the regions of their pairs."""
    return placed.select("region", F.explode(F.array("a", "b")).alias("set_id")).distinct()


def meet(placed: DataFrame, values: DataFrame, threshold: float, parts: int, pairs: bool) -> DataFrame:
    """SIMILAR of the pairs that reach the threshold; values has (region, set_id, value). See similar_sets for `pairs`."""
    routed = values.select("region", F.col("set_id").alias("a"), F.lit(None).cast("long").alias("b"), "value")
    rows = routed.unionByName(placed.withColumn("value", F.lit(None).cast("binary")))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, names, sets, a, b = None, [], [], [], []

        def finish() -> pa.RecordBatch | None:
            if not a:
                return None
            ids, one = np.unique(np.array(names), return_index=True)  # repeated rows of a document sent a set twice
            x, y = np.array(a), np.array(b)
            good, value = verified([np.frombuffer(v, U64) for v in sets], one[np.searchsorted(ids, x)], one[np.searchsorted(ids, y)], threshold)
            if not good.any():
                return None
            x, y = x[good], y[good]
            if pairs:
                columns = [pa.array(x), pa.array(y), pa.array(value[good]), pa.nulls(len(x), pa.int64())]
            else:
                node, links = np.unique(np.append(x, y), return_counts=True)
                u, v = spanning(x, y)
                many, few = len(node), len(u)
                first = np.arange(many + few) < many
                columns = [pa.array(np.append(node, u)), pa.array(np.append(np.zeros(many, np.int64), v), mask=first), pa.nulls(many + few, pa.float64()), pa.array(np.append(links, np.zeros(few, np.int64)), mask=~first)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b", "jaccard", "links"])

        for batch in batches:
            for r, x, y, g in zip(*(c.to_pylist() for c in batch.columns)):
                if r != region:
                    if (done := finish()) is not None:
                        yield done
                    region, names, sets, a, b = r, [], [], [], []
                if g is not None:
                    names.append(x)
                    sets.append(g)
                else:
                    a.append(x)
                    b.append(y)
        if (done := finish()) is not None:
            yield done

    return rows.select("region", "a", "b", "value").repartition(parts, "region").sortWithinPartitions("region").mapInArrow(join, SIMILAR)


def similar_sets(docs: DataFrame, sets: DataFrame, likely: DataFrame, n: int, threshold: float, parts: int, pairs: bool) -> DataFrame:
    """SIMILAR of the likely pairs that reach the threshold. With `pairs`, each as (a, b, jaccard). Else, for each region,
    (a, links): how many partners a has there, and as many (a, b) as connect what all its pairs connect."""
    placed = with_regions(likely, "likely-placed")
    wanted = members_of(placed).join(sets.select("set_id", "name"), "set_id").groupBy(F.col("name").alias("doc_id")).agg(F.collect_list(F.struct("set_id", "region")).alias("places"))
    wanted = written(wanted, "wanted")
    few = wanted.limit(BROADCAST_SETS + 1).count() <= BROADCAST_SETS
    chosen = docs.join(F.broadcast(wanted) if few else wanted, "doc_id").select("doc_id", "text", "places")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = sets_of(batch.select(["doc_id", "text"]), n)
            ends = np.append(0, np.cumsum(found.size))
            place = {x: k for k, x in enumerate(zip(found.doc_id.tolist(), found.set_id.tolist()))}
            region, set_id, values = [], [], []
            for doc, places in zip(batch.column("doc_id").to_pylist(), batch.column("places").to_pylist()):
                for x in places:
                    # a document of several texts is wanted for the sets that it names only
                    if (k := place.get((doc, x["set_id"]))) is not None:
                        region.append(x["region"])
                        set_id.append(x["set_id"])
                        values.append(np.sort(found.grams[ends[k] : ends[k + 1]]).tobytes())
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(set_id), pa.array(values, pa.binary())], ["region", "set_id", "value"])

    return meet(placed, chosen.mapInArrow(send, "region long, set_id long, value binary"), threshold, parts, pairs)


def _joined(docs: DataFrame, threshold: float, n: int, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, set_id) of each document, (set_id, name, bits) of each set, and SIMILAR."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    spark = docs.sparkSession
    parts = partitions(spark)
    docs = readable(docs)
    scanned = written(scan(docs, n, parts), "scan")
    rank = spark.sparkContext.broadcast(ranks(scanned, parts))
    named = scanned.where("part IS NULL").select("doc_id", "set_id").distinct()
    sets = written(scanned.where("part IS NULL").groupBy("set_id").agg(F.min("doc_id").alias("name"), F.first("bits").alias("bits")), "sets")
    named = written(named, "named")
    dropped(scanned)
    members = written(region_members(docs, n, threshold, rank, parts), "members")
    likely = written(likely_pairs(members, sets, threshold, parts), "likely")
    dropped(members)
    similar = written(similar_sets(docs, sets, likely, n, threshold, parts, pairs), "similar")
    dropped(likely)
    return named, sets, similar


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """All pairs of documents whose sets of word n-grams have a Jaccard similarity of at least `threshold`, exactly.

    Jaccard distance is a metric. Documents with equal sets are at distance 0 and are one point. Pivots create regions:
    first the singleton sets of n-grams (see send_prefixes), with boundary sets replicated to all regions in which a
    partner can be; these are regions of documents, named by one of them, of which large ones are cut into blocks; then, once
    parity bits have refuted pairs that only share a few n-grams, the least set of each group of candidates, and inside its
    region further pivots, with triangle inequality windows (see verified). Pivots among documents alone can't divide
    unrelated texts, which are all at nearly 1 from each other, so that every window would hold every document.

    Returns (doc_a, doc_b, jaccard). Each distinct set is named by the least doc_id that has it: doc_a and doc_b are such
    documents, doc_a < doc_b, for pairs of different sets; and each other document of a set is doc_b with that set's name
    as doc_a and 1.0. So all pairs follow from the rows (see every_pair), and thousands of copies give thousands of rows, not
    millions. What grows in proportion to the documents is jaccard_classes.

    A text of fewer than n words has one n-gram, of all its words; null and empty texts and texts without words, and rows
    without doc_id, are in no pair. Repeated rows of one doc_id and text are one document. An empty table gives an empty
    result. Columns other than doc_id and text are ignored.
    """
    named, sets, similar = _joined(docs, threshold, n, True)
    left, right = sets.select(F.col("set_id").alias("a"), F.col("name").alias("x")), sets.select(F.col("set_id").alias("b"), F.col("name").alias("y"))
    across = similar.join(left, "a").join(right, "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    copies = named.join(sets.select("set_id", "name"), "set_id").where("doc_id <> name").select(F.col("name").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(copies)


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """The join of jaccard_join as one row for each document: (doc_id, class_id, n_copies, n_links).

    class_id is the least doc_id of those that pairs connect with the document, n_copies the number of other documents
    with the same set of n-grams, n_links that of other sets, each counted once however many documents have it, with a
    similarity of at least `threshold`. Every pair of different sets is worked out and counted.

    Texts without words and null texts are classes of their own without links. Rows without doc_id aren't there; repeated
    rows are one document. A doc_id with different texts has the least of their classes and the sums of their numbers. An
    empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    named, sets, similar = _joined(docs, threshold, n, False)
    links = similar.where("links IS NOT NULL").groupBy(F.col("a").alias("set_id")).agg(F.sum("links").alias("links"))
    roots = components(similar.where("b IS NOT NULL").select("a", "b"))
    # a root is a set; its class is the least name of its sets
    own = sets.select("set_id", "name").join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = own.groupBy("root").agg(F.min("name").alias("class_id"))
    copies = named.groupBy("set_id").agg((F.count(F.lit(1)) - 1).alias("copies"))
    known = own.join(least, "root").join(copies, "set_id").join(links, "set_id", "left").select("set_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    found = named.join(known, "set_id").select("doc_id", "class_id", "copies", "links")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").withColumns({"class_id": F.col("doc_id"), "copies": F.lit(0).cast("long"), "links": F.lit(0).cast("long")})
    rows = found.withColumn("has", F.lit(True)).unionByName(every.withColumn("has", F.lit(False)))
    return rows.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("has"), F.col("class_id"))), F.col("doc_id")).alias("class_id"), F.sum("copies").alias("n_copies"), F.sum("links").alias("n_links"))


def every_pair(pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, jaccard) of all pairs of documents, doc_a < doc_b, from the rows of jaccard_join.

    Documents of one set are each paired with each other, and with each document of each similar set. The result is as large
    as the number of pairs: 1,000 copies have 499,500.
    """
    copies = pairs.where("jaccard = 1")
    members = copies.selectExpr("doc_a AS name", "doc_b AS doc").unionByName(pairs.selectExpr("explode(array(doc_a, doc_b)) AS name").distinct().join(copies.selectExpr("doc_b AS name"), "name", "left_anti").selectExpr("name", "name AS doc"))
    left, right = members.selectExpr("name AS x", "doc AS a"), members.selectExpr("name AS y", "doc AS b")
    sets = pairs.where("jaccard < 1").selectExpr("doc_a AS x", "doc_b AS y", "jaccard").unionByName(copies.selectExpr("doc_a AS x", "doc_a AS y", "jaccard").distinct())
    return sets.join(left, "x").join(right, "y").where("x <> y OR a < b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of nodes that pairs (a, b) connect; root is the least node of the group.

    Alternating large-star and small-star steps, each a shuffle of as many rows as there are edges, until no edge moves.
    """
    edges = written(pairs.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.withColumn("m", F.least(F.min("u").over(W.partitionBy("v")), "v"))
        large = least.where("u > v").select(F.col("m").alias("v"), "u").distinct()
        # small star: each node's lesser neighbours, and itself, get its least
        lesser = large.select(F.col("u").alias("x"), F.col("v").alias("y")).withColumn("m", F.min("y").over(W.partitionBy("x")))
        small = lesser.select(F.col("m").alias("v"), F.col("y").alias("u")).unionByName(lesser.select(F.col("m").alias("v"), F.col("x").alias("u"))).where("u <> v").distinct()
        fresh = written(small, "edges")
        dropped(edges)
        edges = fresh
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM) -> DataFrame:
    """docs with one document of each class of jaccard_classes: the one with the least doc_id.

    Rows of a doc_id stay or go together. Null and empty texts, texts without words and rows without doc_id all stay;
    repeated rows of a document that stays all stay. Columns are those of docs, whatever their names. An empty table gives
    an empty result.
    """
    gone = jaccard_classes(docs, threshold, n).where("class_id <> doc_id").select(F.col("doc_id").alias("gone_id_"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id_"], "left_anti")


def classes_sql(threshold: float = THRESHOLD, n: int = NGRAM) -> str:
    """The rows of jaccard_classes over `documents` as SQL for DuckDB: sets of n-grams joined on each n-gram, and closure."""
    low = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(n))
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT DISTINCT doc_id, regexp_extract_all({low}, '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), sets AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {n} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {n} + 2), lambda i: {gram}) END)) AS g FROM docs WHERE len(w) > 0
), named AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(g, ',')) AS s, g FROM sets), names AS MATERIALIZED (
  SELECT s, min(doc_id) AS name, count(*) AS docs, any_value(g) AS g FROM named GROUP BY s
), grams AS MATERIALIZED (SELECT s, len(g) AS size, unnest(g) AS x FROM names), pairs AS MATERIALIZED (
  SELECT a.s AS a, b.s AS b FROM grams a JOIN grams b ON a.x = b.x AND a.s <> b.s GROUP BY a.s, b.s, a.size, b.size HAVING count(*) >= ({threshold} - 1e-9) * (a.size + b.size - count(*))
), reach AS (SELECT s AS a, s AS b FROM names UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b), classes AS (
  SELECT r.a AS s, min(n.name) AS class_id FROM reach r JOIN names n ON n.s = r.b GROUP BY r.a
), links AS (SELECT a AS s, count(*) AS links FROM pairs GROUP BY a), found AS (
  SELECT doc_id, min(class_id) AS class_id, sum(docs - 1) AS n_copies, sum(coalesce(links, 0)) AS n_links FROM named JOIN names USING (s) JOIN classes USING (s) LEFT JOIN links USING (s) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(f.class_id, d.doc_id) AS class_id, CAST(coalesce(f.n_copies, 0) AS BIGINT) AS n_copies, CAST(coalesce(f.n_links, 0) AS BIGINT) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN found f USING (doc_id)
"""
