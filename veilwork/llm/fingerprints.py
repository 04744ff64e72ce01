"""Fingerprints of documents by prefix polynomial hashes, and longest common extensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.exchange import written
from veilwork.llm.tokens import U64, chunks

#: Hashes are modulo this Mersenne prime, with powers of BASE.
PRIME = (1 << 61) - 1
BASE = 1_234_567_890_123_456_789
#: Characters of an opening that documents must share to be compared.
OPENING = 64
#: Characters between the places of which a document's prefix hash is kept.
STEP = 256
#: Characters that are hashed at once, a multiple of STEP; bytes of text and rows of pieces that a task handles at once.
BLOCK = 1 << 16
CHUNK = 1 << 18
COMMON_ROWS = 256
#: Most documents whose wanted blocks are broadcast; beyond it they are joined by a shuffle.
BROADCAST_DOCUMENTS = 1 << 20

_P = U64(PRIME)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> U64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers less than it."""
    a1, a0, b1, b0 = a >> U64(31), a & U64((1 << 31) - 1), b >> U64(31), b & U64((1 << 31) - 1)
    mid = a1 * b0 + a0 * b1
    return reduced(U64(2) * a1 * b1 + (mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + a0 * b0)


@lru_cache(maxsize=4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < size:
        out = np.append(out, times(out, np.full(len(out), pow(base, len(out), PRIME), U64)))
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    size = 1 << max(12, (n - 1).bit_length())
    return _powers(BASE, size)[:n], _powers(pow(BASE, -1, PRIME), size)[:n]


class Prefixes:
    """Prefix hashes of several texts, one after the other: sums[i] = sum of (c[j] + 1) * BASE**j over j < i.

    Any span of any text has the hash (sums[b] - sums[a]) / BASE**a, whatever its place; so spans are compared in constant
    time, and the longest common extension of two places is found by binary search.
    """

    def __init__(self, codes: np.ndarray, first: np.ndarray) -> None:
        self.codes, self.first = codes, first
        up, self.down = powers(len(codes) + 1)
        c, b = codes.astype(U64) + U64(1), up[: len(codes)]
        mid = c * (b >> U64(31))
        terms = reduced((mid >> U64(30)) + ((mid & U64((1 << 30) - 1)) << U64(31)) + c * (b & U64((1 << 31) - 1)))
        high, low = (np.append(U64(0), np.cumsum(x)) for x in (terms >> U64(31), terms & U64((1 << 31) - 1)))
        high = reduced(high)
        self.sums = reduced(times(high, np.full(len(high), 1 << 31, U64)) + reduced(low))

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of each span [a, b) of the texts taken together."""
        return times(reduced(self.sums[b] + _P - self.sums[a]), self.down[a])

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the texts from a and from b on are equal, up to `most`, by binary search over span hashes."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.span(a, a + mid) == self.span(b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def prefixes(texts: list[str]) -> Prefixes:
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return Prefixes(codes, np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64))


def fingerprint_rows(texts: list[str]) -> list[tuple[int, int, int, np.ndarray]]:
    """(length, fingerprint, hash of the opening, prefix hash at each STEP characters) of each text.

    A text of more than BLOCK characters goes block by block: what is before a block is one number, and the block's own prefix
    hashes are moved by a power of BASE. So memory is that of a block, however long the text.
    """
    short = [i for i, t in enumerate(texts) if len(t) <= BLOCK]
    out: list = [None] * len(texts)
    at = 0
    while at < len(short):
        end, size = at, 0
        while end < len(short) and (end == at or size + len(texts[short[end]]) <= BLOCK):
            size += len(texts[short[end]])
            end += 1
        own = short[at:end]
        found = prefixes([texts[i] for i in own])
        a, b = found.first[:-1], found.first[1:]
        steps = (b - a) // STEP + 1
        ends = np.cumsum(steps)
        place = np.repeat(a, steps) + STEP * (np.arange(ends[-1]) - np.repeat(ends - steps, steps))
        kept = found.span(np.repeat(a, steps), place)
        for i, n, whole, head, x, y in zip(own, (b - a).tolist(), found.span(a, b).tolist(), found.span(a, a + np.minimum(b - a, OPENING)).tolist(), (ends - steps).tolist(), ends.tolist()):
            out[i] = (n, whole, head, kept[x:y])
        at = end
    for i, text in enumerate(texts):
        if out[i] is not None:
            continue
        before, head, kept = 0, 0, []
        for start in range(0, len(text), BLOCK):
            sums = prefixes([text[start : start + BLOCK]]).sums
            head = head if start else int(sums[OPENING])
            moved = times(sums[:-1:STEP], np.full(-(-(len(sums) - 1) // STEP), pow(BASE, start, PRIME), U64))
            kept.append(reduced(moved + U64(before)))
            before = (before + int(sums[-1]) * pow(BASE, start, PRIME)) % PRIME
        if len(text) % STEP == 0:
            kept.append(np.array([before], U64))
        out[i] = (len(text), before, head, np.concatenate(kept))
    return out


def _scan(docs: DataFrame) -> DataFrame:
    """Length, fingerprint, hash of the opening and kept prefix hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK):
            rows = fingerprint_rows(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), *[pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], pa.array([r[3].tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "fingerprint", "opening", "kept"])

    return docs.mapInArrow(run, "doc_id long, n_chars long, fingerprint long, opening long, kept binary")


PAIRS = "doc_id long, n_chars long, fingerprint long, first_id long, first_chars long, first_print long, block int"


def _blocks(pairs: DataFrame) -> DataFrame:
    """The block in which each pair's texts cease to be equal, by binary search over their kept prefix hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = []
            for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist()):
                one, two = np.frombuffer(x, U64), np.frombuffer(y, U64)
                low, high = 0, min(len(one), len(two)) - 1
                while low < high:
                    mid = (low + high + 1) // 2
                    low, high = (mid, high) if one[mid] == two[mid] else (low, mid - 1)
                block.append(low)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(block, pa.int32())], [*batch.schema.names[:6], "block"])

    return pairs.mapInArrow(run, PAIRS)


def _pieces(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The characters of the wanted blocks (doc_id, blocks) of each text."""
    joined = docs.join(F.broadcast(wanted) if wanted.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS else wanted, "doc_id").select("doc_id", "text", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=CHUNK):
            texts = batch.column("text").to_pylist()
            prints = [r[1] for r in fingerprint_rows(texts)]
            rows = [(doc, len(t), p, block, t[block * STEP : (block + 1) * STEP]) for doc, t, p, blocks in zip(batch.column("doc_id").to_pylist(), texts, prints, batch.column("blocks").to_pylist()) for block in blocks]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], ["doc_id", "n_chars", "fingerprint", "block", "piece"])

    return joined.mapInArrow(run, "doc_id long, n_chars long, fingerprint long, block int, piece string").dropDuplicates(["doc_id", "n_chars", "fingerprint", "block"])


def _common(pieces: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, common): the block's start and the common extension inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, COMMON_ROWS) for b in batches for k in range(0, b.num_rows, COMMON_ROWS)):
            one, two = batch.column("piece").to_pylist(), batch.column("first_piece").to_pylist()
            found = prefixes(one + two)
            n = len(one)
            size = np.diff(found.first)
            more = found.extension(found.first[:n], found.first[n:-1], np.minimum(size[:n], size[n:]))
            common = batch.column("block").to_numpy().astype(np.int64) * STEP + more
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(common)], ["doc_id", "n_chars", "fingerprint", "common"])

    return pieces.mapInArrow(run, "doc_id long, n_chars long, fingerprint long, common long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, fingerprint, same_as, opening_of, common_chars) of every row.

    fingerprint is the text's polynomial hash over code points, sum of (c[j] + 1) * BASE**j modulo PRIME. same_as is the
    least doc_id with an equal text. opening_of is the least doc_id whose first OPENING characters are the same (all of
    them, if the text is shorter), and common_chars how long the texts are equal from their beginning: the longest common
    extension, found by binary search, first over prefix hashes kept for each STEP characters, then over all of them in the
    one block where the texts part. Only hashes and such blocks are shuffled.

    Of rows with one doc_id and different texts that would be opening_of, the shortest, then the one of the least
    fingerprint, is compared. A row that is its own opening has its length as common_chars. A null text, or a row without
    doc_id, has nulls but for doc_id; an empty text has fingerprint 0 and is like other empty texts. Repeated rows are each
    returned. An empty table gives an empty result. Columns other than doc_id and text are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    some = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    scanned = written(_scan(some), "prefixes")
    plain = scanned.select("doc_id", "n_chars", "fingerprint", "opening")
    same = plain.groupBy("n_chars", "fingerprint").agg(F.min("doc_id").alias("same_as"))
    short = F.least("n_chars", F.lit(OPENING)).alias("head")
    first = plain.select("opening", short, F.struct("doc_id", "n_chars", "fingerprint").alias("who")).groupBy("opening", "head").agg(F.min("who").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    unequal = (F.col("n_chars") != F.col("first.n_chars")) | (F.col("fingerprint") != F.col("first.fingerprint"))
    pairs = scanned.withColumn("head", short).join(first, ["opening", "head"]).where(unequal).dropDuplicates(["doc_id", "n_chars", "fingerprint"])
    leads = pairs.select("first").distinct().select(F.col("first.doc_id").alias("doc_id"), F.col("first.n_chars").alias("n_chars"), F.col("first.fingerprint").alias("fingerprint"))
    lead_kept = scanned.join(leads, ["doc_id", "n_chars", "fingerprint"], "left_semi").dropDuplicates(["doc_id", "n_chars", "fingerprint"]).select(F.col("doc_id").alias("first_id"), F.col("n_chars").alias("first_chars"), F.col("fingerprint").alias("first_print"), F.col("kept").alias("first_kept"))
    named = pairs.select("doc_id", "n_chars", "fingerprint", F.col("first.doc_id").alias("first_id"), F.col("first.n_chars").alias("first_chars"), F.col("first.fingerprint").alias("first_print"), "kept")
    found = written(_blocks(named.join(lead_kept, ["first_id", "first_chars", "first_print"]).select("doc_id", "n_chars", "fingerprint", "first_id", "first_chars", "first_print", "kept", "first_kept")), "blocks")
    both = found.select("doc_id", "block").unionByName(found.select(F.col("first_id").alias("doc_id"), "block"))
    wanted = written(both.groupBy("doc_id").agg(F.array_sort(F.collect_set("block")).alias("blocks")), "wanted")
    pieces = written(_pieces(some, wanted), "pieces")
    own = pieces.join(found, ["doc_id", "n_chars", "fingerprint", "block"])
    lead = pieces.select(F.col("doc_id").alias("first_id"), F.col("n_chars").alias("first_chars"), F.col("fingerprint").alias("first_print"), "block", F.col("piece").alias("first_piece"))
    met = own.join(lead, ["first_id", "first_chars", "first_print", "block"]).select("doc_id", "n_chars", "fingerprint", "block", "piece", "first_piece")
    parted = _common(met)
    opening = F.coalesce(F.col("first.doc_id"), F.col("doc_id"))
    known = plain.withColumn("head", short).join(same, ["n_chars", "fingerprint"]).join(first, ["opening", "head"], "left").join(parted, ["doc_id", "n_chars", "fingerprint"], "left")
    full = known.select("doc_id", "n_chars", "fingerprint", "same_as", opening.alias("opening_of"), F.coalesce("common", "n_chars").alias("common_chars"))
    empty = rows.where("doc_id IS NULL OR text IS NULL").select("doc_id", *[F.lit(None).cast("long").alias(c) for c in ("n_chars", "fingerprint", "same_as", "opening_of", "common_chars")])
    return full.unionByName(empty)


ORACLE = f"""
WITH chars AS (
  SELECT doc_id, text, length(text) AS n_chars, CASE WHEN text = '' THEN []::VARCHAR[] ELSE string_split(text, '') END AS c
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), hashed AS (
  SELECT doc_id, text, n_chars, c,
    list_reduce(list_prepend(0::HUGEINT, list_reverse(list_transform(c, lambda x: (ord(x) + 1)::HUGEINT))), lambda h, x: (h * {BASE}::HUGEINT + x) % {PRIME}::HUGEINT)::BIGINT AS fingerprint
  FROM chars
), named AS (
  SELECT *, min(doc_id) OVER (PARTITION BY text) AS same_as, first_value(doc_id) OVER w AS opening_of, first_value(c) OVER w AS other
  FROM hashed WINDOW w AS (PARTITION BY left(text, {OPENING}) ORDER BY doc_id, n_chars, fingerprint ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
)
SELECT doc_id, n_chars, fingerprint, same_as, opening_of,
  coalesce(list_position(list_transform(list_zip(c, other, true), lambda p: p[1] = p[2]), false) - 1, least(n_chars, len(other)))::BIGINT AS common_chars
FROM named
UNION ALL
SELECT doc_id, NULL, NULL, NULL, NULL, NULL FROM documents WHERE doc_id IS NULL OR text IS NULL
"""
