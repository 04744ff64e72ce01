"""Approximate nearest neighbours of every vector by a hash-prefix forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.exchange import partitions, written

NEIGHBOURS = 10
TREES = 10
BITS = 64
#: Places on either side, in each tree's sorted array, that the descent compares.
REACH = 4
#: Chance that is left, for a neighbour as far as the k-th found, of sharing no prefix of the level in any tree.
MISS = 0.05
#: Levels to which the ascent comes; a query goes on to the next of these that is no deeper than it needs.
LEVELS = (48, 40, 32, 26, 20, 16, 12, 10, 8, 6)
#: Queries and members of a bucket that are compared in one task; larger buckets are cut into blocks.
BLOCK = 4096
MEMBERS = 1 << 15
ROWS = 512
SEED = 20_011

FOUND = "vec_id long, ids array<long>, sims array<double>"


def planes(dims: int, trees: int) -> np.ndarray:
    """Normals of the hyperplanes whose sides are the bits of the hash strings; the same for any table."""
    return np.random.default_rng(SEED).standard_normal((dims, trees * BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, normals: np.ndarray, trees: int) -> np.ndarray:
    """A string of BITS bits for each vector and tree, the first bit highest, as unsigned numbers."""
    bits = (vectors @ normals > 0).reshape(len(vectors), trees, BITS)
    return np.packbits(bits, axis=2).view(">u8").reshape(len(vectors), trees).astype(np.uint64)


def needed_level(similarity: np.ndarray, trees: int, miss: float) -> np.ndarray:
    """The deepest level at which a vector as similar as this shares a prefix in some tree but with chance `miss`.

    Two vectors at angle a are on one side of a random hyperplane with chance p = 1 - a/pi; they share a prefix of x bits in
    none of t trees with chance (1 - p^x)^t.
    """
    p = 1 - np.arccos(np.clip(similarity, -1, 1)) / np.pi
    one = 1 - miss ** (1 / trees)
    with np.errstate(divide="ignore"):
        return np.where(p >= 1, BITS, np.where(p <= 0, 0, np.log(one) / np.log(np.clip(p, 1e-12, 1 - 1e-12)))).clip(0, BITS)


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of an array of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return values.reshape(len(column), -1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(vec_id, v): unit vectors of the most frequent length (of equally frequent ones the longest), one for each vec_id."""
    raw = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    good = raw.withColumn("norm", norm).where("norm > 0 AND norm < double('Infinity') AND NOT isnan(norm)")
    rows = good.select("vec_id", F.transform("v", lambda x: (x / F.col("norm")).cast("float")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def best_of(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids: by similarity, then by id."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], sims[first]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def found_batch(query: np.ndarray, ids: list[np.ndarray], sims: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), _lists(ids, pa.int64()), _lists(sims, pa.float64())], ["vec_id", "ids", "sims"])


def descend(strings: DataFrame, points: DataFrame, k: int, parts: int) -> DataFrame:
    """For each query, the best of the places around its own in each tree's sorted array.

    Neighbours in the order of the hash strings are those with the longest common prefixes. Only ids and strings are sorted;
    vectors are joined to the places that queries look at. The array is divided by range; places beyond a partition's edge
    aren't seen, which only makes the bound that follows from these less tight.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each batch with the last places of the one before it, and its queries near the end with those of the next
        tree = ids = asks = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "vec_id", "asks")]
            old = 0 if tree is None else len(tree)
            tree, ids, asks = new if tree is None else (np.concatenate(x) for x in zip((tree, ids, asks), new))
            found = []
            for step in range(1, REACH + 1):
                at = np.arange(max(0, old - step), len(ids) - step)  # pairs of places of which one at least is new
                at = at[tree[at] == tree[at + step]]
                found += [np.stack([ids[at], ids[at + step]])[:, asks[at]], np.stack([ids[at + step], ids[at]])[:, asks[at + step]]]
            both = np.concatenate(found, axis=1)
            if both.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["query", "vec_id"])
            tree, ids, asks = tree[-REACH:], ids[-REACH:], asks[-REACH:]

    sorted_ = strings.repartitionByRange(parts, "tree", "string", "vec_id").sortWithinPartitions("tree", "string", "vec_id")
    pairs = sorted_.mapInArrow(look, "query long, vec_id long").where("query <> vec_id").distinct()
    met = pairs.join(points.select("vec_id", "v"), "vec_id").join(points.where("asks").select(F.col("vec_id").alias("query"), F.col("v").alias("q")), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                sims = (matrix(part.column(2)).astype(np.float64) * matrix(part.column(3))).sum(1)
                yield found_batch(part.column(0).to_numpy(), [x[None] for x in part.column(1).to_numpy()], [x[None] for x in sims])

    return met.select("query", "vec_id", "v", "q").mapInArrow(score, FOUND)


def merge_found(found: DataFrame, k: int, parts: int) -> DataFrame:
    """The k best of all that was found for each vector."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, ids, sims = None, [], []
        out: tuple[list, list, list] = ([], [], [])

        def keep() -> None:
            if query is not None:
                own, value = best_of(np.concatenate(ids), np.concatenate(sims), k)
                out[0].append(query)
                out[1].append(own)
                out[2].append(value)

        for batch in batches:
            names = batch.column(0).to_pylist()
            offsets = batch.column(1).offsets.to_numpy()
            flat, values = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(2).values.to_numpy(zero_copy_only=False)
            other = batch.column(2).offsets.to_numpy()
            for i, name in enumerate(names):
                if name != query:
                    keep()
                    query, ids, sims = name, [], []
                ids.append(flat[offsets[i] : offsets[i + 1]])
                sims.append(values[other[i] : other[i + 1]])
            if len(out[0]) >= 1 << 13:
                yield found_batch(np.array(out[0]), out[1], out[2])
                out = ([], [], [])
        keep()
        if out[0]:
            yield found_batch(np.array(out[0]), out[1], out[2])

    return found.repartition(parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(merge, FOUND)


def ascend(members: DataFrame, sizes: DataFrame, points: DataFrame, k: int, parts: int) -> DataFrame:
    """For the queries in each bucket, its best members. members: level, tree, bucket, vec_id, asks.

    A bucket's queries are cut into blocks of BLOCK and its members into blocks of MEMBERS, by hash of vec_id; each block of
    queries meets each of members in a task, so no bucket is too large and none is sampled. members has ids alone, and
    vectors are joined to those of buckets with a query.
    """
    keys = ["level", "tree", "bucket"]
    split = members.join(sizes, keys).join(points.select("vec_id", "v"), "vec_id")
    block = lambda n, most: F.ceil(F.col(n) / F.lit(float(most))).cast("int")
    split = split.withColumns({"qs": block("asking", BLOCK), "ms": block("n", MEMBERS)})
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = split.where("asks").select(*keys, "vec_id", "v", own("qs").alias("qi"), every("ms").alias("mj"), F.lit(True).alias("asks"))
    given = split.select(*keys, "vec_id", "v", every("qs").alias("qi"), own("ms").alias("mj"), F.lit(False).alias("asks"))
    key = [*keys, "qi", "mj"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ask, give = None, [], []

        def solve() -> Iterator[pa.RecordBatch]:
            if not ask or not give:
                return
            qid, qv = np.concatenate([x for x, _ in ask]), np.concatenate([x for _, x in ask])
            mid, mv = np.concatenate([x for x, _ in give]), np.concatenate([x for _, x in give])
            for a in range(0, len(qid), ROWS):
                sims = qv[a : a + ROWS] @ mv.T
                sims[qid[a : a + ROWS, None] == mid[None, :]] = -9
                # ties at the k-th place all stay; the last merge settles them by id
                if len(mid) > k:
                    least = np.partition(sims, len(mid) - k, axis=1)[:, len(mid) - k] - 1e-6
                else:
                    least = np.full(len(sims), -5, np.float32)
                ids, values = [], []
                for row, (s, x) in enumerate(zip(sims, least)):
                    at = np.flatnonzero(s >= max(x, -5))
                    exact = (mv[at].astype(np.float64) * qv[a + row].astype(np.float64)).sum(1)
                    own, value = best_of(mid[at], exact, k)
                    ids.append(own)
                    values.append(value)
                yield found_batch(qid[a : a + ROWS], ids, values)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)])
            cut = np.append(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(0)) + 1, batch.num_rows)
            asks, ids, v = batch.column(7).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(), matrix(batch.column(6))
            at = 0
            for end in cut.tolist():
                name = tuple(part[:, at].tolist())
                if name != current:
                    yield from solve()
                    current, ask, give = name, [], []
                who = asks[at:end]
                if who.any():
                    ask.append((ids[at:end][who], v[at:end][who]))
                if not who.all():
                    give.append((ids[at:end][~who], v[at:end][~who]))
                at = end
        yield from solve()

    rows = asked.unionByName(given).select(*key, "vec_id", "v", "asks")
    return rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(compare, FOUND)


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, trees: int = TREES, miss: float = MISS, id_column: str = "vec_id", vector_column: str = "embedding", asked: str = "true") -> DataFrame:
    """The k nearest of all vectors, by cosine, of every query: the vectors for which `asked` (SQL over vec_id) holds.

    Each of `trees` trees is a sorted array of hash strings of BITS signs of all vectors. A query descends to the places
    with its longest common prefixes in all arrays, and the k-th similarity found there bounds how far its neighbours can be.
    Then it ascends in all trees at once, to the level at which a neighbour as far as that shares its prefix in some tree but
    with chance `miss`, and meets everything under that prefix. So clustered vectors stay deep and meet few, and the search
    ends early by a bound on recall and not by a number of candidates. Where the trees' buckets would together hold as much
    as the table, the query meets the whole table instead, once; vectors without structure all come to that, so their search is exact
    and takes queries times vectors.

    Returns (vec_id, rank, neighbour_id, similarity): rank 1 is the nearest; equal similarities are in order of id. A vector
    has fewer rows only where the table has fewer others.

    Rows without vec_id, null and empty vectors, those with nulls, NaN or infinite values and those of length 0 are neither
    queries nor neighbours; nor are vectors of another number of dimensions than the most frequent. Repeated rows of a
    vec_id are one vector, the least. An empty table, and one without queries, gives an empty result; other columns are ignored.
    """
    if k < 1 or trees < 1 or not 0 < miss < 1:
        raise ValueError("k and trees must be at least 1 and miss in (0, 1)")
    spark = vectors.sparkSession
    parts = partitions(spark)
    schema = "vec_id long, rank int, neighbour_id long, similarity double"
    points = written(usable(vectors, id_column, vector_column), "vectors")
    top = points.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if top is None:
        return spark.createDataFrame([], schema)
    dims = int(top["dims"])
    points = points.where(F.size("v") == dims).withColumn("asks", F.coalesce(F.expr(asked), F.lit(False)))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = planes(dims, trees)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                strings = hash_strings(matrix(part.column(1)), normals, trees).view(np.int64) ^ np.int64(-(1 << 63))  # signed order is unsigned order
                where = pa.array(np.repeat(np.arange(part.num_rows), trees))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(trees, dtype=np.int32), part.num_rows)), pa.array(strings.ravel()), part.column(0).take(where), part.column(2).take(where)], ["tree", "string", "vec_id", "asks"])

    forest = written(points.select("vec_id", "v", "asks").mapInArrow(plant, "tree int, string long, vec_id long, asks boolean"), "forest")
    first = written(merge_found(descend(forest, points, k, parts), k, parts), "descent")

    floor = int(np.ceil(np.log2(trees))) + 1
    steps = [x for x in LEVELS if x > floor]

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims, ends = batch.column(2).values.to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy()
            full = np.diff(ends) >= k
            last = np.where(full, sims[np.maximum(ends[1:] - 1, 0)] if len(sims) else -1.0, -1.0)
            need = needed_level(last, trees, miss)
            level = np.zeros(len(need), np.int32)
            for x in sorted(steps):
                level[need >= x] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level)], ["vec_id", "level"])

    # a query that met nothing on its way down goes to the top
    queries = points.where("asks").select("vec_id").join(first.mapInArrow(levels, "vec_id long, level int"), "vec_id", "left").select("vec_id", F.coalesce("level", F.lit(0)).alias("level"))
    queries = written(queries, "levels")
    used = sorted(r["level"] for r in queries.groupBy("level").count().collect())
    everything = []
    if any(used):
        # >> keeps the sign, so a prefix of x bits is one number for each bucket of level x
        bucket = F.expr("shiftright(string, 64 - level)").alias("bucket")
        strings = forest.withColumn("level", F.explode(F.array(*[F.lit(x) for x in used if x])))
        wanted = forest.where("asks").join(queries.where("level > 0"), "vec_id").select("level", "tree", bucket).distinct()
        known = strings.select("level", "tree", bucket, "vec_id").join(wanted, ["level", "tree", "bucket"], "left_semi")
        everything.append(known.join(queries.select("vec_id", F.col("level").alias("own_level")), "vec_id", "left").select("level", "tree", "bucket", "vec_id", F.coalesce(F.col("level") == F.col("own_level"), F.lit(False)).alias("asks")))
    if 0 in used:
        everything.append(points.select("vec_id").join(queries, "vec_id", "left").select(F.lit(0).alias("level"), F.lit(0).alias("tree"), F.lit(0).cast("long").alias("bucket"), "vec_id", F.coalesce(F.col("level") == 0, F.lit(False)).alias("asks")))
    if not everything:
        return spark.createDataFrame([], schema)
    members = everything[0] if len(everything) == 1 else everything[0].unionByName(everything[1])
    members = written(members, "members")
    sizes = members.groupBy("level", "tree", "bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asking")).where("asking > 0 AND n > 1")
    second = ascend(members, sizes, points, k, parts)
    merged = merge_found(first.unionByName(second), k, parts)
    return merged.select("vec_id", F.posexplode(F.arrays_zip("ids", "sims")).alias("at", "hit")).select("vec_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.ids").alias("neighbour_id"), F.col("hit.sims").alias("similarity"))
