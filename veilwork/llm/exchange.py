"""A shuffle of packed columns, and where jobs keep what they write.

Operators that move a few bytes for each word pack them into one binary value for each pair of input batch and target
partition. Spark then shuffles few large rows instead of hundreds of millions of small ones; both sides work on numpy
arrays. Lost executors are handled as in any Spark shuffle: the map side is deterministic and is run again.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"


@cache
def _own_folder() -> str:
    """A folder of this process, which goes when it ends."""
    folder = tempfile.mkdtemp(prefix="veilwork-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session whose executors are all in this
    process (local mode, as in tests) gets a folder of its own, and any other is refused."""
    folder = spark.conf.get(CHECKPOINT, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT} must name a folder that all executors share")
        folder = _own_folder()
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veilwork-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the files of a table made by written() once nothing reads it again."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/veilwork-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: their number, then dtype and length of each, then their bytes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (np.dtype(a.dtype).num, len(a)))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


_KINDS = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.int8, np.uint16, np.int16, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64, bool)}


def unpack(value: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(value, np.int64, 1)[0])
    head = np.frombuffer(value, np.int64, 2 * count, 8).reshape(count, 2)
    at, out = 8 * (1 + 2 * count), []
    for kind, n in head.tolist():
        dtype = _KINDS[kind]
        out.append(np.frombuffer(value, dtype, n, at))
        at += n * dtype.itemsize
    return out


PACKED = pa.schema([("part", pa.int32()), ("payload", pa.binary())])


def packed_rows(values: Iterable[tuple[int, bytes]]) -> pa.RecordBatch:
    parts, payloads = [], []
    for part, payload in values:
        parts.append(part)
        payloads.append(payload)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], schema=PACKED)


def spread(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings rows of one partition together, and the edges between partitions; the key's hash decides."""
    part = (key % np.uint64(parts)).astype(np.uint32 if parts > 65535 else np.uint16)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def exchange(df: DataFrame, send: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], receive: Callable[[Iterator[bytes]], Iterator[pa.RecordBatch]], schema: str, parts: int) -> DataFrame:
    """send() turns batches of df into PACKED rows; receive() gets all payloads of one partition."""

    def pull(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from receive(v.as_py() for b in batches for v in b.column(1))

    return df.mapInArrow(send, "part int, payload binary").repartitionById(parts, F.col("part")).mapInArrow(pull, schema)
