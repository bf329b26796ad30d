"""Many small fixed-width entries sent as few rows: one row per batch and bucket, columns as bytes.

A bucket is a range of hashes, so a bucket's entries meet in one group. The number of buckets follows
``spark.sql.shuffle.partitions``, which is sized with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from clinspan.llm.octets import BASE, mix

LEAST_BUCKETS = 96
BUCKETS_PER_PARTITION = 4


def bucket_count(spark: SparkSession) -> int:
    return max(LEAST_BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucket_and_key(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket from the upper half of the hash, mixed anew, and the lower half as the key inside it.

    The hashes may be minima, so their own upper bits are not spread.
    """
    spread = mix(hashes + BASE)
    return ((spread >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32), spread.astype(np.uint32)


def ddl(names: Sequence[str]) -> str:
    return "bucket int, " + ", ".join(f"{n} binary" for n in names)


def pack(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket present: its entries of each column, as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[at, len(bucket)]
    arrays = [pa.array(bucket[at], pa.int32())]
    for values in columns.values():
        values = np.ascontiguousarray(values[order])
        offsets = (ends * values.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(values)]))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def unpack(column, kind) -> np.ndarray:
    """All entries of a packed column of a table, in row order."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def pack_bytes(bucket: np.ndarray, rows: Sequence[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Distinct buckets and the concatenated ``rows`` of each, in the order :func:`pack` keeps."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[at, len(bucket)]
    order = order.tolist()
    return bucket[at], [b"".join([rows[i] for i in order[a:z]]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
