"""Helpers shared by the operators: batches of bounded size, packed shuffles, stored steps.

Most operators move hashes of every position of a text. One row per hash would cost a
JVM row each, so a task packs its hashes by target bucket into a few binary values; a
reducer unpacks its bucket with numpy. A bucket is a range of a uniform hash, so its
size follows the input and the number of buckets, not the commonness of one text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import shared_folder

SLICE_BYTES = 500_000
FLUSH_BYTES = 12_000_000
#: Bytes of input for a bucket at most, unless the cluster sets more partitions.
BUCKET_BYTES = 128_000_000
MOST_CLASHES = 100_000
#: Bits of a filter of keys at most (8 MB), and those for each of its keys.
MOST_BITS, KEY_BITS = 1 << 26, 8


def partitions(df: DataFrame) -> int:
    """Number of buckets: the cluster's shuffle partitions, and more where the input has over BUCKET_BYTES for each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 58 else 0  # tables without statistics
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-known // BUCKET_BYTES))


def named(docs: DataFrame, clashes: DataFrame, first: str = "node") -> tuple[DataFrame, np.ndarray]:
    """docs (first, check: halves of 128-bit digests) with `first` replaced where two digests share it, and those values.

    clashes holds the values of `first` that several digests share: about n * n / 2**65 of n digests, so
    they are few at any size; they are counted before they are sent to the driver.
    """
    values = clashes.select(first).distinct()
    found = [r[0] for r in values.limit(MOST_CLASHES + 1).collect()]
    if len(found) > MOST_CLASHES:
        raise RuntimeError("more digests share their first half than 128-bit digests can")
    if found:
        other = F.when(F.col(first).isin(found), F.col("check")).otherwise(F.col(first))
        docs = docs.withColumn(first, other)
    return docs, np.array(found, np.int64)


def likely(docs: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """The rows of docs whose key `by` is in wanted, and about a tenth of the others, so that a join on it needn't shuffle all texts.

    The filter is a bitmap of the keys' hashes, KEY_BITS to twice as many a key up to MOST_BITS; beyond those it leaves more
    rows, but loses none. `wanted` is stored, as it is read twice. A null in a key is in no join.
    """
    bits = 1 << 15
    count = wanted.count()
    while bits < min(KEY_BITS * count, MOST_BITS):
        bits *= 2
    slot = F.pmod(F.xxhash64(*by), F.lit(bits))
    parts = wanted.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit((1 << 15) - 1))).alias("marks")).collect()
    marks = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for part, found in parts:
        marks[part] = np.frombuffer(found, np.uint8)
    marks = marks.reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(batch.num_columns - 1).to_numpy()
            keep = (marks[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            if keep.any():
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep))

    return docs.withColumn(free(docs.columns, "_slot"), slot).mapInArrow(run, docs.schema)


def free(taken: list[str], name: str) -> str:
    """A column name that `taken` doesn't hold in any case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a step as Parquet in the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a stored step that no later step reads."""
    path = getattr(df, "_stored_at", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are stored by now.

    Listeners hold the latest execution until another one comes, so a trivial one is run first.
    """
    import gc

    spark.range(1).collect()
    gc.collect()
    spark._jvm.System.gc()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows holding about `most` bytes of text; null text is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        values = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
            yield batch.slice(i, j - i), values[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


class Packer:
    """Collects parallel arrays of fixed width by bucket and hands them out as (bucket, data) batches."""

    schema = "bucket int, data binary"

    def __init__(self, buckets: int, dtype: np.dtype):
        self.buckets, self.dtype, self.parts, self.size = buckets, np.dtype(dtype), [], 0

    def add(self, records: np.ndarray) -> None:
        self.parts.append(records)
        self.size += records.nbytes

    def full(self) -> bool:
        return self.size >= FLUSH_BYTES

    def flush(self, key: str = "key", reduced: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """Hand out what has been added, made smaller by `reduced` where that is given."""
        if not self.size:
            return
        records = np.concatenate(self.parts)
        if reduced:
            records = reduced(records)
        self.parts, self.size = [], 0
        bucket = bucket_of(records[key], self.buckets)
        order = np.argsort(bucket, kind="stable")
        records, bucket = records[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(bucket)]])
        for s in range(0, len(starts), 64):
            a, b = starts[s : s + 64], ends[s : s + 64]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[a].astype(np.int32)), pa.array([records[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], names=["bucket", "data"])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a uniform 64-bit hash, from its upper half."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def by_bucket(packed: DataFrame, buckets: int, reducer, schema: str) -> DataFrame:
    """Give each bucket's records, in one array, to reducer(bucket, raw bytes) -> record batches."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(data)
        for bucket in sorted(held):
            yield from reducer(bucket, b"".join(held.pop(bucket)))

    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(reduce, schema)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
