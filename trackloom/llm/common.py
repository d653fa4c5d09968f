"""Shared pieces of the text operators: scratch tables, tokens, packing, graphs."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
SLICE_BYTES = 2 << 20
#: The same where a step's result is packed and sent: larger ones pack better.
PACK_BYTES = 6 << 20
#: Bytes that Spark puts into one Arrow batch for Python workers.
ARROW_BYTES = 16 << 20
#: A word is a run of anything but these; the same set in every operator.
WORD = r"[^\x20\x09-\x0D]+"

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
MASK64 = (1 << 64) - 1


# ---------------------------------------------------------------- scratch tables


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that long texts cannot fill a worker.

    Plans read the setting when they run, so it stays with the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch_base(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset and driver and executors are one process, a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


class Scratch:
    """Tables of one operator run in the shared folder; a lost executor loses none.

    Tables that the returned DataFrame reads live until the session ends;
    ``drop`` removes the others as soon as nothing needs them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_base(spark)}/trackloom-{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, table: str, by: list[str] | None = None) -> DataFrame:
        """Write a table with its partition columns and read it back."""
        path = f"{self.root}/{table}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str = "") -> None:
        """Delete one table, or with no name all of them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}" if table else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session is gone; its owner cleans the shared folder
            return


def held_out(column: str = "doc_id", parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.coalesce(F.crc32(F.col(column).cast("string")), F.lit(0)) % parts


def shards_for(spark: SparkSession, items: int, per_shard: int) -> int:
    """Partitions for ``items`` units of work: never under the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items // per_shard))


def with_global_index(scratch: Scratch, df: DataFrame, order: list[Column], name: str, out: str = "id") -> DataFrame:
    """Number rows 0.. in a total order without putting them in one partition.

    Rows are range-partitioned and sorted, and each partition starts where the
    one before ends; only one row per partition is broadcast.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    stored = scratch.write(
        ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), name
    )
    row = F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = stored.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a partition, so that one task can add them up
    over = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    return stored.join(F.broadcast(before), "_part").withColumn(out, (F.col("_before") + row).cast("long")).drop("_at", "_part", "_before")


# ---------------------------------------------------------------- Arrow text


@lru_cache(maxsize=1)
def _trim():
    """The C library's call that hands freed memory back, where it has one.

    From then on large arrays are mapped by themselves, so that freeing one gives
    its memory back at once (M_MMAP_THRESHOLD is option -3).
    """
    libc = ctypes.CDLL(None)
    getattr(libc, "mallopt", lambda *_: 0)(-3, 4 << 20)
    return getattr(libc, "malloc_trim", lambda _: 0)


def release() -> None:
    """Give memory that a step has freed back to the system: idle workers keep the rest."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole texts of about ``limit`` bytes.

    Yields first row, end row, UTF-8 bytes and offsets; a null text is empty.
    """
    _trim()
    array = pc.fill_null(batch.column(column), "")
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    n = len(array)
    if not n:
        return
    _, offs, data = array.buffers()
    offsets = np.frombuffer(offs, np.int64)[array.offset : array.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
    release()


class Words:
    """Words of several texts, held as arrays: byte range and text of each word.

    ``kinds`` says of each byte whether words have it.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, kinds: np.ndarray = _IS_WORD):
        self.data = _LOWER[data] if lower else data
        self.offsets = offsets
        self.n_docs = len(offsets) - 1
        word = kinds[self.data]
        if len(word):
            cut = np.zeros(len(word) + 1, bool)
            cut[offsets] = True
            begins = word.copy()
            begins[1:] &= ~word[:-1] | cut[1:-1]
            ends = word.copy()
            ends[:-1] &= ~word[1:] | cut[1:-1]
            self.start = np.flatnonzero(begins)
            self.end = np.flatnonzero(ends) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.word = word
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.per_doc = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def encode(self) -> tuple[np.ndarray, list[bytes]]:
        """Code of each word in a dictionary of this slice, and the dictionary."""
        if not len(self):
            return np.zeros(0, np.int32), []
        offs = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.end - self.start, out=offs[1:])
        packed = np.ascontiguousarray(self.data[self.word])
        array = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offs), pa.py_buffer(packed)])
        coded = array.dictionary_encode()
        return coded.indices.to_numpy(), coded.dictionary.to_pylist()


def sum_texts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum over each text of a value (a truth or a small number) for each byte."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values.view(np.uint8), offsets[full], dtype=np.int64)
    return out


def hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word, as unsigned integers."""
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(w) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
    return out


# ---------------------------------------------------------------- packing


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Integers as byte planes under zstd; of little size where values are small."""
    planes = []
    head = [len(arrays)]
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [len(a), a.dtype.itemsize]
        planes.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    """The arrays of ``pack``, as the given integer types, or as unsigned ones of their width."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8)
    at, out = 8 * (1 + 2 * count), []
    for k in range(count):
        n, width = int(head[2 * k]), int(head[2 * k + 1])
        plane = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(plane.T).view(kinds[k] if kinds else f"u{width}").reshape(n))
        at += n * width
    return out


def pack_small(*arrays: np.ndarray) -> bytes:
    """Integers from 0 on, each array in as few bytes as its largest needs, packed."""
    kinds = (np.uint8, np.uint16, np.uint32, np.uint64)
    return pack(*(np.asarray(a).astype(kinds[sum(int(np.max(a, initial=0)) >= 1 << b for b in (8, 16, 32))]) for a in arrays), level=3)


def unpack_small(blob: bytes) -> list[np.ndarray]:
    """The arrays of ``pack_small``, unsigned."""
    return unpack(blob)


def deltas(sorted_keys: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, the first kept as it is."""
    return np.diff(sorted_keys, prepend=sorted_keys[:1] * 0)


# ---------------------------------------------------------------- graphs


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Smallest reachable vertex of each vertex of an undirected graph.

    ``edges`` has columns a and b. Alternates large-star and small-star rounds
    until a round changes nothing; each round's table is written to the shared
    folder, and only a count comes to the driver. Returns vertex, component for
    every vertex that has an edge.
    """
    current = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"
    )
    step, seen = 0, None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each vertex's larger neighbours move to its smallest one
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each vertex and its smaller neighbours move to the smallest
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(small_min, "a")
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        step += 1
        following = scratch.write(small, f"{name}-{step}")
        now = following.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
        scratch.drop(f"{name}-{step - 1}")
        current = following
        if now == seen:
            break
        seen = now
    top = current.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "vertex")
    return top.unionByName(current.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()).groupBy("vertex").agg(F.min("component").alias("component"))
