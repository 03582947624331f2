"""Shared pieces of the training-data operators: durable cuts of the lineage and
vectorised text kernels that work on the Arrow buffers of a whole batch at once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Text bytes that a kernel looks at in one go; its temporaries are some forty times that.
SLICE = 1 << 20
#: Odd, so that it has an inverse modulo 2**64; the base of the rolling word hash.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Entries after which a worker's word cache starts anew.
CACHE = 400_000


# ---------------------------------------------------------------- durable cuts
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Taken from the session's ``spark.checkpoint.dir``;
    only a local master without that setting gets a temporary folder."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if not have:
        have = sc.getConf().get("spark.checkpoint.dir")
        if not have:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            have = tempfile.mkdtemp(prefix="recollect-")
        sc.setCheckpointDir(have)
        have = sc.getCheckpointDir()
    return have


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends
    there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- text kernels
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        both = []
        for x in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, x, U64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works in place on a fresh array."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without copies, and the n + 1 offsets into them;
    a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offs - offs[0]


def _spans(data: np.ndarray, offs: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes for which ``stop`` is false; no run
    crosses an offset."""
    inside = ~stop[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _hash_slice(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def slices(offs: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes each; a longer row is one by itself."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, SLICE bytes at a time, so that memory is bounded for
    long texts. A span longer than a slice is hashed by itself."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + SLICE, "right")))
        out[i:j] = _hash_slice(data[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes (A-Z), and starts and ends of the words in them."""
    return _LOWER[data], *_spans(data, offs, _SPACE)


class Words:
    """The words of some rows: ``hash`` and byte span (``start``, ``end`` in ``data``) of
    each, and ``first``, the n + 1 offsets of the rows into them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = True, stop: np.ndarray = _SPACE):
        self.data = _LOWER[data] if lower else data
        self.start, self.end = _spans(data, offs, stop)
        self.hash = span_hashes(self.data, self.start, self.end)
        self.first = np.searchsorted(self.start, offs)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` neighbouring hashes of a row, and the rows' offsets
    into them; a row with fewer has none."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    begin = np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1])
    h = np.zeros(len(begin), U64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = h * U64(0xD6E8FEB86659FD93) + hashes[begin + k]
    return mix(h), at


def long_hash(h: np.ndarray) -> np.ndarray:
    """As Spark's bigint."""
    return h.view(np.int64)


def text_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, size: int = SLICE) -> DataFrame:
    """``fn`` over slices of every batch: about ``size`` bytes of text at a time, in the column
    ``text``."""

    def run(batches):
        for batch in batches:
            _, offs = buffers(batch.column("text"))
            for i, j in slices(offs, size):
                yield from fn(batch.slice(i, j - i))

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- semi-join with wide rows
#: Bits of the filter that spares rows without a partner the shuffle: eight a key, from 2**20 up to
#: 2**29 (64 MB in every worker). Beyond 2**26 keys more rows pass it than need to, to be dropped by
#: the join; the result is the same.
LEAST_BITS, MOST_BITS = 20, 29


def split(wide: DataFrame, keys: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``wide`` whose bigint ``on`` may be in ``keys``, and those for which it is
    not, by a filter made from all keys and sized by their number. At any fill no key is missed."""
    spark = wide.sparkSession
    size = min(MOST_BITS, max(LEAST_BITS, (8 * keys.count()).bit_length()))
    slot = F.pmod(F.xxhash64(on), F.lit(1 << size))
    bits = np.zeros(1 << (size - 6), np.int64)
    words = keys.select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))).alias("b"))
    got = words.toArrow()
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    shared = spark.sparkContext.broadcast(bits.view(np.uint64))
    names = wide.columns

    def side(want: bool):
        def run(batches):
            for batch in batches:
                s = batch.column("_slot").to_numpy().astype(np.uint64)
                hit = (shared.value[(s >> U64(6)).astype(np.int64)] >> (s & U64(63))) & U64(1)
                yield batch.select(names).filter(pa.array(hit.astype(bool) == want))

        return wide.withColumn("_slot", slot).mapInArrow(run, wide.schema)

    return side(True), side(False)


def matching(wide: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows of ``wide`` whose bigint ``on`` is in ``keys``, with the columns of both. Most
    others are dropped before the shuffle, so that not all texts move for the sake of a few."""
    return split(wide, keys, on)[0].join(keys, on)


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``edges(a, b)``: ``node, label``.

    Smallest neighbour labels and jumps along labels alternate until nothing changes; the
    labels are stored after each round, and the driver sees only the number of changes.
    Self-loops are fine; an empty input gives an empty result.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = stored(
            labels.join(near, "node").join(over, "label", "left").select("node", F.least("label", "near", F.coalesce("jump", "label")).alias("label"), (F.least("label", "near", F.coalesce("jump", "label")) < F.col("label")).alias("moved")),
            "labels",
        )
        if new.where("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
