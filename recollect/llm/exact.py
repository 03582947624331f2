"""Exact duplicates by an index of live digests behind cuckoo filters.

Texts are equal when they are identical without ASCII white space; their digest is the SHA-256
of what is left. The index deals digests to buckets; a bucket has its live digests, with the
row that stays of each, and a cuckoo filter over them.

*Insertion.* What arrives at a bucket is looked up in its filter. A miss is new for certain: nothing
stored is looked at, its digest is put and is live from then on, also for what arrives after it. A
hit is held against the bucket's stored digests; if none is equal, the filter was wrong and the digest
is new, too. When the filter overflows it is made anew from the stored keys, larger. In the end the
texts of all digests that were hit are compared byte by byte.

*Deletion.* Rows that go are taken off their digests; a digest that loses its last row leaves the filter
and the bucket, and one that loses the row that stays gets another.

*Skew.* Rows of one digest are aggregated in ``SALTS`` parts, map side first, before they go to its
bucket; texts are compared as the keys of an aggregate, so equal ones are one a task; and the
groups with more than a ``HOT``-th of the rows, ``HOT`` at most, come back to their rows by broadcast.

Edge cases: a null or empty text, or one of white space only, is equal to each other such text; of
equal texts that with the most code points stays, then that with the smallest id, where a null id comes
last, then one row of those that repeat the same id and text: exactly one row of a group stays, and
``kept`` says which where ids repeat; texts are whole, however long; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, stored, text_rows
from .cuckoo import Cuckoo, Full

#: Digests of a bucket, about; there are as many buckets as the first rows ask for.
BUCKET = 32_768
#: Arrivals that are looked up at once.
CHUNK = 4_096
SALTS = 16
HOT = 1_000
#: Bytes of a key; fewer, and fewer bits of a fingerprint, are for tests.
WIDTH, BITS = 32, 16

_STATE = "bucket int, key binary, n long, chars long, doc_id long, row long, slots binary"


class Index(NamedTuple):
    """``rows`` that are live (doc_id, row, key, chars), ``state`` (live digests with the row that stays of
    each, and a row with the filter for each bucket) and ``content`` (key, body) of live rows, a plan
    over the documents until it is saved."""

    rows: DataFrame | None
    state: DataFrame | None
    content: DataFrame | None
    buckets: int
    width: int = WIDTH
    bits: int = BITS

    @property
    def keys(self) -> DataFrame:
        return self.state.where("key is not null").drop("slots")


class Collision(Exception):
    """Two texts have one digest."""


def _bare(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts without white space, and their offsets."""
    keep = ~common._SPACE[data]
    at = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], at[offs]


def _digest(body: np.ndarray) -> bytes:
    return hashlib.sha256(body).digest()


def digested(docs: DataFrame, width: int = WIDTH, body: bool = False) -> DataFrame:
    """``doc_id, row, key, chars`` of ``docs(doc_id, text, row)``, or ``key, body``."""

    def run(batch):
        data, offs = common.buffers(batch.column("text"))
        bare, at = _bare(data, offs)
        keys = pa.array([_digest(bare[a:b])[:width] for a, b in zip(at[:-1], at[1:])], pa.binary())
        if body:
            texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(at), pa.py_buffer(bare)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([keys, texts], ["key", "body"])
        else:
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), keys, pa.array(np.diff(points))], ["doc_id", "row", "key", "chars"])

    return text_rows(docs, run, "key binary, body binary" if body else "doc_id long, row long, key binary, chars long")


def _rows(docs: DataFrame) -> DataFrame:
    """``doc_id, text, row`` with a name for each row that no other batch has."""
    row = F.xxhash64(F.monotonically_increasing_id(), F.lit(uuid.uuid4().hex))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))


def _short(key: str | Column = "key") -> Column:
    return F.xxhash64(key)


# ---------------------------------------------------------------- buckets
def _keys64(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join((d + bytes(8))[:8] for d in digests), U64) if digests else np.empty(0, U64)


class Bucket:
    """Live digests in the order they came, ``at`` of each, and the filter over them."""

    def __init__(self, digests: list[bytes], slots: bytes | None, bits: int):
        self.digests, self.at, self.bits = digests, {d: i for i, d in enumerate(digests)}, bits
        self.filter = Cuckoo.from_bytes(slots, bits) if slots else Cuckoo.of(_keys64(digests), bits=bits)
        self.looked = 0  # stored digests that were looked at

    def _enter(self, new: list[bytes]) -> None:
        for d in new:
            self.at[d] = len(self.digests)
            self.digests.append(d)
        try:
            self.filter.put(_keys64(new))
        except Full:
            self.filter = Cuckoo.of(_keys64(self.digests), 2 * len(self.digests), self.bits)

    def insert(self, digests: list[bytes]) -> np.ndarray:
        """The place of each among the live digests, where it is put if it is new."""
        out = np.empty(len(digests), np.int64)
        for a in range(0, len(digests), CHUNK):
            some = digests[a : a + CHUNK]
            hit = self.filter.has(_keys64(some))
            # A miss is new unless an equal one stands before it in the chunk.
            fresh = list(dict.fromkeys(d for d, h in zip(some, hit) if not h))
            begin = len(self.digests)
            self.looked += int(hit.sum())
            wrong = [d for d in dict.fromkeys(d for d, h in zip(some, hit) if h) if d not in self.at]
            self._enter(fresh + wrong)
            new = {d: begin + i for i, d in enumerate(fresh)}
            out[a : a + CHUNK] = [self.at[d] if h else new[d] for d, h in zip(some, hit)]
        return out

    def remove(self, dead: np.ndarray) -> None:
        """Take out the live digests at these places."""
        self.filter.take(_keys64([self.digests[i] for i in np.flatnonzero(dead)]))


_NUMBERS = ["n", "chars", "doc_id", "row"]


def _best(at: np.ndarray, table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Of the rows with one ``at``: the sum of n, and the row that stays."""
    ids = table.column("doc_id")
    doc = ids.fill_null(0).to_numpy()
    chars, row = table.column("chars").to_numpy(), table.column("row").to_numpy()
    order = np.lexsort((row, doc, ids.is_null().to_numpy(), -chars, at))
    first = order[np.concatenate([[True], np.diff(at[order]) > 0])] if len(order) else order
    n = np.zeros(int(at.max()) + 1 if len(at) else 0, np.int64)
    np.add.at(n, at, table.column("n").to_numpy())
    return n, table.take(pa.array(first))


def _state(number: int, digests: list[bytes], n: np.ndarray, best: pa.Table, slots: bytes) -> pa.Table:
    """The rows of a bucket, its filter last."""
    m = len(digests)
    own = {"bucket": pa.array([number] * (m + 1), pa.int32()), "key": pa.array([*digests, None], pa.binary()), "n": pa.array(np.append(n, 0))}
    own |= {c: pa.chunked_array([*best.column(c).cast(pa.int64()).chunks, pa.array([None], pa.int64())], pa.int64()) for c in _NUMBERS[1:]}
    return pa.table(own | {"slots": pa.array([None] * m + [slots], pa.binary())})


def _split(state: pa.Table) -> tuple[pa.Table, bytes | None]:
    import pyarrow.compute as pc

    slots = [x for x in state.column("slots").to_pylist() if x is not None]
    return state.filter(pc.is_valid(state.column("key"))), slots[0] if slots else None


def _arrive(bits: int):
    def run(key, arrivals: pa.Table, state: pa.Table) -> pa.Table:
        live, slots = _split(state)
        bucket = Bucket(live.column("key").to_pylist(), slots, bits)
        at = bucket.insert(arrivals.column("key").to_pylist())
        both = pa.concat_tables([live.select(_NUMBERS), arrivals.select(_NUMBERS)])
        n, best = _best(np.concatenate([np.arange(live.num_rows), at]), both)
        return _state(key[0].as_py(), bucket.digests, n, best, bucket.filter.to_bytes())

    return run


def _leave(bits: int):
    """``changes``: digests that lose rows, with what is left of each; n is 0 for those that die."""

    def run(key, changes: pa.Table, state: pa.Table) -> pa.Table:
        live, slots = _split(state)
        digests = live.column("key").to_pylist()
        bucket = Bucket(digests, slots, bits)
        now = {d: i for i, d in enumerate(changes.column("key").to_pylist())}
        dead = np.array([d in now and changes.column("n")[now[d]].as_py() == 0 for d in digests], bool)
        bucket.remove(dead)
        both = pa.concat_tables([live.select(_NUMBERS), changes.select(_NUMBERS)])
        pick = np.array([live.num_rows + now[d] if d in now else i for i, d in enumerate(digests)], np.int64)[~dead]
        best = both.take(pa.array(pick))
        return _state(key[0].as_py(), [d for d, x in zip(digests, dead) if not x], best.column("n").to_numpy(), best, bucket.filter.to_bytes())

    return run


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(_short(), F.lit(buckets)).cast("int"))


def _best_of(rows: DataFrame, *by: str) -> DataFrame:
    """n and the row that stays, by an aggregate."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("bare"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row")))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), best.alias("best"))
    return out.select(*by, "n", (-F.col("best.less")).alias("chars"), F.col("best.doc_id").alias("doc_id"), F.col("best.row").alias("row"))


# ---------------------------------------------------------------- the index
def insert(index: Index | None, docs: DataFrame, width: int = WIDTH, bits: int = BITS) -> Index:
    """The index with the rows of ``docs(doc_id, text)`` in it; None is an empty one. Raises ``Collision``
    if two texts of one digest differ."""
    spark = docs.sparkSession
    texts = _rows(docs)
    rows = stored(digested(texts, index.width if index else width), "rows")
    if index is None:
        buckets = 1 << max(5, int(rows.count() / BUCKET).bit_length())
        index = Index(rows.limit(0), spark.createDataFrame([], _STATE), texts.limit(0).select(F.lit(b"").alias("key"), F.lit(b"").alias("body")), buckets, width, bits)
    arrivals = _bucketed(_best_of(rows.withColumn("salt", F.pmod("row", F.lit(SALTS))), "key", "salt").drop("salt"), index.buckets)
    state = stored(arrivals.groupBy("bucket").cogroup(index.state.groupBy("bucket")).applyInArrow(_arrive(index.bits), _STATE), "state")
    new = index._replace(rows=index.rows.unionByName(rows), state=state, content=index.content.unionByName(digested(texts, index.width, body=True)))
    _compare(new, rows)
    return new


def _compare(index: Index, rows: DataFrame) -> None:
    """Hold the texts of the digests that were hit by ``rows`` against each other."""
    hit = stored(index.keys.where("n > 1").select("key").join(rows.select("key").distinct(), "key", "left_semi").select(_short().alias("short")).distinct(), "hit")
    content = index.content.withColumn("short", _short())
    bodies = common.split(content, hit, "short")[0].groupBy("key", "body").agg(F.count("*").alias("m"))
    if not bodies.groupBy("key").agg(F.count("*").alias("bodies")).where("bodies > 1").isEmpty():
        raise Collision("two texts have one digest")


def delete(index: Index, docs: DataFrame) -> Index:
    """The index without the rows that have an id and text of ``docs``; others are passed over."""
    gone = digested(_rows(docs), index.width).select(F.col("doc_id").alias("gone"), F.col("key").alias("its")).distinct()
    rows = stored(index.rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")) & (F.col("key") == F.col("its")), "left_anti"), "rows")
    touched = gone.select(F.col("its").alias("key")).distinct().join(index.keys.select("key"), "key", "left_semi")
    left = touched.join(_best_of(rows.join(touched, "key", "left_semi"), "key"), "key", "left").fillna(0, ["n"])
    state = stored(_bucketed(left, index.buckets).groupBy("bucket").cogroup(index.state.groupBy("bucket")).applyInArrow(_leave(index.bits), _STATE), "state")
    live = state.where("key is not null").select("key")
    return index._replace(rows=rows, state=state, content=index.content.join(live, "key", "left_semi"))


def lookup(index: Index, docs: DataFrame) -> DataFrame:
    """``doc_id, known`` for each row: whether a live text is equal to its text. Buckets' filters are asked
    first; texts that pass are compared with the content."""
    bits = index.bits
    asked = _bucketed(stored(digested(_rows(docs), index.width), "asked"), index.buckets)
    filters = index.state.where("slots is not null").select("bucket", "slots")

    def run(key, some: pa.Table, own: pa.Table) -> pa.Table:
        if not own.num_rows:
            return some.select(["key"]).slice(0, 0)
        keys = some.column("key").to_pylist()
        return some.select(["key"]).filter(pa.array(Cuckoo.from_bytes(own.column("slots")[0].as_py(), bits).has(_keys64(keys))))

    distinct = asked.select("bucket", "key").distinct()
    hits = stored(distinct.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "key binary").withColumn("short", _short()), "hits")
    mine = stored(digested(_rows(docs), index.width, body=True).join(hits.select("key"), "key", "left_semi").distinct(), "bodies")
    theirs = common.split(index.content.withColumn("short", _short()), hits.select("short"), "short")[0].select("key", "body").distinct()
    same = mine.join(theirs, ["key", "body"], "left_semi").select("key").distinct().withColumn("known", F.lit(True))
    return asked.join(same, "key", "left").select("doc_id", F.coalesce("known", F.lit(False)).alias("known"))


def saved(index: Index) -> Index:
    """The index with its tables written, bodies by bucket, one for each live digest."""
    content = _bucketed(index.content, index.buckets).dropDuplicates(["key"]).repartition("bucket").sortWithinPartitions("bucket", "key").select("key", "body")
    return index._replace(rows=stored(index.rows, "rows"), state=stored(index.state, "state"), content=stored(content, "content"))


def groups(index: Index) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, key`` of every live row."""
    many = index.keys.where("n > 1").select("key", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"))
    bound = index.rows.count() / HOT
    hot, cold = many.where(F.col("group_size") > bound), many.where(F.col("group_size") <= bound)
    rows = index.rows.select("doc_id", "row", "key")
    told = rows.join(F.broadcast(hot), "key").unionByName(rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(cold, "key", "left"), allowMissingColumns=True)
    one = F.col("keep_row").isNull()
    return told.select("doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (one | (F.col("row") == F.col("keep_row"))).alias("kept"), "key")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(insert(None, common.documents(spark, sf_dir)))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256"))
