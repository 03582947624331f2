"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its distinct 4- or 5-word shingles (A-Z lower-cased, words
separated by ASCII white space). Two documents are linked when the Jaccard similarity of
their sets reaches the threshold; a group is a connected component of links.

*Tensored banding.* ``m`` small collections of ``r`` minhashes are computed once; the table
keys are all pairs of collections, ``m * (m - 1) / 2`` tables of ``2 * r`` minhashes each out
of only ``m * r``. Two documents of similarity s meet in a table unless fewer than two of
the collections agree: with m = 14, r = 2 that is 1.6e-5 at s = 0.8 and less above.

*Work stays in proportion to the documents.* Equal sets collapse to one node, a row that has it;
ids do not matter until the end, so an id that stands on several texts takes part with each.
A bucket is never expanded to pairs: each member is tried against the bucket's smallest and
largest member. Links that hold on the full sets give components;
then buckets that still hold more than one component are looked at again, and members of
different ones are matched by their rarest shingles, which is exact.

Edge cases: a null or empty text, or one of white space only, has an empty set and is
linked with nothing; a text of fewer words than a shingle has its whole word sequence as
one shingle; rows repeated with one id are one set member each: with equal texts they fall
into one group, with different texts each row has the group of its own text; a null id takes
part like any other, a group's id is its smallest one that is not null, and a group of null ids
alone has a null id and is kept; long texts are whole (a slice of the work is one text at
least); pairs exactly at the threshold are links; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, Words, long_hash, mix, stored, text_rows, windows

COLLECTIONS = 14
ROWS = 2
#: Counters of shingle frequencies, as a power of two: about one for 64 shingles, 4 bytes each. They
#: only order the shingles, rare ones first; any order gives the same links.
LEAST_SLOTS, MOST_SLOTS = 18, 22


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one after another, and offsets."""
    w = Words(*common.buffers(column))
    h, at = windows(w.hash, w.first, words)
    count = np.diff(w.first)
    sets = []
    for i, n in enumerate(count):
        if n >= words:
            sets.append(np.unique(h[at[i] : at[i + 1]]))
        elif n:
            whole, _ = windows(w.hash, np.array([w.first[i], w.first[i + 1]]), int(n))
            sets.append(mix(whole + U64(n)))  # never equal to a full shingle
        else:
            sets.append(np.empty(0, U64))
    return np.concatenate(sets) if sets else np.empty(0, U64), np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]).astype(np.int64)


def _coefficients(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 1 << 63, size=(n, 2), dtype=np.uint64) | U64(1)


def signatures(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` minhashes of each (non-empty) set."""
    out = np.empty((len(at) - 1, n), U64)
    for k, (a, b) in enumerate(_coefficients(n)):
        v = (flat ^ b) * a
        v ^= v >> U64(32)
        out[:, k] = np.minimum.reduceat(v, at[:-1])
    return out


def sketches(docs: DataFrame, words: int, m: int = COLLECTIONS, r: int = ROWS) -> DataFrame:
    """``doc_id, row`` (the key of a row, of its id and text), ``n_shingles, digest`` (of the whole set)
    and ``sig``: the m collections, each hashed to one number."""

    def run(batch):
        flat, at = shingle_sets(batch.column("text"), words)
        size = np.diff(at)
        full = size > 0
        ends = np.concatenate([at[:-1][full], at[-1:]])
        sig = np.zeros((len(size), m), U64)
        if full.any():
            mins = signatures(flat, ends, m * r)
            with np.errstate(over="ignore"):
                for c in range(m):
                    h = np.full(len(mins), c + 1, U64)
                    for k in range(r):
                        h = mix(h * U64(0x9E3779B97F4A7C15) + mins[:, c * r + k])
                    sig[full, c] = h
        digest = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
        sigs = pa.FixedSizeListArray.from_arrays(pa.array(long_hash(sig.reshape(-1))), m).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(size.astype(np.int64)), pa.array(digest, pa.binary()), sigs], ["doc_id", "row", "n_shingles", "digest", "sig"])

    return text_rows(_keyed(docs), run, "doc_id long, row long, n_shingles long, digest binary, sig array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, row, text``: rows are told apart by a hash of id and text."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return some.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")


def _buckets(reps: DataFrame, m: int) -> DataFrame:
    """``key, node``: one row for each pair of collections. Spark takes them for as small as ``reps``, which it
    would send to every task by way of the driver, so joins with them are merged."""
    keys = [F.xxhash64(F.lit(i * m + j), F.col("sig")[i], F.col("sig")[j]) for i in range(m) for j in range(i + 1, m)]
    return reps.select(F.explode(F.array(*keys)).alias("key"), "node").hint("merge")


def _met(reps: DataFrame, m: int) -> DataFrame:
    """The buckets of two members or more, with the smallest and the largest: ``key, node, low, high``."""
    buckets = _buckets(reps, m)
    heads = buckets.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    return buckets.join(heads, "key")


def _links(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets have 100 * intersection >= percent * union."""

    def check(batches):
        for batch in batches:
            left, right = batch.column("text_a"), batch.column("text_b")
            _, offs_a = common.buffers(left)
            _, offs_b = common.buffers(right)
            for i, j in common.slices(offs_a + offs_b):
                fa, aa = shingle_sets(left.slice(i, j - i), words)
                fb, ab = shingle_sets(right.slice(i, j - i), words)
                keep = []
                for k in range(j - i):
                    x, y = fa[aa[k] : aa[k + 1]], fb[ab[k] : ab[k + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a").slice(i, j - i), batch.column("b").slice(i, j - i)], ["a", "b"]).filter(pa.array(keep))

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").hint("merge").join(one, "a").join(two, "b").select("a", "text_a", "b", "text_b").mapInArrow(check, "a long, b long")


def _rest(met: DataFrame, labels: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of different components that meet in a bucket and may be links.

    A common passage can bring many documents into a bucket without making them alike, so
    the members of buckets with several components are matched on their rarest shingles: a
    pair at the threshold shares one of the first ``n - ceil(t * n) + 1`` in any fixed order,
    and the ranks of the first one shared bound the intersection. The order goes by counts
    in a table of fixed size, so that what is common comes last. Exact: no link is lost.
    """
    spark = texts.sparkSession
    named = met.select("key", "node").join(labels.hint("merge"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    nodes = named.hint("merge").join(mixed, "key").select("node", "label").distinct()
    open_ = stored(texts.join(nodes, "node"), "open")

    total = open_.agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_SLOTS, max(LEAST_SLOTS, int(total).bit_length() - 6))

    def tally(batch):
        flat, _ = shingle_sets(batch.column("text"), words)
        slot, n = np.unique((flat >> U64(64 - bits)).astype(np.int32), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    got = text_rows(open_, tally, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << bits, np.uint32)
    counts[got["slot"].to_numpy()] = np.minimum(got["n"].to_numpy(), (1 << 32) - 1)
    shared = spark.sparkContext.broadcast(counts)

    def prefixes(batch):
        count = shared.value
        flat, at = shingle_sets(batch.column("text"), words)
        row, rank, head = [], [], []
        for i in range(len(at) - 1):
            x = flat[at[i] : at[i + 1]]
            n = len(x) - (-(-percent * len(x) // 100)) + 1
            order = np.lexsort((x, count[(x >> U64(64 - bits)).astype(np.int64)]))[:n]
            head.append(x[order])
            row.append(np.full(len(order), i))
            rank.append(np.arange(len(order)))
        row = np.concatenate(row)
        yield pa.RecordBatch.from_arrays(
            [pa.array(long_hash(np.concatenate(head))), batch.column("node").take(pa.array(row)), batch.column("label").take(pa.array(row)), pa.array(np.diff(at)[row]), pa.array(np.concatenate(rank).astype(np.int64))], ["shingle", "node", "label", "n", "rank"]
        )

    heads = stored(text_rows(open_, prefixes, "shingle long, node long, label long, n long, rank long"), "prefixes")
    mixed = heads.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("shingle")
    heads = heads.join(mixed, "shingle")
    x, y = heads.alias("x"), heads.alias("y")
    most = F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank"))
    may = most * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.label") < F.col("y.label")) & may).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, m: int = COLLECTIONS, r: int = ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, row, n_shingles, label`` (of its group, null for an
    empty set), ``component_id``."""
    sk = stored(sketches(docs, words, m, r), "sketches")
    full = sk.where("n_shingles > 0")
    sets = stored(full.groupBy("digest").agg(F.min("row").alias("row"), F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "sets")
    # A set's node is its smallest id, so that buckets agree on their first member; a row's key where
    # that id stands on other sets, too, or is null.
    shared = sets.groupBy("id").agg(F.count("*").alias("m")).where("m > 1 and id is not null")
    groups = stored(sets.join(shared, "id", "left").withColumn("node", F.when(F.col("id").isNull() | F.col("m").isNotNull(), F.col("row")).otherwise(F.col("id"))).drop("m"), "groups")
    met = stored(_met(groups, m), "buckets")
    size = groups.select("node", "n")
    wanted = stored(groups.select("row", "node", "n").join(met.select("node").distinct(), "node"), "wanted")
    texts = stored(common.matching(_keyed(docs).select("row", "text"), wanted, "row").dropDuplicates(["row"]).select("node", "n", "text"), "texts")

    def sized(pairs: DataFrame) -> DataFrame:
        """In order, each once, and not of sizes that rule a link out."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct().hint("merge")
        pairs = pairs.join(size.withColumnRenamed("node", "a").withColumnRenamed("n", "na"), "a").join(size.withColumnRenamed("node", "b").withColumnRenamed("n", "nb"), "b")
        return pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")

    tried = stored(sized(met.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b"))), "pairs")
    edges = stored(_links(tried, texts, words, percent), "links")
    labels = common.components(edges)
    rest = _rest(met, labels, texts, words, percent)
    late = stored(_links(stored(rest, "pairs"), texts, words, percent), "links")
    if not late.isEmpty():
        labels = common.components(edges.unionByName(late))
    member = groups.select("digest", "node", "id").join(labels, "node", "left").select("digest", "id", F.coalesce("label", "node").alias("label"))
    first = member.groupBy("label").agg(F.min("id").alias("component_id"))
    group = member.join(first, "label").select("digest", "label", "component_id")
    own = full.select("doc_id", "row", "n_shingles", "digest").join(group, "digest").drop("digest")
    bare = sk.where("n_shingles = 0").select("doc_id", "row", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
    return own.unionByName(bare)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, m: int = COLLECTIONS, r: int = ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``."""
    rows = grouped(docs, words, percent, m, r)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but one of each group: the one with the smallest id (null ids are
    the largest), of several texts with that id one, and one of rows that repeat id and text. Rows
    without words stay."""
    rows = stored(grouped(docs, words, percent).where("label is not null").select("doc_id", "row", "label"), "grouped")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "row"))
    stay = rows.groupBy("label").agg(first.alias("f")).select(F.col("f.row").alias("row"))
    each = rows.groupBy("row").agg(F.count("*").alias("n"))
    # Rows that go, and those of which one stays; all others are passed on as they are.
    marked = stored(each.join(stay.withColumn("stays", F.lit(True)), "row", "left").where("stays is null or n > 1").select(F.col("row").alias("_row"), F.col("stays").isNotNull().alias("_one")), "marked")
    keyed = docs.withColumn("_row", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    some, others = common.split(keyed, marked.select("_row"), "_row")
    met = some.join(marked, "_row", "left")
    passed = met.where("_one is null").unionByName(met.where("_one").dropDuplicates(["_row"]))
    return others.select(*docs.columns).unionByName(passed.select(*docs.columns))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir), words=4)
