"""Language-model scores from Brown classes: words in classes, classes in bigrams.

A text is its words (A-Z lower-cased, separated by ASCII white space) and one end token; the
end token is also the history of the first word. The model is

    P(word | before) = P(class | class before) * P(word | class),

learnt from the training documents, all of them, and every word seen has a class:

1. counts of all tokens (a table that grows with the corpus);
2. exchange clustering of the most frequent words: bigram counts among them, at most
   ``CORE`` squared, go to the driver, where each word in turn moves to the class that
   raises the likelihood most, until few move;
3. the exchange step for all other words, in parallel: each is put into the class that fits the
   classes seen beside it best; first the frequent ones, then, by the classes of those, the rare ones;
4. counts of classes behind classes over all tokens.

Classes and counts of the ``VOCABULARY`` most frequent words are broadcast, which bounds that; those
of the others are a table that grows with the corpus and is joined. As a history all rare words are
alike, so that a score needs no second join. Tokens never seen have one probability together: behind
each class, that of the words seen once there. Class bigrams are interpolated with class frequencies.

A word is known by a 64-bit hash. Edge cases: a null or empty text is one end token; a null
id belongs to the part of an empty id string; rows of one id are scored each for itself; equal
frequencies and gains are decided by hash and class number; a long text is scored whole, some
megabytes of others at a time beside it; if nothing is in training, all tokens are unseen ones; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Words, long_hash, stored

END = np.uint64(0x5E1D0F7EC0FFEE01)
#: Words whose classes are broadcast (20 bytes each in every worker), at most; those of others are joined.
VOCABULARY = 200_000
#: Words that are exchanged again and again, on the driver; others are put into their classes once.
CORE = 2048
CLASSES = 64
ROUNDS = 6
#: Tokens whose counts a worker gathers before it hands them on.
GATHER = 2_000_000
#: Weight of the class frequencies against a class's bigrams.
PRIOR = 20.0
ADD = 0.1


def held_out() -> Column:
    """Whether a row is kept out of training: a tenth of the ids, by checksum."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows' tokens, ends included, and the rows' offsets."""
    w = Words(*common.buffers(column))
    n = len(w.first) - 1
    return np.insert(w.hash, w.first[1:], END), w.first + np.arange(n + 1)


def _gathered(docs: DataFrame, keys, schema: str) -> DataFrame:
    """Counts by key over slices of ``docs(text)``: ``keys`` gives a slice's int64 keys. Rows
    ``key, n``, not yet summed up over tasks."""

    def run(batches):
        held, size = [], 0

        def out():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["key", "n"])

        for batch in batches:
            column = batch.column("text")
            _, offs = common.buffers(column)
            for i, j in common.slices(offs):
                held.append(keys(*_tokens(column.slice(i, j - i))))
                size += len(held[-1])
                if size >= GATHER:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return docs.select("text").mapInArrow(run, schema)


class Lookup:
    """Number of a frequent word by its hash; ``rest`` for the others."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.rest = len(hashes)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not self.rest:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.rest - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], self.rest)


def _before(first: np.ndarray, n: int) -> np.ndarray:
    """For each token, the place of the one before it in its text; for the first, the place
    of the text's end token."""
    before = np.arange(n) - 1
    before[first[:-1]] = first[1:] - 1
    return before


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(left: np.ndarray, right: np.ndarray, count: np.ndarray, n_words: int, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of the words ``0..n_words - 1`` by exchange on their bigram counts. Word
    ``n_words`` stands for all others and keeps a class of its own, number ``classes``."""
    kind = np.append(np.arange(n_words) % classes, classes)
    size = n_words + 1
    count = count.astype(float)
    by_left, by_right = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    at_left, at_right = np.searchsorted(left[by_left], np.arange(size + 1)), np.searchsorted(right[by_right], np.arange(size + 1))
    table = np.zeros((classes + 1, classes + 1))
    np.add.at(table, (kind[left], kind[right]), count)
    for _ in range(rounds):
        moves = 0
        for w in range(n_words):
            i, j = by_left[at_left[w] : at_left[w + 1]], by_right[at_right[w] : at_right[w + 1]]
            own = count[i][right[i] == w].sum()
            i, j = i[right[i] != w], j[left[j] != w]
            out, into = np.bincount(kind[right[i]], count[i], classes + 1), np.bincount(kind[left[j]], count[j], classes + 1)
            a = kind[w]
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= own
            diag = np.diagonal(table)
            rows, cols = table.sum(1), table.sum(0)
            gain = (_g(table + out) - _g(table)).sum(1) + (_g(table + into[:, None]) - _g(table)).sum(0)
            gain += _g(diag + out + into + own) - _g(diag + out) - _g(diag + into) + _g(diag)
            n_out, n_in = out.sum() + own, into.sum() + own
            gain -= _g(rows + n_out) - _g(rows) + _g(cols + n_in) - _g(cols)
            b = int(np.argmax(gain[:classes]))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moves += b != a
            kind[w] = b
            table[b] += out
            table[:, b] += into
            table[b, b] += own
        if moves <= n_words // 200:
            break
    return kind[:n_words]


class Model:
    """What a scorer needs besides the table of rare words: ``table`` counts classes (and, last, words seen
    once) behind classes (and, last, rare words); ``totals`` are the classes' tokens."""

    def __init__(self, hashes, counts, kind, table, totals, n_tokens, n_types):
        self.lookup = Lookup(hashes)
        self.new = table.shape[0] - 1
        self.kind = np.append(kind, self.new).astype(np.int64)
        self.n_tokens, self.n_types, self.totals = n_tokens, n_types, np.maximum(totals, 1.0)
        prior = np.append(totals, table[:, self.new].sum()) + ADD
        self.bigram = np.log10((table + PRIOR * prior / prior.sum()) / (table.sum(1) + PRIOR)[:, None])
        self.word = np.append(np.log10(counts / self.totals[kind]), 0.0) if len(kind) else np.zeros(1)
        self.base = np.append(np.log10((counts + ADD) / self.floor), 0.0)

    @property
    def floor(self) -> float:
        return self.n_tokens + ADD * (self.n_types + 1)


def train(docs: DataFrame, vocabulary: int = VOCABULARY, core: int = CORE, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model of all ``docs(text)`` and the table ``key, n, kind`` of all tokens; ``kind`` is null for
    frequent ones, whose classes are in the model."""
    sc = docs.sparkSession.sparkContext
    counts = stored(_gathered(docs, lambda h, _: long_hash(h), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    n_tokens, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where("n > 1").orderBy(F.desc("n"), "key").limit(vocabulary).toArrow()
    hashes, freq = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    head = sc.broadcast(Lookup(hashes[:core]))
    n_core, width = len(hashes[:core]), classes + 1

    def pairs(h, first):
        ids = head.value(h)
        return ids[_before(first, len(ids))] * (n_core + 1) + ids

    bigrams = _gathered(docs, pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = bigrams["key"].to_numpy(), bigrams["n"].to_numpy()
    kind = np.full(len(hashes), classes)
    kind[:n_core] = exchange(key // (n_core + 1), key % (n_core + 1), n, n_core, classes)
    full = sc.broadcast(Lookup(hashes))
    core_kind = np.append(kind[:n_core], classes)
    table = np.zeros((width, width))
    np.add.at(table, (core_kind[key // (n_core + 1)], core_kind[key % (n_core + 1)]), n)
    if len(hashes) > n_core:
        kind = _assign(docs, full, kind, n_core, table, classes)
    kinds = sc.broadcast(np.append(kind, classes).astype(np.int64))

    def class_pairs(h, first):
        ids = full.value(h)
        c, known = kinds.value[ids], ids < full.value.rest
        return (c[_before(first, len(c))] * width + c)[known]

    table = np.zeros(width * width)
    for row in _gathered(docs, class_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():
        table[row.key] = row.n
    table = table.reshape(width, -1)
    totals = np.bincount(kind, freq, width)[:classes].astype(float) if len(kind) else np.zeros(classes)
    beside = stored(_beside(docs, full, kinds, width).groupBy("key", "slot").agg(F.sum("n").alias("n")), "beside")
    words = beside.groupBy("key").agg(F.collect_list(F.struct(F.col("slot").alias("key"), "n")).alias("beside"))  # at most 2 * width entries
    put = words.select(F.col("key").alias("word"), "beside").mapInArrow(_best(sc.broadcast(_weights(table, classes)), width), "word long, kind int").withColumnRenamed("word", "key")
    counts = stored(counts.join(put, "key", "left"), "words")
    for row in counts.where("kind is not null").groupBy("kind").agg(F.sum("n").alias("n")).collect():
        totals[row.kind] += row.n
    rare = beside.where(F.col("slot") < width).join(counts.select("key", "kind", (F.col("n") == 1).alias("once")), "key")
    for row in rare.groupBy("slot", "kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("once"), F.col("n")).otherwise(0)).alias("once")).collect():  # a row for two classes
        table[row.slot, row.kind] += row.n
        table[row.slot, classes] += row.once
    return Model(hashes, freq, kind, table, totals, n_tokens, n_types), counts


def _weights(table: np.ndarray, classes: int) -> tuple[np.ndarray, ...]:
    """Of putting one more token between classes l and r into class c, by side: l to c, c to r, and the
    size of c."""
    table = table + 0.5
    row, col = table.sum(1), table.sum(0)
    return np.log(table[:, :classes] / row[:, None]), np.log(table[:classes] / row[:classes, None]).T, np.log(col[:classes])


def _best(weights, width: int):
    """The class of each of ``word, beside``: the one that fits what stands beside it best."""

    def best(batches):
        after, before, size = weights.value
        for whole in batches:
            for i in range(0, whole.num_rows, 256):  # a gain for each class and each class beside
                batch = whole.slice(i, 256)
                lists = batch.column("beside")
                flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
                k, m = flat.field("key").to_numpy(), flat.field("n").to_numpy()
                side, c = k // width, k % width
                gain = np.where((side == 0)[:, None], after[c], before[c] - size) * m[:, None]
                total = np.add.reduceat(gain, np.cumsum(count) - count)
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(np.argmax(total, 1).astype(np.int32))], ["word", "kind"])

    return best


def _beside(docs: DataFrame, full, kinds, width: int) -> DataFrame:
    """``key, slot, n``: which classes stand before (``slot`` below ``width``) and behind the rare words."""

    def run(batches):
        held, size = [], 0

        def out():
            key, slot = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((slot, key))
            key, slot = key[order], slot[order]
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (slot[1:] != slot[:-1]))) if len(key) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(key)))
            return pa.RecordBatch.from_arrays([pa.array(long_hash(key[at])), pa.array(slot[at]), pa.array(n.astype(np.int64))], ["key", "slot", "n"])

        for batch in batches:
            column = batch.column("text")
            _, offs = common.buffers(column)
            for i, j in common.slices(offs):
                h, first = _tokens(column.slice(i, j - i))
                ids = full.value(h)
                c, b = kinds.value[ids], _before(first, len(ids))
                mine = np.flatnonzero(ids == full.value.rest)
                ends = np.zeros(len(ids), bool)
                ends[first[1:] - 1] = True
                follow = mine[~ends[mine]]
                held.append((np.concatenate([h[mine], h[follow]]), np.concatenate([c[b[mine]], width + c[follow + 1]])))
                size += len(held[-1][0])
                if size >= GATHER:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return docs.select("text").mapInArrow(run, "key long, slot long, n long")


def _assign(docs, full, kind, n_core, table, classes) -> np.ndarray:
    """The exchange step for the frequent words outside the core."""
    sc = docs.sparkSession.sparkContext
    weights = sc.broadcast(_weights(table, classes))
    kinds = sc.broadcast(np.append(kind, classes).astype(np.int64))
    width = classes + 1

    def beside(h, first):
        ids = full.value(h)
        c = kinds.value[ids]
        b = _before(first, len(ids))
        mine, prev = (ids >= n_core) & (ids < full.value.rest), (ids[b] >= n_core) & (ids[b] < full.value.rest)
        return np.concatenate([(ids[mine] * 2) * width + c[b[mine]], (ids[b[prev]] * 2 + 1) * width + c[prev]])

    seen = _gathered(docs, beside, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    seen = seen.groupBy(F.floor(F.col("key") / (2 * width)).alias("word")).agg(F.collect_list(F.struct((F.col("key") % (2 * width)).alias("key"), "n")).alias("beside"))  # at most 2 * width entries
    got = seen.mapInArrow(_best(weights, width), "word long, kind int").toArrow()
    kind = kind.copy()
    kind[got["word"].to_numpy()] = got["kind"].to_numpy()
    return kind


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batch):
        m = shared.value
        h, first = _tokens(batch.column("text"))
        ids = m.lookup(h)
        c = m.kind[ids]
        known = ids < m.lookup.rest
        begin = first[:-1]
        rows, past = len(begin), c[_before(first, len(c))]
        step = np.where(known, m.bigram[past, c] + m.word[ids], 0.0)
        size = np.diff(first)
        row = np.repeat(np.arange(rows), size)[~known]
        tail, past = h[~known], past[~known]
        order = np.lexsort((past, tail, row))
        row, tail, past = row[order], tail[order], past[order]
        new = np.ones(len(tail), bool)
        new[1:] = (row[1:] != row[:-1]) | (tail[1:] != tail[:-1]) | (past[1:] != past[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(tail)))
        offs = pa.array(np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32))
        pairs = pa.ListArray.from_arrays(offs, pa.StructArray.from_arrays([pa.array(long_hash(tail[at])), pa.array(past[at].astype(np.int32)), pa.array(n.astype(np.int64))], ["key", "past", "m"]))
        arrays = [batch.column("doc_id"), batch.column("held_out"), pa.array(size.astype(np.int64)), pa.array(np.add.reduceat(known.astype(np.int64), begin)), pa.array(np.add.reduceat(m.base[ids], begin)), pa.array(np.add.reduceat(step, begin)), pairs]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out().alias("held_out"))
    parts = common.text_rows(rows, run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<key: long, past: int, m: long>>")
    parts = stored(parts.withColumn("rid", F.monotonically_increasing_id()), "scores")
    steps = [(p, c, float(model.bigram[p, c] - (math.log10(model.totals[c]) if c < model.new else 0.0))) for p in range(model.new + 1) for c in range(model.new + 1)]
    table = spark.createDataFrame(steps, "past int, kind int, step double")  # a row for two classes
    seen = parts.select("rid", F.inline("rare")).join(counts, "key", "left").withColumn("kind", F.coalesce("kind", F.lit(model.new)))
    c = F.coalesce("n", F.lit(0))
    rare = seen.join(F.broadcast(table), ["past", "kind"])
    base, own = F.log10((c + ADD) / F.lit(model.floor)), F.col("step") + F.when(c > 0, F.log10(c)).otherwise(0.0)
    rare = rare.groupBy("rid").agg(F.sum(F.when(F.col("n") > 0, F.col("m"))).alias("more"), F.sum(F.col("m") * base).alias("b"), F.sum(F.col("m") * own).alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return parts.drop("rare").join(rare, "rid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more")).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("s")).alias("score"))


def op8_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))
    model, counts = train(docs.where(~held_out()))
    return score(docs, model, counts)
