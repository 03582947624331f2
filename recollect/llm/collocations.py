"""Phrase collocations by suffix sorting.

Texts (A-Z lower-cased) are cut into pieces at punctuation and line ends, pieces into words. From
every word starts a suffix of its piece, cut after ``LONGEST`` words. Suffixes are shuffled by language
and first word and sorted in reverse order; all phrases are prefixes of suffixes, and in that order the
phrases that are still open form one stack: it is popped where a suffix no longer begins with what
lies on it, and what is popped has its final count. Parts of phrases are joined afterwards.

*What is not shuffled.* A phrase is no more frequent than its words, so suffixes end before a word that
is too rare (words are counted first; a bit filter made from all frequent words tells, and what it lets
through by mistake is counted and found too rare). Suffixes of one word need not move. Equal suffixes of
a batch are one row with a count.

*Skew.* Words with more than a ``HOT``-th of all occurrences, ``HOT`` at most, are known to all tasks.
A suffix that begins with one is dealt by its words up to the first that is not hot, or by all of them;
counts of phrases made of hot words only are then partial, and are added up afterwards.

Edge cases: a null or empty text has no words; a null language is ``und``, together with texts of
that language; long texts are whole; repeated rows and null ids count like others; of equal scores that
with more occurrences comes first, then the smaller phrase in the order of UTF-8 bytes; a language without
candidates gives no rows, as does an empty table; other columns are ignored. Counts are exact; words are
told apart by their bytes, and 64-bit hashes decide on what may be left out only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import U64, Words, mix, stored, text_rows

LONGEST = 4
FREQUENT = 30
TOP = 2000
#: A phrase whose parts never stand apart scores half of this.
SCALE = 2_000_000
#: A candidate goes if a longer one around it has this share of its occurrences.
COVER = 80
HOT = 2000
#: Text bytes whose words or suffixes are counted together before they are shuffled.
BATCH = 4 << 20
#: Occurrences for each partition of the sort.
SORTED = 4_000_000
#: Parts of a language whose first ``TOP`` are taken before those of the whole.
PARTS = 64

_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
#: Stands after each word of a suffix, so that beginning with the words is beginning with the bytes.
END = 0x09


def _strings(data: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))


def _taken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte spans, in order and apart from each other, as strings."""
    edge, some = np.zeros(len(data) + 1, np.int8), ends > starts
    edge[starts[some]] += 1
    edge[ends[some]] -= 1
    return _strings(data[np.cumsum(edge[:-1], dtype=np.int8).view(bool)], np.concatenate([[0], np.cumsum(ends - starts)]))


class Pieces:
    """The words of a batch: their language (``codes`` of ``names``), hash with the language, and whether
    the next word stands in the same piece."""

    def __init__(self, batch: pa.RecordBatch):
        data, offs = common.buffers(batch.column("text"))
        self.words = w = Words(data, offs, stop=_GAP | _BREAK)
        langs = batch.column("lang").dictionary_encode()
        self.names, row = langs.dictionary, w.row
        self.codes = langs.indices.to_numpy()[row]
        self.hash = keyed(w.hash, self.names, self.codes)
        breaks = np.cumsum(_BREAK[data])[w.start] if len(w.start) else w.start
        self.joined = np.append((breaks[1:] == breaks[:-1]) & (row[1:] == row[:-1]), False)[: len(row)]


def keyed(words: np.ndarray, names: pa.Array, codes: np.ndarray) -> np.ndarray:
    """Hashes of words of languages."""
    data, offs = common.buffers(names)
    return mix(words * U64(3) + common.span_hashes(data, offs[:-1], offs[1:])[codes])


def _counted(names: pa.Array, codes: np.ndarray, **columns: pa.Array) -> list[pa.RecordBatch]:
    """Equal rows of language and ``columns`` as one, with their number."""
    t = pa.table({"lang": pa.array(codes), **columns}).group_by(["lang", *columns], use_threads=False).aggregate([([], "count_all")])
    t = t.set_column(t.column_names.index("lang"), "lang", names.take(t.column("lang").combine_chunks()))
    return t.select(["lang", *columns, "count_all"]).rename_columns(["lang", *columns, "n"]).combine_chunks().to_batches()[:1]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of all words."""

    def run(batch):
        p = Pieces(batch)
        w = p.words
        yield from _counted(p.names, p.codes, word=_taken(w.data, w.start, w.end))

    return text_rows(_texts(docs), run, "lang string, word string, n long", BATCH).groupBy("lang", "word").agg(F.sum("n").alias("f"))


# ---------------------------------------------------------------- suffixes
def _hashes(words: DataFrame) -> DataFrame:
    """``h`` of ``lang, word``, as the batches have it."""

    def run(batches):
        for b in batches:
            langs = b.column("lang").dictionary_encode()
            data, offs = common.buffers(b.column("word"))
            yield pa.RecordBatch.from_arrays([pa.array(common.long_hash(keyed(common.span_hashes(data, offs[:-1], offs[1:]), langs.dictionary, langs.indices.to_numpy())))], ["h"])

    return words.select("lang", "word").mapInArrow(run, "h long")


def _filter(words: DataFrame) -> np.ndarray:
    """Bits of all ``words``, eight a word up to 2**MOST_BITS."""
    size = min(common.MOST_BITS, max(common.LEAST_BITS, (8 * words.count()).bit_length()))
    slot = F.pmod("h", F.lit(1 << size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("s", F.lit(64)).cast("int"))
    got = _hashes(words).select(slot.alias("s")).groupBy((F.col("s") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    return bits.view(np.uint64)


def _lengths(joined: np.ndarray) -> np.ndarray:
    """Words from each to the end of its run, ``LONGEST`` at most."""
    more, ahead = np.ones(len(joined), np.int64), joined
    for _ in range(LONGEST - 1):
        more += ahead
        ahead = joined & np.append(ahead[1:], False)[: len(joined)]
    return more


def suffixes(docs: DataFrame, frequent: DataFrame, hot: np.ndarray) -> DataFrame:
    """``lang, suffix, depth, n``: ``depth`` words, up to the first that is not ``hot`` (a sorted array of
    hashes), say where a suffix is dealt; LONGEST + 1 if all are hot."""
    shared = docs.sparkSession.sparkContext.broadcast((_filter(frequent), hot if len(hot) else np.zeros(1, U64)))

    def run(batch):
        bits, warm = shared.value
        p = Pieces(batch)
        w, n = p.words, len(p.words.start)
        slot = p.hash & U64(64 * len(bits) - 1)
        may = ((bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1)).astype(bool)
        length = _lengths(p.joined & may & np.append(may[1:], False)[:n])
        size = w.end - w.start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        # All words, each with its end after it.
        data = np.full(at[-1], END, np.uint8)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        data[inside] = w.data[~(_GAP | _BREAK)[w.data]]
        cool = warm[np.searchsorted(warm[:-1], p.hash)] != p.hash
        depth = np.full(n, LONGEST + 1, np.int32)
        for k in reversed(range(LONGEST)):
            here = np.append(cool[k:], np.zeros(min(k, n), bool)) & (length > k)
            depth[here] = k + 1
        tables = []
        # Of the suffixes that start LONGEST words apart none overlaps.
        for phase in range(LONGEST):
            some = np.arange(phase, n, LONGEST)
            some = some[length[some] > 1]
            tables.append(pa.table({"code": pa.array(p.codes[some]), "suffix": _taken(data, at[some], at[some + length[some]]), "depth": pa.array(depth[some])}))
        t = pa.concat_tables(tables).combine_chunks()
        if t.num_rows:
            yield from _counted(p.names, t.column("code").to_numpy(), suffix=t.column("suffix"), depth=t.column("depth"))

    return text_rows(_texts(docs), run, "lang string, suffix string, depth int, n long", BATCH)


# ---------------------------------------------------------------- the stack
class Stack:
    """The open prefixes of 2 words and more, with their counts so far. Suffixes come in reverse order, by
    the batch; a prefix is popped when a suffix does not begin with it, and goes to ``out``."""

    def __init__(self):
        self.lang, self.open, self.out = None, {}, []

    def _pop(self, k: int) -> None:
        have = self.open.pop(k, None)
        if have and (have[2] > k or have[1] >= FREQUENT):  # partial counts, or enough
            self.out.append((self.lang, *have))

    def close(self) -> None:
        for k in sorted(self.open, reverse=True):
            self._pop(k)

    def push(self, lang: str, suffix: pa.Array, depth: np.ndarray, n: np.ndarray) -> None:
        if lang != self.lang:
            self.close()
            self.lang = lang
        data, offs = common.buffers(suffix)
        ends = np.flatnonzero(data == END) + 1
        first = np.searchsorted(ends, offs[:-1], "right")
        words = np.searchsorted(ends, offs[1:], "right") - first
        total = np.concatenate([[0], np.cumsum(n)])
        for k in range(LONGEST, 1, -1):
            long = words >= k
            stop = offs[:-1].copy()
            stop[long] = ends[first[long] + k - 1]
            runs = pc.run_end_encode(_taken(data, offs[:-1], stop), run_end_type=pa.int64())
            until = runs.run_ends.to_numpy()
            begin = np.concatenate([[0], until[:-1]])
            count, top, which = total[until] - total[begin], len(until) - 1, np.flatnonzero(long[begin])
            # Runs that neither continue what is open nor stay open are popped as they come.
            inner = which[(which > 0) & (which < top)]
            inner = inner[(depth[begin[inner]] > k) | (count[inner] >= FREQUENT)]
            for i in [x for x in (0,) if top >= 0] + inner.tolist() + [x for x in (top,) if top > 0]:
                value, d = runs.values[i].as_py(), int(depth[begin[i]])
                held = self.open.get(k)
                if held and held[0] == value:
                    self.open[k] = (value, held[1] + int(count[i]), d, k)
                else:
                    self._pop(k)
                    if long[begin[i]]:
                        self.open[k] = (value, int(count[i]), d, k)

    def popped(self) -> pa.RecordBatch:
        lang, phrase, f = [x[0] for x in self.out], [x[1][:-1].replace("\t", " ") for x in self.out], [x[2] for x in self.out]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(f, pa.int64())], ["lang", "phrase", "f"])


def prefix_counts(sorted_: DataFrame) -> DataFrame:
    """``lang, phrase, f`` of all prefixes of two words and more, of partitions of suffixes sorted in reverse:
    frequent ones, and all whose counts may be partial."""

    def run(batches):
        stack = Stack()
        for b in batches:
            if not b.num_rows:
                continue
            langs = pc.run_end_encode(b.column("lang"))
            at = 0
            for lang, until in zip(langs.values.to_pylist(), langs.run_ends.to_pylist()):
                some = b.slice(at, until - at)
                stack.push(lang, some.column("suffix"), some.column("depth").to_numpy(), some.column("n").to_numpy())
                at = until
            yield stack.popped()
        stack.close()
        yield stack.popped()

    return sorted_.select("lang", "suffix", "depth", "n").mapInArrow(run, "lang string, phrase string, f long")


def phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, f`` of all frequent phrases of up to LONGEST words, and ``lang, n``, the words of each
    language."""
    spark = docs.sparkSession
    words = stored(word_counts(docs), "words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 0
    frequent = words.where(F.col("f") >= FREQUENT)
    hot = _hashes(words.where(F.col("f") * HOT > F.lit(total))).toArrow()["h"].to_numpy().view(np.uint64)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SORTED))
    dealt = suffixes(docs, frequent, np.sort(hot)).repartition(parts, F.col("lang"), F.expr("substring_index(suffix, '\t', depth)"))
    counts = prefix_counts(dealt.sortWithinPartitions("lang", F.desc("suffix")))
    long = counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= FREQUENT)
    return stored(frequent.select("lang", F.col("word").alias("phrase"), "f").unionByName(long), "phrases"), sizes


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language."""
    grams, sizes = phrases(docs)
    words = F.split("phrase", " ")
    cand = grams.where(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("f").alias("a"), words.alias("w"))
    m = F.size("w")

    cuts = cand.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, m - F.col("k")), " ").alias("right"))
    part = lambda side, f: grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    score = F.expr(f"(cast({SCALE} as decimal(19, 0)) * cast(a as decimal(19, 0))) div cast(l + r as decimal(19, 0))")
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("b")).select("lang", "phrase", "b.*")

    # Shorter phrases of two words and more inside each candidate.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), m - 1), lambda j: F.transform(F.sequence(F.lit(1), m - j + 1), lambda i: F.array_join(F.slice("w", i, j), " "))))
    around = cand.where(m > 2).select("lang", F.col("a").alias("most"), F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < COVER * F.col("a")))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each part hold the first of the whole, and no task sees all of a language.
    first = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))
