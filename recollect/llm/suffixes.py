"""Repeated passages by a sparse suffix array over minimiser positions.

A text is its words (A-Z lower-cased, ASCII white space between them). Of every ``PASSAGE``
neighbouring words the position of the least hash of ``ANCHOR`` words is selected, so equal
passages of that length hold an equally placed selected position. Only the suffixes at
selected positions are retained, and of these only the ones whose first ``ANCHOR`` words
occur in a second document.

Suffixes with the same words around them, as far as a passage may reach, are one: positions are
grouped by a hash of that context before any text moves, and a context of two documents or more is
a repeat as a whole. The others are sorted by their words and each is compared with its nearest
neighbours of another document on both sides; the longest common beginning is the match to the
right. Matches are extended to the left word by word: after each, suffixes with another word there
part, those left stand in sorted order still, and are compared with their neighbours again, as the
nearest one to the right need not share most to the left. So a run of ``PASSAGE`` words or more
that stands in two documents is found in each of them, and none is found that does not.

Suffixes with one beginning are sorted in one task up to ``RUN`` of them. More are parted by longer
ones: two that share ``PASSAGE`` words share either some words more to the left or some more to the
right, so each goes to a group of both kinds, again and again until groups are small or share a
whole passage. Such a group needs no sorting: it is counted before the shuffle.

Words are compared by hashes. Edge cases: null, empty and short texts (fewer words than a
passage) hold no passage; rows repeated with equal id and text are one document, and a
passage repeated only inside one document is not reported; equal texts under different ids
repeat each other; a null id is an id like others; a long text is whole, and of one word over and
over only some positions are kept, which cover it; equal contexts have no order among each other,
so ties do not matter; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, Words, long_hash, mix, stored, windows

PASSAGE = 50
ANCHOR = 25
#: Suffixes with one beginning that a task takes at once, at most.
RUN = 20_000


def selected(w: Words, passage: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word position in the row and anchor hash of the selected positions."""
    h, at = windows(w.hash, w.first, anchor)
    span = passage - anchor + 1
    if len(h) < span:
        e = np.empty(0, np.int64)
        return e, e, e.view(U64)
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    least = np.argmin(view, axis=1) + np.arange(len(view))
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[: len(view)] == row[span - 1 :]
    pick = np.unique(least[inside])
    # One word over and over selects every position: of such a run the ends and some between stay.
    same = np.zeros(len(pick) + 1, bool)
    same[1:-1] = (np.diff(pick) == 1) & (h[pick[1:]] == h[pick[:-1]]) & (row[pick[1:]] == row[pick[:-1]])
    first = np.maximum.accumulate(np.where(~same[:-1], np.arange(len(pick)), 0)) if len(pick) else pick
    pick = pick[~same[:-1] | ~same[1:] | ((np.arange(len(pick)) - first) % span == 0)]
    return row[pick], pick - at[row[pick]], h[pick]


def _contexts(w: Words, row: np.ndarray, pos: np.ndarray, passage: int, anchor: int) -> np.ndarray:
    """Hashes of the words around positions: before, as far as a passage may reach, and from there on."""
    at = w.first[row] + pos
    low, high = np.maximum(at - (passage - anchor), w.first[row]), np.minimum(at + passage, w.first[row + 1])
    up, down = common._powers(len(w.hash) + 1)
    sums = np.empty(len(w.hash) + 1, U64)
    sums[0] = 0
    np.cumsum(mix(w.hash) * up[: len(w.hash)], out=sums[1:])
    with np.errstate(over="ignore"):
        left, right = (sums[at] - sums[low]) * down[low], (sums[high] - sums[at]) * down[at]
        return mix(mix(left + (at - low).astype(U64)) * U64(0x9FB21C651E98DF25) + mix(right + (high - at).astype(U64)))


def _anchors(docs: DataFrame, passage: int, anchor: int) -> DataFrame:
    def run(batch):
        w = Words(*common.buffers(batch.column("text")))
        row, pos, h = selected(w, passage, anchor)
        around = _contexts(w, row, pos, passage, anchor)
        yield pa.RecordBatch.from_arrays([batch.column("_doc").take(pa.array(row)), pa.array(pos.astype(np.int32)), pa.array(long_hash(h)), pa.array(long_hash(around))], ["doc", "pos", "hash", "context"])

    return common.text_rows(docs.select("_doc", "text"), run, "doc long, pos int, hash long, context long")


_SUFFIX = "key long, a int, b int, context long, doc long, many boolean, left binary, right binary"


def _suffixes(docs: DataFrame, passage: int, anchor: int) -> DataFrame:
    """The suffix of each wanted context, in the group of its anchor: the words before it (the nearest
    first) and from it on, as 32-bit hashes; ``a`` and ``b`` words to both sides are those of its group."""
    back = passage - anchor

    def run(batch):
        w = Words(*common.buffers(batch.column("text")))
        small = (w.hash >> U64(32)).astype("<u4")
        lists = batch.column("wanted")
        offs = lists.offsets.to_numpy()
        flat = lists.flatten()
        pos = flat.field("pos").to_numpy()
        row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        left, right = [], []
        for r, p in zip(row.tolist(), pos.tolist()):
            x, y = w.first[r], w.first[r + 1]
            left.append(small[max(x, x + p - back) : x + p][::-1].byteswap().tobytes())
            right.append(small[x + p : min(y, x + p + passage)].byteswap().tobytes())  # so that bytes sort as numbers
        n = len(row)
        arrays = [flat.field("hash"), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, anchor, np.int32)), flat.field("context"), batch.column("_doc").take(pa.array(row)), flat.field("many"), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _SUFFIX.split(", ")])

    return common.text_rows(docs, run, _SUFFIX)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of 32-bit numbers, padded with 0, and their lengths."""
    data, offs = common.buffers(column)
    size = np.diff(offs) // 4
    out = np.zeros((len(size), width), np.uint32)
    out[np.arange(width) < size[:, None]] = np.ascontiguousarray(data).view(">u4")
    return out, size


class Suffixes:
    """A piece of the suffix array: suffixes of some groups, sorted by group and words."""

    def __init__(self, table: pa.Table, passage: int, anchor: int):
        column = lambda c: table[c].combine_chunks()
        self.key, self.doc, self.context, self.a, self.b = (column(c).to_numpy() for c in ("key", "doc", "context", "a", "b"))
        self.many = column("many").to_numpy(zero_copy_only=False)
        self.left, self.n_left = _matrix(column("left"), passage - anchor)
        right, self.n_right = _matrix(column("right"), passage)
        self.passage = passage
        # Common beginnings of neighbours, and the least of them over 1, 2, 4 ... in a row.
        same = (right[1:] == right[:-1]) & (np.arange(passage) < np.minimum(self.n_right[1:], self.n_right[:-1])[:, None])
        common_ = np.where(same.all(1), passage, np.argmin(same, 1)) if len(same) else np.zeros(0, np.int64)
        common_ = np.where(self.key[1:] == self.key[:-1], common_, 0)
        self.least = [common_]
        while 2 << (len(self.least) - 1) <= len(common_):
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-step], last[step:]))

    def beginning(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from the position on the suffixes ``i`` < ``j`` share."""
        out = np.empty(len(i), np.int64)
        level = np.frexp((j - i).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.least[k][i[at]], self.least[k][j[at] - (1 << k)])
        return out

    def neighbours(self, place: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For sorted suffixes ``place`` in groups, the most words that each shares with one of another
        document in its group: with the nearest before or the nearest behind it."""
        n = len(place)
        at = np.arange(n)
        doc, many = self.doc[place], self.many[place]
        new = np.append(True, (doc[1:] != doc[:-1]) | many[1:] | many[:-1])
        before = np.maximum.accumulate(np.where(new, at, 0)) - 1
        behind = n - np.maximum.accumulate(np.where(np.append(new[1:], True)[::-1], at, 0))[::-1]
        best = np.zeros(n, np.int64)
        for other, first in ((before, False), (behind, True)):
            ok = np.flatnonzero((other >= 0) & (other < n))
            ok = ok[group[other[ok]] == group[ok]]
            x, y = (place[ok], place[other[ok]]) if first else (place[other[ok]], place[ok])
            best[ok] = np.maximum(best[ok], self.beginning(x, y))
        return best

    def extents(self) -> tuple[np.ndarray, np.ndarray]:
        """Words before and from each position on that matches of a passage or more reach; 0, 0 for none."""
        back, ahead = np.zeros(len(self.key), np.int64), np.zeros(len(self.key), np.int64)
        place = np.arange(len(self.key))
        group = np.cumsum(np.append(0, self.key[1:] != self.key[:-1])) if len(place) else place
        for k in range(self.left.shape[1] + 1):
            if k:
                fit = self.n_left[place] >= k
                place, group, word = place[fit], group[fit], self.left[place[fit], k - 1]
                order = np.lexsort((word, group))  # stable: the sorted order stays within a word
                place, group, word = place[order], group[order], word[order]
                parts = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1])) if len(place) else np.zeros(0, bool)
                group = np.cumsum(parts) - 1
                size = np.bincount(group) if len(group) else group
                lone = size[group] < 2
                place, group = place[~lone], group[~lone]
            if not len(place):
                break
            right = self.neighbours(place, group)
            hit = (k + right >= self.passage) & (k >= self.a[place])
            at = place[hit]
            back[at], ahead[at] = np.maximum(back[at], k), np.maximum(ahead[at], right[hit])
        whole = self.many & (self.n_left + self.n_right >= self.passage)  # repeated with all that is around it
        return np.where(whole, self.n_left, back), np.where(whole, self.n_right, ahead)


_EXTENT = "context long, back int, ahead int"


def _extents(held: list, passage: int, anchor: int) -> pa.RecordBatch:
    s = Suffixes(pa.Table.from_batches(held), passage, anchor)
    back, ahead = s.extents()
    found = np.flatnonzero(back + ahead)
    return pa.RecordBatch.from_arrays([pa.array(s.context[found]), pa.array(back[found].astype(np.int32)), pa.array(ahead[found].astype(np.int32))], ["context", "back", "ahead"])


def _sorted(suffixes: DataFrame, passage: int, anchor: int, run: int) -> DataFrame:
    """The suffix array, some groups at once, and what its neighbours share."""

    def work(batches):
        held, size = [], 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            if size + len(key) >= run:  # work on what is complete: all but the last group
                cut = len(key) - int((key == key[-1]).sum())
                if cut:
                    yield _extents([*held, batch.slice(0, cut)], passage, anchor)
                    held, size, batch = [], 0, batch.slice(cut)
                elif held and held[-1].column("key")[-1].as_py() != key[0]:
                    yield _extents(held, passage, anchor)
                    held, size = [], 0
            held.append(batch)
            size += batch.num_rows
        if size:
            yield _extents(held, passage, anchor)

    return suffixes.repartition("key").sortWithinPartitions("key", "right", "context").mapInArrow(work, _EXTENT)


def _parted(groups: DataFrame, passage: int) -> DataFrame:
    """The suffixes of groups that share ``a`` and ``b`` words to both sides, each in the two groups that
    share more; one that ends before that is in none."""
    gap = passage - F.col("a") - F.col("b")
    half = F.ceil(gap / 2).cast("int")
    ways = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b")), F.struct(F.col("a"), (F.col("b") + gap - half + 1).alias("b")))).alias("w")
    more = groups.select("key", ways, "context", "doc", "many", "left", "right").where("length(left) >= 4 * w.a and length(right) >= 4 * w.b")
    key = F.xxhash64("key", "w.a", "w.b", F.expr("substring(left, 1, 4 * w.a)"), F.expr("substring(right, 1, 4 * w.b)"))
    return more.select(key.alias("key"), "w.a", "w.b", "context", "doc", "many", "left", "right")


def _reach(suffixes: DataFrame, passage: int, anchor: int, run: int) -> DataFrame:
    """``context, back, ahead``: how far the matches of each context reach."""
    sizes = suffixes.groupBy("key").agg(F.count("*").alias("n"))
    found = None
    while True:
        hot = stored(sizes.where(F.col("n") > run).select("key"), "hot")
        some = _sorted(suffixes.join(hot, "key", "left_anti"), passage, anchor, run)
        found = some if found is None else found.unionByName(some)
        if hot.isEmpty():
            return found
        parts = stored(_parted(suffixes.join(hot, "key", "left_semi"), passage), "parted")
        # Groups that share a whole passage are found by counting.
        whole = parts.where(F.col("a") + F.col("b") >= passage)
        twice = whole.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max("many").alias("m")).where("low <> high or m").select("key")
        found = found.unionByName(whole.join(twice, "key").select("context", F.col("a").alias("back"), F.col("b").alias("ahead")))
        suffixes = parts.where(F.col("a") + F.col("b") < passage)
        sizes = suffixes.groupBy("key").agg(F.count("*").alias("n"))


_SPAN = "doc long, start int, end int"


def _merged(doc, start, end) -> pa.RecordBatch:
    """Overlapping spans of one document as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if len(doc):
        # The furthest end so far within the document; documents are told apart by a large step.
        rank = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
        step = np.int64(1) << 32
        reach = np.maximum.accumulate(end + rank * step)
        first = np.flatnonzero(np.append(True, start[1:] + rank[1:] * step > reach[:-1]))
        last = np.append(first[1:], len(doc)) - 1
        doc, start, end = doc[first], start[first], reach[last] - rank[last] * step
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["doc", "start", "end"])


def repeats(docs: DataFrame, passage: int = PASSAGE, anchor: int = ANCHOR, run: int = RUN) -> DataFrame:
    """``doc_id, start, n_words``: the maximal spans of words of each document that are covered
    by passages of ``passage`` words or more which stand in another document, too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("_doc", F.xxhash64("doc_id", "text"))
    spots = stored(_anchors(docs, passage, anchor), "anchors")
    often = stored(spots.groupBy("hash").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("hash"), "often")
    spots = stored(spots.join(often, "hash"), "spots")
    first = F.min(F.struct("doc", "pos"))
    contexts = spots.groupBy("hash", "context").agg(first.alias("f"), F.max("doc").alias("high")).select("hash", "context", "f.doc", "f.pos", (F.col("f.doc") != F.col("high")).alias("many"))
    wanted = stored(contexts.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("pos", "hash", "context", "many")).alias("wanted")), "wanted")  # of one document
    near = common.matching(docs.select("_doc", "text"), wanted, "_doc").dropDuplicates(["_doc"])
    suffixes = stored(_suffixes(near, passage, anchor), "suffixes")
    reach = stored(_reach(suffixes, passage, anchor, run).where(F.col("back") + F.col("ahead") >= passage), "reach")
    spans = spots.join(reach, "context").select("doc", (F.col("pos") - F.col("back")).alias("start"), (F.col("pos") + F.col("ahead")).alias("end"))
    spans = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one document

    def merge(batches):
        for batch in batches:
            lists = batch.column("spans")
            flat = lists.flatten()
            doc = np.repeat(batch.column("doc").to_numpy(), np.diff(lists.offsets.to_numpy()))
            yield _merged(doc, flat.field("start").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64))

    ids = docs.select(F.col("_doc").alias("doc"), "doc_id").distinct()
    return spans.mapInArrow(merge, _SPAN).join(ids, "doc").select("doc_id", "start", (F.col("end") - F.col("start")).alias("n_words"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.documents(spark, sf_dir))
