"""Removal of repeated line chunks with content-defined boundaries.

A text is its lines (split at the newline). Lines are hashed, and hashes of two lines at a time roll
over the text: a line whose hash is not larger than that of the line before it ends a run of lines, so
that boundaries follow the content and a passage is cut alike wherever it stands. Each run is cut into
pairs of lines from both its ends (which differ in runs of odd length, so that neither end of a
passage depends on what stands beyond it); a run of one line makes a pair with the line before it.
This is done with hashes of three seeds: the last line of a short passage is cut off or not by what
follows it, which one rolling hash decides for one of two places otherwise than for the other.
So chunks cover their text and may share a line. Of the chunks with equal bytes in all documents,
the first (by id, then place) stays and the others are removed: hashes and lengths find
candidates, and their bytes are compared with the first one's. The first place of a line is in no
later copy, so no line vanishes from all documents.

A passage goes as far as whole chunks lie in it; a short one is in none where all seeds cut it.
``cleaned``, the pipeline's form, takes the whole runs between the boundaries of one seed as chunks (``runs``;
each begins with the line that ended the one before it, so that every pair of neighbouring lines lies in
one), and an exact check follows: of chunks that stand for the first time, and of these only, the pairs of
neighbouring lines are compared. So each repeated passage of ``LINES`` lines or more goes from its first line to
its last, wherever boundaries are; a line that stands for the first time stays.

Texts of one line and chunks without a word are never removed. Only chunks whose hash repeats move
their text; equal hashes are counted before the shuffle, and a hash as common as it may be meets
one row, the first chunk.

Edge cases: a text that loses a chunk loses the newlines at its end, too, any other stays as it is;
a long text is whole, and its chunks are pieces of bytes; of equal chunks the one of the smallest id, then
the first place, stays; a null text stays null and an empty one empty; rows repeated with equal id and
text are one document and stay alike; a null id sorts first and is a document as any other;
an empty table gives an empty result; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, long_hash, span_hashes, stored

LINES = 2

#: Of rolling hashes, each with boundaries of its own: a passage that one of them cuts through, another keeps.
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _lines(column: pa.Array) -> tuple[np.ndarray, ...]:
    """The bytes, and row, first byte, end (past the newline) and end of the body of the lines."""
    data, offs = common.buffers(column)
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    first[np.flatnonzero(data == 10) + 1] = True
    start = np.flatnonzero(first[:-1])  # each byte run that ends with a newline or its text
    end = np.append(start[1:], len(data)) if len(start) else start
    row = np.searchsorted(offs, start, "right") - 1
    return data, row, start, end, np.where(data[end - 1] == 10, end - 1, end)


def _boundaries(h: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which lines end a run: those with a hash not larger than the one before, and the last ones."""
    cut = np.append(fresh[1:], True)
    cut[1:] |= ~fresh[1:] & (h[1:] <= h[:-1])
    return cut


def _closes(h: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Which lines close a chunk: runs are cut in pairs from both ends."""
    cut = _boundaries(h, fresh)
    # Places in the run of lines between two boundaries, from either end.
    ends = np.flatnonzero(cut)
    size = np.diff(ends, prepend=-1)
    left = np.repeat(ends, size) - np.arange(len(h))
    place = np.repeat(size, size) - left
    return np.where(place >= LINES, (left % LINES == 0) | (place % LINES == 0), cut & ~fresh)


def chunks(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, first byte, end (past the newline), number of lines and hash of the chunks; they may
    share lines."""
    data, row, start, end, body = _lines(column)
    if not len(start):
        e = np.empty(0, np.int64)
        return e, e, e, e, e.view(U64)
    h = span_hashes(data, start, body)
    fresh = np.append(True, row[1:] != row[:-1])  # first line of a text
    closes = np.zeros(len(h), bool)
    for seed in SEEDS:
        closes |= _closes(common.mix(h ^ U64(seed)), fresh)
    ends = np.flatnonzero(closes)
    begins = ends - LINES + 1
    a = start[begins]
    return row[begins], a, end[ends], np.full(len(begins), LINES), span_hashes(data, a, body[ends])


def runs(column: pa.Array) -> tuple[np.ndarray, ...]:
    """As ``chunks``, the whole runs of lines between boundaries, each from the line that ended the one before it
    on; and first byte, size and hash of the pairs of neighbouring lines in them, one run after the other. Each pair
    with a word is in one run; one without parts runs and is in none."""
    data, row, start, end, body = _lines(column)
    if not len(start):
        e = np.empty(0, np.int64)
        return e, e, e, e, e.view(U64), (e, e, e.view(U64))
    words = np.concatenate([[0], np.cumsum(~common._SPACE[data])])
    blank = words[end] == words[start]
    fresh = np.append(True, (row[1:] != row[:-1]) | (blank[1:] & blank[:-1]))
    ends = np.flatnonzero(_boundaries(common.mix(span_hashes(data, start, body) ^ U64(SEEDS[0])), fresh))
    begins = np.append(0, ends[:-1] + 1)
    begins -= ~fresh[begins]
    begins, ends = begins[ends > begins], ends[ends > begins]
    a, of = start[begins], np.flatnonzero(~fresh[1:])
    inner = start[of], body[of + 1] - start[of], span_hashes(data, start[of], body[of + 1])
    return row[begins], a, end[ends], ends - begins + 1, span_hashes(data, a, body[ends]), inner


def _key(docs: DataFrame) -> DataFrame:
    """``_row, doc_id, text`` and ``_doc``, a document's key: the hash of its id and text."""
    parts = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return parts.withColumn("_doc", F.xxhash64("doc_id", "text"))


def _spans(docs: DataFrame) -> DataFrame:
    """``doc, id, at, size, hash`` of the chunks of several lines with a word in them."""

    def run(batch):
        row, a, b, lines, h = chunks(batch.column("text"))
        data, offs = common.buffers(batch.column("text"))
        words = np.concatenate([[0], np.cumsum(~common._SPACE[data])])
        pick = (lines >= LINES) & (words[b] > words[a]) if len(row) else np.zeros(0, bool)
        row, a, b, h = row[pick], a[pick], b[pick], h[pick]
        take = pa.array(row)
        size = np.where(data[b - 1] == 10, b - 1, b) - a if len(row) else a
        yield pa.RecordBatch.from_arrays([batch.column("_doc").take(take), batch.column("doc_id").take(take), pa.array(a - offs[row]), pa.array(size.astype(np.int64)), pa.array(long_hash(h))], ["doc", "id", "at", "size", "hash"])

    return common.text_rows(docs.select("_doc", F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc long, id long, at long, size long, hash long")


def _run_spans(docs: DataFrame) -> DataFrame:
    """``doc, id, at, size, hash, pairs`` of the runs, with ``at, size, hash`` of their pairs of lines."""

    def run(batch):
        row, a, b, lines, h, (p, p_size, p_hash) = runs(batch.column("text"))
        data, offs = common.buffers(batch.column("text"))
        take = pa.array(row)
        size = np.where(data[b - 1] == 10, b - 1, b) - a if len(row) else a
        pair = pa.StructArray.from_arrays([pa.array(p - np.repeat(offs[row], lines - 1)), pa.array(p_size), pa.array(long_hash(p_hash))], ["at", "size", "hash"])
        own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lines - 1)).astype(np.int32)), pair)
        yield pa.RecordBatch.from_arrays([batch.column("_doc").take(take), batch.column("doc_id").take(take), pa.array(a - offs[row]), pa.array(size.astype(np.int64)), pa.array(long_hash(h)), own], ["doc", "id", "at", "size", "hash", "pairs"])

    return common.text_rows(docs.select("_doc", F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc long, id long, at long, size long, hash long, pairs array<struct<at: long, size: long, hash: long>>")


def _often(spans: DataFrame) -> DataFrame:
    """``hash, size`` of what stands more than once."""
    return spans.groupBy("hash", "size").agg(F.count("*").alias("n")).where("n > 1").select("hash", "size")


def _again(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``doc, at, size, o``: those of ``candidates(doc, id, at, size, hash)`` whose bytes are those of the first one
    with their hash and size, and its place ``o`` (id, at, doc)."""
    wanted = candidates.groupBy(F.col("doc").alias("_doc")).agg(F.first("id").alias("id"), F.collect_list(F.struct("at", "size", "hash")).alias("spans"))  # of one document
    held = common.matching(docs.select("_doc", F.col("text").cast("string").alias("text")), wanted, "_doc")
    held = held.dropDuplicates(["_doc"]).select(F.col("_doc").alias("doc"), "id", F.col("text").cast("binary").alias("text"), F.explode("spans").alias("s"))
    held = held.select("doc", "id", "s.at", "s.size", "s.hash", F.substring("text", F.col("s.at").cast("int") + 1, F.col("s.size").cast("int")).alias("bytes"))
    held = stored(held, "chunktexts")
    order = F.struct("id", "at", "doc")
    firsts = held.groupBy("hash", "size").agg(F.min(F.struct(order.alias("o"), "bytes")).alias("f")).select("hash", "size", F.col("f.o").alias("o"), F.col("f.bytes").alias("first"))
    return held.join(firsts, ["hash", "size"]).where((F.col("bytes") == F.col("first")) & (order != F.col("o"))).select("doc", "at", "size", "o")


def _lost(again: DataFrame) -> DataFrame:
    """``doc, at, end`` of what goes. A pair of equal lines that overlaps its first, in a run of such lines, goes
    from where that ends; longer ones share no more than a line that is in a repeated pair itself."""
    over = (F.col("doc") == F.col("o.doc")) & (2 * (F.col("at") - F.col("o.at")) == F.col("size") + 1)
    return again.select("doc", F.when(over, F.col("o.at") + F.col("size") + 1).otherwise(F.col("at")).alias("at"), (F.col("at") + F.col("size")).alias("end"))


def _merged(lost: DataFrame) -> DataFrame:
    """``doc, spans``: for each document that loses pieces, first bytes and sizes; pieces that
    overlap or follow each other make up one."""
    lost = lost.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("s"))
    starts = F.expr("filter(s, (x, i) -> i = 0 or x.at > s[i - 1].end + 1)")
    ends = F.expr("filter(s, (x, i) -> i = size(s) - 1 or s[i + 1].at > x.end + 1)")
    return lost.select("doc", F.zip_with(starts, ends, lambda x, y: F.struct(x["at"].alias("at"), (y["end"] - x["at"]).alias("size"))).alias("spans"))


def _removals(docs: DataFrame) -> DataFrame:
    """The spans of repeated chunks."""
    spans = stored(_spans(docs).dropDuplicates(["doc", "at"]), "chunks")
    return _merged(_lost(_again(docs, stored(spans.join(_often(spans), ["hash", "size"]), "candidates"))))


def _rest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repeated runs, as ``_again`` tells them, and ``doc, id, at, size, hash`` of the pairs of lines of all others.
    The first place of a pair is in the first one of its runs, so nothing is missed."""
    spans = stored(_run_spans(docs), "chunks")
    spans = stored(spans.join(_often(spans).withColumn("often", F.lit(True)), ["hash", "size"], "left"), "runs")
    # Rows that repeat have runs that do.
    candidates = stored(spans.where("often").drop("often").dropDuplicates(["doc", "at"]), "candidates")
    again = stored(_again(docs, candidates.drop("pairs")), "again")
    new = spans.where("often is null").drop("often").unionByName(candidates.join(again.select("doc", "at"), ["doc", "at"], "left_anti"))
    return again, new.select("doc", "id", F.explode("pairs").alias("p")).select("doc", "id", "p.at", "p.size", "p.hash")


def _exact_removals(docs: DataFrame) -> DataFrame:
    """The spans of repeated runs, and of the repeated pairs of lines in others."""
    again, pairs = _rest(docs)
    pairs = stored(pairs, "pairs")
    checked = _again(docs, stored(pairs.join(_often(pairs), ["hash", "size"]), "candidates"))
    return _merged(_lost(again).unionByName(_lost(checked)))


def deduplicated(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` without repeated chunks, and ``removed``: the spans of bytes
    (``at, size``) that went, null if none did. If ``exact``, chunks are whole runs, and the pairs of lines of
    those that are not repeated are compared, too."""
    names = docs.columns
    keyed = _key(docs)
    cut = stored(_exact_removals(keyed) if exact else _removals(keyed), "removals")
    near, rest = common.split(keyed, cut.select(F.col("doc").alias("_doc")), "_doc")
    near = near.join(cut, F.col("_doc") == F.col("doc"), "left").drop("doc")
    data = F.col("text").cast("string").cast("binary")
    # What lies between removed chunks stays, with its newlines.
    bounds = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["at"] + s["size"] + 1))
    until = F.concat(F.transform("spans", lambda s: s["at"]), F.array(F.octet_length(data).cast("long")))
    parts = F.transform(F.arrays_zip(bounds.alias("a"), until.alias("b")), lambda p: F.substring(data, p["a"].cast("int") + 1, F.greatest(p["b"] - p["a"], F.lit(0)).cast("int")).cast("string"))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.rtrim(F.array_join(parts, ""), F.lit("\n")))
    own = lambda new: [new.alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names]
    near = near.select(*own(text), F.col("spans").alias("removed"))
    return near.unionByName(rest.select(*own(F.col("text")), F.lit(None).cast(near.schema["removed"].dataType).alias("removed")))


def cleaned(docs: DataFrame) -> DataFrame:
    """The pipeline's form: no line of a repeated pair of lines is left, but where it stands first.
    The documents' columns, with ``n_chars`` of the new text; those of which nothing is left go
    (all their text stands in others)."""
    out = deduplicated(docs, exact=True)
    empty = F.col("removed").isNotNull() & (F.length(F.trim(F.translate("text", "\n\r\t", "   "))) == 0)
    names = [F.when(F.col("removed").isNull(), F.col(c)).otherwise(F.length("text")).cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.where(~empty).select(*names)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated chunks; ``n_removed`` runs of lines went, ``removed_bytes`` long."""
    out = deduplicated(common.documents(spark, sf_dir))
    return out.select("doc_id", "text", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["size"]), F.lit(0)).alias("removed_bytes"))
