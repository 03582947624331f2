"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words, without punctuation and case. In its template, numbers,
names (a capitalised word inside a sentence) and units (a unit word behind a number) are
replaced by typed placeholders. Windows of ``WINDOW`` neighbouring words are hashed both as
they are and as templates (those with fewer than ``LITERAL`` plain words are no evidence),
and the windows of documents are joined with those of benchmark items by hash.

For each document and item the windows that met are checked for slots: along one alignment
(one offset between the texts), equal values in the item's slots must stand for equal values
in the document, and different ones for different ones. An item counts as found if the
windows left cover at least ``COVER`` percent of its words, so a re-parameterised question
is found and a common turn of phrase is not, or if ``VERBATIM`` of its words in a row stand
there as they are. Items shorter than a window are matched as a whole, as they are and as
templates.

If the benchmark has at most ``FILTER_ROWS`` windows, their hashes are broadcast to spare
other windows the join; beyond that all windows are joined. The result is the same.

Edge cases: long texts are whole, and windows run over all of them; a word that may be several
kinds is the first of number, unit, name; null and empty texts hold nothing and are clean; null ids are ids like others; empty items match nothing; an
item that stands twice is found under each of its ids; repeated rows are one document each,
by id and text; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, long_hash, mix, windows

WINDOW = 6
LITERAL = 3
COVER = 50
VERBATIM = 13
#: Hashes of 8 bytes each.
FILTER_ROWS = 2_000_000

# Units that may stand behind a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces "
    "ml l liter liters litre litres gallon gallons cup cups "
    "s sec secs min mins h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh watt watts volt volts".split()
)
PLAIN, NUMBER, NAME, UNIT = range(4)
_NUMBER = re.compile(r"[+-]?[\d][\d.,:/]*(?:st|nd|rd|th|%)?$|[+-]?[$€£][\d][\d.,]*$")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_STOPS = tuple(".!?:;\n")
_MARKS = frozenset(".,!?;:|")
_TYPED = np.array([0, 0x1111111111111111, 0x2222222222222222, 0x3333333333333333], U64)


def _kind(raw: bytes) -> tuple[int, int, bool, bool]:
    """Hash of the bare word, its kind, whether it is empty, whether a sentence ends with it."""
    text = raw.decode("utf-8", "replace")
    bare, ends = text, False
    if not text.isalpha():
        bare = text[:-1] if text[:-1].isalpha() and text[-1:] in _MARKS else _EDGE.sub("", text)
        ends = text.rstrip("\"')]}»”’").endswith(_STOPS)
    if not bare:
        return 0, PLAIN, True, ends
    if bare[0].isdigit() and _NUMBER.match(bare):
        kind = NUMBER
    elif bare.lower() in UNITS:
        kind = UNIT
    elif bare[0].isupper() and bare[1:].islower():
        kind = NAME
    else:
        kind = PLAIN
    low = bare.casefold().encode()
    return xxhash.xxh64_intdigest(low), kind, False, ends


class _Cache(dict):
    """Number of a raw word in growing arrays of what is known of it."""

    def __init__(self):
        self.hash, self.kind, self.bare, self.ends = array("Q"), bytearray(), bytearray(), bytearray()

    def __missing__(self, raw: bytes) -> int:
        h, kind, empty, ends = _kind(raw)
        self.hash.append(h)
        self.kind.append(kind)
        self.bare.append(not empty)
        self.ends.append(ends)
        self[raw] = n = len(self.hash) - 1
        return n

    def fresh(self) -> None:
        if len(self) >= common.CACHE:
            self.clear()
            self.__init__()


_WORDS = _Cache()


class Template:
    """Words of some rows: plain and typed hashes, kinds, and for each its raw bytes."""

    def __init__(self, column: pa.Array):
        _WORDS.fresh()
        texts = [t.replace(b"\n", b" \n ") if b"\n" in t else t for t in column.fill_null("").cast(pa.binary()).to_pylist()]
        raw, first, starts = [], [0], []
        get = _WORDS.__getitem__
        ids: list[int] = []
        for t in texts:
            words = t.split()
            ids += map(get, words)
            raw += words
            first.append(len(ids))
        ids_ = np.array(ids, np.int64)
        known = (_WORDS.hash, U64), (_WORDS.kind, np.uint8), (_WORDS.bare, bool), (_WORDS.ends, bool)
        h, kind, bare, ends = (np.frombuffer(bytes(x), t)[ids_] for x, t in known)
        first = np.array(first)
        opens = np.zeros(len(ids_) + 1, bool)  # at the start of a text or behind the end of a sentence
        opens[first] = True
        opens[1:] |= np.append(ends[:-1], True) if len(ends) else opens[1:]
        # A mark of its own passes the start of a sentence on to the next word.
        keep = np.flatnonzero(bare)
        run = np.cumsum(opens[: len(ids_)])
        opened = np.ones(len(keep), bool)
        opened[1:] = run[keep[1:]] > run[keep[:-1]]
        kind = kind[keep]
        kind[(kind == NAME) & opened] = PLAIN
        kind[1:][(kind[1:] == UNIT) & (kind[:-1] != NUMBER)] = PLAIN
        kind[:1][kind[:1] == UNIT] = PLAIN
        self.raw = raw
        self.keep = keep
        self.kind = kind
        self.plain = mix(h[keep])
        self.typed = np.where(kind == PLAIN, self.plain, _TYPED[kind])
        self.first = np.searchsorted(keep, first)

    def values(self, a: int, b: int) -> list[str]:
        """What the words a..b-1 say, bare."""
        return [_EDGE.sub("", self.raw[i].decode("utf-8", "replace")).casefold() for i in self.keep[a:b]]


def _windows(t: Template, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hash, row and first word of all windows, as they are and then as templates."""
    out = []
    slots = np.concatenate([[0], np.cumsum(t.kind != PLAIN)])
    for typed, h in ((False, t.plain), (True, t.typed)):
        w, at = windows(h, t.first, n)
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        word = np.arange(len(w)) - at[row] + t.first[row]
        if typed:
            count = slots[word + n] - slots[word]
            some = (count > 0) & (n - count >= LITERAL)
            w, row, word = w[some] ^ U64(1), row[some], word[some]
        out.append((w, row, word))
    return out


_SCHEMA = "id long, tag long, hash long, at long, n_words long, kinds array<int>, values array<string>"


def window_rows(rows: DataFrame, n: int, whole: bool, wanted=None) -> DataFrame:
    """``id, tag`` (of the text), ``hash, at, n_words, kinds, values`` for the windows of
    ``rows(id, tag, text)``; with ``wanted`` (sorted hashes in a broadcast) for those in it."""

    def run(batch):
        t = Template(batch.column("text"))
        parts = _windows(t, n)
        if whole:  # short items are a window by themselves
            for i in np.flatnonzero((np.diff(t.first) < n) & (np.diff(t.first) > 0)):
                k = int(t.first[i + 1] - t.first[i])
                parts.append((windows(t.plain, t.first[i : i + 2], k)[0], np.array([i]), t.first[i : i + 1]))
                slots = int((t.kind[t.first[i] : t.first[i + 1]] != PLAIN).sum())
                if slots and k - slots >= LITERAL:
                    parts.append((windows(t.typed, t.first[i : i + 2], k)[0] ^ U64(1), np.array([i]), t.first[i : i + 1]))
        h, row, word = (np.concatenate(x) for x in zip(*parts))
        if wanted is not None:
            keys = wanted.value
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            h, row, word = h[hit], row[hit], word[hit]
        size = np.diff(t.first)
        span = np.minimum(n, size[row])
        kinds = [t.kind[a : a + k].tolist() for a, k in zip(word, span)]
        values = [t.values(a, a + k) if any(x) else None for a, k, x in zip(word, span, kinds)]
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(take), batch.column("tag").take(take), pa.array(long_hash(h)), pa.array((word - t.first[row]).astype(np.int64)), pa.array(size[row].astype(np.int64)), pa.array(kinds, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.string()))],
            ["id", "tag", "hash", "at", "n_words", "kinds", "values"],
        )

    return common.text_rows(rows, run, _SCHEMA)


def _consistent(rows: list) -> tuple[set[int], set[int]]:
    """Of windows on one alignment, the item's words covered by those whose slots agree with the slots
    before them (one value there for one value here, both ways), and those that stand as they are."""
    there, here, covered, verbatim = {}, {}, set(), set()
    for r in sorted(rows, key=lambda r: r.at):
        slots = r.values is not None and r.item_values is not None
        new = [(k, a, b) for k, a, b in zip(r.kinds, r.item_values, r.values) if k != PLAIN] if slots else []
        if any(there.get((k, a), b) != b or here.get((k, b), a) != a for k, a, b in new) or len({(k, a) for k, a, _ in new}) != len({(k, b) for k, _, b in new}):
            continue
        for k, a, b in new:
            there[k, a], here[k, b] = b, a
        span = range(r.item_at, r.item_at + len(r.kinds))
        covered.update(span)
        if all(a == b for _, a, b in new):
            verbatim.update(span)
    return covered, verbatim


def _longest(words: set[int]) -> int:
    """The most numbers in a row."""
    best = 0
    for w in words:
        if w - 1 not in words:
            end = w
            while end + 1 in words:
                end += 1
            best = max(best, end - w + 1)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, cover: int = COVER) -> DataFrame:
    """``doc_id, tag, item_id, n_words`` (of the item), ``n_covered, changed`` (whether slots
    differ) for the items found in ``docs(doc_id, text)``."""
    text = F.col("text").cast("string").alias("text")
    tag = F.xxhash64(F.col("text").cast("string")).alias("tag")
    # Items of one text are looked for once, and found under each of their ids.
    names = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tag.alias("rep"))
    items = common.stored(window_rows(benchmark.select(tag.alias("id"), F.lit(0).cast("long").alias("tag"), text).distinct(), n, True), "items")
    spark = docs.sparkSession
    short = [r[0] for r in items.where(F.size("kinds") < n).select(F.size("kinds")).distinct().collect()]
    wanted = None
    if items.count() <= FILTER_ROWS:
        wanted = spark.sparkContext.broadcast(np.unique(items.select("hash").distinct().toArrow()["hash"].to_numpy().view(U64)))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), tag, text)
    seen = window_rows(rows, n, False, wanted)
    for k in short:  # at most n - 1 lengths
        seen = seen.unionByName(window_rows(rows, k, False, wanted))
    item = items.select("hash", F.col("id").alias("rep"), F.col("at").alias("item_at"), F.col("n_words").alias("item_words"), F.col("kinds").alias("item_kinds"), F.col("values").alias("item_values"))
    hits = seen.join(item, "hash").where(F.size("kinds") == F.size("item_kinds"))

    def check(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        covered: set[int] = set()
        by_offset: dict[int, list] = {}
        for r in group.itertuples():
            by_offset.setdefault(r.at - r.item_at, []).append(r)
        longest = 0
        for aligned in by_offset.values():
            some, same = _consistent(aligned)
            covered |= some
            longest = max(longest, _longest(same))
        size = int(group["item_words"].iloc[0])
        if 100 * len(covered) < cover * size and longest < VERBATIM:
            return pd.DataFrame({"n_words": [], "n_covered": [], "changed": []}).assign(doc_id=[], tag=[], rep=[])
        changed = any(r.values is not None and list(r.values) != list(r.item_values) for r in group.itertuples() if r.item_values is not None)
        return pd.DataFrame({"doc_id": [key[0]], "tag": [key[1]], "rep": [key[2]], "n_words": [size], "n_covered": [len(covered)], "changed": [changed]})

    found = hits.groupBy("id", "tag", "rep").applyInPandas(check, "doc_id long, tag long, rep long, n_words long, n_covered long, changed boolean")
    return found.join(names, "rep").select("doc_id", "tag", "item_id", "n_words", "n_covered", "changed")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their own columns."""
    found = leaks(docs, benchmark).select("doc_id", "tag").distinct()
    tag = F.xxhash64(F.col("text").cast("string"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (tag == found["tag"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold which items; one row each."""
    found = leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "n_words", "n_covered", "changed")
