"""Filter interaction audit: what five filters remove in each of their 120 orders.

A document fails a set of the filters, its mask; the orders only see how many documents of a
part have each mask (and of these, how many are good or toxic by ``labels``), so the corpus is
read once and every part comes down to at most 128 cells.

*Adjacent transpositions.* The orders of the filters are visited by plain changes, each one swap
of neighbours away from the last. A swap leaves what stands before and after it as it was, so only
its two steps are counted anew, from the mask cells; the others keep their numbers. What each filter
removes is added up along the walk, which is its Shapley value times 120.

*Copies.* A text is a copy if a smaller id has an equal one: the smallest id of every digest
(SHA-256) is found by a partial aggregate, so that a large group of copies is a row a task, and is
joined back by id and digest, so that the group's rows stay spread.

Edge cases: a null or empty text has no words and no code points: it fails A only, and E if
a smaller id has no text either; a null language is the part ``''``, as is an empty one; a null id is
smaller than none and larger than none: its row fails E never, makes no other fail, and has no label;
rows that repeat an id are documents of their own, and none is a copy of another with its own id;
an id with several labels is good (toxic) if one of them says so, a null label says nothing; texts are
whole, however long; other columns are ignored; a table without rows has no parts and gives no rows.
Distinct words are told apart by 64-bit hashes within a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import Words, stored, text_rows

FILTERS = "ABCDE"
#: The bit of the filter that depends on other documents.
COPY = 1 << FILTERS.index("E")
#: Cells of a part: 32 masks, each for documents that are good or not and toxic or not.
GOOD, TOXIC, CELLS = 32, 64, 128
#: Parts whose walks are held in memory at once.
PARTS = 32

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|")] = True
#: Bytes that begin a code point.
_POINT = (np.arange(256) & 0xC0) != 0x80


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each row."""
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[offs[1:]] - c[offs[:-1]]


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest`` of each row: the mask has the filters that look at one text only."""

    def run(batch):
        data, offs = common.buffers(batch.column("text"))
        w = Words(data, offs, lower=False)
        n = np.diff(w.first)
        distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:])], np.int64)
        fails = [n < 200, 100 * distinct < 50 * n, 100 * _sums(_UPPER[data], offs) > 3 * _sums(_POINT[data], offs), _sums(_SYMBOL[data], offs) > 0]
        mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
        digest = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(digest, pa.binary())], ["doc_id", "part", "mask", "digest"])

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return text_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.col("text").cast("string").alias("text")), run, "doc_id long, part string, mask int, digest binary")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, cell, n``: how many documents of a part have each mask, split by label."""
    rows = stored(measured(docs), "measured")
    known = rows.where("doc_id is not null")
    firsts = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    marked = known.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("first").isNull(), F.lit(COPY)).otherwise(0)
    label = F.when(F.col("good"), F.lit(GOOD)).otherwise(0) + F.when(F.col("toxic"), F.lit(TOXIC)).otherwise(0)
    lone = rows.where("doc_id is null").select("part", F.col("mask").alias("cell"))
    return marked.select("part", (F.col("mask") + copy + label).alias("cell")).unionByName(lone).groupBy("part", "cell").agg(F.count("*").alias("n"))


def plain_changes(n: int) -> Iterator[int]:
    """The places ``i`` at which neighbours ``i, i + 1`` are swapped, one after another, so that all
    orders of ``n`` things are visited: the last thing sweeps through the orders of the others."""
    if n < 2:
        return
    down, others = True, plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        swap = next(others, None)
        if swap is None:
            return
        # The swept thing stands in front of the others after a sweep down, behind them after one up.
        yield swap + 1 if down else swap
        down = not down


class Walk:
    """A walk over all orders for some parts at once; ``cell`` has their 128 cells, a row a part."""

    def __init__(self, cell: np.ndarray):
        c = cell.reshape(-1, 4, 32)
        #: By mask: documents, good ones, toxic ones.
        self.by_mask = np.stack([c.sum(1), c[:, 1] + c[:, 3], c[:, 2] + c[:, 3]], 2)
        k, masks = len(FILTERS), np.arange(32)
        self.failing = np.stack([self._of(masks >> f & 1 == 1)[:, 0] for f in range(k)], 1)
        self.alone = self.by_mask[:, [1 << f for f in range(k)], 0]
        self.order = list(range(k))
        #: What is left before and after each step.
        self.left = np.stack([self._after(self.order[:i]) for i in range(k + 1)], 1)
        self.removed = self.left[:, :-1] - self.left[:, 1:]
        self.shapley = np.zeros((len(cell), k), np.int64)

    def _of(self, which: np.ndarray) -> np.ndarray:
        return self.by_mask[:, which].sum(1)

    def _after(self, filters: list[int]) -> np.ndarray:
        """What fails none of ``filters``, from the cells."""
        return self._of(np.arange(32) & sum(1 << f for f in filters) == 0)

    def swap(self, i: int) -> None:
        o = self.order
        o[i], o[i + 1] = o[i + 1], o[i]
        self.left[:, i + 1] = self._after(o[: i + 1])
        self.removed[:, i : i + 2] = self.left[:, i : i + 2] - self.left[:, i + 1 : i + 3]

    def visit(self) -> tuple[str, list[int], np.ndarray]:
        """The order's name, its filters, and for each part and step: kept, removed, redundant,
        unique_fails, good_lost, toxic_lost."""
        o = self.order
        self.shapley[:, o] += self.removed[:, :, 0]
        failing = self.failing[:, o]
        of = [self.left[:, 1:, 0], self.removed[:, :, 0], failing - self.removed[:, :, 0], self.alone[:, o], self.removed[:, :, 1], self.removed[:, :, 2]]
        return "".join(FILTERS[f] for f in o), list(o), np.stack(of, 2)

    def run(self) -> list[tuple[str, list[int], np.ndarray]]:
        out = [self.visit()]
        for i in plain_changes(len(FILTERS)):
            self.swap(i)
            out.append(self.visit())
        return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def walked(batches):
    """Rows of all orders and steps for batches of ``part, cells``."""
    k = len(FILTERS)
    for batch in batches:
        for at in range(0, batch.num_rows, PARTS):
            some = batch.slice(at, PARTS)
            cell = np.zeros((some.num_rows, CELLS), np.int64)
            for i, have in enumerate(some.column("cells").to_pylist()):
                for x in have:
                    cell[i, x["cell"]] = x["n"]
            walk = Walk(cell)
            visits = walk.run()
            for p, part in enumerate(some.column("part").to_pylist()):
                names = [name for name, _, _ in visits for _ in range(k)]
                numbers = np.concatenate([np.column_stack([x[p], walk.shapley[p, o]]) for _, o, x in visits])
                columns = [pa.array([part] * len(names)), pa.array(names), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(visits)))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x) for x in numbers.T)], ["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", "n")).alias("cells"))
    return parts.mapInArrow(walked, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
