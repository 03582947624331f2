"""Mixture-controlled packing of token streams into fixed-length sequences.

Documents stand in one queue per source. Deficit round-robin serves the queues: every window is
a round, in which each queue's credit grows by its target share of the window, it hands over
whole tokens, and what it is over or short of, always less than a token, is carried to the next
window. So every window has every source in its target proportion, and no window has gaps. A
queue that runs empty leaves the round, and the others share its part; only the very last
sequence is padded.

As quanta are fixed, the credits after any number of rounds are known without going through
them: over w windows the first q queues together hand over the whole part of w windows times
their summed share. Each document's place in its queue then says which windows its tokens go to
and where in them. Places are sums of tokens before: those of the same task, counted while it
encodes, and those of the tasks before it, from a small table by task and source. So credits are
carried across windows and partitions, token ids are not shuffled, and no task holds a source.

Targets are the sources' parts of all tokens, or given by name; a source without a target is
served when the others are empty.

Edge cases: a null or empty text is packed as its end id alone; a null source counts as an
empty name; rows repeated with one id are packed once each, in the order they are read, which
also decides between equals; a document longer than a window is cut over as many as its
source's share takes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .common import stored, word_spans

LENGTH = 2048
#: Target shares are whole numbers of parts, as a power of two.
SHARE_BITS = 31
END_ID = 1
#: Ids of known words (of some 10 bytes each, with the tables) after which a worker starts anew.
IDS_KEPT = 10_000_000
#: Rows (of a short name and two numbers) up to which the table by task and source is broadcast.
BROADCAST_ROWS = 300_000


class WordIds:
    """The ids of words (bytes between ASCII white space), found by the words' hashes.

    Every boundary the tokenizer makes at white space is a hard one, so the ids of a text are
    those of its words in turn. Known words lie in sorted arrays; new ones are encoded
    together: one of letters only is one unit to the tokenizer, whose last token ends a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("a vocabulary of up to 65,536 ids is expected")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._anew()

    def _anew(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.uint16), 0
        #: Hash, first id and number of ids of known words: many in order, and the latest.
        self.known = [np.empty((3, 0), np.uint64), np.empty((3, 0), np.uint64)]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        until = np.cumsum(end - start)
        odd = np.append(0, np.cumsum(~_letters(_spans(data, start, end))))
        plain = odd[until] == odd[until - (end - start)]
        one, other = np.flatnonzero(plain), np.flatnonzero(~plain)
        text = _spans(data, start[one], end[one], True)
        ids = self._encode([text.tobytes().decode()])[0] if len(one) else np.empty(0, np.uint16)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(one):  # a letter that the tokenizer takes apart
            parts = self._encode(text.tobytes().decode().split(" ")[:-1])
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        rest = self._encode([data[start[k] : end[k]].tobytes().decode() for k in other])
        size = np.concatenate([np.diff(ends, prepend=0), [len(x) for x in rest]]).astype(np.int64)
        ids = np.concatenate([ids, *rest])
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used + len(ids), np.uint16)])
        first = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        new = np.stack([hashes[np.concatenate([one, other])], first.astype(np.uint64), size.astype(np.uint64)])
        return new[:, np.argsort(new[0])]

    def find(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First ids and numbers of ids of distinct words, which are byte spans."""
        out, left = np.zeros((2, len(hashes)), np.int64), np.arange(len(hashes))
        for table in self.known:
            if table.shape[1] and len(left):
                at = np.minimum(np.searchsorted(table[0], hashes[left]), table.shape[1] - 1)
                hit = table[0, at] == hashes[left]
                out[:, left[hit]] = table[1:, at[hit]]
                left = left[~hit]
        if len(left):
            new = self._learn(hashes[left], data, start[left], end[left])
            out[:, left] = new[1:, np.searchsorted(new[0], hashes[left])]
            many, late = self.known
            late = np.concatenate([late, new], axis=1)
            if late.shape[1] > max(1 << 16, many.shape[1] // 4):
                many, late = np.concatenate([many, late], axis=1), late[:, :0]
                many = many[:, np.argsort(many[0])]
            self.known = [many, late[:, np.argsort(late[0])]]
        return out

    def of(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, each with ``end_id`` behind, and the rows' offsets into them."""
        if self.used >= IDS_KEPT:
            self._anew()
        data, offs = common.buffers(column)
        low, a, b = word_spans(data, offs)  # the tokenizer lower-cases, but for its special strings
        first = np.searchsorted(a, offs)
        cut = _stems(low, a, b)
        mark = np.flatnonzero(cut < b)
        a, b, first = np.insert(a, mark + 1, cut[mark]), np.insert(cut, mark + 1, b[mark]), first + np.searchsorted(mark, first)
        distinct, index, inverse = np.unique(common.span_hashes(low, a, b), return_index=True, return_inverse=True)
        begin, size = self.find(distinct, low, a[index], b[index])[:, inverse]
        until = np.cumsum(size)
        ids = self.flat[np.repeat(begin - until + size, size) + np.arange(until[-1] if len(until) else 0)]
        at = np.append(0, until)[first]
        ids = np.insert(ids, at[1:], end_id)
        at += np.arange(len(at))
        if b"<|" in (raw := data.tobytes()):  # it may be a special string
            rows = [ids[at[i] : at[i + 1]] for i in range(len(at) - 1)]
            for i in range(len(rows)):
                if b"<|" in (row := raw[offs[i] : offs[i + 1]]):
                    rows[i] = np.append(self._encode([row.decode()])[0], np.uint16(end_id))
            ids, at = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        return ids, at


_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of the letters a-z and U+00C0 to U+023F, without two signs and the one letter that
    is two characters in lower case."""
    lead = (data >= 0xC3) & (data <= 0xC8)
    out = ((data >= 97) & (data <= 122)) | lead
    tail = np.flatnonzero(lead[:-1]) + 1
    one, two = data[tail], data[tail - 1]
    fine = ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & ~((two == 0xC4) & (one == 0xB0))
    out[tail] |= fine
    return out


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, spaced: bool = False) -> np.ndarray:
    """The bytes of spans, one after another, each with a space behind if wanted."""
    size = end - start + spaced
    until = np.cumsum(size)
    out = data[np.minimum(np.repeat(start - until + size, size) + np.arange(until[-1] if len(until) else 0), max(len(data) - 1, 0))]
    if spaced and len(until):
        out[until - 1] = 32
    return out


def _stems(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the run of ASCII marks at the end of each word begins, if a letter stands before
    it: it is a unit of its own to the tokenizer. Else the word's end."""
    last, open_ = end.copy(), np.flatnonzero(_MARK[data[end - 1]]) if len(end) else end
    while len(open_):  # runs of marks are short
        last[open_] -= 1
        open_ = open_[last[open_] > start[open_]]
        open_ = open_[_MARK[data[last[open_] - 1]]]
    some = np.flatnonzero((last > start) & (last < end))
    one, two = data[last[some] - 1], data[np.maximum(last[some] - 2, 0)]
    ascii_ = (one >= 97) & (one <= 122)
    # U+00C0 to U+023F are letters but for two signs; one of them is two characters in lower case.
    latin = (one >= 0x80) & (one < 0xC0) & (two >= 0xC3) & (two <= 0xC8) & (last[some] - 2 >= start[some]) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & ~((two == 0xC4) & (one == 0xB0))
    some = some[ascii_ | latin]
    out = end.copy()
    out[some] = last[some]
    return out


_WORDS: dict[str, WordIds] = {}


def token_ids(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``doc_id, source, n, within, part, ids``: the ids of each whole text and ``end_id``, two bytes
    each, the task, and the tokens of the source that stand before the row in the task."""

    def run(batches):
        import public_tokenizers

        file = path or public_tokenizers.path("word_bpe_49k.json")
        words = _WORDS.get(file) or _WORDS.setdefault(file, WordIds(file))
        part, so_far = TaskContext.get().partitionId(), {}
        for whole in batches:
            _, offs = common.buffers(whole.column("text"))
            for i, j in common.slices(offs, 2 * common.SLICE):
                batch = whole.slice(i, j - i)
                ids, at = words.of(batch.column("text"), end_id)
                sizes, within = np.diff(at), []
                for source, n in zip(batch.column("source").to_pylist(), sizes.tolist()):
                    within.append(so_far.get(source, 0))
                    so_far[source] = within[-1] + n
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int64)), pa.py_buffer(ids.astype("<u2"))])
                arrays = [batch.column("doc_id"), batch.column("source"), pa.array(sizes), pa.array(within, pa.int64()), pa.array(np.full(len(sizes), part, np.int64)), packed.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "source", "n", "within", "part", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, source string, n long, within long, part long, ids binary")


def _share_of(tokens: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The whole part of ``tokens`` times ``share`` / 2**SHARE_BITS, for up to 2**50 tokens."""
    high = (tokens >> 20) * share
    return (high >> 11) + ((((high & 2047) << 20) + (tokens & 0xFFFFF) * share) >> SHARE_BITS)


class Rounds:
    """Which tokens of each queue go to which window.

    Windows come in stretches. In a regular one, all windows have the same targets: ``sums`` holds
    the summed shares of the queues before each. In others, of one window each, in which a queue
    runs empty, it holds the summed tokens themselves. ``first`` is a stretch's first window and
    ``served`` what the queues have handed over before it."""

    def __init__(self, totals: list[int], targets: list[float] | None = None, window: int = LENGTH):
        self.window, left = window, list(totals)
        weights = [Fraction(x) for x in (totals if targets is None else targets)]
        first, served, sums, regular, w = [], [], [], [], 0
        while any(left):
            now = [x if n else Fraction(0) for x, n in zip(weights, left)]
            if not any(now):  # only queues without a target are left
                now = [Fraction(n) for n in left]
            whole, run, cum = sum(now), Fraction(0), [0]
            for x in now:
                run += x
                cum.append(int(run * (1 << SHARE_BITS) / whole))
            full = min(self._lasts(n, a, b) for n, a, b in zip(left, cum, cum[1:]))
            first.append(w)
            served.append([t - n for t, n in zip(totals, left)])
            regular.append(full > 0)
            if full:
                t = full * window
                gone = [(t * b >> SHARE_BITS) - (t * a >> SHARE_BITS) for a, b in zip(cum, cum[1:])]
                sums.append(cum)
                w += full
            else:
                gone = self._one(left, now)
                sums.append([0, *np.cumsum(gone).tolist()])
                w += 1
            left = [n - x for n, x in zip(left, gone)]
        self.n_windows = w
        self.first, self.regular = np.array(first, np.int64), np.array(regular, bool)
        self.served, self.sums = np.array(served, np.int64).reshape(len(first), len(totals)), np.array(sums, np.int64).reshape(len(first), len(totals) + 1)

    def _lasts(self, n: int, low: int, high: int) -> int:
        """Windows in a row that a queue of ``n`` tokens can serve."""
        if low == high:
            return 1 << 62
        takes = lambda w: (w * self.window * high >> SHARE_BITS) - (w * self.window * low >> SHARE_BITS)
        w = max(0, (n << SHARE_BITS) // ((high - low) * self.window) - 1)
        while takes(w + 1) <= n:
            w += 1
        while w and takes(w) > n:
            w -= 1
        return w

    def _one(self, left: list[int], weights: list[Fraction]) -> list[int]:
        """Tokens of each queue for one window in which not all can serve their share."""
        space, gone = min(self.window, sum(left)), [0] * len(left)
        while space:
            open_ = [x if n > g else Fraction(0) for x, n, g in zip(weights, left, gone)]
            if not any(open_):
                open_ = [Fraction(n - g) for n, g in zip(left, gone)]
            whole, run, before, took = sum(open_), Fraction(0), 0, 0
            for q, x in enumerate(open_):
                run += x
                until = int(space * run / whole)
                some = min(until - before, left[q] - gone[q])
                gone[q] += some
                took += some
                before = until
            space -= took
        return gone

    def starts(self, queue: int, w: np.ndarray) -> np.ndarray:
        """The queue's first token that is not handed over before window ``w``."""
        k = np.searchsorted(self.first, w, "right") - 1
        t = (w - self.first[k]) * self.window
        return self.served[k, queue] + np.where(self.regular[k], _share_of(t, self.sums[k, queue + 1]) - _share_of(t, self.sums[k, queue]), 0)

    def before(self, queue: int, w: np.ndarray) -> np.ndarray:
        """The tokens of the queues before this one in window ``w``."""
        k = np.searchsorted(self.first, w, "right") - 1
        t, low = (w - self.first[k]) * self.window, self.sums[k, queue]
        return np.where(self.regular[k], _share_of(t + self.window, low) - _share_of(t, low), low)

    def windows(self, queue: int, token: np.ndarray) -> np.ndarray:
        """The window to which a token of the queue goes."""
        k = np.searchsorted(self.served[:, queue], token, "right") - 1
        share = np.maximum(self.sums[k, queue + 1] - self.sums[k, queue], 1)
        most = np.append(self.first[1:], self.n_windows)[k] - 1
        guess = (token - self.served[k, queue]) * (float(1 << SHARE_BITS) / self.window) / share
        w = np.where(self.regular[k], np.clip(self.first[k] + guess.astype(np.int64), self.first[k], most), self.first[k])
        while (late := self.starts(queue, w) > token).any():
            w = w - late
        while (early := (w < self.n_windows - 1) & (self._ends(queue, w) <= token)).any():
            w = w + early
        return w

    def _ends(self, queue: int, w: np.ndarray) -> np.ndarray:
        last = w == self.n_windows - 1
        return np.where(last, np.int64(1) << 62, self.starts(queue, np.minimum(w + 1, self.n_windows - 1)))

    def pieces(self, queue: int, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, first token in the row, tokens, window and place in it of the pieces of documents that stand
        from ``begin`` on in the queue."""
        a, b = self.windows(queue, begin), self.windows(queue, begin + size - 1)
        many = b - a + 1
        row = np.repeat(np.arange(len(a)), many)
        w = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + a[row]
        start = self.starts(queue, w)
        low, high = np.maximum(start, begin[row]), np.minimum(self._ends(queue, w), (begin + size)[row])
        some = high > low
        row, w, low, high, start = row[some], w[some], low[some], high[some], start[some]
        return row, low - begin[row], high - low, w, self.before(queue, w) + low - start


def pack(docs: DataFrame, path: str | None = None, window: int = LENGTH, targets: dict[str, float] | None = None) -> DataFrame:
    """Pieces ``doc_id, source, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian
    32-bit) of all ``docs(doc_id, source, text)``. ``targets``: the sources' parts of a window by name;
    without them, their parts of all tokens."""
    tokens = stored(token_ids(docs, path), "ids", "snappy")
    sums = stored(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "sums")
    total = {r.source: r.n for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}  # one row a source
    names = sorted(total)
    rounds = Rounds([total[k] for k in names], None if targets is None else [targets.get(k, 0.0) for k in names], window)
    before = F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")  # a row a task
    base = sums.select("source", "part", before.alias("base"))
    lines = tokens.join(F.broadcast(base) if sums.count() <= BROADCAST_ROWS else base, ["source", "part"])
    shared = docs.sparkSession.sparkContext.broadcast((rounds, {k: q for q, k in enumerate(names)}))

    def serve(batches):
        rounds, number = shared.value
        for whole in batches:
            _, offs = common.buffers(whole.column("ids"))
            for i, j in common.slices(offs, 2 * common.SLICE):
                rows = whole.slice(i, j - i)
                queue = np.fromiter(map(number.__getitem__, rows.column("source").to_pylist()), np.int64, len(rows))
                size, place = rows.column("n").to_numpy(), rows.column("line").to_numpy()
                parts = []
                for q in np.unique(queue).tolist():
                    own = np.flatnonzero(queue == q)
                    row, *rest = rounds.pieces(q, place[own], size[own])
                    parts.append((own[row], *rest))
                doc, start, n, w, at = (np.concatenate(x) for x in zip(*parts))
                data, offs_ = common.buffers(rows.column("ids"))
                wide = np.ascontiguousarray(data).view("<u2").astype("<u4")
                begin, until = offs_[doc] // 2 + start, np.cumsum(n)
                ids = wide[np.repeat(begin - until + n, n) + np.arange(until[-1] if len(until) else 0)]
                cut = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(0, 4 * until).astype(np.int32)), pa.py_buffer(ids)])
                pick = pa.array(doc)
                arrays = [rows.column("doc_id").take(pick), rows.column("source").take(pick), pa.array(start), pa.array(n), pa.array(size[doc]), pa.array(w), pa.array(at), cut]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return lines.select("doc_id", "source", "n", (F.col("base") + F.col("within")).alias("line"), "ids").mapInArrow(serve, schema)


def packed(docs: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, targets=targets).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.documents(spark, sf_dir))
