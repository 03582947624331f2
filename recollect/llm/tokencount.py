"""Token counts of a piece vocabulary (BPE by score, byte fallback) by a compiled transducer.

The vocabulary is compiled, as texts need it, to a deterministic transducer over characters.
A state is what later characters can depend on: the suffixes read so far that can begin a
longer piece, each with the last token before it and that prefix's token count relative to
the newest one. A transition carries the number by which the count of the prefix changes.
The last token of a prefix is the one piece that ends it and that stands next to the last
token before it without the two being merged otherwise.

No piece holds a space mark behind another character, and a character that no piece holds
becomes bytes and merges with nothing. At both the automaton is back in its start state,
and a whole run between two such places is one compiled transition from start to start;
these are memoised.

A long text is cut into chunks, which are dealt to tasks. A chunk's state map says for each state
it may be entered in the state it is left in and the tokens in between. Where a chunk begins at a
reset that is one state; else it is entered in one of the few states that reading what lies before
the cut leads to. Maps compose associatively: neighbouring chunks are composed in groups, those
again, in a few rounds over all texts, so that no task passes through one long text. If a chunk
turns out to be entered in a state its map does not have (no text is known to do that), its text is
counted in one pass, so the result is exact anyway.

Counts are those of the library for the vocabulary, without begin or end tokens; strings
that look like special tokens are text.

Edge cases: a null text counts as empty and has no tokens; rows are independent, so ties,
repeated rows, repeated and null ids each give a row; a run of space marks stands in one chunk,
however long it is; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import stored, text_rows

MARK = "▁"
#: Characters of a chunk of a text, and of what is read before a cut to know the states there.
CHUNK, LOOK = 1 << 16, 64
#: Maps composed in one go.
FAN = 64
#: Transitions and whole runs kept by a worker before it starts anew.
KEEP = 400_000


class Vocabulary:
    """Pieces with their scores, and the merge procedure over short strings."""

    #: The state before anything is read.
    START = (("", "", 0),)

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores))
        self.chars = {c for p in scores for c in p}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        return cls({sp.id_to_piece(i): sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))})

    def merge(self, text: str) -> list[str]:
        """Merge neighbours, best score first and leftmost among equals, until none is a piece."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), list(range(1, len(part) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := right[i]) < len(part) and (s := self.scores.get(p := part[i] + part[j])) is not None:
                heapq.heappush(heap, (-s, i, j, p))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if part[i] is None or right[i] != j or part[j] is None or part[i] + part[j] != p:
                continue
            part[i], part[j] = p, None
            right[i] = right[j]
            if right[j] < len(part):
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [p for p in part if p is not None]


class State:
    """``ends``: for each suffix of what was read that can begin a longer piece, shortest
    first, the suffix, the last token of the prefix before it, and that prefix's token count
    relative to the whole. ``next``: the compiled transitions, by character."""

    __slots__ = ("ends", "next")

    def __init__(self, ends: tuple):
        self.ends, self.next = ends, {}


class Transducer:
    """Counts tokens of runs: strings that hold no character outside the vocabulary, and
    space marks only in front."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.begins = {p[:k] for p in vocabulary.scores for k in range(len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.runs = _Runs(self)
        self._anew()

    def _anew(self) -> None:
        self.start = State(Vocabulary.START)
        self.states = {self.start.ends: self.start}

    def _stands(self, piece: str) -> bool:
        """Whether the piece is a token of its own text."""
        if len(piece) == 1:
            return True
        if (known := self.whole.get(piece)) is None:
            if piece not in self.v.scores:
                return False
            known = self.whole[piece] = self.v.merge(piece) == [piece]
        return known

    def _meets(self, a: str, b: str) -> bool:
        """Whether the tokens a, b stay as they are next to each other."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= KEEP:
                self.pairs.clear()
            known = self.pairs[a, b] = self.v.merge(a + b) == [a, b]
        return known

    def _compile(self, state: State, char: str) -> tuple[State, int]:
        """The transition: the next state, and by how many tokens the prefix's count changes."""
        for suffix, last, count in state.ends:
            piece = suffix + char
            if self._stands(piece) and (not last or self._meets(last, piece)):
                gain = count + 1
                break
        else:
            raise AssertionError(f"no token ends with {char!r}")
        begins = self.begins
        ends = (("", piece, 0), *((s + char, t, c - gain) for s, t, c in state.ends if s + char in begins))
        to = self.states.get(ends)
        if to is None:
            if len(self.states) >= KEEP:  # bounded: start anew; states in use stay valid
                self._anew()
            to = self.states[ends] = State(ends)
        state.next[char] = to, gain
        return to, gain

    def run(self, text: str) -> int:
        """Tokens of one run."""
        if text[1:2] == MARK and text[0] == MARK:  # marks of equal scores grow from the left
            return len(self.v.merge(text))
        state, total = self.start, 0
        for char in text:
            state, gain = state.next.get(char) or self._compile(state, char)
            total += gain
        return total

    def walk(self, ends: tuple, text: str) -> tuple[tuple, int]:
        """From the state ``ends`` through a part of a run, with characters that become bytes: the state at its
        end, and by how many tokens the prefix's count changes."""
        state, total = self.states.get(ends) or State(ends), 0
        for char in text:
            if char in self.v.chars:
                state, gain = state.next.get(char) or self._compile(state, char)
            else:
                state, gain = self.start, len(char.encode())
            total += gain
        return state.ends, total


class _Runs(dict):
    """Memoised transitions from start to start, by run."""

    def __init__(self, transducer: Transducer):
        self.t = transducer
        chars = "".join(map(re.escape, sorted(transducer.v.chars - {MARK})))
        self.known = re.compile(f"[{MARK}]+[{chars}]*|[{chars}]+")

    def __missing__(self, run: str) -> int:
        n, at = 0, 0
        for m in self.known.finditer(run):
            n += len(run[at : m.start()].encode()) + self.t.run(m[0])
            at = m.end()
        n += len(run[at:].encode())
        if len(run) <= 32:
            if len(self) >= KEEP:
                self.clear()
            self[run] = n
        return n


#: The runs of a text: a reset lies between any two.
_RUN = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+")


def marked(text: str) -> str:
    """The text as the vocabulary has it: spaces are marks, and one stands in front."""
    return MARK + text.replace(" ", MARK)


def cuts(text: str, chunk: int = CHUNK) -> list[int]:
    """Where the chunks of a marked text begin: at the last reset of a chunk's latter half, else at its
    end; but never in a run that several marks begin."""
    out, at = [0], 0
    while at + chunk < len(text):
        end = at + chunk
        mark, line = text.rfind(MARK, at + 1, end + 1), text.rfind("\n", at, end) + 1
        while mark > at and text[mark - 1] == MARK:
            mark -= 1
        near = max(mark, line)
        if near > at + chunk // 2:
            at = near
        elif text[max(near, at) : max(near, at) + 2] == MARK * 2:
            stops = [x for x in (_AFTER.search(text, max(near, at)),) if x]
            at = stops[0].end() if stops else len(text)
        else:
            at = end
        if at < len(text):
            out.append(at)
    return out


#: A run that several marks begin, up to the next reset.
_AFTER = re.compile(f"{MARK}+[^{MARK}\n]*")


class StateMap:
    """What a chunk does to the automaton: for each state it may be entered in, the state it is left in
    and the tokens in between (the change of the prefix's count)."""

    __slots__ = ("to",)

    def __init__(self, to: dict[tuple, tuple[tuple, int]]):
        self.to = to

    @classmethod
    def of(cls, before: str, chunk: str, after: str, runs: _Runs) -> StateMap:
        """Of a chunk between ``before`` and ``after``, some characters of its text, or nothing at its ends."""
        t, start = runs.t, runs.t.start.ends
        found = _RUN.findall(chunk)
        open_end = bool(after) and after[0] not in (MARK, "\n") and chunk[-1] != "\n"
        if not before or chunk[0] in (MARK, "\n") or before[-1] == "\n":
            *whole, last = found if open_end else [*found, ""]
            end, n = t.walk(start, last)
            return cls({start: (end, sum(map(runs.__getitem__, whole)) + n)})
        first, rest = found[0], found[1:]
        begin = max(before.rfind(MARK), before.rfind("\n") + 1)
        states = dict.fromkeys(t.walk(start, before[k:])[0] for k in ([begin] if begin > 0 or before[0] == MARK else range(len(before))))
        if not rest and open_end:
            return cls({s: t.walk(s, first) for s in states})
        *whole, last = rest if open_end else [*rest, ""]
        end, n = t.walk(start, last)
        n += sum(map(runs.__getitem__, whole))
        return cls({s: (end, t.walk(s, first)[1] + n) for s in states})

    def then(self, other: StateMap) -> StateMap:
        """This map, then the other one; associative. Without an entry in the other one, there is none."""
        out = {}
        for entry, (middle, n) in self.to.items():
            if (end := other.to.get(middle)) is not None:
                out[entry] = end[0], n + end[1]
        return StateMap(out)

    def packed(self) -> str:
        return json.dumps([[e, x, n] for e, (x, n) in self.to.items()])

    @classmethod
    def unpacked(cls, text: str) -> StateMap:
        state = lambda x: tuple(map(tuple, x))
        return cls({state(e): (state(x), n) for e, x, n in json.loads(text)})


def scan(maps: list[StateMap]) -> StateMap:
    """Compose neighbours in rounds, a balanced tree."""
    while len(maps) > 1:
        maps = [maps[i].then(maps[i + 1]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def state_maps(text: str, runs: _Runs, chunk: int = CHUNK, look: int = LOOK) -> list[StateMap]:
    """The maps of all chunks of a marked text."""
    at = cuts(text, chunk)
    return [StateMap.of(text[max(0, a - look) : a], text[a:b], text[b : b + 1], runs) for a, b in zip(at, [*at[1:], len(text)])]


def count(text: str, runs: _Runs) -> int:
    """Tokens of a whole text in one pass."""
    return sum(map(runs.__getitem__, _RUN.findall(marked(text)))) if text else 0


_COMPILED: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """One transducer per worker and vocabulary."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer(Vocabulary.load(path))
    return _COMPILED[path]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096, chunk: int = CHUNK, look: int = LOOK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs(doc_id, text)``.
    ``path``: a sentencepiece BPE model, there on every machine. Texts of up to ``chunk`` characters are
    counted where they are read."""
    runs = lambda: compiled(path or _default()).runs

    def run(batch):
        known = runs()
        text = pc.fill_null(batch.column("text"), "")
        n = np.fromiter((count(t, known) for t in text.to_pylist()), np.int64, len(text))
        size = pc.binary_length(text).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = text_rows(rows.where(~long), run, "doc_id long, n_bytes long, n_tokens long")
    keyed = rows.where(long).withColumn("key", F.md5(F.col("text").cast("binary")))
    counted = _long_counts(keyed.select("key", "text"), runs, chunk, look)
    parts = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "key").join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(parts).withColumn("over_limit", F.col("n_tokens") > limit)


def _default() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _long_counts(texts: DataFrame, runs, chunk: int, look: int) -> DataFrame:
    """``key, n_tokens`` of long texts: their chunks' state maps, composed ``FAN`` at a time in as many rounds
    as the longest string there can be takes."""
    texts = stored(texts.dropDuplicates(["key"]), "long")

    def pieces(batch):
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            text = marked(text)
            at = cuts(text, chunk)
            for no, (a, b) in enumerate(zip(at, [*at[1:], len(text)])):
                yield pa.RecordBatch.from_pylist([{"key": key, "no": no, "before": text[max(0, a - look) : a], "chunk": text[a:b], "after": text[b : b + 1]}])

    def maps(batches):
        known = runs()
        for batch in batches:
            rows = batch.to_pydict()
            done = [StateMap.of(*x, known).packed() for x in zip(rows["before"], rows["chunk"], rows["after"])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(done, pa.string())], ["key", "no", "map"])

    def composed(batches):
        for batch in batches:
            done = [scan([StateMap.unpacked(x["map"]) for x in sorted(some, key=lambda x: x["no"])]).packed() for some in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("no"), pa.array(done, pa.string())], ["key", "no", "map"])

    def totals(batches):
        for batch in batches:
            start = Vocabulary.START
            n = [StateMap.unpacked(x).to.get(start, (None, None))[1] for x in batch.column("map").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    rows = text_rows(texts, pieces, "key string, no long, before string, chunk string, after string").repartition("key", "no").mapInArrow(maps, "key string, no long, map string")
    most = (1 << 31) // max(chunk // 2, 1)
    while most > 1:
        rows = rows.groupBy("key", F.floor(F.col("no") / FAN).alias("no")).agg(F.collect_list(F.struct("no", "map")).alias("maps")).mapInArrow(composed, "key string, no long, map string")  # FAN small maps
        most = -(-most // FAN)
    counts = stored(rows.mapInArrow(totals, "key string, n_tokens long"), "counts")
    lost = counts.where("n_tokens is null")
    if lost.isEmpty():
        return counts

    def again(batch):
        known = runs()
        n = [count(t, known) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], ["key", "n_tokens"])

    rest = text_rows(texts.join(lost.select("key"), "key", "left_semi"), again, "key string, n_tokens long")
    return counts.where("n_tokens is not null").unionByName(rest)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(common.documents(spark, sf_dir))
