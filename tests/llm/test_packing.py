import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recollect.llm import packing as K

from .conftest import TEXTS


def encoded(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, docs, window=2048):
    """Every id lies in one piece, and the sequences have no gaps."""
    ids = defaultdict(list)
    for (d, _), x in zip(docs, encoded([t for _, t in docs])):
        ids[d].append(x)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for d, some in pieces.items():
        seen = Counter(p for s, n in some for p in range(s, s + n))
        assert seen == Counter(p for x in ids[d] for p in range(len(x)))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, some in sequences.items():
        at = 0
        for o, n in sorted(some):
            assert o == at
            at += n
        assert at == window or k == len(sequences) - 1


@pytest.mark.parametrize("parts", [1, 7])
def test_documents(spark, sf, parts):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(parts)
    rows = K.pack(docs).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_every_window_of_the_query_has_the_target_mixture(spark, folder):
    """Every source in every window, within two tokens of its share (a token carried in, one carried on); but for the last one or two, in which
    queues run empty."""
    out = K.op9_packing(spark, f"/root/testdata/{folder}")
    total = {r.source: r.n for r in out.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    whole = sum(total.values())
    have = defaultdict(Counter)
    for r in out.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect():
        have[r.sequence_id][r.source] = r.n
    assert len(have) == -(-whole // 2048)
    for w in range(len(have) - 2):
        for s, n in total.items():
            assert abs(have[w][s] - 2048 * n / whole) < 2, (w, s)


def test_odd_rows(odd, none):
    check(K.packed(odd).collect(), TEXTS)
    assert K.packed(none).count() == 0


def test_words_of_all_kinds():
    import random

    r, w = random.Random(2), K.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    parts = ["a", "b", "THE", "Ing", " ", "\n", "é", "É", "日本", "😀", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "1234", "...", "ﬁ", "é", "\x00", "İ", "ß", "µ", ".", ",", "!", "|", " ", "\x1c", "_", "ſ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    import pyarrow as pa

    ids, at = w.of(pa.array(texts), 1)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == encoded(texts)


def served(totals, targets=None, window=2048):
    """Round-robin window by window: each queue's credit grows by its share of what the window holds, and
    whole tokens are handed over, so that the queues so far have all of what is theirs together."""
    left = list(totals)
    weights = [Fraction(x) for x in (targets or totals)]
    out, credit = [], None
    while any(left):
        live = tuple(x if n else Fraction(0) for x, n in zip(weights, left))
        if not any(live):
            live = tuple(Fraction(n) for n in left) if credit is None or credit[0] != "rest" else credit[2]
        if credit is None or credit[1] != live:
            credit = ("rest" if not any(x if n else 0 for x, n in zip(weights, left)) else "all", live, live, [Fraction(0)] * len(left))
        owed, whole = credit[3], sum(live)
        take, over = [], Fraction(0)
        for q, x in enumerate(live):
            owed[q] += window * x / whole
            over += owed[q]
            take.append(int(over) if q == len(left) - 1 else over.__floor__())
            over -= take[-1]
        if any(n > m for n, m in zip(take, left)):
            out.append(None)  # a queue runs empty in it
            return out
        for q, n in enumerate(take):
            owed[q] -= n
            left[q] -= n
        out.append(take)
    return out


def test_rounds_are_those_of_round_robin():
    rng = np.random.default_rng(3)
    for targets in (None, [0.25, 0.25, 0.25, 0.25], [0.5, 0.125, 0.25, 0.125]):
        totals = rng.integers(5_000, 400_000, 4).tolist()
        rounds, want = K.Rounds(totals, targets, 512), served(totals, targets, 512)
        n = len(want) - 1
        got = np.stack([rounds.starts(q, np.arange(n + 1)) for q in range(4)], 1)
        assert n > 5 and np.abs(np.cumsum(want[:n], 0) - got[1:]).max() <= 1
        assert (np.diff(got, axis=0).sum(1) == 512).all()


@pytest.mark.parametrize("targets", [None, [1.0, 1.0, 1.0], [0.7, 0.3, 0.0], [0.0, 0.0, 0.0]])
def test_all_tokens_are_placed_once(targets):
    """Whatever the targets are, with queues that run empty, tiny and empty ones."""
    rng = np.random.default_rng(4)
    for totals in ([10_000, 300, 7], [0, 5000, 1], [1, 1, 1], [64, 64, 64], [100_000, 1, 99_999]):
        rounds, seen = K.Rounds(totals, targets, 64), Counter()
        for q, n in enumerate(totals):
            cuts = np.unique(np.append(0, rng.integers(0, max(n, 1), 20)))
            cuts = cuts[cuts < n]
            if not n:
                continue
            row, start, length, w, at = rounds.pieces(q, cuts, np.diff(np.append(cuts, n)))
            assert length.sum() == n and (length > 0).all() and (np.diff(cuts[row] + start) > 0).all()
            for x, y, z in zip(w.tolist(), at.tolist(), length.tolist()):
                seen.update((x, y + k) for k in range(z))
        want = Counter((t // 64, t % 64) for t in range(sum(totals)))
        assert seen == want


def test_targets_by_name(make):
    docs = make([(i, f"word{i} again and again " * 40) for i in range(300)], {i: "a" if i % 3 else "b" for i in range(300)})
    rows = K.pack(docs, window=256, targets={"a": 0.5, "b": 0.5}).collect()
    by = defaultdict(Counter)
    for r in rows:
        by[r.sequence_id][r.source] += r.length
    both = [w for w in by if by[w]["a"] and by[w]["b"]]
    assert len(both) > 20 and sum(abs(by[w]["a"] - 128) <= 1 for w in both) >= len(both) - 1
    assert all(by[w]["a"] in (256, by[max(by)]["a"]) for w in by if w > max(both))


def test_large_counts_are_exact():
    rng = np.random.default_rng(5)
    t, s = rng.integers(0, 1 << 50, 2000), rng.integers(0, (1 << 31) + 1, 2000)
    assert K._share_of(t, s).tolist() == [int(a) * int(b) >> 31 for a, b in zip(t, s)]
