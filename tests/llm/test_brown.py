import math
import zlib
from collections import Counter

import numpy as np
import pytest

from recollect.llm import brown as B

from .conftest import TEXTS


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(d):
    return zlib.crc32(str("" if d is None else d).encode()) % 10 == 0


def check(rows, texts):
    train = Counter(w for d, t in texts if not held(d) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = sorted((-1 if d is None else d, held(d), len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for d, t in texts)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-5)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in rows)


def test_query(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = B.op8_brown(spark, sf).collect()
    check(rows, texts)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_the_model_is_a_distribution(spark, sf):
    """Over all seen tokens and the unseen one, from every class."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    model, counts = B.train(docs, vocabulary=500, core=100, classes=8)
    rows = counts.collect()
    inside = np.bincount(model.kind[:-1], 10.0 ** model.word[:-1], 9)
    for r in rows:
        if r.kind is not None:
            inside[r.kind] += r.n / model.totals[r.kind]
    assert len({r.key for r in rows if r.kind is None}) == len(model.word) - 1  # every other word has a class
    used = np.flatnonzero(inside)
    assert len(used) == 8 and inside[used] == pytest.approx(1.0)
    assert (10.0**model.bigram).sum(1) == pytest.approx(1.0)


@pytest.mark.parametrize("vocabulary", [300, 200_000])
def test_scores_are_those_of_the_model(spark, sf, vocabulary):
    """Token by token, from the classes and counts."""
    import pyarrow as pa

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model, counts = B.train(docs.where(~B.held_out()), vocabulary, 100, 8)
    count, kind, past = {}, {}, {}
    for r in counts.collect():
        count[r.key], kind[r.key] = r.n, r.kind
    frequent = {int(h): i for i, h in enumerate(model.lookup.sorted.view(np.int64)[np.argsort(model.lookup.order)])}
    for key, i in frequent.items():
        kind[key] = past[key] = int(model.kind[i])
    total = Counter()
    for key, n in count.items():
        total[kind[key]] += n
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in B.score(docs, model, counts).collect():
        keys = B.long_hash(B._tokens(pa.array([texts[r.doc_id]]))[0]).tolist()
        want, before = 0.0, int(B.END.astype(np.int64))
        for key in keys:
            c = kind.get(key, 8)
            want += model.bigram[past.get(before, 8), c] + (math.log10(count[key] / total[c]) if key in count else 0.0)
            before = key
        assert r.score == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_exchange_finds_classes():
    """Words of two languages that never mix."""
    left, right, n = [], [], []
    for base in (0, 5):
        for i in range(5):
            for j in range(5):
                left.append(base + i), right.append(base + j), n.append(10)
    kind = B.exchange(np.array(left), np.array(right), np.array(n), 10, classes=2)
    assert len(set(kind[:5])) == 1 and len(set(kind[5:])) == 1 and kind[0] != kind[9]


def test_small_vocabulary_and_odd_rows(odd, none):
    docs = odd.select("doc_id", "text")
    for vocabulary, core in ((200_000, 2048), (20, 5)):
        model, counts = B.train(docs.where(~B.held_out()), vocabulary, core, 4)
        check(B.score(odd, model, counts).collect(), TEXTS)
    model, counts = B.train(none.select("doc_id", "text"))
    assert B.score(none, model, counts).count() == 0
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in B.score(odd, model, counts).collect())
