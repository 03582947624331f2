import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recollect.llm import exact as E
from recollect.llm.cuckoo import Cuckoo, Full

from .conftest import LONG, TEXTS, words


def body(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def brute(docs):
    """Groups by the bare text itself: id, id of the row that stays, size and digest of each row, and how many
    rows of each group stay."""
    at = {}
    for d, t in docs:
        at.setdefault(body(t), []).append((-len(t or ""), d is None, d or 0))
    some = lambda x: -1 if x is None else x
    best = {b: min(rows) for b, rows in at.items()}
    keep = {b: None if x[1] else x[2] for b, x in best.items()}
    return sorted((some(d), some(keep[body(t)]), len(at[body(t)]), hashlib.sha256(body(t).encode()).hexdigest()) for d, t in docs)


def got(df):
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.key).hex()) for r in df.collect()]
    stay = {}
    for d, keep, _, kept, key in rows:
        stay.setdefault(key, []).extend([(d, keep)] * kept)
    assert all(len(x) == 1 and x[0][0] == x[0][1] for x in stay.values())
    some = lambda x: -1 if x is None else x
    return sorted((some(d), some(keep), n, key) for d, keep, n, _, key in rows)


# ---------------------------------------------------------------- the filter
def keys(seed, n):
    return np.unique(np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 60)), max_size=120), st.integers(3, 16))
def test_filter_has_what_is_live(steps, bits):
    """Keys go in and out; small fingerprints, so that many are equal."""
    pool, live, f = keys(1, 80), [], Cuckoo(4, bits=bits)
    for put, i in steps:
        k = pool[i]
        if put and k not in live:
            live.append(k)
            try:
                f.put(np.array([k]))
            except Full:
                f = Cuckoo.of(np.array(live), bits=bits)
        elif not put and k in live:
            live.remove(k)
            f.take(np.array([k]))
        assert f.has(np.array(live, np.uint64)).all()
        assert (f.slots != 0).sum() == len(live)


def test_filter_by_the_batch():
    a = keys(2, 50_000)
    f = Cuckoo.of(a)
    assert f.has(a).all() and f.has(keys(3, 50_000)).mean() < 0.001
    f.take(a[::2])
    assert f.has(a[1::2]).all() and f.has(a[::2]).mean() < 0.001
    f.take(a[1::2])
    assert not f.slots.any()
    with pytest.raises(KeyError):
        f.take(a[:1])
    with pytest.raises(Full):
        Cuckoo(4).put(a[:17])


def test_a_bucket_grows_from_its_keys_and_looks_at_hits_only():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    b = E.Bucket([], None, 16)
    small = len(b.filter.slots)
    assert b.insert(digests + digests[:500]).tolist() == [*range(20_000), *range(500)]
    assert len(b.filter.slots) > 100 * small and b.filter.has(E._keys64(digests)).all()
    assert 500 <= b.looked < 700  # copies, and what the filter took for one
    narrow = E.Bucket([], None, 4)
    assert narrow.insert(digests[:3000] + digests[:3000]).tolist() == [*range(3000), *range(3000)]


# ---------------------------------------------------------------- the operator
def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = E.op13_exact_dedup(spark, sf).collect()
    some = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows)
    assert some == brute(docs) and all(r.kept == (r.doc_id == r.keep_id) for r in rows)


ODD = [(20, " a b"), (21, "ab"), (22, "a\nb\t"), (22, "a\nb\t"), (None, "a  b   "), (23, "a\x0bb\x0c\r "), (24, "a\xa0b"), (None, None), (25, LONG.replace(" ", "\n")), (26, "\x1cab"), (None, "é e"), (None, "ée"), (None, "ée")]


@pytest.mark.parametrize("bits", [16, 2])
def test_odd_rows(make, none, bits):
    docs = TEXTS + ODD
    assert got(E.groups(E.insert(None, make(docs).repartition(5), bits=bits))) == brute(docs)
    assert E.groups(E.insert(None, none)).count() == 0


def test_large_groups(make, monkeypatch):
    """Hot groups come by broadcast, others by a join, and many digests go to one bucket."""
    monkeypatch.setattr(E, "HOT", 10)
    docs = [(i, "x" + " " * (i % 7) + "y") for i in range(600)] + [(1000 + i, f"t {i // 2}") for i in range(1200)]
    assert got(E.groups(E.insert(None, make(docs)))) == brute(docs)


def test_texts_of_one_digest_are_compared(make):
    """With digests of one byte different texts meet; equal ones only do not."""
    with pytest.raises(E.Collision):
        E.insert(None, make([(i, f"text {i}") for i in range(300)]), width=1)
    assert got(E.groups(E.insert(None, make([(i, "same text") for i in range(50)]), width=1)))[0][:3] == (0, 0, 50)


@pytest.mark.parametrize("bits", [16, 3])
def test_rows_come_and_go(make, bits):
    first = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(100)] + [(None, "text 1    "), (200, None)]
    more = [(300 + i, f"text\n{i}") for i in range(20, 60)]
    gone = [(None, "text 1    "), (5, "text 5  "), (45, "text 5"), (85, "text 5 "), (21, "text 21"), (61, "other"), (200, ""), (999, "text 2")]
    index = E.insert(E.saved(E.insert(None, make(first), bits=bits)), make(more))
    assert got(E.groups(index)) == brute(first + more)
    index = E.delete(index, make(gone))
    out = {(d, body(t)) for d, t in gone}
    rest = [(d, t) for d, t in first + more if (d, body(t)) not in out]
    assert got(E.groups(index)) == brute(rest)
    live = {body(t) for _, t in rest}
    asked = [(i, t) for i, t in enumerate(["text 1", "tex t5", "text5", "text 59", "", "text 200", None])]
    known = {r.doc_id: r.known for r in E.lookup(index, make(asked)).collect()}
    assert known == {i: body(t) in live for i, t in asked}
    again = E.insert(E.saved(index), make([(7000, "text 5"), (7001, "te xt 5")]))
    assert got(E.groups(again)) == brute(rest + [(7000, "text 5"), (7001, "te xt 5")])
