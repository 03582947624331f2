from itertools import combinations

import pytest

from recollect.llm import minhash as M

from .conftest import TEXTS, words


def brute(texts, k=4, percent=80):
    """Each row's id, set size and the smallest id of the rows it is linked with, over some others or not."""
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    first = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            first[find(i)] = min(d, first.get(find(i), d))
    some = lambda x: -1 if x is None else x
    return sorted((some(d), len(s), some(first.get(find(i)))) for i, ((d, _), s) in enumerate(zip(texts, sets)))


def got(df):
    rows = df.collect()
    for r in rows:
        assert r.kept == (r.doc_id == r.component_id)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in rows)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(M.op10_minhash(spark, sf)) == brute(docs)


@pytest.mark.parametrize("words_", [4, 5])
def test_edited_copies(make, words_):
    """Chains of edits, some near the threshold, and a passage that many others share."""
    passage = words(50, 60, 5000)
    base, texts = words(51, 150, 5000).split(), []
    for i in range(40):
        if i % 4 == 0:
            base = list(base)
            base[(i * 13) % 150] = f"new{i}"
            base[(i * 29 + 7) % 150] = f"more{i}"
        texts.append((i, " ".join(base)))
    texts += [(100 + i, f"{words(200 + i, 25 + i, 5000)} {passage} {words(300 + i, 20, 5000)}") for i in range(40)]
    assert got(M.near_duplicates(make(texts), words=words_)) == brute(texts, words_)


def test_odd_rows(odd, none):
    assert got(M.near_duplicates(odd, words=4)) == brute(TEXTS)
    assert M.near_duplicates(none, words=4).count() == 0


A, B = words(60, 120, 5000), words(61, 120, 5000)


@pytest.mark.parametrize("turn", [1, -1])
def test_one_id_on_several_texts(make, turn):
    """Links of each text hold, whatever the order of the rows."""
    texts = [(5, A), (5, B), (8, A + " more"), (9, B + " else"), (7, words(62, 90, 5000)), (7, A)][::turn]
    want = brute(texts)
    assert got(M.near_duplicates(make(texts), words=4)) == want
    assert [x for x in want if x[0] in (8, 9)] == [(8, 118, 5), (9, 118, 5)]


def test_null_ids_take_part(make):
    texts = [(None, B), (9, B + " else"), (None, A), (None, A + " more"), (None, None), (3, ""), (2, A + " x y z")]
    assert got(M.near_duplicates(make(texts), words=4)) == brute(texts)
    lone = [(None, A), (None, A), (4, B)]
    assert got(M.near_duplicates(make(lone), words=4)) == brute(lone) == [(-1, 117, -1), (-1, 117, -1), (4, 117, 4)]


def test_buckets_are_not_sent_to_every_task(spark, tmp_path):
    """The file of the sets is smaller than what Spark broadcasts; their 91 keys each are not."""
    spark.range(300).selectExpr("id as node", "transform(sequence(0, 13), i -> (id div 2) * 14 + i) as sig").write.parquet(f"{tmp_path}/sets")
    out = M._met(spark.read.parquet(f"{tmp_path}/sets"), M.COLLECTIONS)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "BroadcastExchange" not in plan
    assert {(r.node, r.low, r.high) for r in out.collect()} == {(i, i - i % 2, i - i % 2 + 1) for i in range(300)} and out.count() == 300 * 91
