from itertools import permutations

import pytest

from recollect.llm import audit as A

from .conftest import LONG, TEXTS, words


def brute(docs, labels):
    """By applying the filters one after another to lists of documents."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    parts = {}
    for d, text, lang in docs:
        t = text or ""
        w = t.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
        w = [x for x in w if x]
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs),
        }
        parts.setdefault(lang or "", []).append((d, {f for f, x in fails.items() if x}))
    out = []
    for part, have in parts.items():
        rows, shapley = [], dict.fromkeys(A.FILTERS, 0)
        for order in permutations(A.FILTERS):
            left = have
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(here)
                rows.append(("".join(order), step, len(left), len(here), sum(f in x[1] for x in have) - len(here), sum(x[1] == {f} for x in have), sum(x[0] in good for x in here), sum(x[0] in toxic for x in here)))
        out += [(part, *r, shapley[r[0][r[1] - 1]]) for r in rows]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", *A.COUNTS).collect())


def test_plain_changes():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for i in A.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n)))) == len(list(A.plain_changes(n))) + 1


def test_a_swap_counts_two_steps_anew(monkeypatch):
    """From the cells: 6 sets for the first order, one for each of the 119 swaps."""
    calls, count = [], A.Walk._after
    monkeypatch.setattr(A.Walk, "_after", lambda self, f: calls.append(len(f)) or count(self, f))
    import numpy as np

    A.Walk(np.ones((1, A.CELLS), np.int64)).run()
    assert len(calls) == 6 + 119


def test_query(spark, sf):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    assert got(A.op11_filter_audit(spark, sf)) == brute(docs, labels)


LABELS = [(1, 1, 0), (2, None, 1), (2, 1, None), (3, 0, 0), (11, 1, 1), (None, 1, 1), (9, 1, 0), (9, 1, 1), (999, 1, 1)]


def labelled(spark, rows=LABELS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, quality int, toxic int, part string, mask int")


def test_odd_rows(spark, odd, none):
    assert got(A.audit(odd, labelled(spark))) == brute([(d, t, "en") for d, t in TEXTS], LABELS)
    assert A.audit(none, labelled(spark)).count() == 0
    assert {r[5:9] == (0,) * 4 or r[7:9] == (0, 0) for r in got(A.audit(odd, labelled(spark, [])))} == {True}


@pytest.mark.parametrize("turn", [1, -1])
def test_copies_nulls_and_ties(spark, turn):
    """Copies across parts, null texts and empty ones, ids that repeat or are null."""
    a, b = words(70, 250), words(71, 250) + " #"
    texts = [(5, a, "en"), (3, a, "de"), (9, a, None), (3, a, "en"), (None, a, "en"), (None, a, ""), (7, None, "en"), (6, "", "de"), (8, None, None), (10, b, "en"), (10, b + " B", "en"), (12, b, "en"), (13, "A" * 300, "de"), (14, LONG, "de"), (15, LONG, "fr")]
    df = spark.createDataFrame([(*r, "x") for r in texts[::turn]], "doc_id long, text string, lang string, digest string").repartition(3)
    assert got(A.audit(df, labelled(spark))) == brute(texts, LABELS)
