import corpus_pipeline as P
from recollect.llm import common, linededup, minhash, packing, quality, templates

import pytest

from .conftest import TEXTS, words
from .test_minhash import brute as groups
from .test_packing import check as packs


def lines(docs):
    """Texts without the lines of pairs of neighbours that stand in an earlier place, and how many went."""
    first, out = {}, {}
    for d in sorted(docs):
        text = docs[d].split("\n")
        if text[-1] == "":
            text.pop()
        gone = set()
        for i, pair in enumerate(zip(text, text[1:])):
            if "".join(pair).split():
                at = first.setdefault(pair, (d, i))
                if at != (d, i):
                    gone |= {k for k in (i, i + 1) if at[0] != d or k > at[1] + 1}
        left = "\n".join(x for i, x in enumerate(text) if i not in gone)
        out[d] = (left.rstrip("\n") if gone else docs[d]), len(gone)
    return out


def test_stages_against_brute_force(spark, sf):
    docs = common.documents(spark, sf)
    names = docs.columns
    assert [k for k, _ in P.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "packing"]

    kept = common.stored(P.quality_stage(spark, docs, sf), "t")
    good = {r.doc_id for r in quality.op7_quality(spark, sf).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and kept.columns == names

    cut = common.stored(P.line_stage(spark, kept, sf), "t")
    want = {d: t for d, (t, gone) in lines({r.doc_id: r.text for r in kept.collect()}).items() if t.strip() or not gone}
    assert {r.doc_id: r.text for r in cut.collect()} == want and cut.columns == names
    assert all(r.n_chars == len(r.text) for r in cut.collect())

    once = common.stored(P.near_duplicate_stage(spark, cut, sf), "t")
    first = {i for i, _, c in groups([(r.doc_id, r.text) for r in cut.collect()], 5) if i == c}
    assert {r.doc_id for r in once.collect()} == first and once.columns == names

    clean = common.stored(P.decontamination_stage(spark, once, sf), "t")
    leaks = {r.doc_id for r in templates.leaks(once, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == first - leaks and clean.columns == names

    packs(P.packing_stage(spark, clean, sf).collect(), [(r.doc_id, r.text) for r in clean.collect()])


def test_run_is_the_stages(spark, sf):
    out = P.run(spark, sf).collect()
    assert out and {"doc_id", "sequence_id", "offset", "length"} <= set(out[0].asDict())


def test_odd_and_empty_documents(spark, sf, odd, none):
    """Every stage on all of them: columns stay, nothing new comes, what is packed is whole; of no
    documents nothing is left."""
    ids = {r.doc_id for r in odd.collect()}
    for name, stage in P.STAGES[:-1]:
        out = common.stored(stage(spark, odd, sf), "t")
        kept = [r.doc_id for r in out.collect()]
        assert out.columns == odd.columns and set(kept) <= ids and len(kept) <= odd.count(), name
        if name == "line dedup":
            assert {4, 5, 12, None} <= set(kept)
        if name == "near duplicates":
            assert {1, 4, 5, 6, 7, 9, 11} <= set(kept) and not {2, 3, 8, 10} & set(kept)
        if name == "decontamination":
            assert len(kept) == odd.count()
    packs(P.packing_stage(spark, odd, sf).collect(), TEXTS)
    for name, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0, name


A, B = words(80, 120, 5000), words(81, 120, 5000)
SHARED = [
    [(3, A), (5, A + " more"), (5, B), (None, A + " more"), (9, words(82, 90, 5000))],
    [(5, B), (5, B + " x"), (5, B + " x"), (7, A), (8, B + " y"), (None, None), (None, ""), (7, None)],
    [(None, A), (None, A), (None, A + " z"), (2, B), (2, B), (4, words(83, 60, 5000))],
    [(6, A), (6, B), (1, B + " q"), (2, A + " q"), (6, words(84, 70, 5000)), (6, words(84, 70, 5000))],
]


@pytest.mark.parametrize("turn", [1, -1])
@pytest.mark.parametrize("texts", SHARED)
def test_near_duplicates_lose_no_text(spark, make, texts, turn):
    """One row of each group stays, the one with the smallest id, and every row without words."""
    texts = texts[::turn]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in ((t or "").split() for _, t in texts)]
    group = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a & b and 100 * len(a & b) >= 80 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    large = lambda d: (d is None, d or 0)
    left = sorted((large(r.doc_id), r.text or "") for r in P.near_duplicate_stage(spark, make(texts).repartition(3), "").collect())
    assert [k for k, t in left if t] == sorted(min(large(d) for g, (d, t) in zip(group, texts) if g == i) for i in set(group) if texts[i][1])
    assert all(any(large(d) == k and t == (u or "") for d, u in texts) for k, t in left)
    assert sum(not t for _, t in left) == sum(not t for _, t in texts)
    assert len({group[[u or "" for _, u in texts].index(t)] for _, t in left if t}) == sum(1 for _, t in left if t)


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_null_and_repeated_ids_in_every_stage(spark, sf, make, name, stage):
    """Rows are decided on by themselves: what is not alike, rejected or a leak stays under any id."""
    whole = [f"The {words(90 + i, 30, 5000)} and that {words(190 + i, 30, 5000)} of it was for them as they are.\nThis is the end of the line {i} which we have." for i in range(6)]
    texts = [(None, whole[0]), (None, whole[1]), (4, whole[2]), (4, whole[3]), (5, whole[4])]
    out = [(r.doc_id, r.text) for r in stage(spark, make(texts), sf).collect()]
    assert sorted(out, key=str) == sorted(texts, key=str)


def test_entry_points_are_used():
    assert P.linededup is linededup and P.minhash is minhash and P.packing is packing
