import re
from collections import Counter

from recollect.llm import quality as Q

from .conftest import TEXTS

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept is not None and not (r.base_failed and r.kept)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = Q.op7_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = Q.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.02 * len(bad)


def test_plan_is_native(spark, sf):
    plan = Q.op7_quality(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_odd_rows(odd, none):
    check(Q.quality(odd).collect(), dict(TEXTS))
    kept = Q.kept_documents(odd)
    assert kept.columns == odd.columns
    want = {r.doc_id for r in Q.quality(odd).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == want
    assert Q.quality(none).count() == 0 and Q.kept_documents(none).count() == 0


def test_rules_are_data(make):
    docs = make([(1, "the word of it " * 30 + "and so on for a while with some other words that do not repeat at all here " * 1)])
    strict = [Q.Rule("no words at all", "n_words", None, None, 0)]
    assert not Q.quality(docs, strict).first().kept
