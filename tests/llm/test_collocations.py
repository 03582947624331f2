import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from recollect.llm import collocations as P

from .conftest import LONG, TEXTS


def brute(docs, top=P.TOP):
    """By counting all phrases of all pieces in dictionaries."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + m])) for m in range(1, 5) for i in range(len(w) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= 30}
    out = {}
    for (lang, p), a in cand.items():
        if any(100 * b >= 80 * a for (other, q), b in cand.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def table(spark, docs, parts=4):
    return spark.createDataFrame([(*r, "x", 1, None) for r in docs], "lang string, text string, word string, n int, phrase string").repartition(parts)


def chatter(seed, n, vocabulary=12, ends=".,;:!?\n\r\x0b "):
    """Text of few words, so that phrases repeat, with odd white space and punctuation."""
    r = random.Random(seed)
    return "".join(f"{r.choice('wWvé')}{r.randrange(vocabulary)}" + r.choice([" "] * 12 + ["\t", "  "] + list(ends)) for _ in range(n))


def test_query(spark, sf):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(P.op12_collocations(spark, sf)) == brute(docs)


@pytest.mark.parametrize("hot", [P.HOT, 30, 1])
def test_phrases_of_few_words(spark, monkeypatch, hot):
    """With many hot words, some and none; small batches; ties at the last rank."""
    monkeypatch.setattr(P, "HOT", hot)
    monkeypatch.setattr(P, "BATCH", 3000)
    docs = [(lang, chatter(s, 2500, 3)) for s in range(4) for lang in ("en", "de", None, "und")] + [("en", "one hot word " * 700), ("fr", "a a a a " * 100), ("", chatter(9, 900, 1))]
    for top in (P.TOP, 7):
        want = brute(docs, top)
        assert got(P.collocations(table(spark, docs), top)) == want
        assert len({r[0] for r in want}) == 5


def test_odd_rows(spark, odd, none):
    assert got(P.collocations(odd)) == brute([("en", t) for _, t in TEXTS])
    assert P.collocations(none).count() == 0
    control = [("en", "p\x01q r p s p\x00 r\x1f p " * 50), ("en", "p r s " * 40), ("en", LONG)]
    assert got(P.collocations(table(spark, control))) == brute(control)


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_one_stack_over_batches(step):
    """Prefixes that run over the ends of batches, and languages that follow one another."""
    r = random.Random(step)
    suffixes = Counter((lang, "".join(f"{w}\t" for w in r.choices("abc", k=r.randint(2, 4)))) for lang in ("x", "y") for _ in range(3000))
    rows = sorted(suffixes.items(), key=lambda x: (x[0][0], [-b for b in x[0][1].encode()] + [1]))
    want = Counter()
    for (lang, s), n in rows:
        w = s.split("\t")[:-1]
        for k in range(2, len(w) + 1):
            want[lang, " ".join(w[:k])] += n
    stack, out = P.Stack(), []
    for a in range(0, len(rows), step):
        for lang in ("x", "y"):
            some = [(s, n) for (g, s), n in rows[a : a + step] if g == lang]
            if some:
                stack.push(lang, pa.array([s for s, _ in some]), np.ones(len(some), np.int32), np.array([n for _, n in some]))
                assert len(stack.open) <= 3
    stack.close()
    out = {(lang, phrase[:-1].replace("\t", " ")): f for lang, phrase, f, *_ in stack.out}
    assert len(out) == len(stack.out) and out == {k: f for k, f in want.items() if f >= 30}
