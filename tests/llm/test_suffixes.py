from collections import defaultdict

import pytest

from recollect.llm import suffixes as S

from .conftest import words


def brute(docs, n=50):
    """Words covered by windows of n words that stand in another document, too."""
    where = defaultdict(set)
    split = {d: (t or "").encode().lower().split() for d, t in docs.items()}
    for d, w in split.items():
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(d)
    out = {}
    for d, w in split.items():
        covered = set()
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                covered.update(range(i, i + n))
        if covered:
            out[d] = covered
    return out


def covered(df):
    out = defaultdict(set)
    for r in df.collect():
        assert not out[r.doc_id] & set(range(r.start, r.start + r.n_words))
        out[r.doc_id].update(range(r.start, r.start + r.n_words))
    return dict(out)


@pytest.mark.parametrize("run", [20_000, 2])
def test_brute_force(spark, sf, run):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert covered(S.repeats(docs, run=run)) == brute({r.doc_id: r.text for r in docs.collect()})


@pytest.mark.parametrize("run", [20_000, 2])
def test_edited_copies(make, run):
    """Many variants of one text: matches lie between the edits, and nearest neighbours differ."""
    base = words(9, 400, 5000).split()
    texts = []
    for i in range(25):
        w = list(base)
        for k in range(5):
            w[(37 * i + 83 * k) % 400] = f"edit{i}x{k}"
        texts.append((i, " ".join(w)))
    assert covered(S.repeats(make(texts), run=run)) == brute(dict(texts))


def test_lengths_at_the_limit(make):
    p49, p50, p51 = (words(s, n, 5000) for s, n in ((1, 49), (2, 50), (3, 51)))
    texts = [(i, f"{words(10 + i, 30, 5000)} {p49} {words(20 + i, 30, 5000)} {p50} {words(30 + i, 30, 5000)} {p51}") for i in range(2)]
    got = covered(S.repeats(make(texts)))
    assert got == brute(dict(texts)) and len(got[0]) == 101


def test_odd_rows(odd, none):
    got = covered(S.repeats(odd))
    assert set(got) >= {1, 2, 9, 10} and 4 not in got and 5 not in got and 11 not in got and 17 not in got
    assert len(got[9]) == 60_000
    assert S.repeats(none).count() == 0


def _pieces(texts, passage=50, anchor=25):
    """The suffixes of some documents, one group an anchor, as the array's pieces get them."""
    import numpy as np
    import pyarrow as pa

    column = pa.array([t for _, t in texts])
    w = S.Words(*S.common.buffers(column))
    row, pos, h = S.selected(w, passage, anchor)
    small, back, out = (w.hash >> np.uint64(32)).astype("<u4"), passage - anchor, []
    for r, p, x in zip(row.tolist(), pos.tolist(), h.view(np.int64).tolist()):
        a, b = w.first[r], w.first[r + 1]
        out.append((x, small[a + p : min(b, a + p + passage)].byteswap().tobytes(), texts[r][0], p, small[max(a, a + p - back) : a + p][::-1].byteswap().tobytes()))
    return out


def _reached(rows, passage=50, anchor=25):
    import pyarrow as pa

    n = len(rows)
    names = ["key", "a", "b", "context", "doc", "many", "left", "right"]
    table = pa.table([[r[0] for r in rows], pa.array([0] * n, pa.int32()), pa.array([anchor] * n, pa.int32()), list(range(n)), [r[2] for r in rows], [False] * n, pa.array([r[4] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names)
    back, ahead = S.Suffixes(table, passage, anchor).extents()
    out = defaultdict(set)
    for r, x, y in zip(rows, back.tolist(), ahead.tolist()):
        out[r[2]].update(range(r[3] - x, r[3] + y))
    return {d: s for d, s in out.items() if s}


def test_the_result_is_that_of_sorted_neighbours(monkeypatch):
    """Neighbours in sorted order give all passages; in another order they do not, and without the
    comparison there is nothing."""
    base = words(9, 400, 5000).split()
    texts = []
    for i in range(12):
        w = list(base)
        for k in range(5):
            w[(37 * i + 83 * k) % 400] = f"edit{i}x{k}"
        texts.append((i, " ".join(w)))
    rows, want = _pieces(texts), brute(dict(texts))
    assert _reached(sorted(rows)) == want
    assert _reached(sorted(rows, key=lambda r: (r[0], r[2] * 7 % 12))) != want
    monkeypatch.setattr(S.Suffixes, "neighbours", lambda self, place, group: place * 0)
    assert _reached(sorted(rows)) == {}


def test_copies_and_hot_beginnings(make):
    """Groups of equal texts, and a passage that many others share, with groups that are parted often."""
    passage = words(70, 64, 5000)
    texts = [(i, f"{words(100 + i, 30, 5000)} {passage} {words(200 + i, 30 + i, 5000)}") for i in range(30)]
    texts += [(50 + i, words(71, 130, 5000)) for i in range(6)] + [(60, words(71, 130, 5000) + " more"), (61, "same word " * 80), (62, "word same " * 60)]
    for run in (20_000, 1):
        assert covered(S.repeats(make(texts), run=run)) == brute(dict(texts))
