import random

import numpy as np
import pyarrow as pa

from recollect.llm import common, linededup as L


def chunked(lines):
    """First lines of a text's chunks, which are pairs: a line whose hash is not larger than the one before ends a
    run, runs are cut from both ends, and a run of one line goes with the line before it; for each seed."""
    data, ends = np.frombuffer(b"".join(lines), np.uint8), np.cumsum([len(x) for x in lines])
    plain = common.span_hashes(data, ends - [len(x) for x in lines], ends)
    out = set()
    for seed in L.SEEDS:
        h, at = common.mix(plain ^ np.uint64(seed)).tolist(), 0
        for i in range(len(lines)):
            if i == len(lines) - 1 or (i and h[i] <= h[i - 1]):
                out |= {*range(at, i, 2), *range(i - 1, at - 1, -2)} if i > at else {i - 1} if i else set()
                at = i + 1
    return sorted(out)


def split(raw):
    lines = raw.split(b"\n")
    return lines[:-1] if lines[-1] == b"" else lines


def brute(docs):
    """One document after the other, with the first place of each chunk's bytes: what is left, the runs of lines that went."""
    first, out = {}, {}
    for key in sorted(docs, key=lambda k: (k is not None, k)):
        raw = (docs[key] or "").encode()
        lines, gone = split(raw), set()
        for i in chunked(lines) if lines else ():
            body = b"\n".join(lines[i : i + 2])
            if body.split():
                at = first.setdefault(body, (key, i))
                if at != (key, i):
                    gone |= {k for k in (i, i + 1) if at[0] != key or k > at[1] + 1}
        left = b"\n".join(x for i, x in enumerate(lines) if i not in gone).rstrip(b"\n")
        out[key] = (left if gone else raw).decode(), len([i for i in gone if i - 1 not in gone])
    return out


def test_chunks_cover_the_text():
    text = "\n".join(f"line {i % 7}" for i in range(50))
    for t in (text, text + "\n", "\n\n\n", "x", "", "\n", "a\na\na\na"):
        lines = split(t.encode())
        _, a, b, n, _ = L.chunks(pa.array([t]))
        assert [t[: x].count("\n") for x in a] == (chunked(lines) if lines else []) and all(k == L.LINES for k in n)
        assert len(lines) < 2 or {i for x, y in zip(a, b) for i in range(x, y)} == set(range(len(t)))


def test_boundaries_shift_with_the_text():
    passage = "\n".join(f"shared line number {i}" for i in range(40))
    spans = []
    for head in ("", "one\n", "one\ntwo\nthree\n"):
        text = head + passage
        _, a, b, _, _ = L.chunks(pa.array([text]))
        spans.append({text[x:y] for x, y in zip(a, b)})
    assert len(spans[0] & spans[1]) >= len(spans[0]) - 2 and len(spans[1] & spans[2]) >= len(spans[1]) - 2


def test_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute(docs)
    for r in L.op4_line_dedup(spark, sf).collect():
        assert (r.text or "", r.n_removed) == want[r.doc_id]


def test_odd_rows(odd, none):
    out = L.deduplicated(odd)
    assert out.columns == [*odd.columns, "removed"]
    rows = out.collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[4].text is None and by[5].text == "" and by[12].removed is None
    assert L.cleaned(odd).columns == odd.columns
    assert L.deduplicated(none).count() == 0 and L.cleaned(none).count() == 0


def test_copies_go_and_counts_are_new(make):
    text = "\n".join(f"a line of number {i}" for i in range(30))
    docs = make([(1, text), (2, text), (3, "first of mine\n" + text + "\nlast of mine")])
    out = {r.doc_id: r for r in L.cleaned(docs).collect()}
    assert out[1].text == text and 2 not in out
    assert len(out[3].text) < len(text) and out[3].n_chars == len(out[3].text) and "first of mine" in out[3].text


def repeated_lines(texts):
    """Places of the lines in a pair of neighbours that stood before, by document; no chunks."""
    seen, out = set(), {}
    for d, t in sorted(texts):
        lines = t.split("\n")
        pairs = list(zip(lines, lines[1:]))
        out[d] = {i + k for i, p in enumerate(pairs) if p in seen for k in (0, 1)}
        seen.update(pairs)
    return out


def planted(lengths=range(2, 9), each=12):
    """Passages of some lines in a first document, and again between new lines in a later one."""
    texts, k = [], 0
    for n in lengths:
        for _ in range(each):
            passage = [f"passage {k} line {i} of {n}" for i in range(n)]
            for d in (k, 1000 + k):
                texts.append((d, "\n".join([*(f"own {d} {i}" for i in range(d % 5 + 1)), *passage, *(f"end {d} {i}" for i in range(d % 3 + 1))])))
            k += 1
    return texts


def test_the_pipeline_removes_whole_planted_passages(make):
    texts = planted() + [(5000, "one\none\none\none"), (5001, "x\na\na\na\nb\nc\nd"), (5002, "a\na\na\nq\nb\nc")]
    gone = repeated_lines(texts)
    gone[5000], gone[5001] = {2, 3}, {3}  # what stands first in a run of equal lines stays
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in texts}
    got = {r.doc_id: r.text for r in L.cleaned(make(texts)).collect()}
    assert got == {d: t for d, t in want.items() if t}


def test_chunks_find_most_planted_passages(make):
    texts = planted()
    gone = repeated_lines(texts)
    rows = {r.doc_id: r for r in L.deduplicated(make(texts)).collect()}
    later = [d for d in rows if d >= 1000]
    assert all(rows[d].removed is None for d in rows if d < 1000)
    left = sum(len([x for x in rows[d].text.split("\n") if x.startswith("passage")]) for d in later)
    assert sum(rows[d].removed is not None for d in later) >= 0.95 * len(later)
    assert left <= 0.1 * sum(len(gone[d]) for d in later)


def test_copies_of_all_line_counts_vanish_whole(make):
    """With every way the end of a text may be cut."""
    texts = {100 * n + k: "\n".join(f"text {k} of {n} lines, line {i}" for i in range(n)) for n in range(2, 12) for k in range(10)}
    docs = make([*texts.items(), *((d + 10_000, t) for d, t in texts.items())])
    for out in (L.deduplicated(docs).where("doc_id >= 10000").collect(), L.cleaned(docs).where("doc_id >= 10000").collect()):
        assert [r.text for r in out if r.text] == []
    assert {r.doc_id: r.text for r in L.cleaned(docs).collect()} == texts


def odd_lines(seed, n=60):
    """Texts of few different lines, blank ones among them, so that runs, copies and overlaps of all kinds arise."""
    r = random.Random(seed)
    lines = ["a", "b", "cc", "d d", "", " ", "\t", "  ", "e", "ff"]
    texts = [(i, "\n".join(r.choices(lines[: r.randrange(2, 11)], k=r.randrange(1, 14))) + r.choice(["", "\n"])) for i in range(n)]
    return texts + [(n + i, "\n".join([texts[i][1], *r.choices(lines, k=3), texts[i + 1][1]])) for i in range(n // 2)]


def test_runs_follow_the_content_and_hold_every_pair_once():
    for _, text in odd_lines(1, 200):
        lines = split(text.encode())
        at = np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist()
        row, a, b, n, _, (p, size, _) = L.runs(pa.array(["x\ny", text]))
        assert list(zip(p[1:] - 3, size[1:])) == [(at[i], at[i + 2] - 1 - at[i]) for i in range(len(lines) - 1) if b"".join(lines[i : i + 2]).split()]
        assert sum(n - 1) == len(p) and all(x == y for x, y in zip(a, p[np.append(0, np.cumsum(n - 1)[:-1])]))
    passage = "\n".join(f"shared line number {i}" for i in range(40))
    found = []
    for head in ("", "one\n", "one\ntwo\nthree\n"):
        _, a, b, n, _, _ = L.runs(pa.array([head + passage]))
        assert max(n) > L.LINES
        found.append({(head + passage)[x:y] for x, y in zip(a, b)})
    assert len(found[0] & found[1]) >= len(found[0]) - 2 and len(found[1] & found[2]) >= len(found[1]) - 2


def test_the_pipeline_goes_by_chunks_and_checks_only_the_rest(make):
    """Of a passage that is copied often, whole chunks are found; pairs are compared in its first place and where
    chunks meet other lines."""
    passage = "\n".join(f"a line of number {i}" for i in range(60))
    docs = L._key(make([(d, f"own {d}\n{passage}\nend {d}") for d in range(20)]))
    again, pairs = L._rest(docs)
    assert again.count() >= 19 * 15
    assert pairs.count() <= 61 + 19 * 8


def test_exact_form_on_odd_lines(make):
    """As every pair of neighbouring lines compared with all before it."""
    for seed in range(3):
        texts = odd_lines(seed)
        first, want = {}, {}
        for d, t in texts:
            lines, gone = split(t.encode()), set()
            for i, pair in enumerate(zip(lines, lines[1:])):
                if b"".join(pair).split():
                    at = first.setdefault(pair, (d, i))
                    if at != (d, i):
                        gone |= {k for k in (i, i + 1) if at[0] != d or k > at[1] + 1}
            left = b"\n".join(x for i, x in enumerate(lines) if i not in gone).rstrip(b"\n").decode()
            if left.strip() or not gone:
                want[d] = left if gone else t
        assert {r.doc_id: r.text for r in L.cleaned(make(texts + texts[:5])).collect()} == want
