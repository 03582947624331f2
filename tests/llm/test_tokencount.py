import random

import public_tokenizers
import sentencepiece

from recollect.llm import tokencount as C

from .conftest import TEXTS

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def by_maps(text, runs, chunk, look):
    m = C.scan(C.state_maps(C.marked(text), runs, chunk, look)) if text else None
    return 0 if m is None else m.to.get(C.Vocabulary.START, (None, None))[1]


def test_texts_of_odd_parts():
    sp, runs, r = library(), C.compiled(PATH).runs, random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "日本", "😀", "<s>", "</s>", "<0x0A>", "1234", "...", "    ", "ﬁ", "é", "\x00", "http://", "==", "ção"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = len(sp.encode(text))
        assert C.count(text, runs) == want, text
        assert [by_maps(text, runs, n, 64) for n in (64, 5, 2)] == [want] * 3, text


def test_maps_know_the_states_they_are_entered_in():
    """Runs without a reset, cut everywhere: what lies before a cut leads to few states, the right one among
    them; with too little of it some maps lack it, and say so."""
    sp, runs, r = library(), C.compiled(PATH).runs, random.Random(2)
    missing = 0
    for _ in range(300):
        text = "".join(r.choice(["er", "ing", "tion", "un", "xq", "日本", "the", "9", "==", "😀", "z"]) for _ in range(200))
        want, maps = len(sp.encode(text)), C.state_maps(C.marked(text), runs, 40, 32)
        assert max(len(m.to) for m in maps) <= 16 and by_maps(text, runs, 40, 32) == want
        short = by_maps(text, runs, 40, 1)
        missing += short is None
        assert short in (None, want)
    assert missing


def test_composition_is_associative():
    runs = C.compiled(PATH).runs
    text = C.marked("some words  and\nlines of textwithoutanyspaceatall " * 8)
    maps = C.state_maps(text, runs, 6, 16)
    whole = C.scan(maps).to
    assert len(maps) > 30
    for i in range(1, len(maps) - 1, 5):
        for j in range(i + 1, len(maps), 7):
            a, b, c = C.scan(maps[:i]), C.scan(maps[i:j]), C.scan(maps[j:])
            assert a.then(b).then(c).to == a.then(b.then(c)).to == whole
    m = maps[3]
    assert C.StateMap.unpacked(m.packed()).to == m.to


def test_long_texts_are_dealt_to_tasks(make):
    """Chunks of a few characters, so that maps are composed in rounds, with and without what lies before."""
    sp, r = library(), random.Random(3)
    texts = [(1, "word " * 900), (2, "x" * 3000), (3, " " * 2000 + "end"), (4, "日本語" * 700), (5, "abcdef12345" * 400 + "\n" * 50), (None, "word " * 900), (6, "short"), (7, "".join(r.choice("aeinorst") for _ in range(4000)))]
    for look in (64, 1):
        out = C.token_counts(make(texts), chunk=50, look=look).collect()
        assert sorted((x.doc_id or -1, x.n_tokens, x.n_bytes) for x in out) == sorted((d or -1, len(sp.encode(t)), len(t.encode())) for d, t in texts)


def test_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sp = library()
    out = C.op5_token_counts(spark, sf).collect()
    assert len(out) == len(docs)
    for r in out:
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_odd_rows(odd, none):
    sp = library()
    out = C.token_counts(odd).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted((d or -1, len(sp.encode(t or ""))) for d, t in TEXTS)
    assert C.token_counts(none).count() == 0
