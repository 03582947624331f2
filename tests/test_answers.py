"""Literal search, order statistics, cards, secrets and slugs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import redact
from recollect.operators import cards as C, evaluate as E, literal as L, orders as O, quality as Q, rank as R, sessions as S, vectors as V


# ---------------------------------------------------------------- literal search
def look(pages, needle, per_page=4, lines=24):
    """Page by page and line by line."""
    out = []
    for key, text in sorted(pages):
        split = (text or "").split("\n")
        at = [i for i, line in enumerate(split) if needle.lower() in line.lower()][:per_page] if needle and "\n" not in needle and text is not None else []
        shown = sorted({j for i in at for j in (i - 1, i, i + 1) if 0 <= j < len(split)})
        out += [(key, j, split[j], j in at) for j in shown]
    return [(*x, len(out) > lines) for x in out[:lines]]


def test_literal_search(spark, tmp_path):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abAB é") for _ in range(r.randrange(1, 6)))
    pages = [(i, "\n".join(" ".join(word() for _ in range(r.randrange(6))) for _ in range(r.randrange(9)))) for i in range(60)] + [(100, None), (101, ""), (102, "x"), (103, "ab\n\nab\nAB\nab\nab\nab")]
    df = spark.createDataFrame(pages, "id int, body string")
    grams = L.Grams.build(df, "id", F.col("body"), str(tmp_path / "g"))
    needles = ["ab", "a", "É", "baab", "b a", "ab ab", "x", "nowhere", "", "a\nb", "aB bA", " ", "  ", "bbb", "q"] + [word() for _ in range(25)]
    asked = spark.createDataFrame(list(enumerate(needles)), "qid int, needle string")
    got = {}
    for x in L.found(grams, df, F.col("body"), asked).orderBy("qid", "id", "line_no").collect():
        got.setdefault(x.qid, []).append((x.id, x.line_no, x.line, x.hit, x.truncated))
    assert got == {i: look(pages, n) for i, n in enumerate(needles) if look(pages, n)}
    assert any(x[4] for v in got.values() for x in v) and not all(x[4] for v in got.values() for x in v)
    few = grams.candidates(spark.createDataFrame([(1, "baab")], "qid int, needle string")).count()
    assert few < len(pages) / 2


def test_literal_search_by_reading(spark, monkeypatch):
    """As by trigrams, without an index: needles of one to forty bytes at the edges of texts, steps and rounds."""
    monkeypatch.setattr(L, "ROUND", 40)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abAB é") for _ in range(r.randrange(1, 6)))
    pages = [(i, "\n".join(" ".join(word() for _ in range(r.randrange(9))) for _ in range(r.randrange(9)))) for i in range(80)]
    pages += [(i, "the same long beginning of many a page\n" + ("é" * (i % 5)) + f"page {i}") for i in range(100, 160)] + [(200, None), (201, ""), (202, "x"), (203, "ab")]
    df = spark.createDataFrame([*pages, (None, "ab")], "id int, body string").repartition(3)
    needles = ["ab", "a", "É", "x", "nowhere", "", "a\nb", " ", "the same long", "the same long beginning of many a page", "beginning of many a pag", "age 15", "page 159", "ééé", "é", "b" * 20]
    needles += [t[i : i + n] for n in range(1, 41) for _, t in r.sample([p for p in pages if p[1]], 3) for i in [r.randrange(max(1, len(t) - n))]]
    asked = spark.createDataFrame(list(enumerate(needles)), "qid int, needle string")
    scan = L.Scan(df, "id", F.col("body"))
    got = {}
    for x in L.found(scan, df, F.col("body"), asked).orderBy("qid", "id", "line_no").collect():
        got.setdefault(x.qid, []).append((x.id, x.line_no, x.line, x.hit, x.truncated))
    assert got == {i: look(pages, n) for i, n in enumerate(needles) if look(pages, n)}
    # No more pages than an answer can show, and of all of them no page that does not hold the needle.
    low = asked.select("qid", F.lower("needle").alias("needle"))
    near = scan.candidates(low, 25).groupBy("qid").count().collect()
    assert max(x["count"] for x in near) == 25
    assert {(x.qid, x.id) for x in scan.candidates(low).collect()} == {(i, k) for i, n in enumerate(needles) for k, t in pages if n and n.lower() in (t or "").lower()}


def test_scan_steps_and_equal_keys(monkeypatch):
    """Places do not depend on the bytes looked at at once; needles whose keys are equal are told apart."""
    monkeypatch.setattr(L, "STEP", 7)
    monkeypatch.setattr(L._Needles, "_key", lambda self, data, at, size, width: self._at(data, at, width))
    r = random.Random(6)
    text = bytes(r.choice(b"abc") for _ in range(900)) + b"a common beginning, one" + b"a common beginning, two"
    needles = sorted({text[i : i + n] for n in range(1, 41) for i in r.sample(range(860), 4)} | {b"a common beginning, one", b"a common beginning, two"})
    import numpy as np

    data = np.frombuffer(text + bytes(16), np.uint8)
    got = {(needles[i], int(a)) for at, ids, _ in L._Needles(needles).places(data, len(text)) for a, i in zip(at, ids)}
    assert got == {(n, i) for n in needles for i in range(len(text)) if text.startswith(n, i)}


# ---------------------------------------------------------------- order
@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_sums(spark, parts):
    r = random.Random(parts)
    rows = [(i, r.choice([None, 1.5, 2.0, 2.0, r.random()]), r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, score double, n int").repartition(3)
    got = O.running(df, [F.desc("score"), F.asc("id")], {"total": F.col("n"), "odd": F.col("n") % 2}, parts).collect()
    total = odd = 0
    want = []
    for at, (i, s, n) in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])), 1):
        total, odd = total + n, odd + n % 2
        want.append((i, s, n, at, total, odd))
    assert sorted(tuple(x) for x in got) == sorted(want)
    assert O.running(df.limit(0), [F.asc("id")], {"t": F.col("n")}, parts).count() == 0


def test_order_statistics_run_in_several_tasks(spark):
    r = random.Random(4)
    rows = [(i, None if i % 7 == 0 else i % 3, float(r.randrange(40))) for i in range(500)]
    answers = spark.createDataFrame(rows, "qid int, cited int, score double")
    best = sorted((x for x in rows if x[1] is not None), key=lambda x: (-x[2], x[0]))[:90]
    kept = E.at_coverage(answers, 90)
    assert {x.qid for x in kept.where("cited is not null").collect()} == {x[0] for x in best} and kept.count() == 500
    values = sorted(x[2] for x in rows)
    for q in (0.0, 0.5, 0.99):
        assert E.percentile(answers, "score", q).first().value == values[int(500 * q)]
    assert "SinglePartition" not in kept._jdf.queryExecution().executedPlan().toString()
    grades = E.graded(spark.createDataFrame([(i, "k", i % 2) for i in range(500)], "qid int, kind string, gold int"), answers)
    cuts = spark.createDataFrame([(float(x),) for x in (-1, 0, 7, 39, 40, 7)], "floor double")
    got = {x.floor: (x.n_answered, x.n_right) for x in E.floors(grades, cuts).collect()}
    some = [x for x in rows if x[1] is not None]
    assert got == {c: (sum(x[2] >= c for x in some), sum(x[2] >= c and x[1] == x[0] % 2 for x in some)) for c in (-1.0, 0.0, 7.0, 39.0, 40.0)}


def test_query_vectors_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, [r.random() - 0.5 for _ in range(6)] if i % 50 else ([0.0] * 6 if i else None)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = df.where("id % 10 = 3").select(F.col("id").alias("qid"), "v")
    whole = sorted(map(tuple, V.dense_top(df, "id", "v", asked, 4, -0.2).collect()))
    monkeypatch.setattr(V, "BLOCK", 7)
    assert sorted(map(tuple, V.dense_top(df, "id", "v", asked, 4, -0.2).collect())) == whole and len(whole) == 120
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    have = {i: unit(v) for i, v in rows if v is not None}
    q = rows[13][0]
    want = sorted((-round(sum(a * b for a, b in zip(have[q], v)), 4), i) for i, v in have.items() if i != q)[:4]
    assert [(-x[2], x[1]) for x in sorted(whole, key=lambda x: x[3]) if x[0] == q] == want


# ---------------------------------------------------------------- secrets
SECRET = ["password: tiger", "Authorization: bearer abc", "token = see vault", "sk-abcdefgh1234", "API-KEY = x", "id abcdefghij0123456789abcdef", "x_abcdefghijklmnopqrstuvwx1"]
OPEN = ["the password is not here", "20260811-090406-v4-flash-and-more-parts", "task-abcdefghijk", "bearers of news", "abcdefghijklmnopqrstuvwxyzabc", "", "tokens: none"]


def test_secret_like(spark):
    df = spark.createDataFrame([(t, True) for t in SECRET] + [(t, False) for t in OPEN], "t string, want boolean")
    assert df.where(redact.secret_like(F.col("t")) != F.col("want")).collect() == []


def test_search_lines_of_secret_pages(spark):
    lines = ["k/s.md:3:x", "k/s.md-4- the key is here", "k/t.md:4: token=abcdefgh12345678", "k/t.md-5- plain", "--", "no page: k/s.md"]
    out = Q.without_secret_hits(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([("k/s.md",)], "rel string"))
    assert sorted(x.line for x in out.collect()) == sorted(["k/t.md:4: token=<redacted>", "k/t.md-5- plain", "--", "no page: k/s.md"])


def test_best_lines(spark):
    text = "restart the smart cart\nart is here\n\n  art and more art, with password=hunter2222x  \nart\n" + "art " * 60
    docs = spark.createDataFrame([(1, 1, text, False), (1, 2, text, True), (2, 1, "nothing", None)], "qid int, id int, body string, secret boolean")
    terms = spark.createDataFrame([(1, ["art", "more"]), (2, ["art"])], "qid int, terms array<string>")
    got = [tuple(x) for x in R.best_lines(docs, "id", F.col("body"), terms, 3, 30, F.col("secret")).orderBy("line_no").collect()]
    assert got == [(1, 1, 2, "art is here", 1), (1, 1, 4, "art and more art, with passwor", 2), (1, 1, 5, "art", 1)]


# ---------------------------------------------------------------- cards
@pytest.mark.parametrize("text, page, want", [("3", "30 and 1.3 and 3_", False), ("3", "30, 3.", True), ("0.9", "v0.9 out", True), ("80", "8080", False), ("x x", "ax x x", True), ("abc", "abc.5", False), ("abc", "abc. 5", True), ("", "a", True), ("日更", "每日更新", True)])
def test_stands(text, page, want):
    assert C.stands(text, page) is want if text else True


def test_acceptance_and_proofs(spark):
    page = "The gateway closes calls after 30 seconds, and retries push, then release."
    rows = [("", "x", "malformed"), ("gateway?", None, "malformed"), ("gateway", "token: abc", "secret-like"), ("gateway", "after 31 seconds", "not-verbatim"), ("lunch", "after 30 seconds", "question-off-page"), ("when does the gateway close", "calls after 30 seconds, push/release", "")]
    df = spark.createDataFrame([(*r, page) for r in rows], "q string, a string, want string, p string")
    assert [(r.q, r.reason) for r in C.accept(df, F.col("q"), F.col("a"), "p").where("reason <> want").collect()] == []
    quotes = [("closes calls  after 30 seconds.", "when are calls closed after", True), ("「closes calls after 30 seconds」", "which calls", True), ("30 seconds", "seconds", False), ("closes calls after 31 seconds", "calls", False), ("closes calls after 30 seconds", "where is the lunch", False), ("Closes Calls after 30 seconds", "calls", False), ("after after after after", "after", False)]
    df = spark.createDataFrame([(*x, page) for x in quotes], "quote string, q string, want boolean, p string")
    assert df.where(C.quoted(F.col("quote"), F.col("p"), F.col("q")) != F.col("want")).collect() == []


def test_health_buckets_and_what_to_do(spark):
    pages = spark.createDataFrame([("a", "s1", "alpha beta gamma delta"), ("b", "s1", "other words")], "rel string, sha string, body string")
    cards = [("a", "s1", "alpha beta", "—", False, None, "unverified", True, False), ("a", "s1", "alpha", "beta gamma", False, 1, "ok", False, True), ("a", "s1", "alpha gamma", "delta", False, None, "unverified", False, False), ("b", "old", "x", "y", False, 1, "stale", False, False), ("c", "s1", "x", "y", False, 1, "stale", False, False), ("a", "s1", None, None, True, None, "empty", False, False)]
    df = spark.createDataFrame(cards, "rel string, sha string, q string, a string, empty boolean, v int, want string, unchecked_ boolean, broad_ boolean")
    out = C.health(df, pages)
    assert out.where("state <> want or unchecked <> unchecked_ or broad <> broad_").collect() == []
    keep, todo = C.reconciled(df, pages.unionByName(spark.createDataFrame([("d", "s", "")], pages.schema)))
    assert {r.rel for r in keep.collect()} == {"a"} and sorted(r.rel for r in todo.collect()) == ["b", "d"]


# ---------------------------------------------------------------- slugs
def walk(slug, folders):
    """The rule, as a search that goes back: the longest name first."""
    parts = [p for p in slug.split("-") if p]

    def go(base, i):
        if i == len(parts):
            return base or "/"
        for j in range(len(parts), i, -1):
            at = f"{base}/{'-'.join(parts[i:j])}"
            if at in folders and (found := go(at, j)):
                return found
        return None

    return go("", 0) or ""


def test_slug_paths(spark):
    r = random.Random(6)
    folders = set()
    for _ in range(40):
        path = ""
        for _ in range(r.randrange(1, 5)):
            path += "/" + "-".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
            folders.add(path)
    slugs = ["-".join(r.choice("abc") for _ in range(r.randrange(1, 8))) for _ in range(80)] + ["", "-a--b-", "zz"] + [f[1:].replace("/", "-") for f in folders]
    got = {x.slug: x.path for x in S.slug_paths(spark.createDataFrame([(s,) for s in [*slugs, None]], "slug string"), spark.createDataFrame([(f,) for f in folders], "path string")).collect()}
    assert got == {s: walk(s, folders) for s in slugs} and sum(bool(v) for v in got.values()) > 20


# ---------------------------------------------------------------- hinge
@pytest.mark.parametrize("seed", range(6))
def test_hinge_is_the_sweep_without_each_item(spark, seed):
    r = random.Random(seed)
    items = []
    for i in range(14):
        part = r.choice(["hit", "hit", "negative", "neighbor"])
        gold = None if part == "negative" else i % 4
        good = {0: 0.95, 1: 1.0}.get(seed % 3, 0.7)
        pred = gold if gold is not None and r.random() < good else r.choice([0, 1, 2, 3])
        score = r.choice([0.3, 0.5, 0.55, 0.7, 0.9]) if pred == gold else r.choice([0.1, 0.3, 0.52])
        items.append((i, part, "rewrite" if part == "hit" and i % 2 else None, gold, score, pred))
    floors = [0.0, 0.2, 0.4, 0.6]

    def matches(rest, f):
        return all(s >= f and p == g for _, part, _, g, s, p in rest if part == "hit") and not any(s >= f and p != g for _, _, _, g, s, p in rest)

    best = max((x[4] for x in items if x[1] == "negative"), default=0.0)
    want = {x[0]: (x[2] == "rewrite" and x[4] < best, not any(matches([y for y in items if y is not x], f) for f in floors)) for x in items if x[2] == "rewrite" or x[1] == "negative"}
    df = spark.createDataFrame(items, "id int, slice string, kind string, gold int, score double, pred int")
    assert {x.dropped: (x.inverted, x.still_no_floor) for x in E.hinge(df, floors).collect()} == want


def test_live_cards_against_sql_on_odd_rows(spark, tmp_path):
    """A heading that is cut, other scripts and forms, rows that repeat id and text, one id on two texts."""
    import duckdb

    from recollect import catalog

    texts = ["a" * 70 + " more", "plain words of a page", "x " * 40, "", None, "日本語の文章", "ﬁne ＡＢＣ", "İs it", "Ks", "has `code` in it", "１２", "é è", "word" * 12 + "zz tail", "😀 smile at it", "的 了"]
    rows = [(1 + i * 4 + k, x) for k in (0, 3) for i, x in enumerate(texts)]
    rows += [(1001, "twice the same"), (1001, "twice the same"), (1002, "one text"), (1002, "another text"), (None, "no id"), (1003, "b" * 60), (1003, "b" * 60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(r[0] for r in db.execute(catalog.SQL["live_cards"]).fetchall())
    assert sorted(r.rel for r in catalog.QUERIES["live_cards"](spark, str(tmp_path)).collect()) == want


def test_cards_are_judged_without_all_documents(spark, sf):
    """What is judged are the cards with their pages; a condition on the page is not moved below the join, to the documents."""
    from recollect.plans import answers

    for df in (answers._cards(spark, sf), answers.card_acceptance(spark, sf), answers.cards_attached(spark, sf)):
        assert not [f for f in df.inputFiles() if "documents.parquet" in f]
