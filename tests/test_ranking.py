"""BM25 against the full-text engine of the standard library's database, and the engine itself."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from recollect.operators import evaluate as E, rank as R
from recollect.plans import engine


def test_bm25_equals_fts5(spark):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table d using fts5(title, triggers, body, uni)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine in this build")
    r = random.Random(3)
    some = lambda n: [f"t{r.randrange(30)}" for _ in range(n)]
    rows = [(i, some(r.randint(0, 4)), some(r.randint(0, 3)), some(r.randint(1, 40)), some(r.randint(0, 5))) for i in range(60)]
    for i, *fields in rows:
        db.execute("insert into d(rowid, title, triggers, body, uni) values (?, ?, ?, ?, ?)", (i + 1, *(" ".join(f) for f in fields)))
    docs = spark.createDataFrame(rows, "id int, title array<string>, triggers array<string>, body array<string>, uni array<string>")
    asked = [(q, sorted(set(some(4)))) for q in range(8)]
    got = {(x.qid, x.id): x.score for x in R.bm25(docs, "id", engine.FIELDS, spark.createDataFrame(asked, "qid int, terms array<string>"), 9).collect()}
    want = {}
    for q, terms in asked:
        match = "{title triggers body} : (" + " OR ".join(terms) + ")"
        for row, s in db.execute("select rowid, bm25(d, 4.0, 4.0, 1.0, 0.0) from d where d match ?", (match,)):
            want[q, row - 1] = -s
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


PAGES = {
    "rules/API timeout.md": "---\ntitle: API timeout\nstatus: current\n---\n- **Requests time out after 30 seconds now.**\nThe gateway closes slow calls.",
    "logs/old timeout.md": "---\ntitle: Old timeout\nstatus: superseded\n---\nRequests time out after 90 seconds.",
    "topics/健康.md": "---\ntitle: 日更健康\ntriggers: 健康检查\n---\n每天检查网关健康状态。",
    "rules/Keys.md": "---\ntitle: Where API keys live\nsecret: true\n---\ntoken = abc123def456",
    **{f"logs/day {i}.md": f"---\ntitle: Day {i}\n---\nWe talked about lunch, gardens and trains number {i}." for i in range(30)},
}


@pytest.fixture(scope="module")
def index(spark):
    pages = spark.createDataFrame(list(PAGES.items()), "rel string, content string")
    return engine.Index.build(pages, [("rules/", "rule"), ("topics/", "topic"), ("logs/", "log")])


def test_recall_finds_and_refuses(spark, index):
    asked = spark.createDataFrame([(1, "requests gateway timeout seconds"), (2, "quantum chromodynamics lattice"), (3, "日更健康"), (4, "")], "qid int, q string")
    rows = engine.recall(index, asked).collect()
    first = {r.qid: r for r in rows if r["rank"] in (1, None)}
    assert first[1].rel == "rules/API timeout.md" and first[1].confidence != "none" and first[1].tier == "rule"
    assert first[2].confidence == "none" and first[4].confidence == "none"
    assert first[3].rel == "topics/健康.md"
    assert not any(r.rel == "rules/Keys.md" for r in rows)
    assert index.n == len(PAGES) - 1


def test_scope_and_lock(spark, index):
    asked = spark.createDataFrame([(1, "requests gateway timeout seconds"), (2, "the API timeout")], "qid int, q string")
    first = lambda scope: {r.qid: (r.rel, r.widened) for r in engine.widened(index, asked, scope).collect() if r["rank"] == 1}
    assert first("logs")[1] == ("logs/old timeout.md", False) and first("topics")[1] == ("rules/API timeout.md", True)
    aliases = spark.createDataFrame([("a1", "API timeout", "rules/API timeout.md")], "id string, alias string, source string")
    out = {r.qid: r for r in engine.ask(index, asked, aliases).collect()}
    assert out[2].route == "lock" and out[2].rel == "rules/API timeout.md" and out[1].route == "recall"
    text = engine.receipt(engine.ask(index, asked, aliases))
    assert {r.qid: r.route for r in engine.from_receipt(text, "route").collect()} == {1: "recall", 2: "lock"}


def test_cards(spark, index):
    from recollect.operators import cards as C

    pages = spark.createDataFrame([("rules/API timeout.md", "s1", PAGES["rules/API timeout.md"])], "rel string, sha string, body string")
    cards = [
        ("rules/API timeout.md", "s1", "what is the API timeout", "Requests time out after 30 seconds.", None, 1), ("rules/API timeout.md", "old", "q timeout", "a", None, 1),
        ("rules/API timeout.md", "s1", "api timeout", "After 45 seconds.", None, 1), ("rules/API timeout.md", "s1", "lunch menu", "Requests time out after 30 seconds.", None, 1),
        ("rules/API timeout.md", "s1", "api timeout", "Requests time out after 30 seconds.", None, None), ("rules/API timeout.md", "s1", "x", "token: abcd1234", None, 1),
    ]
    df = spark.createDataFrame(cards, "rel string, sha string, q string, a string, empty boolean, v int")
    assert {(r.q, r.sha, r.v): r.state for r in C.health(df, pages).collect()} == {
        ("what is the API timeout", "s1", 1): "ok", ("q timeout", "old", 1): "stale", ("api timeout", "s1", 1): "unfaithful",
        ("lunch menu", "s1", 1): "off-page", ("api timeout", "s1", None): "unverified", ("x", "s1", 1): "secret",
    }
    asked = spark.createDataFrame([(1, "requests gateway timeout api")], "qid int, q string")
    hits = engine.recall(index, asked)
    assert any(r.card is not None for r in engine.with_cards(index, hits, asked, df.where("v = 1")).collect())


def test_grading_published_rows(spark):
    """A sloppy and a perfect answer set."""
    q = spark.createDataFrame([(i, "refuse" if i >= 6 else "current", None if i >= 6 else i) for i in range(9)], "qid int, kind string, gold int")
    good = spark.createDataFrame([(i, i, 5.0 + i) for i in range(6)], "qid int, cited int, score double")
    bad = spark.createDataFrame([(i, 0, 5.0 - i) for i in range(9)], "qid int, cited int, score double")
    s = E.summary(E.graded(q, good)).first()
    assert (s.n, s.n_answered, s.n_wrong, s.n_refused, s.wrong_rate) == (9, 6, 0, 3, 0.0)
    t = E.summary(E.graded(q, bad)).first()
    assert (t.n_answered, t.n_wrong, t.wrong_rate) == (9, 8, 0.889)
    assert E.pick_floor(E.graded(q, bad)).first().floor == 5.0
    curve = E.coverage_curve(E.graded(q, good)).orderBy("cut").collect()
    assert curve[-1].n_answered == 6 and all(c.n_wrong == 0 for c in curve)
    assert E.summary(E.graded(q, E.with_floor(bad, 100.0))).first().wrong_rate == 0.0
    assert E.at_coverage(bad, 3).where("cited is not null").count() == 3


def test_intervals_are_those_of_one_stream(spark):
    """Against the resampling written out, for one system and for a difference."""
    r = random.Random(1)
    rows = [(i, r.choice([None, i % 3]), r.choice([None, 0, 1, 2]), r.choice([None, 0, 1, 2])) for i in range(40)]
    q = spark.createDataFrame([(i, "k", g) for i, g, _, _ in rows], "qid int, kind string, gold int")
    grade = lambda k: E.graded(q, spark.createDataFrame([(x[0], x[k], 1.0) for x in rows], "qid int, cited int, score double"))
    reps, stream = 400, random.Random(20261013)
    seen = {}
    for _ in range(reps):
        pick = [rows[stream.randrange(len(rows))] for _ in rows]
        one = []
        for k in (2, 3):
            answered = [x for x in pick if x[k] is not None]
            right = sum(x[k] == x[1] for x in answered)
            one.append((round((len(answered) - right) / len(answered), 3) if answered else 0.0, right, len(pick) - len(answered)))
        for name, a, b in zip(("wrong_citation_rate", "right", "refused"), *one):
            seen.setdefault(name, []).append(a)
            seen.setdefault(f"delta_{name}", []).append(a - b)
    want = {k: (sorted(v)[int(0.025 * (reps - 1))], sorted(v)[int(0.975 * (reps - 1))]) for k, v in seen.items()}
    got = {x.metric: (x.low, x.high) for x in E.bootstrap(grade(2), grade(3), reps).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1.1e-3) for k in want)
    assert set(x.metric for x in E.bootstrap(grade(2), None, 50).collect()) == {"wrong_citation_rate", "right", "refused"}


def test_a_duel_and_its_interval(spark):
    """Against the rule and the resampling written out; marks that are no points, and a question of one system only."""
    r = random.Random(4)
    rows = [(q, f"2025-0{1 + q % 3}-05", s, p, r.random() < 0.2, r.random() < 0.8, r.random() < 0.2, r.choice([0, 1, 2, 5, None])) for q in range(50) for s in "ab" for p in (0, 1) if (q, s) != (7, "b")]
    df = spark.createDataFrame(rows, "qid int, day string, system string, pass int, refused boolean, existed boolean, invalid boolean, points int").withColumn("day", F.col("day").cast("date"))
    points = lambda x: (0 if x[5] else 2) if x[4] else 0 if x[6] or not x[5] else x[7] if x[7] in (0, 1, 2) else 0
    mean = lambda xs: sum(xs) / len(xs)
    each = {q: [mean([points(x) for x in rows if x[0] == q and x[2] == s]) for s in "ab"] for q in range(50) if q != 7}
    diffs = [a - b for a, b in each.values()]
    stream, reps = random.Random(0), 400
    means = sorted(mean([stream.choice(diffs) for _ in diffs]) for _ in range(reps))
    out = {x.month: x for x in E.duel(df, "a", "b", reps).collect()}
    assert (out["all"].n, out["all"].mean_a, out["all"].mean_b) == (49, round(mean([a for a, _ in each.values()]), 3), round(mean([b for _, b in each.values()]), 3))
    assert (out["all"].low, out["all"].high) == pytest.approx((means[10], means[389]), abs=1e-3)
    assert set(out) == {"all", "2025-01", "2025-02", "2025-03"} and out["2025-02"].n == len([q for q in each if q % 3 == 1]) and out["2025-01"].low is None
    assert out["all"].existed == pytest.approx(mean([x[5] for x in rows if x[2:4] == ("a", 0)]), abs=1e-3)
    assert E.duel(df.limit(0), "a", "b", 10).where("n > 0").count() == 0


@pytest.mark.parametrize("answer, page, want", [
    ("version 3", "we run version 1.3 here", False), ("version 1.3", "we run version 1.3 here", True), ("3 items", "30 items", False), ("v0.9.2", "tag v0.9.2 out", True), ("0.9.2", "tag v0.9.2 out", True),
    ("8/16", "8 and 16", False), ("push/release", "push, then release", True), ("llm+DeepSeek", "llm and deepseek", True), ("`a b`", "x a b y", True), ("`a b`", "xa by", False),
    ("没有数字", "别的", True), ("go on", "stay", True), ("Opus 5.5：/opt/x", "opus 5.5 in /opt/x", True), ("1:3.3", "1 and 3.3", False), ("ＡＢＣ", "abc", True),
])
def test_faithful_answers(spark, answer, page, want):
    from recollect.operators import cards as C

    df = spark.createDataFrame([(answer, page)], "a string, p string")
    assert df.select(C.faithful(F.col("a"), F.col("p")).alias("x")).first().x is want


def test_cards_that_hold_are_triggers(spark, tmp_path):
    import hashlib

    text = "---\ntitle: Gateway\n---\nCalls end after 30 seconds."
    sha = hashlib.sha1(text.encode()).hexdigest()[:16]
    cards = [("a.md", sha, "zebra question seconds", "Calls end after 30 seconds."), ("a.md", "old", "walrus question seconds", "Calls end after 30 seconds."), ("a.md", sha, "heron question seconds", "Calls end after 45 seconds."), ("a.md", sha, "otter", "Calls end after 30 seconds.")]
    pages = spark.createDataFrame([("a.md", text), ("b.md", "Something else altogether, of lunch.")], "rel string, content string")
    df = spark.createDataFrame(cards, "rel string, sha string, q string, a string")
    index = engine.Index.current(pages, [], str(tmp_path / "index"), cards=df)
    words = {r.rel: set(r.triggers) for r in index.rows.collect()}
    assert words["a.md"] == {"zebra", "question", "seconds"} and not words["b.md"]
    again = engine.Index.current(pages.limit(0), [], str(tmp_path / "index"))
    assert again.n == 2  # it stands, so it is not made anew
    spark.createDataFrame([("older",)], "version string").write.mode("overwrite").parquet(str(tmp_path / "index" / "version"))
    index = engine.Index.current(pages.where("rel = 'b.md'"), [], str(tmp_path / "index"))
    assert index.n == 1
    found, lines = engine.bounded(index, spark.createDataFrame([(1, "ALTOGETHER, of lunch"), (2, "nowhere to be seen")], "qid int, q string"), "b.md")
    assert [(r.qid, r.rel, r.line_no) for r in lines.collect()] == [(1, "b.md", 0)]


def test_words_of_the_language_that_are_nowhere(spark, tmp_path):
    freq = spark.createDataFrame([("常见", 900), ("房贷", 50), ("报销", 40), ("利率", 30), ("健康", 25), ("检查", 24), ("网关", 20), ("的", 5000)], "word string, freq int")
    lexicon = engine.Lexicon.of(freq, generic=1, chars=3)
    assert {r.char for r in lexicon.chars.collect()} == {"的", "常", "见"} and {r.word for r in lexicon.words.where("generic").collect()} == {"常见"}
    pages = spark.createDataFrame([(f"p{i}.md", f"---\ntitle: 网关 {i}\n---\n" + ("网关 健康 检查 每天" if i == 3 else "会议 记录")) for i in range(12)], "rel string, content string")
    index = engine.Index.build(pages, [], path=str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "网关 房贷 报销 利率"), (2, "网关 健康 检查")], "qid int, q string")
    got = {r.qid: r.refuse for r in engine.recall(index, asked, 1, lexicon=lexicon).collect()}
    assert got == {1: True, 2: False}


def test_the_first_ones_are_those_of_all_scores(spark):
    """No pair of question and document is left out that may be among the first ones; ties, documents without asked
    terms, a question that nobody answers, and keys of several rows."""
    r = random.Random(8)
    some = lambda n: [f"t{r.randrange(25)}" for _ in range(n)]
    docs = [(f"d{i:03}", some(r.randint(0, 3)), [], some(r.randint(0, 30)), some(2)) for i in range(120)] + [(f"e{i}", ["t1"], [], ["t2", "t2"], []) for i in range(9)]
    asked = spark.createDataFrame([(q, sorted(set(some(5)))) for q in range(300)] + [(300, ["nowhere"]), (301, [])], "qid int, terms array<string>")
    schema = "rel string, title array<string>, triggers array<string>, body array<string>, uni array<string>"
    top = lambda scored: {(x.qid, x["rank"]): (x.rel, round(x.score, 9)) for x in R.top(scored, "rel", 7, F.round("score", 9)).collect()}
    for rows in (docs, [*docs, docs[3], docs[3]], docs[:0]):
        df = spark.createDataFrame(rows, schema).repartition(3)
        want = top(R.bm25(df, "rel", engine.FIELDS, asked, digits=None))
        assert top(R.bm25_first(df, "rel", engine.FIELDS, asked, 7)) == want and (want or not rows)
    got = R.bm25_first(spark.createDataFrame(docs * 1, schema).repartition(3), "rel", engine.FIELDS, asked, 2)
    assert got.count() < R.bm25(spark.createDataFrame(docs, schema), "rel", engine.FIELDS, asked, digits=None).count() / 2


def test_trigrams_are_made_when_they_are_asked_for(spark, tmp_path):
    """Recall has no use for them; once made they stand, are loaded again, and go with the pages they are of."""
    pages = spark.createDataFrame([("a.md", "Calls end after 30 seconds."), ("b.md", "Something else altogether.")], "rel string, content string")
    at = tmp_path / "index"
    index = engine.Index.current(pages, [], str(at))
    asked = spark.createDataFrame([(1, "ELSE altogether")], "qid int, q string")
    engine.recall(index, asked).collect()
    assert not (at / "grams").exists()
    lines = lambda i: [(x.rel, x.hit) for x in engine.literal(i, asked).collect()]
    assert lines(index) == [("b.md", True)] and (at / "grams" / "version").exists()
    made = sorted((at / "grams" / "rows").rglob("*.parquet"))
    assert lines(engine.Index.load(spark, str(at))) == [("b.md", True)] and sorted((at / "grams" / "rows").rglob("*.parquet")) == made
    assert not lines(engine.Index.build(pages.where("rel = 'a.md'"), [], path=str(at)))
