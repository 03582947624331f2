import datetime as dt
import json
import sqlite3

import pandas as pd
import pytest
from pyspark.sql import functions as F

from recollect.operators import changes, lock, quality, sessions
from recollect.plans import nightly
from recollect.sources import files
from recollect.streaming import logs


def test_page_folder(spark, tmp_path):
    for rel, text in {"a/b c.md": "---\ntitle: x\n---\nhi", "健.md": "y", ".obsidian/z.md": "no", "Clippings/q.md": "no", "a/+1.md": "p", "a/no.txt": "no"}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    rows = {r.rel: r.content for r in files.pages(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/b c.md", "健.md", "a/+1.md"} and rows["健.md"] == "y"


def test_lists_and_lines(spark, tmp_path):
    (tmp_path / "alias.psv").write_text("# comment\nid|aliases|source|anchor\na1|api timeout;timeout|e/a.md|#x\n\na2|b|c.md|\n")
    got = files.alias_table(spark, str(tmp_path / "alias.psv")).collect()
    assert [(r.id, r.aliases, r.source, r.anchor) for r in got] == [("a1", ["api timeout", "timeout"], "e/a.md", "#x"), ("a2", ["b"], "c.md", "")]
    (tmp_path / "bad.psv").write_text("a1|x\n")
    with pytest.raises(Exception, match="not four fields"):
        files.alias_table(spark, str(tmp_path / "bad.psv")).collect()
    (tmp_path / "trig").write_text('p.md|x;y\na1|q|r.md|z\n{"rel": "s.md", "word": "w"}\n')
    assert {r.rel: r.words for r in files.trigger_lists(spark, str(tmp_path / "trig")).collect()} == {"p.md": ["x", "y"], "r.md": ["q"], "s.md": ["w"]}
    (tmp_path / "topics").write_text("t|Title|a;b\n")
    assert files.topic_list(spark, str(tmp_path / "topics")).first().terms == ["a", "b"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n[1]\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").where("a is not null").collect()) == [1, 2]
    (tmp_path / "h.csv").write_text("﻿intent,kind\nEXAMPLE 1,x\nreal,y\n")
    assert [r.kind for r in files.csv_with_examples(spark, str(tmp_path / "h.csv"), "intent").collect()] == ["y"]


def test_store_of_two_generations(spark, tmp_path):
    for name, cols in (("a.db", "id, title, text"), ("b.db", "id, title, narrative")):
        db = sqlite3.connect(tmp_path / name)
        db.execute(f"create table observations ({cols})")
        db.execute("insert into observations values (1, 't', 'x')")
        db.commit()
        row = files.store(spark, str(tmp_path / name), "observations", ["id", "title", "text", "narrative"]).first()
        assert row.title == "t" and (row.text, row.narrative) in (("x", None), (None, "x"))


def test_transcripts(spark, tmp_path):
    say = lambda role, text, **k: json.dumps({"type": role, "timestamp": "2025-01-01T00:00:00Z", "cwd": "/w", "message": {"role": role, "content": text}, **k})
    (tmp_path / "s1.jsonl").write_text("\n".join([say("user", "first ask"), say("assistant", [{"type": "text", "text": "draft"}]), say("assistant", [{"type": "text", "text": "answer"}]), say("user", "meta", isMeta=True), say("user", "second")]))
    (tmp_path / "s2.jsonl").write_text(say("user", "robot", entrypoint="sdk-cli"))
    rows = files.transcripts(spark, str(tmp_path), "claude")
    turns = sessions.turns(rows, "session", "seq", F.col("role") == "user", F.col("role") == "assistant", "text").orderBy("turn_no").collect()
    assert [(t.session, t.ask, t.answer) for t in turns] == [("s1", "first ask", "answer"), ("s1", "second", None)]
    df = spark.createDataFrame([("Monday, Oct 13, 2025, 9:05 PM (UTC+8)",), ("Monday, Oct 13, 2025, 9:05 PM (UTC-3:30)",)], "t string")
    got = [str(r[0]) for r in df.select(files.cursor_time(F.col("t")).cast("string")).collect()]
    assert got == ["2025-10-13 13:05:00", "2025-10-14 00:35:00"]


def test_lock_bands(spark):
    aliases = spark.createDataFrame([("a", "deploy freeze", "x.md"), ("b", "deploy", "y.md"), ("c", "plan", "z.md"), ("d", "plan", "z.md"), ("e", "rota", "r.md"), ("f", "rota", "s.md")], "id string, alias string, source string")
    asked = spark.createDataFrame([(1, "Deploy freeze!"), (2, "when is the deploy freeze over"), (3, "plan"), (4, "rota"), (5, "nothing here"), (6, "…")], "qid int, q string")
    got = {r.qid: r.id for r in lock.locked(asked, aliases).collect()}
    assert got == {1: "a", 2: "a", 3: "c"}
    assert [(r.qid, r.first, r.second) for r in lock.conflicts(asked, aliases).collect()] == [(4, "e", "f")]
    triggers = spark.createDataFrame([("p", "ship"), ("q", "ship it"), ("r", "^go"), ("s", "xx"), ("t", "xx")], "rel string, word string")
    asks = spark.createDataFrame([(1, "please ship it"), (2, "go"), (3, "go on"), (4, "xx")], "qid int, q string")
    assert {r.qid: (r.rel, r.ambiguous) for r in lock.trigger_match(asks, triggers).collect()} == {1: ("q", False), 2: ("r", False), 4: ("s", True)}


CHANGES = {
    "replaced": [("1", "本地 API 端口用 8080（10:05）", "replaced"), ("1", "日志级别用 info（10:20）", "holds"), ("2", "原来本地 API 端口 8080 → 改成 9090（14:00）", "holds")],
    "restated": [("1", "原来本地 API 端口 8080 → 改成 9090（14:00）", "holds"), ("2", "本地 API 端口用 9090，已经写进 README（09:00）", "holds")],
    "chain": [("1", "原来缓存过期 30 分钟 → 改成 10 分钟（10:00）", "replaced"), ("2", "原来缓存过期 10 分钟 → 改成 15 分钟（15:00）", "holds")],
    "english chain": [("1", "timeout 30 seconds → 10 seconds (10:00)", "replaced"), ("2", "timeout 10 seconds → 15 seconds (11:00)", "holds")],
    "back": [("1", "本地 API 端口用 8080（10:00）", "holds"), ("1", "原来本地 API 端口 8080 → 改成 9090（11:00）", "replaced"), ("1", "原来本地 API 端口 9090 → 改回 8080（15:00）", "holds")],
    "shared words": [("1", "本地 API 端口文档放在 README（10:00）", "holds"), ("1", "本地 API 用 JWT 鉴权（10:10）", "holds"), ("2", "was local API port 8080 → now 9090 (14:05)", "holds")],
    "another subject": [("1", "缓存过期 10 分钟（10:00）", "holds"), ("1", "会议时长 10 分钟（10:05）", "replaced"), ("2", "原来会议时长 10 分钟 → 改成 15 分钟（14:00）", "holds")],
    "part of the subject": [("1", "测试环境 API 端口用 8080（10:00）", "unsure"), ("1", "本地 API 端口用 8080（10:05）", "replaced"), ("2", "原来本地 API 端口 8080 → 改成 9090（14:00）", "holds")],
    "order of time": [("1", "port 9090 gateway → port 8080 gateway (09:00)", "holds"), ("1", "gateway uses port 9090 (11:00)", "holds")],
}


def test_changes(spark):
    rows = [(root, day, seq, line) for root, lines in CHANGES.items() for seq, (day, line, _) in enumerate(lines)]
    got = {(r.root, r.seq): r.state for r in changes.stale(spark.createDataFrame(rows, "root string, day string, seq int, line string")).collect()}
    assert got == {(root, seq): state for root, lines in CHANGES.items() for seq, (_, _, state) in enumerate(lines)}


def _states(lines):
    """The written rule, line by line, over word sets."""
    words = [set(x["said"]) for x in lines]
    value = lambda s: {w for w in s if any(c.isdigit() or "a" <= c <= "z" for c in w)} or s
    out = []
    for i, x in enumerate(lines):
        later = [y for y in lines if y["at"] > x["at"] and y["change"]]
        state = "holds"
        if x["change"]:
            gone, came = value(x["old"] - x["new"]), value(x["new"] - x["old"])
            core = (x["old"] | x["new"]) - gone - came
            if any(came and came <= y["old"] and (not core or core & y["old"]) for y in later):
                state = "replaced"
        else:
            for y in sorted(later, key=lambda y: y["at"]):
                less, more = y["old"] - y["new"], y["new"] - y["old"]
                gone, came, about = value(less), value(more), {w for w in less if not any(c.isdigit() or "a" <= c <= "z" for c in w)}
                undone = any(z["at"] > y["at"] and value(z["new"] - z["old"]) and value(z["new"] - z["old"]) <= words[i] for z in later)
                if gone and gone <= words[i] and not (came and 2 * len(came & words[i]) >= len(came)) and (not about or about & words[i]) and not undone:
                    if about <= words[i]:
                        state = "replaced"
                    elif state == "holds":
                        state = "unsure"
        out.append(state)
    return out


def test_changes_against_the_rule(spark):
    import random

    r = random.Random(5)
    vocabulary = ["缓存", "端口", "会议", "日志", "a1", "b2", "c3"]
    some = lambda n: r.sample(vocabulary, n)
    rows, want = [], {}
    for root in range(150):
        lines = []
        for seq in range(r.randint(2, 6)):
            change = r.random() < 0.6
            old, new = some(r.randint(1, 4)), some(r.randint(1, 3))
            text = f"{' '.join(old)} → {' '.join(new)}" if change else " ".join(old)
            day = str(r.randint(1, 3))
            rows.append((root, day, seq, text))
            lines.append({"said": old + (new if change else []), "old": set(old), "new": set(new), "change": change, "at": (day, seq), "seq": seq})
        want |= {(root, x["seq"]): s for x, s in zip(lines, _states(lines))}
    got = {(x.root, x.seq): x.state for x in changes.stale(spark.createDataFrame(rows, "root int, day string, seq int, line string")).collect()}
    assert {k: (got[k], v) for k, v in want.items() if got[k] != v} == {} and {"holds", "replaced", "unsure"} <= set(want.values())


def test_days(spark):
    d = dt.date
    df = spark.createDataFrame([("a", d(2024, 1, 1)), ("a", d(2024, 1, 2)), ("a", d(2024, 1, 2)), ("a", d(2024, 1, 4)), ("b", d(2024, 1, 1))], "k string, day date")
    got = sorted((r.k, str(r.first_day), r.n_days) for r in sessions.streaks(df, ["k"], "day").collect())
    assert got == [("a", "2024-01-01", 2), ("a", "2024-01-04", 1), ("b", "2024-01-01", 1)]
    assert sessions.calendar("2024-01-01", "2024-01-05", df.where("k = 'a'").select("day").distinct(), "day").count() == 5


def test_budgets(spark):
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate([10, 20, 5, 1])], "k string, o int, n int")
    keep = lambda crossing: [r.o for r in sessions.running_budget(df, "k", ["o"], F.col("n"), 25, crossing).orderBy("o").collect()]
    assert keep(True) == [0, 1] and keep(False) == [0]
    segs = sessions.segments(spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([300, 300, 100, 700, 50])], "k string, o int, t string"), "k", "o", "t", 650)
    assert sorted((r.segment, r.n) for r in segs.collect()) == [(0, 2), (1, 1), (2, 1), (3, 1)]


def test_upkeep(spark):
    pages = spark.createDataFrame([("a.md", {"supersedes": "[[b]]"}), ("b.md", {"superseded_by": "a"}), ("c/d.md", {})], "rel string, meta map<string,string>")
    assert [(r.new, r.old) for r in quality.supersede_edges(pages).collect()] == [("a.md", "b.md")]
    links = spark.createDataFrame([("a.md", "d"), ("a.md", "x"), ("a.md", "c/d.md")], "src string, target string")
    assert [r.target for r in quality.broken_links(links, pages).collect()] == ["x"]
    fresh = spark.createDataFrame([("n.md", "new mark"), ("s.md", "same mark"), ("f.md", "mine mark")], "rel string, content string")
    there = spark.createDataFrame([("s.md", "same mark"), ("f.md", "theirs")], "rel string, content string")
    assert {r.rel: r.state for r in quality.merged_pages(fresh, there, "mark").collect()} == {"n.md": "written", "s.md": "same", "f.md": "kept"}
    bad = spark.createDataFrame([("../x.md", "a"), ("ok.md", "a"), ("x.txt", "a"), ("big.md", "a" * 70_000)], "path string, content string")
    assert {r.path: r.reason for r in quality.safe_files(bad).collect()} == {"../x.md": "outside the folder", "ok.md": None, "x.txt": "not a page", "big.md": "too large"}


def test_model_steps(spark):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(13)], "k int, t string")
    prompts = nightly.batches(rows, "k", "t", 6, 1)
    assert sorted(r.n for r in prompts.collect()) == [1, 6, 6]
    answered = nightly.complete(prompts, lambda s: s.str.len().astype(str))
    assert all(int(r.answer) == len(r.prompt) for r in answered.collect())
    steps = nightly.run_steps(spark, [("a", lambda: "done"), ("b", lambda: nightly.complete(prompts, None)), ("c", lambda: 1 / 0)])
    assert [r.state for r in steps.collect()] == ["ok", "skipped", "failed"] and nightly.overall(steps) == "failed"
    out = nightly.adapter(spark.createDataFrame([(1, "q")], "qid int, q string"), lambda f: pd.DataFrame({"qid": f.qid, "cited": ["p"], "score": [1.0]}))
    assert out.first().cited == "p"


def test_models_are_tried_in_turn(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(9)], "k int, prompt string").repartition(3)

    def broken(s):
        raise OSError("offline")

    half = lambda s: pd.Series([x if int(x[1:]) % 2 else None for x in s], index=s.index)
    out = nightly.complete(prompts, [("a", broken), ("b", half), ("c", lambda s: s + "!"), ("d", broken)]).collect()
    assert {r.k: (r.answer, r.channel) for r in out} == {i: (f"p{i}", "b") if i % 2 else (f"p{i}!", "c") for i in range(9)}
    with pytest.raises(Exception, match="a: OSError: offline . b: no text"):
        nightly.complete(prompts, [("a", broken), ("b", half)]).collect()
    steps = nightly.run_steps(spark, [("none", lambda: nightly.complete(prompts, [])), ("down", lambda: str(nightly.complete(prompts, [("a", broken)]).collect()))])
    assert [r.state for r in steps.collect()] == ["skipped", "failed"]


def test_streams_go_on_where_they_ended(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    put = lambda rows, n: spark.createDataFrame([(i, t, 1, k, 1.0, "p") for i, t, k in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = dt.datetime(2024, 1, 1)
    put([(1, t, "view"), (2, t + dt.timedelta(hours=5), "view")], 0)
    again = lambda: logs.drained(logs.asked_again(logs.stream(spark, str(tmp_path / "in"), logs.EVENTS), "user_id", "view", "purchase"), str(tmp_path / "out"), str(tmp_path / "c"))
    assert {r.event_id: r.repeated for r in again().collect()} == {1: False, 2: True}
    put([(3, t + dt.timedelta(hours=6), "purchase"), (4, t + dt.timedelta(hours=7), "view"), (5, t + dt.timedelta(hours=40), "view")], 1)
    assert {r.event_id: r.repeated for r in again().collect()} == {1: False, 2: True, 4: False, 5: False}


def test_a_late_row_is_judged_by_time(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    put = lambda rows: spark.createDataFrame([(i, t, 1, k, 1.0, "p") for i, t, k in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    go = lambda: {r.event_id: r.repeated for r in logs.drained(logs.asked_again(logs.stream(spark, str(tmp_path / "in"), logs.EVENTS), "user_id", "view", "purchase"), str(tmp_path / "out"), str(tmp_path / "c")).collect()}
    put([(1, t, "view"), (2, t + 10 * h, "purchase")])
    assert go() == {1: False}
    put([(3, t + 5 * h, "view"), (4, t + 11 * h, "view")])  # 3 comes after 2 has been seen, but stands before it
    assert go() == {1: False, 3: True, 4: False}
    put([(5, t + 400 * h, "view")])
    go()
    put([(6, t + 401 * h, "view")])
    assert go()[6] is True


def test_state_is_gone_after_its_time(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    put = lambda rows: spark.createDataFrame([(i, t, u, "view", 1.0, "p") for i, t, u in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    go = lambda: logs.drained(logs.asked_again(logs.stream(spark, str(tmp_path / "in"), logs.EVENTS), "user_id", "view", "purchase"), str(tmp_path / "out"), str(tmp_path / "c"))

    def held():
        rows = spark.read.format("statestore").option("stateVarName", "line").load(str(tmp_path / "c")).select("key.user_id", "list_element.event_id")
        return {(r.user_id, r.event_id) for r in rows.collect()}

    put([(1, t, 1), (2, t + h, 1), (3, t, 2)])
    go()
    assert held() == {(1, 1), (1, 2), (2, 3)}
    put([(4, t + 100 * h, 2)])
    go()
    put([(5, t + 101 * h, 2)])  # the mark is 76 hours on now
    assert {r.event_id: r.repeated for r in go().collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}
    assert held() == {(2, 4), (2, 5)}


def test_stream_upsert(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, "k int, v int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    (tmp_path / "in").mkdir()
    go = lambda: {r.k: r.v for r in logs.upserted(logs.stream(spark, str(tmp_path / "in"), "k int, v int"), str(tmp_path / "t"), str(tmp_path / "c"), "k", "v", 4).collect()}
    assert go() == {}
    put([(1, 1), (1, 2), (2, 1)])
    assert go() == {1: 2, 2: 1}
    assert go() == {1: 2, 2: 1}  # nothing new
    put([(2, 5), (3, 1), (1, 0)])  # an older version of 1 comes late
    assert go() == {1: 2, 2: 5, 3: 1}


def test_ledger_lines_and_ticks(spark):
    import hashlib

    ledger = spark.createDataFrame([("a", hashlib.sha256(b"x").hexdigest()), ("b", "0"), ("c", "0")], "rel string, sha string")
    have = spark.createDataFrame([("a", "x"), ("b", "y")], "rel string, content string")
    assert {r.rel: r.state for r in quality.ledger_check(ledger, have).collect()} == {"a": "verified", "b": "mismatch", "c": "missing"}
    hits = spark.createDataFrame([("k/s.md:3: x",), ("k/t.md:4: y",)], "line string")
    assert [r.line for r in quality.without_secret_hits(hits, spark.createDataFrame([("k/s.md",)], "rel string")).collect()] == ["k/t.md:4: y"]
    ticked = [("n1", "new", "p.md"), ("n1", "other", "p.md"), ("n2", "new", "p.md"), ("n3", "z", "gone.md")]
    got = [r.reason for r in lock.apply_ticked(spark, [("a", "old", "p.md")], ticked, {"p.md"}).collect()]
    assert got == [None, "id is taken", "alias is taken", "no such page"]


def test_slices_and_leaving_out(spark):
    from recollect.operators import evaluate as E

    items = spark.createDataFrame([("1", "hit", "a", None, None), ("2", "hit", "b", "c", None), ("3", "negative", None, None, "t")], "id string, slice string, gold string, old string, trap string")
    lockish = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, cited string")
    s = E.slices_exact(items, lockish)
    assert {r.slice: r.exact for r in s.collect()} == {"hit": 1.0, "negative": 1.0, "all": 1.0} and E.matches_lock(s).first().matches
    assert not E.matches_lock(E.slices_exact(items, spark.createDataFrame([("1", "a"), ("2", "c"), ("3", "t")], "id string, cited string"))).first().matches
    q = spark.createDataFrame([(1, "k", 1), (2, "k", 2)], "qid int, kind string, gold int")
    g = E.graded(q, spark.createDataFrame([(1, 1, 5.0), (2, 9, 3.0)], "qid int, cited int, score double"))
    cuts = spark.createDataFrame([(0.0,), (4.0,)], "floor double")
    assert {(r.left_out, r.floor): r.points for r in E.leave_one_out(g, cuts).collect()} == {(1, 0.0): -1, (2, 0.0): 1, (1, 4.0): 0, (2, 4.0): 1}


def test_pages_of_sessions_and_other_memories(spark):
    from recollect.operators import upkeep as U

    lines = spark.createDataFrame([("r", 1, "first", True, "holds"), ("r", 2, "second", False, "unsure"), ("z", 1, "用 8080", True, "holds"), ("z", 2, "x" * 2000, True, "holds")], "root string, n int, line string, confirmed boolean, state string")
    got = {r.root: (r.zh, r.context) for r in U.session_start(lines).collect()}
    assert got == {"r": (False, "- first\n- second (unconfirmed) (may have changed; check)"), "z": (True, "- 用 8080")}
    days = spark.createDataFrame([("a.md", "# x\n## Decisions\n- use a\n* use b\nplain\n\n## Other\n- no"), ("b.md", "## 定下来的事\n- 没有定下来的事"), ("c.md", "none")], "rel string, body string")
    assert sorted((r.rel, r.seq, r.line) for r in U.digest_lines(days).collect()) == [("a.md", 0, "- use a"), ("a.md", 1, "* use b")]
    s = spark.createDataFrame([("s1", ""), ("s2", "asked")], "session string, request string")
    o = spark.createDataFrame([("s1", 1, None, None, "f1", "p"), ("s1", 2, "T", "do it", "f2", "q"), ("s1", 3, "U", "no", "f1", None), ("s2", 1, "V", None, None, None)], "session string, seq int, title string, decision string, fact string, file string")
    assert sorted((r.session, r.title, r.how, r.facts, r.files, r.n) for r in U.memory_pages(s, o).collect()) == [("s1", "T", "do it", ["f1", "f2"], ["p", "q"], 3), ("s2", "asked", None, [], [], 1)]
    p = spark.createDataFrame([("k", 3), ("l", 4)], "key string, n long")
    assert sorted((r.key, r.digest) for r in U.reused_digests(p, spark.createDataFrame([("k", 3, "d"), ("l", 3, "e")], "key string, n long, digest string")).collect()) == [("k", "d"), ("l", None)]
    f = spark.createDataFrame([("x", 1, "/home/u/v/notes/b.md"), ("x", 2, "notes/a.md"), ("x", 3, "/w/notes/b.md"), ("x", 4, "/other")], "answer string, seq int, file string")
    assert sorted((r.place, r.rel) for r in U.source_pages(f, ["notes"]).collect()) == [(1, "notes/b.md"), (2, "notes/a.md")]
    r = spark.createDataFrame([("1: Yes\n2: maybe\n9: yes\nno line",)], "reply string")
    assert [(x.id, x.label) for x in U.parsed_labels(r, spark.createDataFrame([(1,), (2,)], "id int"), ["yes", "no"]).collect()] == [("1", "yes")]
    t = spark.createDataFrame([("a", "x"), ("b", "y")], "rel string, text string")
    assert U.vector_key(t, "m").first().sha == U.vector_key(t.orderBy("text", ascending=False), "m").first().sha != U.vector_key(t, "n").first().sha
    v = spark.createDataFrame([("a", "T", "body"), ("b", "U", "x")], "rel string, title string, body string")
    assert [(x.rel, x.text) for x in U.view_texts(v, spark.createDataFrame([("a", "n2"), ("a", "n1")], "source string, alias string")).collect()] == [("a", "n1 n2\nT\nbody")]
    c = spark.createDataFrame([("a.md", "provisional", ["x"]), ("b.md", "provisional", []), ("c.md", "active", ["x"]), ("d.md", "Provisional", ["y"])], "file string, status string, triggers array<string>")
    assert [x.file for x in U.to_ask(c, spark.createDataFrame([("d.md", True), ("a.md", False)], "file string, repeated boolean")).collect()] == ["a.md"]
    k = spark.createDataFrame([("r/a.md", "rule", {"title": "x"}), ("r/b.md", "rule", {"title": "api key"}), ("n/c.md", "topic", {}), ("o.md", "other", {})], "rel string, tier string, meta map<string,string>")
    assert [x.rel for x in U.card_targets(k, ["n/"]).collect()] == ["r/a.md"]
    st = spark.createDataFrame([("a1", "n, m", "p.md", "do"), ("a0", "k", "q.md", "be")], "id string, names string, source string, how string")
    page = U.standing_page(st).first()
    assert page.page == "a0 | k | q.md | be\na1 | n, m | p.md | do" and page.n == 2 and U.stale_triggers(st.select(F.col("source").alias("rel")), spark.createDataFrame([("p.md", "dead"), ("q.md", "rule")], "rel string, tier string")).first().rel == "p.md"


def test_lines_to_inject_need_no_earlier_lines(spark, sf, monkeypatch):
    """What is no longer shown is not compared, and the states of what is are the same."""
    from recollect.plans import memory

    seen, stale = [], changes.stale
    monkeypatch.setattr(memory.C, "stale", lambda lines: seen.append(lines) or stale(lines))
    memory.lines_to_inject(spark, sf)
    every = memory._queue_lines(spark, sf)
    late = every.where("day >= '1997-12-02'")
    assert 0 < seen[0].count() == late.count() < every.count()
    rows = [(str(dt.date(2024, 1, 1) + dt.timedelta(days=k % 9 * 8)), k, f"{'was ' if k % 2 else ''}queue c{k % 3}{f' → now queue c{k % 4}' if k % 2 else ''}") for k in range(60)]
    lines = spark.createDataFrame([("r", *x) for x in rows], "root string, day string, seq int, line string")
    short, long = (sorted(map(tuple, df.collect())) for df in (stale(changes.recent(lines, "2024-02-20")), changes.recent(stale(lines), "2024-02-20")))
    assert short == long and 0 < len(short) < 60 and len({x[-1] for x in short}) > 1


def test_a_fresh_key_asks_no_more_of_its_state_than_it_needs():
    """Keys are told from each other with plain rows; timers are looked up only where events were kept."""
    from pyspark.sql import Row

    class Handle:
        def __init__(self):
            self.rows, self.timers, self.calls = [], [], []

        def getListState(self, name, schema):
            return self

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def listTimers(self):
            self.calls.append("listTimers")
            return iter(self.timers)

        def deleteTimer(self, timer):
            self.timers.remove(timer)

        def registerTimer(self, timer):
            self.timers.append(timer)

        def getCurrentWatermarkInMs(self):
            return 0

    handle, p = Handle(), logs._Repeats("user_id", 10)
    p.init(handle)
    big = 2**60 + 1
    out = list(p.handleInputRows((None,), iter([Row(at=15, event_id=big, ask=True), Row(at=5, event_id=2, ask=True)]), handle))
    assert [tuple(r) for r in out] == [(None, 2, 5, False), (None, big, 15, True)] and handle.calls == []
    out = list(p.handleInputRows((None,), iter([Row(at=6, event_id=3, ask=False), Row(at=26, event_id=4, ask=True)]), handle))
    assert [tuple(r) for r in out] == [(None, 4, 26, False)] and handle.calls == ["listTimers"] and len(handle.timers) == 1
    assert [r[1] for r in handle.rows] == [2, 3, big, 4]
