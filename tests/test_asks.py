"""Asks of further tools, read and put together; compressed logs."""

import gzip
import json
import random
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from recollect.sources import asks, files

T = 1_735_732_800  # 2025-01-01 12:00 UTC


def got(df):
    return sorted((r.session, r.at, r.cwd, r.text) for r in df.select("session", F.unix_seconds("ts").alias("at"), "cwd", "text").collect())


def test_history(spark, tmp_path):
    lines = [{"display": "one", "timestamp": T * 1000, "project": "/w", "sessionId": "s"}, {"display": "/clear", "timestamp": T}, {"display": "no time", "timestamp": "x"}]
    (tmp_path / "h.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", "", "[]"]))
    rows = asks.history(spark, str(tmp_path / "h.jsonl"))
    assert sorted(map(str, [tuple(x) for x in rows.select("session", F.unix_seconds("ts"), "cwd", "text").collect()])) == sorted(map(str, [("s", T, "/w", "one"), ("", None, None, "no time")]))


def log(at, lines, cut=None, frames=1):
    at.parent.mkdir(parents=True, exist_ok=True)
    z = zstandard.ZstdCompressor()
    data = [json.dumps(x) if isinstance(x, dict) else x for x in lines]
    step = -(-len(data) // frames)
    raw = b"".join(z.compress(("\n".join(data[i : i + step]) + "\n").encode()) for i in range(0, len(data), step))
    at.write_bytes(raw[:cut])


def test_packed_logs(spark, tmp_path):
    say = lambda text, kind="user", ms=T * 1000: {"type": "user/message", "time": ms, "data": {"source": {"kind": kind}, "content": text}}
    top = tmp_path / "a" / "sessions" / "x" / "y"
    log(top / "session-1.jsonl.zstd", ["no json", {"type": "session", "id": "s1", "cwd": "/w"}, say("plain é"), say([{"type": "text", "text": "two"}, {"image": 1}, {"text": "parts"}]), say("robot", "agent"), {"type": "other"}])
    log(top / "session-2.jsonl.zstd", [{"type": "session", "id": "s2", "delegationDepth": 1}, say("inner")])
    log(top / "session-3.jsonl.zstd", [{"type": "session", "id": "s3", "cwd": "/v", "delegationDepth": 0}, *(say(f"text {i} " + "y" * 3000) for i in range(1500))], frames=7)
    log(top / "session-4.jsonl.zstd", [say("no head")])
    log(top / "session-5.jsonl.zstd", [{"type": "session", "id": "s5"}], cut=9)
    log(tmp_path / "a" / "session-6.jsonl.zstd", [{"type": "session", "id": "s6"}, say("elsewhere")])
    rows = got(asks.packed_logs(spark, str(tmp_path)).fillna("-", ["cwd"]))
    assert [r for r in rows if r[0] == "s1"] == [("s1", T, "/w", "plain é"), ("s1", T, "/w", "two\n\nparts")]
    assert sorted(r[3] for r in rows if r[0] == "s3") == sorted(f"text {i} " + "y" * 3000 for i in range(1500))
    rest = [r for r in rows if r[0] not in ("s1", "s3")]
    assert [(r[0].endswith("session-4.jsonl.zstd"), *r[2:]) for r in rest] == [(True, "-", "no head")]


def test_project_logs(spark, tmp_path):
    deep = tmp_path / "%2Fhome%2Fme" / "x"
    deep.mkdir(parents=True)
    (deep / "a.jsonl").write_text("\n".join([json.dumps({"prompt": "p", "session_id": "s", "timestamp": "2025-01-01T12:00:00Z"}), json.dumps({"prompt": "ls", "is_bash": True}), json.dumps({"answer": 1}), "{"]))
    (deep.parent / "b.jsonl").write_text(json.dumps({"prompt": "q", "session_id": "t", "timestamp": T}))
    (tmp_path / "c.jsonl").write_text(json.dumps({"prompt": "too high"}))
    assert got(asks.project_logs(spark, str(tmp_path))) == [("s", T, "/home/me", "p"), ("t", T, "/home/me", "q")]


def test_message_store(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "state.db")
    con.execute("create table sessions(id text, source text)")
    con.execute("create table messages(session_id text, role text, timestamp real, content text)")
    con.executemany("insert into sessions values (?, ?)", [("a", "cli"), ("b", "api")])
    con.executemany("insert into messages values (?, ?, ?, ?)", [("a", "user", T + 0.5, "hello"), ("a", "assistant", T, "hi"), ("b", "user", T, "robot"), ("c", "user", T, "no session")])
    con.commit()
    con.close()
    assert got(asks.message_store(spark, str(tmp_path / "state.db"), 3)) == [("a", T, "", "hello")]


def test_asked(spark):
    texts = [("a", " hi <timestamp>x\ny</timestamp>\n there\n"), ("b", "<SYSTEM-reminder>odd"), ("c", "caveat: the messages below are"), ("d", None), ("e", "<rules>only</rules>"), ("f", "password=hunter2secret99"), ("g", "x")]
    rows = spark.createDataFrame([(s, None, "/tmp/z" if s == "g" else None, t) for s, t in texts], "session string, ts timestamp, cwd string, text string")
    out = {r.session: r for r in asks.asked(rows, "src").collect()}
    assert set(out) == {"a", "f"} and out["a"].text == "hi \n there" and "hunter2" not in out["f"].text
    import hashlib

    assert out["a"].id == hashlib.sha1(b"src\0a\0hi \n there").hexdigest()[:16]


@pytest.mark.parametrize("seed,back", [(1, 3), (2, 8), (3, 50)])
def test_merged_equals_a_walk(spark, seed, back):
    r = random.Random(seed)
    rows = []
    for s in range(2):
        for _ in range(150):
            text, session = f"t{r.randrange(4)}" + " " * r.randrange(1, 3) + "x", f"s{r.randrange(2)}"
            rows.append((f"{s}{session}{text}", f"src{s}", session, None if r.random() < 0.03 else T + r.randrange(60) * 86_400 + r.randrange(80_000) % 11, "", text))
    schema = "id string, source string, session string, at long, cwd string, text string"
    both = [spark.createDataFrame([x for x in rows if x[1] == f"src{s}"], schema).select("id", "source", "session", F.timestamp_seconds("at").alias("ts"), "cwd", "text") for s in range(2)]
    seen, once, want = set(), [], []
    for x in sorted(rows, key=lambda x: (x[3] is not None, x[3] or 0, x[1], x[2], x[5])):
        key = (" ".join(x[5].split()), x[3] and x[3] // 86_400)
        if key not in seen:
            once.append(x)
        seen.add(key)
    for x in once:
        if all(u[0] != x[0] for u in want[-back:]):
            want.append(x)
    assert len(want) < len(once)
    out = asks.merged(both, back).select("id", "source", "session", F.unix_seconds("ts").alias("at"), "cwd", "text").collect()
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_lines_may_be_compressed(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"k": 1}\nno\n{"k": 2}\n')
    assert sorted(r.k for r in files.json_lines(spark, str(tmp_path), "k int").collect()) == [1, 2]


def test_the_other_two_dialects(spark, tmp_path):
    a, b = tmp_path / "codex", tmp_path / "cursor" / "x" / "agent-transcripts"
    (a / "2025").mkdir(parents=True)
    b.mkdir(parents=True)
    meta = lambda who: {"type": "session_meta", "payload": {"cwd": "/w", "originator": who}}
    say = lambda role, text, kind="response_item": {"type": kind, "timestamp": "2025-01-01T00:00:00Z", "payload": {"role": role, "content": [{"type": "input_text", "text": text}]}}
    (a / "2025" / "s1.jsonl").write_text("\n".join(map(json.dumps, [meta("cli"), say("user", "ask"), say("assistant", "answer"), say("system", "no"), say("user", "event", "event_msg"), say("user", " ")])))
    (a / "s2.jsonl").write_text("\n".join(map(json.dumps, [meta("codex_exec"), say("user", "robot")])))
    rows = files.transcripts(spark, str(a), "codex").orderBy("seq").collect()
    assert [(r.session, r.role, r.text, r.cwd, r.entry) for r in rows] == [("s1", "user", "ask", "/w", "cli"), ("s1", "assistant", "answer", "/w", "cli")]
    ask = "<timestamp>Monday, Oct 13, 2025, 9:05 PM (UTC+8)</timestamp>\n<user_query>\nwhat\nnow\n</user_query>"
    lines = [{"role": "user", "message": {"content": [{"type": "text", "text": ask}]}}, {"role": "assistant", "message": {"content": "this"}}]
    (b / "c1.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "cursor" / "c2.jsonl").write_text(json.dumps(lines[0]))  # not among the transcripts
    (b / "subagents").mkdir()
    (b / "subagents" / "c3.jsonl").write_text(json.dumps(lines[0]))
    rows = files.transcripts(spark, str(tmp_path / "cursor"), "cursor").orderBy("seq").select("session", "role", "text", files.cursor_time(F.col("ts")).cast("string").alias("ts")).collect()
    assert [tuple(r)[:3] for r in rows] == [("c1", "user", "what\nnow"), ("c1", "assistant", "this")] and rows[0].ts == "2025-10-13 13:05:00"
