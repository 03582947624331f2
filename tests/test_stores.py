"""Database files by ranges, and pages that change as a whole or not at all."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from recollect.sources import files, stores


@pytest.fixture
def db(tmp_path):
    at = str(tmp_path / "some.db")
    con = sqlite3.connect(at)
    con.execute('create table notes(id integer primary key, title text, "odd ""name" real, body blob)')
    con.executemany("insert into notes values (?, ?, ?, ?)", [(i * 3, None if i % 9 == 0 else f"t{i} é", i / 4, f"b{i}") for i in range(1000)])
    con.execute("create view few as select id, title from notes where id < 30")
    con.execute("create table empty_one(id integer, title text)")
    con.execute("create table keyed(k text primary key, v text) without rowid")
    con.execute("insert into keyed values ('a', 'b')")
    con.commit()
    con.close()
    return at


def test_rows_equal_those_of_the_file_and_come_in_several_tasks(spark, db, monkeypatch):
    columns = ["id", "missing", "title", 'odd "name', "body"]
    got = stores.store(spark, db, "notes", columns, 7)
    con = sqlite3.connect(db)
    want = [(str(i), None, t, str(o), b) for i, t, o, b in con.execute("select * from notes")]
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == columns
    assert got.select(F.spark_partition_id()).distinct().count() == 7
    assert sorted(map(tuple, stores.store(spark, db, "few", ["title", "id"]).collect()), key=str) == sorted(con.execute("select title, cast(id as text) from few"), key=str)
    assert stores.store(spark, db, "empty_one", ["id", "x"]).count() == 0
    assert stores.store(spark, db, "keyed", ["v", "none"]).collect() == [("b", None)]
    assert sorted(map(tuple, files.store(spark, db, "notes", columns).collect())) == sorted(want)


def pages(spark, rows):
    return spark.createDataFrame(rows, "rel string, content string").repartition(3)


def there(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), newline="").read() for d, _, names in os.walk(folder) for f in names}


def test_pages_written_same_and_kept(spark, tmp_path):
    folder, report = str(tmp_path / "pages"), str(tmp_path / "report" / "r.json")
    first = [("a/x.md", "ours\r\n1"), ("a/y.md", "ours\n2"), ("z.md", "ours\n")]
    assert {r.rel: r.state for r in stores.write_pages(pages(spark, first), folder, "ours", report).collect()} == {k: "added" for k, _ in first}
    with open(f"{folder}/a/y.md", "w") as f:
        f.write("a person's page")
    told = stores.write_pages(pages(spark, [("a/x.md", "ours\r\n1"), ("a/y.md", "ours\n3"), ("z.md", "ours, changed"), ("b/new.md", None)]), folder, "ours", report)
    assert {r.rel: r.state for r in told.collect()} == {"a/x.md": "same", "a/y.md": "kept", "z.md": "changed", "b/new.md": "added"}
    assert there(folder) == {"a/x.md": "ours\r\n1", "a/y.md": "a person's page", "z.md": "ours, changed", "b/new.md": ""}
    assert sorted(os.listdir(tmp_path)) == ["pages", "report"]


@pytest.mark.parametrize("bad", ["../out.md", "/etc/x.md", "a/page.txt", None])
def test_a_failed_job_changes_nothing(spark, tmp_path, bad):
    folder, report = str(tmp_path / "pages"), str(tmp_path / "r.json")
    stores.write_pages(pages(spark, [("a.md", "ours 1"), ("b.md", "ours 2")]), folder, "ours", report)
    before = there(folder)
    with pytest.raises(Exception):
        stores.write_pages(pages(spark, [("a.md", "ours 9"), ("c.md", "ours 3"), (bad, "ours"), *((f"d/{i}.md", "ours") for i in range(20))]), folder, "ours", report)
    assert there(folder) == before
