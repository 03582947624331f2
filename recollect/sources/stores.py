"""Data sources of this library: tables of small database files, read by ranges of rows, and a folder of pages
that a job changes as a whole or not at all. Paths are of folders that all executors share."""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Rows of a database file that are sent on at once.
ROWS = 10_000


# ---------------------------------------------------------------- database files
def _opened(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass
class Rows(InputPartition):
    """Row numbers from ``low`` to ``high``; all rows if there are no row numbers."""

    low: int | None
    high: int | None


class StoreReader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts

    def partitions(self) -> list[Rows]:
        db = _opened(self.path)
        try:
            low, high = db.execute(f"select min(rowid), max(rowid) from {_named(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a view, or a table without row numbers
            return [Rows(None, None)]
        finally:
            db.close()
        if low is None:  # no rows, or none with a number
            return [Rows(None, None)]
        step = -(-(high - low + 1) // self.parts)
        return [Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        db = _opened(self.path)
        try:
            have = {r[1] for r in db.execute(f"pragma table_info({_named(self.table)})")}
            some = ", ".join(f"cast({_named(c)} as text)" if c in have else "null" for c in self.columns)
            where, args = ("", ()) if part.low is None else (" where rowid between ? and ?", (part.low, part.high))
            rows = db.execute(f"select {some} from {_named(self.table)}{where}", args)
            while batch := rows.fetchmany(ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*batch)], self.columns)
        finally:
            db.close()


class StoreSource(DataSource):
    """``path, table, columns`` (as JSON) and ``parts``; columns that the table lacks are null."""

    @classmethod
    def name(cls) -> str:
        return "recollect_store"

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> StoreReader:
        return StoreReader(self.options["path"], self.options["table"], json.loads(self.options["columns"]), int(self.options["parts"]))


def store(spark: SparkSession, path: str, name: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """A table of a database file, read-only, as text, by ranges of its row numbers in several tasks; columns it
    lacks are null."""
    spark.dataSource.register(StoreSource)
    options = {"path": path, "table": name, "columns": json.dumps(columns), "parts": parts or spark.sparkContext.defaultParallelism}
    return spark.read.format("recollect_store").options(**options).load()


# ---------------------------------------------------------------- pages
@dataclass
class Told(WriterCommitMessage):
    """What a task has done with each of its pages."""

    states: list[tuple[str, str]]


class PageWriter(DataSourceWriter):
    """Pages stand beside the folder until the job is done, then each takes its place by a rename. What a task that
    is being stopped writes after a job was given up may stay there; nobody reads it."""

    def __init__(self, folder: str, mark: str, report: str):
        self.folder, self.mark, self.report = folder, mark, report
        self.beside = f"{folder.rstrip('/')}.new-{uuid.uuid4().hex}"

    def write(self, rows) -> Told:
        states = []
        for row in rows:
            rel, content = row["rel"], row["content"] or ""
            if rel is None or rel.startswith("/") or ".." in rel.split("/") or not rel.endswith(".md"):
                raise ValueError(f"{rel!r} is no page of the folder")
            states.append((rel, self._state(rel, content)))
            if states[-1][1] in ("added", "changed"):
                at = os.path.join(self.beside, rel)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "w", encoding="utf-8", newline="") as f:
                    f.write(content)
        return Told(states)

    def _state(self, rel: str, content: str) -> str:
        """Somebody else's page is kept; one of ours is written if it is another."""
        try:
            with open(os.path.join(self.folder, rel), encoding="utf-8", newline="") as f:
                old = f.read()
        except FileNotFoundError:
            return "added"
        return "kept" if self.mark not in old else "same" if old == content else "changed"

    def commit(self, messages: list[Told | None]) -> None:
        states = sorted(x for m in messages if m is not None for x in m.states)
        for rel, state in states:
            if state in ("added", "changed"):
                at = os.path.join(self.folder, rel)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                os.replace(os.path.join(self.beside, rel), at)
        os.makedirs(os.path.dirname(self.report), exist_ok=True)
        with open(self.report, "w", encoding="utf-8") as f:
            f.writelines(json.dumps({"rel": rel, "state": state}, ensure_ascii=False) + "\n" for rel, state in states)
        shutil.rmtree(self.beside, ignore_errors=True)

    def abort(self, messages: list[Told | None]) -> None:
        shutil.rmtree(self.beside, ignore_errors=True)


class PageSink(DataSource):
    """``path``, ``mark`` and ``report``, a file of what was done."""

    @classmethod
    def name(cls) -> str:
        return "recollect_pages"

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], self.options["mark"], self.options["report"])


def write_pages(pages: DataFrame, folder: str, mark: str, report: str) -> DataFrame:
    """Write ``pages(rel, content)`` to a folder: new ones and ours that have changed; pages without our ``mark``
    are kept as they are. ``rel, state`` (added, changed, same, kept), which is also in the file ``report``. A
    job that fails changes nothing. Paths must be unique."""
    spark = pages.sparkSession
    spark.dataSource.register(PageSink)
    pages.select("rel", "content").write.format("recollect_pages").mode("append").options(path=folder, mark=mark, report=report).save()
    return spark.read.schema("rel string, state string").json(report)
