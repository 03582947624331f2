"""Event logs as streams: cursors, de-duplication, a day's state per key, incremental ingestion."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from recollect.operators.segments import written
from recollect.plans.nightly import NoModel, complete

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

#: The state store that list state and timers need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", files: int = 100) -> DataFrame:
    """A folder of files that is appended to."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(format).load(path)


def timed(events: DataFrame, late: str = "1 day", column: str = "ts") -> DataFrame:
    """With event time and a watermark; what comes later than that is left out."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def by_day(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return timed(events, late).groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.to_date("w.start").alias("day"), *keys, "n", "total")


def sliding(events: DataFrame, keys: list[str], size: str = "30 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    return timed(events, late).groupBy(F.window("ts", size, step).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.to_date("w.end").alias("until"), *keys, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("first_ts"), F.col("w.end").alias("last_ts"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(events, late).dropDuplicatesWithinWatermark(keys)


def once_a_day(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key and day; a key's state goes when the watermark has passed it, which is
    ``late`` (a day at least) behind the newest event."""
    return timed(events, late).withColumn("day", F.to_date("ts")).dropDuplicatesWithinWatermark([*keys, "day"])


class _Repeats(StatefulProcessor):
    """The asks and clearing events of a key that may still stand before others, as list state; a timer ends it.

    A key has few events, so they are plain rows, and the state is asked for no more than it holds: a key without
    events kept has no timer either."""

    def __init__(self, key: str, span: int):
        self.key, self.span = key, span

    def init(self, handle) -> None:
        self.handle = handle
        self.line = handle.getListState("line", "at long, event_id long, ask boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        past = [(at, event_id, ask, False) for at, event_id, ask in self.line.get()]
        line = past + [(r["at"], r["event_id"], r["ask"], True) for r in rows]
        line.sort(key=lambda e: e[:2])
        # Rows that are not too late yet come after the mark: what stands further before it counts no more.
        mark = timerValues.getCurrentWatermarkInMs()
        left = [e[:3] for e in line if e[0] >= mark * 1000 - self.span]
        if past:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if left:
            self.line.put(left)
            self.handle.registerTimer(max((left[-1][0] + self.span) // 1000, mark) + 1)
        elif past:
            self.line.clear()
        before = None
        for at, event_id, ask, fresh in line:
            if fresh and ask:
                yield Row(**{self.key: key[0], "event_id": event_id, "at": at, "repeated": before is not None and before[2] and at - before[0] <= self.span})
            before = (at, event_id, ask)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.line.clear()
        return iter(())

    def close(self) -> None:
        pass


def asked_again(events: DataFrame, key: str, ask: str, clear: str, hours: int = 24, late: str = "1 day") -> DataFrame:
    """Asks with ``repeated``, by keyed state: an ask within the hours after another one is a
    repeat, unless a clearing event came between.

    The state is the key's events of the last hours and of the time by which rows may be late, so a row
    of a later batch is judged by what stands before it in time. A timer drops it when the watermark
    has passed all of it. Such state needs the session's state store to be RocksDB, which is set here."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = timed(events.select(key, "event_id", "ts", "event_type"), late).where(F.col("event_type").isin(ask, clear))
    rows = rows.select(key, "ts", "event_id", F.unix_micros("ts").alias("at"), (F.col("event_type") == ask).alias("ask"))
    out = rows.groupBy(key).transformWithState(_Repeats(key, hours * 3_600_000_000), f"{key} long, event_id long, at long, repeated boolean", "append", "eventTime")
    return out.select(key, "event_id", F.timestamp_micros("at").alias("ts"), "repeated")


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, to a table; a second call goes on where the first one ended. In
    ``complete`` mode the table is the whole result as of the last batch."""
    w = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "complete":
        q = w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(path)).start()
    else:
        q = w.format("parquet").option("path", path).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Questions that one round of learning takes; what is beyond them is passed over.
ROUND = 40


class Cursor:
    """How far a log was learnt from, with what was learnt, in the folder ``path``. A round's answers stand
    beside the others before the cursor moves, and count only once it has: a round that was stopped in
    between is done again under its own number, so nothing is lost and nothing stands there twice."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _moves(self) -> DataFrame:
        schema = StructType.fromDDL("round int, upto timestamp, batch string")
        have = written(self.spark, f"{self.path}/cursor", schema)
        return self.spark.createDataFrame([], schema) if have is None else have

    def last(self) -> tuple[int, object, str | None]:
        """The last round, where the cursor stands, and the batch it was moved by."""
        r = self._moves().orderBy(F.desc("round")).first()
        return (0, None, None) if r is None else (r["round"], r["upto"], r["batch"])

    def move(self, log: DataFrame, model, now, batch: str | None = None, most: int = ROUND) -> bool:
        """One round over ``log(q, ts, confidence)``: the first row of each weak question that is newer than the
        cursor, ``most`` in the order of time, is asked of ``model``; the cursor then stands at ``now``, the time at
        which the log was read. Rows up to the cursor that come later are never read, nor are those
        beyond ``most``. Without a model, and for a ``batch`` that was done already, nothing moves."""
        number, since, done = self.last()
        if batch is not None and done == batch:
            return False
        fresh = log.where((F.col("ts") <= F.lit(now)) if since is None else (F.col("ts") > F.lit(since)) & (F.col("ts") <= F.lit(now)))
        weak = fresh.where(F.col("confidence").isin("none", "low")).select(F.trim("q").alias("prompt"), "ts").where("prompt <> ''")
        first = weak.groupBy("prompt").agg(F.min("ts").alias("ts")).orderBy("ts", "prompt").limit(most)
        try:
            answers = complete(first, model)
        except NoModel:
            return False
        answers.write.mode("overwrite").parquet(f"{self.path}/answers/round={number + 1}")
        self.spark.createDataFrame([(number + 1, now, batch)], self._moves().schema).coalesce(1).write.mode("append").parquet(f"{self.path}/cursor")
        return True

    def answers(self) -> DataFrame | None:
        """``prompt, ts, answer, round`` of the rounds that count; None before the first."""
        have = written(self.spark, f"{self.path}/answers")
        return None if have is None or not self.last()[0] else have.where(F.col("round") <= self.last()[0])

    def follow(self, log: DataFrame, model, clock, checkpoint: str, most: int = ROUND) -> None:
        """The rounds of a stream of the log, one a batch, by ``clock()``."""

        def put(batch: DataFrame, n: int) -> None:
            self.move(batch, model, clock(), f"{checkpoint}#{n}", most)

        log.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Parts of an upserted table that are replaced by themselves.
PARTS = 64


def upserted(files: DataFrame, path: str, checkpoint: str, key: str, order: str, parts: int = PARTS) -> DataFrame:
    """The newest row of each key of a stream of versions, as a table. Rows lie in parts by key, and a batch
    writes a new version of those it touches only; the latest version of each part counts.
    The file source gives no deletions; those are found by comparing snapshots."""
    spark = files.sparkSession
    schema = files.schema

    def put(batch: DataFrame, n: int) -> None:
        new = batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        touched = [r[0] for r in new.select("part").distinct().collect()]
        if not touched:
            return
        both = new.unionByName(_latest(spark, path, schema, touched, n))
        rows = both.groupBy("part", key).agg(F.max_by(F.struct(*schema.names), order).alias("r")).select("r.*", "part", F.lit(n).alias("version"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "version").parquet(path)

    q = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return _latest(spark, path, schema).drop("part")


def _latest(spark: SparkSession, path: str, schema, only: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The latest version of each part, of some of them or before a version only; no rows if nothing is there."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    if fs.exists(root):
        for p in fs.listStatus(root):
            name = p.getPath().getName()
            if not name.startswith("part=") or (only is not None and int(name[5:]) not in only):
                continue
            versions = [int(v.getPath().getName()[8:]) for v in fs.listStatus(p.getPath()) if v.getPath().getName().startswith("version=")]
            versions = [v for v in versions if before is None or v < before]
            if versions:
                found.append(f"{path}/{name}/version={max(versions)}")
    if not found:
        return spark.createDataFrame([], schema).withColumn("part", F.lit(0))
    from pyspark.sql.types import IntegerType, StructType

    full = StructType([*schema.fields]).add("part", IntegerType()).add("version", IntegerType())
    return spark.read.schema(full).option("basePath", path).parquet(*found).drop("version")
