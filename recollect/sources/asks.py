"""Asks from further tools: a prompt history, compressed logs, logs in a folder for each project, and a message
database. All readers give ``session, ts, cwd, text``; ``asked`` cleans the rows of one, ``merged`` puts them together."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.redact import redact
from recollect.operators.orders import running
from recollect.plans.place import place
from recollect.sources import stores

# Elements that tools wrap around an ask, and beginnings of what nobody has typed.
WRAPS = [
    "system-reminder", "ide_selection", "ide_opened_file", "timestamp", "image_files", "attached_files", "user_info", "rules",
    "agent_requestable_workspace_rules", "open_and_recently_viewed_files", "system_reminder", "git_status",
]
NOISE = [
    "<environment_context", "<user_instructions", "<system-reminder", "<command-", "<local-command", "<task-notification",
    "<turn_aborted", "<permissions", "# AGENTS.md", "Caveat: The messages below", "This session is being continued",
]
MACHINE_FOLDERS = "/private/tmp|^/tmp|/var/folders|scratchpad"

#: Bytes of a compressed log that are taken apart at a time.
PIECE = 1 << 20


def _get(path: str) -> Column:
    return F.get_json_object("line", path)


def _seconds(value: Column) -> Column:
    """The time of seconds since 1970, null where it is no number."""
    return F.timestamp_micros((value.try_cast("double") * 1_000_000).try_cast("long"))


def _file(column: str) -> Column:
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def history(spark: SparkSession, path: str) -> DataFrame:
    """A history of prompts as JSON lines, times in milliseconds; commands (``/...``) are no asks."""
    rows = spark.read.text(path).withColumnRenamed("value", "line")
    out = rows.select(F.coalesce(_get("$.sessionId"), F.lit("")).alias("session"), _seconds(_get("$.timestamp").try_cast("double") / 1000).alias("ts"), _get("$.project").alias("cwd"), _get("$.display").alias("text"))
    return out.where(~F.col("text").startswith("/"))


def packed_lines(files: DataFrame) -> DataFrame:
    """``file, line`` of zstd files ``(path, content)``, taken apart piece by piece in the tasks; of a
    broken file, the lines before the break."""

    def lines(raw: bytes) -> Iterator[str]:
        import io

        import zstandard

        rest = b""
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as at:
            while True:
                try:
                    piece = at.read(PIECE)
                except zstandard.ZstdError:
                    piece = b""
                if not piece:
                    break
                *whole, rest = (rest + piece).split(b"\n")
                yield from (x.decode("utf-8", "replace") for x in whole)
        if rest:
            yield rest.decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                some, size = [], 0
                for line in lines(content.as_py()):
                    some.append(line)
                    size += len(line)
                    if size >= PIECE:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(some)], ["file", "line"])
                        some, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some), pa.string()), pa.array(some, pa.string())], ["file", "line"])

    return files.select("path", "content").mapInArrow(run, "file string, line string")


def packed_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Logs ``sessions/*/*/session*.jsonl.zstd`` anywhere below a folder. A log's head names its session and
    folder; logs of delegated agents are left out, and so is what no user has said."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "session*.jsonl.zstd").load(folder)
    rows = packed_lines(files.where(_file("path").rlike("/sessions/[^/]+/[^/]+/[^/]+$"))).where(F.col("line").startswith("{"))
    # The first session row is a log's head; ids keep the order of the lines of a file, which one task reads.
    at = F.monotonically_increasing_id()
    kept = rows.select("file", at.alias("at"), _get("$.type").alias("type"), "line").where(F.col("type").isin("session", "user/message"))
    parts = F.from_json(_get("$.data.content"), "array<struct<text: string>>")
    listed = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    text = F.when(_get("$.data.content").startswith("["), listed).otherwise(_get("$.data.content"))
    depth = F.coalesce(_get("$.delegationDepth"), F.lit("0"))
    # Each row once: the columns that follow are taken from it before the shuffle by file.
    each = kept.select("file", "at", "type", _get("$.id").alias("id"), _get("$.cwd").alias("cwd"), (~depth.isin("0", "false", "", "0.0")).alias("inner"), (_get("$.data.source.kind") == "user").alias("said"), _seconds(_get("$.time").try_cast("double") / 1000).alias("ts"), text.alias("text"))
    heads = each.where("type = 'session'").groupBy("file").agg(F.min_by(F.struct("id", "cwd", "inner"), "at").alias("h"))
    said = each.where("type = 'user/message' and said").select("file", "ts", "text").join(heads, "file", "left")
    return said.where(~F.coalesce("h.inner", F.lit(False))).select(F.coalesce("h.id", "file").alias("session"), "ts", F.col("h.cwd").alias("cwd"), "text")


def project_logs(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """Logs one or two folders deep, whose first folder is the project's path (``%2F`` for its separators);
    rows with a prompt that is no shell command. Times are text or seconds."""
    root = folder.rstrip("/").split("://")[-1]
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder)
    rows = raw.select(_file("_metadata.file_path").alias("file"), F.col("value").alias("line")).withColumn("rel", F.substring_index("file", f"{root}/", -1))
    rows = rows.where(F.size(F.split("rel", "/")).isin(2, 3) & _get("$.prompt").isNotNull() & F.coalesce(_get("$.is_bash"), F.lit("false")).isin("false", "0", ""))
    ts = F.coalesce(F.try_to_timestamp(_get("$.timestamp")), _seconds(_get("$.timestamp")))
    return rows.select(F.coalesce(_get("$.session_id"), "file").alias("session"), ts.alias("ts"), F.replace(F.split("rel", "/")[0], F.lit("%2F"), F.lit("/")).alias("cwd"), _get("$.prompt").alias("text"))


def message_store(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """What users said in the sessions of the command line, of a database file; times are in seconds."""
    said = stores.store(spark, path, "messages", ["session_id", "timestamp", "content", "role"], parts).where("role = 'user'")
    ours = stores.store(spark, path, "sessions", ["id", "source"], parts).where("source = 'cli'").select(F.col("id").alias("session_id")).distinct()
    return said.join(ours, "session_id").select(F.col("session_id").alias("session"), _seconds(F.col("timestamp")).alias("ts"), F.lit("").alias("cwd"), F.col("content").alias("text"))


def asked(rows: DataFrame, source: str, machine: str = MACHINE_FOLDERS) -> DataFrame:
    """``id, source, session, ts, cwd, text`` of what people typed: without what tools wrap around it, without
    noise and work in folders of machines, redacted. A null text is none; a null folder is empty."""
    wraps = f"(?s)<({'|'.join(WRAPS)})>.*?</\\1>"
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), wraps, ""), "^\\s+|\\s+$", ""))
    lead = F.lower(F.col("text"))
    clean = rows.select("session", "ts", F.coalesce("cwd", F.lit("")).alias("cwd"), text.alias("text"))
    noisy = F.lit(False)
    for begin in NOISE:
        noisy = noisy | lead.startswith(begin.lower())
    clean = clean.where((F.col("text") != "") & ~noisy & ~F.col("cwd").rlike(machine)).withColumn("text", redact(F.col("text")))
    key = F.substring(F.sha1(F.concat_ws("\u0000", F.lit(source), "session", "text")), 1, 16)
    return clean.select(key.alias("id"), F.lit(source).alias("source"), "session", "ts", "cwd", "text")


def merged(sources: list[DataFrame], back: int = 50) -> DataFrame:
    """The asks of several sources, each text once a UTC day (white space apart): the earliest, of equal times that of
    the first source, then by session and text; without a time, before all others. Of what is left, an ask whose
    ``id`` is among the last ``back`` that were kept is not kept (also where another source had the same text
    on that day, later).

    Whether one is kept depends on how many were kept before it, so that is guessed (all) and made anew until
    nothing changes. Each round is right for all rows up to the first one that it changes, so what stays is
    what a walk over the rows gives, in rounds over all of them at once."""
    rows = sources[0].withColumn("_s", F.lit(0))
    for k, more in enumerate(sources[1:], 1):
        rows = rows.unionByName(more.withColumn("_s", F.lit(k)))
    order = ["ts", "_s", "session", "text", "cwd"]
    key = [F.trim(F.regexp_replace("text", "\\s+", " ")), F.floor(F.unix_seconds("ts") / 86_400)]
    first = rows.groupBy(key[0].alias("_t"), key[1].alias("_d")).agg(F.min(F.struct(F.col("ts").isNotNull(), *order, "id", "source")).alias("r"))
    spark = rows.sparkSession

    def held(df: DataFrame, name: str) -> DataFrame:
        at = place(spark, name)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    line = held(running(first.select("r.*"), [F.asc_nulls_first(c) for c in order]), "asks")
    # Only what has an id more than once can go.
    again = held(line.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id"), "again")
    if again.isEmpty():
        return line.select("id", "source", "session", "ts", "cwd", "text")
    twice = held(line.join(again, "id", "left_semi").select("id", "at"), "twice")
    gone = twice.select("at").limit(0)
    while True:
        # How many of those that went stand before a row.
        marks = twice.select("id", "at").join(gone.withColumn("_g", F.lit(1)), "at", "left").fillna(0, ["_g"])
        told = running(marks.withColumnRenamed("at", "_at"), [F.asc("_at")], {"_lost": F.col("_g")}).select("id", "_at", (F.col("_at") - F.col("_lost") + F.col("_g")).alias("_c"))
        walk = F.aggregate(
            F.sort_array(F.collect_list(F.struct("_at", "_c"))),
            F.struct(F.lit(None).cast("long").alias("kept"), F.array().cast("array<bigint>").alias("gone")),
            lambda s, x: F.when(s["kept"].isNotNull() & (x["_c"] - s["kept"] <= back), F.struct(s["kept"].alias("kept"), F.concat(s["gone"], F.array(x["_at"].cast("long"))).alias("gone"))).otherwise(F.struct(x["_c"].cast("long").alias("kept"), s["gone"].alias("gone"))),
        )
        new = held(told.groupBy("id").agg(walk.alias("w")).select(F.explode("w.gone").alias("at")), "gone")
        same = new.join(gone, "at", "left_anti").isEmpty() and gone.join(new, "at", "left_anti").isEmpty()
        gone = new
        if same:
            break
    return line.join(gone, "at", "left_anti").select("id", "source", "session", "ts", "cwd", "text")
