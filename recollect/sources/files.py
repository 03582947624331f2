"""Readers of page folders, bar-separated lists, JSON lines, CSV and page stores; writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no pages of one's own.
SKIPPED = ["Clippings", ".trash", ".obsidian", "迁移备份", "node_modules", ".git"]


def pages(spark: SparkSession, folder: str, skipped: list[str] | None = None, glob: str = "*.md") -> DataFrame:
    """``rel, content, mtime, size`` of all pages below a folder, without skipped and hidden folders."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    root = folder.rstrip("/").split("://")[-1]
    rel = F.url_decode(F.replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.lit("+"), F.lit("%2B")))
    rel = F.substring_index(rel, f"{root.rstrip('/')}/", -1)
    parts = F.split(rel, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    names = SKIPPED if skipped is None else skipped
    kept = ~F.exists(folders, lambda f: f.isin(names) | f.startswith("."))
    return raw.select(rel.alias("rel"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), kept.alias("_k")).where("_k").drop("_k")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    line = F.regexp_replace("value", "^﻿", "")
    return spark.read.text(path).select(F.trim(line).alias("line")).where("line <> '' and not line like '#%'")


def alias_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, aliases, source, anchor`` of ``id|a;b|source|anchor`` lines; another number of
    fields is an error, raised when the rows are read."""
    parts = F.split("line", "\\|")
    bad = F.raise_error(F.concat(F.lit("not four fields: "), F.col("line")))
    rows = _lines(spark, path).select(F.when(F.size(parts) == 4, F.transform(parts, lambda x: F.trim(x))).otherwise(bad.cast("array<string>")).alias("p")).where("p[0] <> 'id'")
    words = F.filter(F.transform(F.split(F.col("p")[1], ";"), lambda x: F.trim(x)), lambda w: w != "")
    return rows.select(F.col("p")[0].alias("id"), words.alias("aliases"), F.col("p")[2].alias("source"), F.col("p")[3].alias("anchor"))


def trigger_lists(spark: SparkSession, path: str) -> DataFrame:
    """``rel, words`` of a file that mixes ``rel|a;b`` lines, alias rows and JSON lines."""
    parts = F.transform(F.split("line", "\\|"), lambda x: F.trim(x))
    js = F.from_json("line", "rel string, words array<string>, word string")
    split = lambda x: F.filter(F.transform(F.split(x, ";"), lambda x: F.trim(x)), lambda w: w != "")
    kind = F.when(F.col("line").startswith("{"), F.struct(js["rel"].alias("rel"), F.coalesce(js["words"], F.array_compact(F.array(js["word"]))).alias("words")))
    kind = kind.when(F.size(parts) == 4, F.struct(parts[2].alias("rel"), split(parts[1]).alias("words"))).when(F.size(parts) == 2, F.struct(parts[0].alias("rel"), split(parts[1]).alias("words")))
    return _lines(spark, path).select(kind.alias("r")).where("r.rel is not null").select("r.rel", "r.words")


def topic_list(spark: SparkSession, path: str) -> DataFrame:
    """``topic, title, terms, authority`` of lines of up to four fields."""
    p = F.split(F.concat("line", F.lit("|||")), "\\|")
    some = lambda x: F.filter(F.transform(F.split(x, ";"), lambda x: F.trim(x)), lambda w: w != "")
    return _lines(spark, path).select(F.trim(p[0]).alias("topic"), F.trim(p[1]).alias("title"), some(p[2]).alias("terms"), some(p[3]).alias("authority"))


def zone_map(spark: SparkSession, path: str) -> DataFrame:
    """``prefix, target`` of two-field lines."""
    p = F.split("line", "\\|")
    return _lines(spark, path).where(F.size(p) == 2).select(F.regexp_replace(F.trim(p[0]), "/+$", "").alias("prefix"), F.regexp_replace(F.trim(p[1]), "/+$", "").alias("target"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines, plain or compressed; lines that are no object are left out."""
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("r"), "value").where("trim(value) like '{%' and r is not null")
    return rows.select("r.*")


def csv_with_examples(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV with a header, without its example rows; a byte order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.where(~F.col(key).startswith("EXAMPLE"))


def store(spark: SparkSession, path: str, name: str, columns: list[str]) -> DataFrame:
    """A table of a database file, read-only, as text; columns it lacks are null."""
    from recollect.sources import stores

    return stores.store(spark, path, name, columns)


def transcripts(spark: SparkSession, path: str, dialect: str, since: str | None = None) -> DataFrame:
    """``session, seq, ts, role, text, cwd, entry`` of agent logs in one of three dialects:
    ``claude`` and ``codex`` (rows with types) and ``cursor`` (roles with tags)."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if since:
        reader = reader.option("modifiedAfter", since)
    raw = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("seq"), "value").where(~F.col("file").contains("/subagents/"))
    session = F.regexp_extract("file", "([^/]+)\\.jsonl$", 1)
    get = lambda p: F.get_json_object("value", p)
    from recollect.functions.frontmatter import message_text

    if dialect == "claude":
        drop = (F.coalesce(get("$.isSidechain"), F.lit("false")) == "true") | (F.coalesce(get("$.isMeta"), F.lit("false")) == "true") | (F.coalesce(get("$.isCompactSummary"), F.lit("false")) == "true")
        rows = raw.where(get("$.type").isin("user", "assistant") & ~drop)
        body = message_text(get("$.message.content"))
        out = rows.select(session.alias("session"), "seq", get("$.timestamp").alias("ts"), get("$.message.role").alias("role"), body.alias("text"), get("$.cwd").alias("cwd"), F.coalesce(get("$.entrypoint"), F.lit("")).alias("entry"))
        machine = F.col("entry").startswith("sdk-")
    elif dialect == "codex":
        head = raw.where(get("$.type") == "session_meta").select("file", get("$.payload.cwd").alias("cwd"), F.coalesce(get("$.payload.originator"), F.lit("")).alias("entry"))
        rows = raw.where((get("$.type") == "response_item") & get("$.payload.role").isin("user", "assistant"))
        out = rows.join(F.broadcast(head) if head.limit(100_001).count() <= 100_000 else head, "file", "left").select(session.alias("session"), "seq", get("$.timestamp").alias("ts"), get("$.payload.role").alias("role"), message_text(get("$.payload.content")).alias("text"), "cwd", F.coalesce("entry", F.lit("")).alias("entry"))
        machine = F.col("entry").contains("exec")
    else:
        text = message_text(get("$.message.content"))
        asked = F.regexp_extract(text, "(?s)<user_query>\\s*(.*?)\\s*</user_query>", 1)
        out = raw.where(F.col("file").contains("agent-transcripts")).select(session.alias("session"), "seq", F.regexp_extract(text, "(?s)<timestamp>(.*?)</timestamp>", 1).alias("ts"), get("$.role").alias("role"), F.when(asked != "", asked).otherwise(text).alias("text"), F.lit(None).cast("string").alias("cwd"), F.lit("").alias("entry"))
        machine = F.lit(False)
    auto = out.where(machine).select("session").distinct()
    return out.join(auto, "session", "left_anti").where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def cursor_time(text):
    """UTC of texts like ``Monday, Oct 13, 2025, 9:05 PM (UTC+8)``."""
    at = F.regexp_extract(text, "([A-Z][a-z]{2} \\d{1,2}, \\d{4}, \\d{1,2}:\\d{2} [AP]M)", 1)
    sign, hours, minutes = (F.regexp_extract(text, "UTC([+-])(\\d{1,2})(?::(\\d{2}))?", k) for k in (1, 2, 3))
    shift = F.when(hours != "", hours.cast("int") * 60 + F.coalesce(F.when(minutes != "", minutes.cast("int")), F.lit(0))).otherwise(0) * F.when(sign == "-", -1).otherwise(1)
    return F.try_to_timestamp(at, F.lit("MMM d, yyyy, h:mm a")) - F.make_dt_interval(mins=shift)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_pages(df: DataFrame, path: str) -> None:
    """``rel, content`` as a table, by folder."""
    df.withColumn("folder", F.regexp_replace("rel", "/?[^/]*$", "")).write.mode("overwrite").partitionBy("folder").parquet(path)
