"""Front matter in its dialects, dates, and content shapes.

The dialects differ on purpose: pages are read differently by different steps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructType


def _unix(content: Column) -> Column:
    return F.replace(content, F.lit("\r\n"), F.lit("\n"))


def _entries(head: Column, skip: str | None, quotes: bool) -> Column:
    """Key and value of each line with a colon, the last of equal keys winning."""
    lines = F.filter(F.split(head, "\n"), lambda x: F.contains(x, F.lit(":")) & (~x.rlike(skip) if skip else F.lit(True)))
    value = lambda x: F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1))
    bare = (lambda x: F.btrim(F.btrim(value(x), F.lit('"')), F.lit("'"))) if quotes else value
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)).alias("k"), bare(x).alias("v")))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(pairs, empty, lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def split_meta(content: Column) -> Column:
    """Struct ``meta, body``: the head ends at the first line of dashes; list and nested lines
    are no keys; quotes go."""
    text = _unix(content)
    head, rest = F.regexp_extract(text, "(?s)\\A---\\n(.*?)\\n---", 1), F.regexp_replace(text, "(?s)\\A---\\n.*?\\n---[^\\n]*\\n?", "")
    has = text.rlike("(?s)\\A---\\n.*?\\n---")
    return F.struct(F.when(has, _entries(head, "^[ \\-\\t]", True)).otherwise(F.create_map().cast("map<string,string>")).alias("meta"), F.when(has, rest).otherwise(text).alias("body"))


def plain_meta(content: Column) -> Column:
    """A map: the head ends at any three dashes, even inside a value; comments are no keys."""
    parts = F.split(content, "---", 3)
    return F.when(content.startswith("---") & (F.size(parts) == 3), _entries(F.get(parts, F.lit(1)), "^\\s*#", True)).otherwise(F.create_map().cast("map<string,string>"))


def importer_meta(content: Column) -> Column:
    """A map from the first 800 characters; quotes stay."""
    text = F.substring(_unix(content), 1, 800)
    return F.when(text.rlike("(?s)\\A---\\n.*?\\n---"), _entries(F.regexp_extract(text, "(?s)\\A---\\n(.*?)\\n---", 1), None, False)).otherwise(F.create_map().cast("map<string,string>"))


def hook_meta(content: Column) -> Column:
    """A map without list and nested lines; quotes stay."""
    text = _unix(content)
    return F.when(text.rlike("(?s)\\A---\\n.*?\\n---"), _entries(F.regexp_extract(text, "(?s)\\A---\\n(.*?)\\n---", 1), "^[ \\-]", False)).otherwise(F.create_map().cast("map<string,string>"))


@pandas_udf(StructType().add("ok", BooleanType()).add("error", StringType()))
def yaml_check(content: pd.Series) -> pd.DataFrame:
    """Whether the head is YAML; without the parser it is said to be unchecked."""
    try:
        import yaml
    except ImportError:
        return pd.DataFrame({"ok": [None] * len(content), "error": ["unchecked"] * len(content)})

    def one(text):
        if not text or not text.startswith("---\n"):
            return False, "no front matter"
        head, end, _ = text[4:].partition("\n---\n")
        if not end:
            return False, "front matter does not end"
        try:
            yaml.safe_load(head)
        except yaml.YAMLError as e:
            return False, str(e).split("\n")[0]
        return True, None

    out = [one(t) for t in content]
    return pd.DataFrame({"ok": [o for o, _ in out], "error": [e for _, e in out]})


def upsert(meta: Column, key: str, value: Column) -> Column:
    """The map with one entry replaced or added."""
    rest = F.map_filter(meta, lambda k, _: k != F.lit(key))
    return F.map_concat(rest, F.create_map(F.lit(key), value))


def rendered(meta: Column, body: Column) -> Column:
    """A page from its parts, keys in order."""
    lines = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"), body)


def patched(content: Column, key: str, value: Column) -> Column:
    """A page whose head says ``key: value``: its first line of that key is replaced, or one is added at
    the end of the head; all other lines stay as they are. A page without a head stays as it is."""
    text = _unix(content)
    head, rest = F.regexp_extract(text, "(?s)\\A---\\n(.*?)\\n---", 1), F.regexp_replace(text, "(?s)\\A---\\n.*?\\n---", "")
    lines = F.split(head, "\n")
    at = F.array_position(F.transform(lines, lambda x: x.startswith(f"{key}:")), F.lit(True))
    new = F.concat(F.lit(f"{key}: "), value)
    put = F.when(at > 0, F.transform(lines, lambda x, i: F.when(i + 1 == at, new).otherwise(x))).otherwise(F.concat(lines, F.array(new)))
    return F.when(text.rlike("(?s)\\A---\\n.*?\\n---"), F.concat(F.lit("---\n"), F.array_join(put, "\n"), F.lit("\n---"), rest)).otherwise(content)


def iso_day(text: Column) -> Column:
    return F.to_date(F.when(F.substring(text, 1, 10).rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.substring(text, 1, 10)))


def epoch(value: Column) -> Column:
    """A timestamp from seconds, or from milliseconds beyond 1e11."""
    v = value.cast("double")
    return F.timestamp_millis(F.when(v > 1e11, v).otherwise(v * 1000).cast("long"))


def local_day(ts: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def message_text(content: Column) -> Column:
    """Of a JSON string, or of a JSON list of ``{type, text}`` parts, the texts joined."""
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    listed = F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull() & (F.coalesce(p["type"], F.lit("text")).isin("text", "input_text", "output_text"))), lambda p: p["text"]), "\n")
    return F.when(content.startswith("["), listed).when(content.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), content, F.lit("}")), "v string")["v"]).otherwise(content)
