"""The log queries as streams that are drained, with the batch result as their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from recollect.plans.place import place
from recollect.plans.registry import query, table
from recollect.streaming import logs


def _events(spark, sf):
    return logs.stream(spark, f"{sf}/events.parquet*", logs.EVENTS)


def _drained(spark, df, mode="append"):
    at = place(spark, "stream")
    return logs.drained(df, f"{at}/out", f"{at}/checkpoint", mode)


@query("select props as q, min(ts) as ts from events where ts > timestamp '2024-01-10' and event_type = 'error' group by props")
def stream_cursor(spark, sf):
    """Weak questions of a log after a cursor, each once; the checkpoint is the next cursor."""
    weak = _events(spark, sf).where("event_type = 'error' and ts > timestamp_ntz '2024-01-10'").select(F.col("props").alias("q"), "ts")
    return _drained(spark, weak).groupBy("q").agg(F.min("ts").alias("ts"))


@query("select ts::date as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by all")
def stream_by_day(spark, sf):
    return _drained(spark, logs.by_day(_events(spark, sf), ["event_type"]).select("day", "event_type", "n", "total"), "complete")


@query("select props, min(ts)::date as day from events group by props, ts::date")
def stream_once_a_day(spark, sf):
    return _drained(spark, logs.once_a_day(_events(spark, sf), ["props"], "40 days").select("props", "day"))


@query(
    """with e as (select event_id, user_id, ts, event_type, max(case when event_type = 'view' then {ts: ts, id: event_id} end) over w as a, max(case when event_type = 'purchase' then {ts: ts, id: event_id} end) over w as c from events where event_type in ('view', 'purchase') window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
select event_id, user_id, (a is not null and ts - a.ts <= interval 24 hour and (c is null or c < a)) as repeated from e where event_type = 'view'"""
)
def stream_asked_again(spark, sf):
    """A day's suppression by keyed state; the file is drained as one batch, in time order."""
    return _drained(spark, logs.asked_again(_events(spark, sf), "user_id", "view", "purchase")).select("event_id", "user_id", F.col("repeated"))


_TIMES = ["2024-01-08", "2024-01-20", "2024-01-29"]


@query(
    """with c as (select unnest([1, 2, 3]) as round, unnest(['1900-01-01', '2024-01-08', '2024-01-20']::timestamp[]) as since, unnest(['2024-01-08', '2024-01-20', '2024-01-29']::timestamp[]) as upto),
w as (select round, trim(props) as prompt, min(ts) as ts from c join events on ts > since and ts <= upto where event_type = 'error' group by all),
k as (select *, row_number() over (partition by round order by ts, prompt) as r from w)
select round, prompt, ts, 'seen: ' || prompt as answer from k where r <= 40"""
)
def learning_cursor(spark, sf):
    """Three rounds of learning from the log, as of three times; a round takes forty questions."""
    log = table(spark, sf, "events").select(F.col("props").alias("q"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", "none").otherwise("high").alias("confidence"))
    cursor = logs.Cursor(spark, place(spark, "cursor"))
    for day in _TIMES:
        cursor.move(log, lambda prompts: "seen: " + prompts, datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.timezone.utc))
    return cursor.answers().select(F.col("round").cast("int").alias("round"), "prompt", F.col("ts").cast("timestamp_ntz").alias("ts"), "answer")
