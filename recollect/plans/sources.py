"""Queries over sources: logs that are written from the tables and read as other tools leave them."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.plans.place import place
from recollect.plans.registry import query, table
from recollect.sources import asks

_START = 1_704_067_200  # 2024-01-01


@query(
    f"""with u as (select conv_id::varchar as session, text, {_START} + conv_id * 3600 + turn as sec, conv_id % 3 as k from conversations where role = 'user' and trim(text) <> ''),
a as (select 'history' as source, 0 as s, session, sec, text from u union all select 'projects', 1, session, sec + case when k = 1 then 86400 else 5 end, text from u where k < 2),
r as (select *, row_number() over (partition by regexp_replace(text, '\\s+', ' ', 'g'), sec // 86400 order by sec, s, session) as i from a)
select source, session, sec from r where i = 1"""
)
def merged_asks(spark, sf):
    """What users said, once as a history of prompts and in part again, later, as logs of two projects:
    each text once a day."""
    said = table(spark, sf, "conversations").where("role = 'user'").select(F.col("conv_id").cast("string").alias("session"), (F.lit(_START) + F.col("conv_id") * 3600 + F.col("turn")).alias("at"), (F.col("conv_id") % 3).alias("k"), "text")
    at = place(spark, "logs")
    said.select(F.to_json(F.struct(F.col("session").alias("sessionId"), (F.col("at") * 1000).alias("timestamp"), F.lit("/work").alias("project"), F.col("text").alias("display")))).write.text(f"{at}/history")
    for k, days in ((0, 0), (1, 1)):
        later = F.col("at") + (86_400 if days else 5)
        when = later.cast("string") if k else F.date_format(F.timestamp_seconds(later), "yyyy-MM-dd'T'HH:mm:ssXXX")
        said.where(F.col("k") == k).select(F.to_json(F.struct(F.col("session").alias("session_id"), when.alias("timestamp"), F.lit(False).alias("is_bash"), F.col("text").alias("prompt")))).write.text(f"{at}/projects/%2Fwork%2Fp{k}")
    both = [asks.asked(asks.history(spark, f"{at}/history"), "history"), asks.asked(asks.project_logs(spark, f"{at}/projects", "*.txt"), "projects")]
    return asks.merged(both).select("source", "session", F.unix_seconds("ts").alias("sec"))
