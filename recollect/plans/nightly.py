"""Model-backed and nightly steps: prompts in batches, an injected model, a table of outcomes."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.orders import running
from recollect.operators.quality import SEVERITY


class NoModel(Exception):
    """No model is there to answer; the step is skipped."""


def batches(rows: DataFrame, key: str, text: str, size: int = 6, parts: int | None = None, by: str | None = None) -> DataFrame:
    """``batch, prompt, n``: texts joined in batches of ``size`` in the order of ``key``, of each ``by``. Rows are
    numbered over ``parts`` ranges of the order, so no task sees them all."""
    over = [by] if by else []
    run = running(rows.select(*over, key, text), [F.asc(c) for c in [*over, key]], parts=parts)
    first = run.groupBy(*over).agg(F.min("at").alias("_first"))
    run = run.join(first, by) if by else run.withColumn("_first", F.lit(1))
    n = run.withColumn("batch", F.floor((F.col("at") - F.col("_first")) / size))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n")
    return n.groupBy(*over, "batch").agg(joined.alias("prompt"), F.count("*").alias("n"))


Model = Callable[[pd.Series], pd.Series]


def complete(prompts: DataFrame, model: Model | list[tuple[str, Model]] | None) -> DataFrame:
    """``prompts`` with ``answer`` from an injected batch function; without one, NoModel.

    Of a list of ``(name, function)`` each is tried in turn: what the first one raises for, or gives no text for,
    goes to the next. ``channel`` then says which one has answered; a prompt that all of them failed
    is an error with what each has said, an empty list NoModel."""
    if model is None or model == []:
        raise NoModel("no model is set")
    from pyspark.sql.types import StringType, StructField, StructType

    several = isinstance(model, list)
    channels = model if several else [("", model)]
    schema = StructType([*prompts.schema.fields, StructField("answer", StringType())])
    if several:
        schema = schema.add("channel", StringType())

    def tried(frame: pd.DataFrame) -> pd.DataFrame:
        answers = pd.Series([None] * len(frame), index=frame.index, dtype=object)
        by, said = answers.copy(), []
        for name, ask in channels:
            left = answers.isna()
            if not left.any():
                break
            try:
                got = ask(frame.loc[left, "prompt"])
            except Exception as e:  # noqa: BLE001  what a channel raises sends its prompts to the next one
                said.append(f"{name}: {type(e).__name__}: {e}"[:200])
                continue
            got = pd.Series(list(got), index=frame.index[left], dtype=object)
            if got.isna().any():
                said.append(f"{name}: no text")
            answers[left], by[left] = got, [name if x is not None and x == x else None for x in got]
        if answers.isna().any():
            raise RuntimeError("all models failed: " + " | ".join(said))
        return frame.assign(answer=answers, channel=by)

    def run(frames):
        for frame in frames:
            yield tried(frame) if several else frame.assign(answer=model(frame["prompt"]))

    return prompts.mapInPandas(run, schema)


def adapter(questions: DataFrame, system: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """``qid, cited, score`` from an external system that takes and gives batches."""

    def run(frames):
        for frame in frames:
            yield system(frame)[["qid", "cited", "score"]]

    return questions.mapInPandas(run, f"qid {dict(questions.dtypes)['qid']}, cited string, score double")


def cost(prompts: DataFrame, by: str | None = None) -> DataFrame:
    """A dry run, of each ``by``: calls, characters and about how many tokens."""
    return prompts.groupBy(*([by] if by else [])).agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.length("prompt")), F.lit(0)).alias("chars"), F.ceil(F.coalesce(F.sum(F.length("prompt")), F.lit(0)) / 1.6).alias("tokens"))


def run_steps(spark: SparkSession, steps: list[tuple[str, Callable[[], str]]]) -> DataFrame:
    """Every step in turn; a failing one does not stop the others. ``step, state, reason, seconds``."""
    rows = []
    for name, step in steps:
        began = time.time()
        try:
            state, reason = "ok", step() or ""
        except NoModel as e:
            state, reason = "skipped", str(e)
        except Exception as e:  # noqa: BLE001  a step's failure is its outcome
            state, reason = "failed", f"{type(e).__name__}: {e}".split("\n")[0]
        rows.append((name, state, reason, round(time.time() - began, 3)))
    return spark.createDataFrame(rows, "step string, state string, reason string, seconds double")


def overall(outcomes: DataFrame) -> str:
    have = {r.state for r in outcomes.select("state").distinct().collect()}
    return next((s for s in SEVERITY if s in have), "ok")
