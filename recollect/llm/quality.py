"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are runs without ASCII white space. Every measure of a document is an expression over
its text; every row of the threshold table becomes a comparison with a measure or a ratio of
two; the verdict is their conjunction. No user function, no shuffle.

Edge cases: a null or empty text has no words: all counts are 0, it fails the base rule and
is not kept; ratios over no words or no lines count as 0; rows are independent, so ties and
repeated rows each give a row; an empty table gives an empty result; other columns are
passed through by ``kept_documents`` and ignored by the query.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
#: The white space that separates words, each turned into a space.
WHITE = "\t\n\x0b\x0c\r"

# Frequent function words.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with as by be this are at from or an have not which they you his had were but".split(),
    "de": "der die und in den von zu das sich mit des auf für nicht ist im dem ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du que une pour est par qui dans sur pas au avec il plus ne ce se son sont ou mais aux".split(),
    "es": "de la que el en y los se las del con un por no su una para es al lo como más o pero sus le ha este si sin".split(),
}


class Rule(NamedTuple):
    """``low <= measure / over <= high``; a bound of None does not bind."""

    name: str
    measure: str
    over: str | None
    low: float | None
    high: float | None


#: Production thresholds. The base rule (word count, repeated words) is not among them.
RULES = [
    Rule("mean word length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.1),
    Rule("stop words per word", "n_stop_words", "n_words", 0.08, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE, " " * len(WHITE)), " "), "")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + WHITE, "")) > 0)


def _repeated(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more.

    Windows with their places are sorted; a window equal to a neighbour is a repeat, and a
    word is counted by the first of the repeated windows around it."""
    n = F.size(words)
    grams = F.zip_with(
        F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 2, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)),
        F.slice(words, F.lit(3), F.greatest(n - 2, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return grams


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the measures of the rule table, in one projection per layer."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    df = df.withColumn("_text", value).withColumn("_words", _words(F.col("_text"))).withColumn("_lines", _lines(F.col("_text")))
    df = df.withColumn("_grams", _repeated(F.col("_words")))
    # Without two equal windows there is nothing to count; most documents end here.
    df = df.withColumn("_repeats", F.size("_grams") > F.size(F.array_distinct("_grams")))
    places = F.sort_array(F.arrays_zip(F.col("_grams").alias("g"), F.sequence(F.lit(0), F.size("_grams") - 1).alias("i")))
    df = df.withColumn("_sorted", F.when(F.col("_repeats"), places))
    n = F.size("_sorted")
    equal = F.zip_with(F.slice("_sorted", F.lit(1), n - 1), F.slice("_sorted", F.lit(2), n - 1), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    df = df.withColumn("_starts", F.when(F.col("_repeats"), F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))))
    m = F.size("_starts")
    # A start adds three words, less those the start before it has added.
    covered = F.aggregate(F.zip_with(F.slice("_starts", F.lit(1), m - 1), F.slice("_starts", F.lit(2), m - 1), lambda a, b: F.least(F.lit(3), b - a)), F.lit(3), lambda s, x: s + x)
    bare = F.lower(F.rtrim(F.translate("_text", WHITE, "     ")))
    stops = F.filter(F.split(F.regexp_replace(bare, "[.,;:?!]+(?= |$)", ""), " "), lambda w: w.isin(stop))
    return df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " " + WHITE, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_repeats"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size(stops).cast("long").alias("n_stop_words"),
    ).drop("_text", "_words", "_lines", "_grams", "_repeats", "_sorted", "_starts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule] = RULES) -> Column:
    """The conjunction of the base rule and the table."""
    keep = ~base_failed()
    for r in rules:
        x = F.col(r.measure).cast("double")
        if r.over:
            x = F.coalesce(F.try_divide(x, F.col(r.over)), F.lit(0.0))
        if r.low is not None:
            keep &= x >= r.low
        if r.high is not None:
            keep &= x <= r.high
    return keep


def quality(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``doc_id``, the measures, ``base_failed`` and ``kept`` for each row of ``docs``."""
    return measured(docs.select("doc_id", F.col("text").alias("_raw")), "_raw").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict(rules).alias("kept"), "n_lines", "n_stop_words")


def kept_documents(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    own = [F.col("_row")[c].alias(c) for c in docs.columns]
    out = measured(docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_raw")), "_raw")
    # A filter moves below projections, with its measures written out in full and evaluated
    # over and over; it stays above one that numbers the rows.
    out = out.withColumn("_number", F.monotonically_increasing_id())
    return out.where(verdict(rules) & (F.col("_number") >= 0)).select(*own)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir))
