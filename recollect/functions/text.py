"""Scalar text functions as Column expressions: normalisation, tokens, n-grams, features.

Everything runs in the JVM but Unicode compatibility normalisation, which Spark lacks: an
Arrow function sees only texts with characters beyond ASCII and plain Latin.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

# Character ranges and word lists.
CJK = "\\u3400-\\u9fff\\uf900-\\ufaff"
CJK_BASIC = "\\u4e00-\\u9fff"
FUNCTION_CHARS = "的了我你他她吗呢吧啊么什"
COUNT_CHARS = "一二两三四五六七八九十百千几每这那哪某各"
PARTICLES = "的了着过地得"
PAIR_STOP = (
    "什么 怎么 怎样 能不 不能 是不 不是 哪个 哪些 哪里 应该 可以 现在 到底 一下 我的 我们 你的 为什 么要 有没 没有 "
    "是什 么样 要不 不要 还是 这个 那个 如何 多少 吗我 关于 帮我 请问 一首 一个"
).split()
ENGLISH_FUNCTION = (
    "a an the and or but if then so of to in on at by for from with about into over under as is are was were be been "
    "being am do does did done doing have has had having can could should would will shall may might must need needs "
    "what which who whom whose when where why how many much long often far old there here this that these those it its "
    "i me my we us our you your he him his she her they them their one ones any some all each every no not more most "
    "less other else than too very just also only ever still again use used using get got make made way ways thing things "
    "please tell know want like"
).split()


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else None)


#: ASCII and the Latin letters and signs that are their own compatibility form, whatever of them stands beside them.
PLAIN = "\\x00-\\x9F\\u00A1-\\u00A7\\u00A9\\u00AB-\\u00AE\\u00B0\\u00B1\\u00B6\\u00B7\\u00BB\\u00BF-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E"


def nfkc(text: Column) -> Column:
    """Compatibility form; texts of plain characters never leave the JVM."""
    wide = text.rlike(f"[^\\x00-\\x7F](?<![{PLAIN}])")
    return F.coalesce(_nfkc(F.when(wide, text)), text)


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, and outside of ``use``, however often it is used there."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def latin_words(text: Column, longer_than: int = 2) -> Column:
    """Lower-case runs of a-z and 0-9 with more than so many characters."""
    return extract_all(F.lower(text), f"[a-z0-9]{{{longer_than + 1},}}")


def bigrams(run: Column) -> Column:
    """A single character as it is, else the overlapping pairs."""
    n = F.length(run)
    return F.when(n == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens(text: Column, normalise: bool = True) -> Column:
    """Pairs of neighbouring CJK characters of each run, then latin words of two characters or more."""
    low = F.lower(nfkc(text) if normalise else text)
    # Of a lower-cased text, letters and digits of ASCII are a-z and 0-9.
    return let(low, lambda t: F.concat(F.flatten(F.transform(_cjk(t, "+"), bigrams)), extract_all(t, "\\p{Alnum}{2,}")))


def _cjk(text: Column, times: str = "") -> Column:
    """CJK characters or runs of them; texts that have nothing beyond their first one are looked at but once."""
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(text.rlike("[\\u3400-\\ufaff]"), extract_all(text, f"[{CJK}]{times}")).otherwise(none)


def bench_tokens(text: Column) -> Column:
    """Latin words of three characters or more, then CJK pairs; no normalisation."""
    low = F.lower(text)
    return F.concat(F.filter(extract_all(low, "[a-z0-9]+"), lambda w: F.length(w) > 2), F.flatten(F.transform(extract_all(low, f"[{CJK_BASIC}]+"), lambda r: F.when(F.length(r) == 1, F.array().cast("array<string>")).otherwise(bigrams(r)))))


def run_tokens(text: Column) -> Column:
    """Whole runs of letters a-z, digits and CJK characters."""
    return extract_all(F.lower(text), f"[a-z0-9{CJK_BASIC}]+")


def unigrams(text: Column) -> Column:
    """Distinct CJK characters in order."""
    return let(F.lower(nfkc(text)), lambda t: F.array_sort(F.array_distinct(_cjk(t))))


def compact(text: Column) -> Column:
    """Letters and digits only, normalised and lower-cased."""
    return F.regexp_replace(F.lower(nfkc(text)), "(?U)[\\s\\W_]+", "")


def lock_form(text: Column) -> Column:
    """What alias look-ups compare: without particles, space, punctuation and symbols."""
    return F.lower(F.regexp_replace(text, f"[{PARTICLES}\\s\\p{{P}}\\p{{S}}]", ""))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Character n-grams of the lower-cased text with single spaces; a short text is its own."""
    flat = F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))
    size = F.length(flat)
    return F.when(size == 0, F.array().cast("array<string>")).when(size <= n, F.array(flat)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(flat, i, F.lit(n))))


def features(text: Column, stop: list[str] | None = None, n: int = 3) -> Column:
    """Bag of words (w:) and character n-grams (c:)."""
    words = run_tokens(text)
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return F.concat(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), F.transform(char_ngrams(text, n), lambda c: F.concat(F.lit("c:"), c)))


def latin_forms(word: Column) -> Column:
    """A word with its plural and singular forms."""
    forms = [word, F.concat(word, F.lit("s")), F.concat(word, F.lit("es"))]
    cut = F.when(word.endswith("ies"), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
    less = [cut, F.when(word.endswith("es"), F.substring(word, F.lit(1), F.length(word) - 2)), F.when(word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1))]
    return F.array_distinct(F.array_compact(F.array(*forms, *less)))


def is_pair(token: Column) -> Column:
    return token.rlike(f"^[{CJK}]{{2}}$")


def single_concept(text: Column) -> Column:
    """One latin word (marks of names and versions count as letters), or up to four CJK
    characters; no digits alone."""
    bare = F.trim(text)
    return (bare.rlike("^[A-Za-z0-9._+-]+$") & ~bare.rlike("^[0-9]+$")) | bare.rlike(f"^[{CJK}]{{1,4}}$")


def query_terms(text: Column) -> Column:
    """Distinct tokens of a question: no single CJK characters, no pairs that ask rather than
    say something, no English function words unless nothing else is left."""
    some = F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) > 1) & ~t.isin(PAIR_STOP))
    kept = F.filter(some, lambda t: ~t.isin(ENGLISH_FUNCTION))
    return F.when(F.size(kept) > 0, kept).otherwise(some)


def content_terms(text: Column) -> Column:
    """What a text says: distinct tokens without asking pairs and pairs with a function character."""
    return F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) > 1) & ~t.isin(PAIR_STOP) & ~(is_pair(t) & t.rlike(f"[{FUNCTION_CHARS}]")))


def squash(text: Column, limit: int) -> Column:
    """White space to single spaces, cut to so many characters with a mark."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.rtrim(F.substring(flat, 1, limit)), F.lit(" …"))).otherwise(flat)


def pipe_safe(text: Column) -> Column:
    """Fit for a field between bars."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\|", "/"), "\\s+", " "))


def file_safe(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, '[\\\\/:*?"<>|#^\\[\\]\\r\\n\\t]+', " "))


def clean_line(line: Column) -> Column:
    """Without one quote, call-out, list or number mark in front, and without emphasis, code and link marks."""
    bare = F.regexp_replace(F.trim(line), "^(?:>\\s*(?:\\[![^\\]]+\\]\\s*)?|[-*+]\\s+|\\d+\\.\\s+)", "")
    return F.trim(F.regexp_replace(bare, "[*`_]|\\[\\[([^|\\]]*\\|)?|\\]\\]", ""))


def first_rule_line(body: Column, limit: int = 80) -> Column:
    """The first line with emphasis, else the first plain one, of eight characters or more without
    marks; headings, tables, fences, markup and status lines do not count."""
    lines = F.split(body, "\r?\n")
    plain = lambda x: (F.length(x) > 0) & ~x.rlike("^(?:#|\\||```|<|!\\[|%%)")
    fit = lambda c: F.when((F.length(c) >= 8) & ~c.rlike("^(?i)status\\s*[:：]"), c)
    told = lambda x: let(F.trim(x), lambda y: F.when(plain(y), let(clean_line(y), fit)))
    # Lines after the first one that fits are not looked at.
    first = lambda some: F.aggregate(some, F.lit(None).cast("string"), lambda have, x: F.when(have.isNotNull(), have).otherwise(told(x)))
    bold = F.when(F.contains(body, F.lit("**")), first(F.filter(lines, lambda x: F.contains(x, F.lit("**")))))
    pick = F.coalesce(bold, first(lines))
    return F.when(F.length(pick) > limit, F.concat(F.substring(pick, 1, limit - 1), F.lit("…"))).otherwise(pick)


def noun_candidates(text: Column, stop: list[str]) -> Column:
    """Pieces between punctuation that could name a page."""
    parts = F.transform(F.split(nfkc(text), "(?U)[\\s\\p{P}\\p{S}]+"), F.lower)
    fits = lambda w: F.when(w.rlike("^[\\x00-\\x7f]+$"), F.length(w).between(2, 24)).otherwise(F.length(w).between(2, 12))
    return F.filter(F.array_distinct(parts), lambda w: fits(w) & ~w.rlike("^[0-9]+$") & ~w.rlike("^\\d{4}-?\\d{2}") & ~w.isin(stop))


def has_term(term: Column, text: Column) -> Column:
    """A CJK term anywhere, a latin one as a whole word with an optional plural ending."""
    low, t = F.lower(text), F.lower(term)
    word = F.concat(F.lit("(?<![a-z0-9])\\Q"), t, F.lit("\\E(?:s|es)?(?![a-z0-9])"))
    return F.when(t.rlike(f"[{CJK}]"), F.contains(low, t)).otherwise(F.regexp_like(low, word))


def wiki_links(body: Column) -> Column:
    """Targets of [[target#part|label]]."""
    return F.transform(extract_all(body, "\\[\\[[^\\]\\n]+\\]\\]"), lambda x: F.trim(F.regexp_extract(x, "\\[\\[([^\\]#|]*)", 1)))


def json_in_prose(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(text, "(?s)\\{.*\\}", 0)
