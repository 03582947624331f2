"""Ranking: weighted BM25, TF-IDF cosine, lexical counts, fusion, re-ranking, best lines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import redact
from recollect.functions import text as T
from recollect.operators.index import boost
from recollect.operators.segments import View
from recollect.plans.place import place

K1, B = 1.2, 0.75
#: What ends a line.
LINE_END = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
#: Rows of query terms up to which they are sent to every task.
BROADCAST_TERMS = 200_000
#: Cells of a block of documents by terms, and questions that it is multiplied with at once.
CELLS, QUESTIONS = 2_000_000, 256


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``qid, term`` of ``queries(qid, terms)`` and the distinct terms, sent to every task if they
    are few; the size is counted on the questions alone."""
    asked = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    terms = asked.select("term").distinct()
    return (F.broadcast(asked), F.broadcast(terms)) if few else (asked, terms)


def _idf(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``term, avg, idf`` of ``df(term, df)``; ``totals(n, avg)`` is one row."""
    raw = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.crossJoin(F.broadcast(totals)).select("term", "avg", F.when(raw > 0, raw).otherwise(1e-6).alias("idf"))


def _bm25_part() -> Column:
    return F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg")))


def _scored(tf: DataFrame, totals: DataFrame, asked: DataFrame, key: str, digits: int | None) -> DataFrame:
    """BM25 of the postings ``key, term, f, len`` of asked terms; ``totals(n, avg)`` is one row."""
    idf = _idf(tf.groupBy("term").agg(F.count("*").alias("df")), totals)
    scored = tf.join(idf, "term").select(key, "term", _bm25_part().alias("s"))
    total = F.sum("s")
    return scored.join(asked, "term").groupBy("qid", key).agg((total if digits is None else F.round(total, digits)).alias("score"))


def bm25(docs: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, digits: int | None = 4) -> DataFrame:
    """``qid, key, score``: BM25 over weighted token columns, for a batch of questions.

    ``docs`` holds token arrays named as ``fields`` (name to weight; weight 0 counts for the
    length only), ``queries`` holds ``qid, terms``. Only postings of query terms are kept,
    before anything is shuffled; a term in most documents weighs 1e-6. Without ``digits`` scores
    are not rounded."""

    def entries(field: str, weight: float) -> Column:
        return F.transform(F.col(field), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    weighted = F.flatten(F.array(*[entries(f, w) for f, w in fields.items() if w]))
    length = sum((F.size(f) for f in fields), F.lit(0))
    rows = docs.select(key, weighted.alias("_terms"), length.cast("double").alias("len"))
    totals = rows.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg"))
    asked, terms = _asked(queries)
    tf = rows.select(key, "len", F.explode("_terms").alias("p")).select(key, "len", "p.term", "p.w").join(terms, "term").groupBy(key, "len", "term").agg(F.sum("w").alias("f"))
    return _scored(tf, totals, asked, key, digits)


def bm25_of(view: View, fields: dict[str, float], queries: DataFrame, k: int, digits: int | None = 4) -> DataFrame:
    """The first ``k`` of each question, and some more, by BM25 from an index: nothing is read but the
    buckets of the asked terms."""
    field = next(iter(fields)) if len(fields) == 1 else None
    asked, terms, few = _numbered(queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")))
    rows, df = view.of(terms, field)
    weight = F.element_at(F.create_map(*[x for f, w in fields.items() for x in (F.lit(f), F.lit(float(w)))]), F.col("field"))
    length = sum((F.col(f"n_{f}") for f in fields), F.lit(0)).cast("double")
    tf = rows.select(view.key, "t", "term", length.alias("len"), weight.alias("w"), "tf").where("w <> 0").groupBy(view.key, "t", "term", "len").agg(F.sum(F.col("w") * F.col("tf")).alias("f"))
    n = view.totals.select(F.col("n").cast("double").alias("n"), F.try_divide(sum((F.col(f"n_{f}") for f in fields), F.lit(0)), F.col("n")).alias("avg"))
    every = field is not None or all(fields.get(f) for f in view.fields)
    df = df if df is not None and every else tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.broadcast(_idf(df, n)) if few else _idf(df, n)
    parts = tf.join(idf, "term").select(view.key, "t", _bm25_part().alias("s"))
    return _best(parts, asked.withColumn("w", F.lit(1.0)), view.key, k, few, digits)


def bm25_first(docs: DataFrame, key: str, fields: dict[str, float], queries: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each question, and some more, by ``bm25`` without rounding; where a key has several rows, all scores.

    Tokens are looked up among the asked ones in one reading; what is found is written, a row a document, and
    counted and scored from there, so that no posting is moved and no pair of question and document but the first ones."""
    asked, terms, few = _numbered(queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")))
    if not few:
        return bm25(docs, key, fields, queries, digits=None)
    spark, at = docs.sparkSession, place(docs.sparkSession, "met")
    words = spark.sparkContext.broadcast([r["term"] for r in terms.orderBy("t").collect()])
    counted = [f for f, w in fields.items() if w]

    def meet(batches):
        known = pa.array(words.value, pa.string())
        n = max(len(known), 1)
        for batch in batches:
            own, weight = [np.empty(0, np.int64)], [np.empty(0)]
            for f in counted:
                lists = batch.column(f)
                code = pc.index_in(lists.flatten(), known)
                hit = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
                row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
                own.append(row[hit] * n + code.take(pa.array(hit)).to_numpy())
                weight.append(np.full(len(hit), float(fields[f])))
            each, which = np.unique(np.concatenate(own), return_inverse=True)
            f = np.bincount(which, np.concatenate(weight), len(each))
            row, t = np.divmod(each, n)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (t.astype(np.int32), f)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("len"), *lists], [key, "len", "t", "f"])

    kind = docs.schema[key].dataType.simpleString()
    length = sum((F.size(f) for f in fields), F.lit(0)).cast("double")
    docs.select(key, length.alias("len"), *counted).mapInArrow(meet, f"{key} {kind}, len double, t array<int>, f array<double>").write.parquet(at)
    met = spark.read.schema(f"{key} {kind}, len double, t array<int>, f array<double>").parquet(at)
    if not met.groupBy(key).count().where("count > 1").isEmpty():
        return bm25(docs, key, fields, queries, digits=None)
    totals = met.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg")).first()
    df = np.zeros(len(words.value))
    for r in met.select(F.explode("t").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    raw = np.log((totals["n"] - df + 0.5) / (df + 0.5))
    idf, mean = np.where(raw > 0, raw, 1e-6), totals["avg"]
    rows = asked.select("qid", "t").toArrow()
    ids = rows["qid"].combine_chunks().dictionary_encode()
    shared = spark.sparkContext.broadcast((ids.dictionary, ids.indices.to_numpy(), rows["t"].to_numpy(), np.ones(rows.num_rows), idf))

    def score(batches):
        names, q, t, w, idf = shared.value
        least = np.zeros((len(names), k))
        for batch in batches:
            size = pc.list_value_length(batch.column("t")).to_numpy().astype(np.int64)
            code, f = batch.column("t").flatten().to_numpy(), batch.column("f").flatten().to_numpy()
            long = np.repeat(batch.column("len").to_numpy(), size)
            s = idf[code] * f * (K1 + 1) / (f + K1 * (1 - B + B * long / mean))
            for question, doc, got in _products(size, code, s, len(idf), len(names), q, t, w, least, 1e-9):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(question)), batch.column(key).take(pa.array(doc)), pa.array(got)], ["qid", key, "score"])

    return met.mapInArrow(score, f"qid {asked.schema['qid'].dataType.simpleString()}, {key} {kind}, score double")


def _products(size: np.ndarray, at: np.ndarray, s: np.ndarray, n_terms: int, n_names: int, q: np.ndarray, t: np.ndarray, w: np.ndarray, least: np.ndarray, margin: float):
    """Questions, documents and scores: documents with ``size`` parts ``s`` of the terms ``at`` times questions ``q`` with
    weights ``w`` of the terms ``t``, a bounded number of both at a time; what may be among the first ones, whose
    scores are kept in ``least`` by question."""
    ends = np.cumsum(size)
    begin = ends - size
    step = max(16, CELLS // max(n_terms, 1))
    for c in range(0, n_names, QUESTIONS):
        some = (q >= c) & (q < c + QUESTIONS)
        want = np.zeros((n_terms, min(QUESTIONS, n_names - c)))
        want[t[some], q[some] - c] = w[some]
        for i in range(0, len(ends), step):
            a, b = begin[i], ends[min(i + step, len(ends)) - 1]
            own = size[i : i + step]
            # A term may have several parts in a document.
            have = np.bincount(np.repeat(np.arange(len(own)) * n_terms, own) + at[a:b], s[a:b], len(own) * n_terms).reshape(len(own), n_terms)
            got = have @ want
            best = least[c : c + QUESTIONS]
            new = np.partition(np.concatenate([best, got.T], 1), -least.shape[1], 1)[:, -least.shape[1] :]  # the least of them comes first
            least[c : c + QUESTIONS] = new
            doc, question = np.nonzero((got > 0) & (got >= new[:, 0] - margin))
            yield question + c, doc + i, got[doc, question]


def _numbered(asked: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """``qid, term, t`` and the distinct ``term, t``, numbered by their order if they are few."""
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    terms = asked.select("term").distinct()
    if not few:
        terms = terms.withColumn("t", F.xxhash64("term"))
        return asked.join(terms, "term"), terms, False
    spark = asked.sparkSession
    words = sorted(r[0] for r in terms.collect())
    terms = F.broadcast(spark.createDataFrame(list(zip(words, range(len(words)))), "term string, t long"))
    return asked.join(terms, "term"), terms, True


def _best(parts: DataFrame, asked: DataFrame, key: str, k: int, few: bool, digits: int | None) -> DataFrame:
    """``qid, key, score`` from ``parts(key, t, s)`` and ``asked(qid, t, w)``, the sums of s * w: those that may be
    among the first ``k`` of a question, by documents. Of a few terms a partition's scores are a product
    of two matrices, a bounded number of documents at a time, and all but its first ones stay there."""
    total = F.sum(F.col("s") * F.col("w"))
    if not few:
        return parts.join(asked, "t").groupBy("qid", key).agg((total if digits is None else F.round(total, digits)).alias("score"))
    spark, kind = parts.sparkSession, parts.schema[key].dataType.simpleString()
    rows = asked.select("qid", "t", "w").toArrow()
    ids = rows["qid"].combine_chunks().dictionary_encode()
    n_terms = 1 + (pc.max(rows["t"]).as_py() or 0)
    matrix = (ids.dictionary, ids.indices.to_numpy(), rows["t"].to_numpy(), rows["w"].to_numpy())
    shared, margin = spark.sparkContext.broadcast(matrix), 10.0 ** -(digits or 9)

    def scores(table: pa.Table, names, q, t, w, least: np.ndarray):
        runs = pc.run_end_encode(table.column(key).combine_chunks())
        ends = runs.run_ends.to_numpy()
        at, s = table.column("t").to_numpy(), table.column("s").to_numpy()
        for question, doc, got in _products(np.diff(ends, prepend=0), at, s, n_terms, len(names), q, t, w, least, margin):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(question)), runs.values.take(pa.array(doc)), pa.array(got)], ["qid", key, "score"])

    def run(batches):
        names, q, t, w = shared.value
        least, held = np.zeros((len(names), k)), None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            runs = pc.run_end_encode(table.column(key).combine_chunks()) if table.num_rows else None
            last = int(runs.run_ends[-2].as_py()) if runs is not None and len(runs.run_ends) > 1 else 0
            held = table.slice(last)  # the last document may go on
            if last:
                yield from scores(table.slice(0, last), names, q, t, w, least)
        if held is not None and held.num_rows:
            yield from scores(held, names, q, t, w, least)

    found = parts.select(key, "t", "s").repartition(key).sortWithinPartitions(key).mapInArrow(run, f"qid {asked.schema['qid'].dataType.simpleString()}, {key} {kind}, score double")
    return found if digits is None else found.withColumn("score", F.round("score", digits))


def top(scored: DataFrame, key: str, k: int, by: str | Column = "score", partition: str = "qid") -> DataFrame:
    """The first ``k`` of each question, ties by key, with their ``rank``."""
    w = W.partitionBy(partition).orderBy(F.desc(by), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rerank(candidates: DataFrame, tier: Column, topic_named: Column | None = None, is_topic: Column | None = None, name_hit: Column | None = None) -> DataFrame:
    """Scores, which must not be rounded before, times the tier's weight, the topic's (1.25 named,
    0.35 not) and 2 for a name hit; rounded to three places, once."""
    score = F.col("score") * boost(tier)
    if is_topic is not None:
        score = score * F.when(is_topic & topic_named, 1.25).when(is_topic, 0.35).otherwise(1.0)
    if name_hit is not None:
        score = score * F.when(name_hit, 2.0).otherwise(1.0)
    return candidates.withColumn("score", F.round(score, 3))


def lexical_count(view: View, field: str, queries: DataFrame, k: int) -> DataFrame:
    """``qid, key, score``: how often the distinct ``queries(qid, terms)`` occur as substrings of a document's
    words in a field of the index, for those that may be among the first ``k`` of a question. Terms and
    words are runs of a-z and 0-9 of three or more.

    A word that holds a term holds its first three characters: the words of the index (from its frequencies,
    each once) and terms meet on those, so texts are not scanned, and a word is compared once however often
    it occurs. Documents then get numbers by term, not by question and term."""
    asked, terms, few = _numbered(queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")))
    n = F.length("word")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring("word", i, F.lit(3))))
    words = view.rows.where(F.col("field") == field).select(F.col("term").alias("word")).distinct() if view.df is None else view.df.where(F.col("field") == field).select(F.col("term").alias("word"))
    known = words.withColumn("_g", F.explode(grams))
    begun = terms.withColumn("_g", F.substring("term", 1, 3))
    times = ((n - F.length(F.replace("word", F.col("term"), F.lit("")))) / F.length("term")).cast("long")
    at = place(view.rows.sparkSession, "holds")
    known.join(F.broadcast(begun) if few else begun, "_g").where(F.contains("word", F.col("term"))).select("word", "t", times.alias("times")).write.parquet(at)
    holds = view.rows.sparkSession.read.parquet(at)  # looked at twice
    holds = F.broadcast(holds) if holds.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else holds
    parts = view.rows.where(F.col("field") == field).select(view.key, F.col("term").alias("word"), "tf").join(holds, "word").select(view.key, "t", (F.col("tf") * F.col("times")).cast("double").alias("s"))
    return _best(parts, asked.withColumn("w", F.lit(1.0)), view.key, k, few, None)


def _inverse(df: DataFrame, totals: DataFrame) -> DataFrame:
    """``term, idf`` for TF-IDF: ln((1 + n) / (1 + df)) + 1; ``totals`` is one row."""
    return df.crossJoin(F.broadcast(totals.select(F.col("n").alias("_n")))).select("term", (F.ln((F.col("_n") + 1.0) / (F.col("df") + 1.0)) + 1).alias("idf"))


def _weighted(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """``counts(.., term, c)`` with ``w``, (1 + ln c) * idf."""
    return counts.join(idf, "term").withColumn("w", (1 + F.ln("c")) * F.col("idf")).drop("idf", "c")


def tfidf_of(view: View, field: str, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The first ``k`` of each question, and some more, by cosine of (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)
    between a field of the documents and ``queries(qid, terms)``, where a term may stand more than once."""
    counts = queries.select("qid", F.explode("terms").alias("term")).groupBy("qid", "term").agg(F.count("*").alias("c"))
    asked, terms, few = _numbered(counts)
    rows, df = view.of(terms, field)
    idf = F.broadcast(_inverse(df, view.totals)) if few else _inverse(df, view.totals)
    q = _weighted(asked, idf)
    qnorm = q.groupBy("qid").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("qnorm"))
    every = _inverse(view.df.where(F.col("field") == field).select("term", "df"), view.totals)
    # Of all postings and words, the words are looked up; postings are not sorted for that.
    norms = view.norms(lambda all_: _weighted(all_.where(F.col("field") == field).select(view.key, "term", F.col("tf").alias("c")), every.hint("shuffle_hash")))
    parts = _weighted(rows.select(view.key, "t", "term", F.col("tf").alias("c")), idf).join(norms, view.key).select(view.key, "t", (F.col("w") / F.col("norm")).alias("s"))
    return _best(parts, q.join(qnorm, "qid").select("qid", "t", (F.col("w") / F.col("qnorm")).alias("w")), view.key, k, few, digits)


def reciprocal_rank_fusion(key: str, *ranked: DataFrame, k: int = 60, digits: int = 6) -> DataFrame:
    """``qid, key, score``: the sum of 1 / (k + rank) over several rankings ``qid, key, rank``."""
    both = ranked[0].select("qid", key, "rank")
    for r in ranked[1:]:
        both = both.unionByName(r.select("qid", key, "rank"))
    return both.groupBy("qid", key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), digits).alias("score"))


def best_lines(docs: DataFrame, key: str, text: Column, terms: DataFrame, k: int = 3, width: int = 160, secret: Column | None = None) -> DataFrame:
    """``qid, key, line_no, line, hits``: the ``k`` lines of ``docs(qid, key, ..)`` whose tokens hold most of
    ``terms(qid, terms)``, the earlier one of equals, from line 1 on; redacted, then cut to ``width``. Of
    ``secret`` pages there are none."""
    open_ = docs if secret is None else docs.where(~F.coalesce(secret, F.lit(False)))
    lines = open_.join(terms, "qid").select("qid", key, "terms", F.posexplode(F.split(text, LINE_END)).alias("_at", "line"))
    hits = T.let(T.tokens(F.col("line")), lambda have: F.size(F.filter("terms", lambda t: F.array_contains(have, t))))
    w = W.partitionBy("qid", key).orderBy(F.desc("hits"), "_at")
    first = lines.withColumn("hits", hits).where("hits > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    shown = F.substring(redact.redact(F.regexp_replace("line", "^\\s+|\\s+$", "")), 1, width)
    return first.select("qid", key, (F.col("_at") + 1).alias("line_no"), shown.alias("line"), "hits")


def literal_context(docs: DataFrame, key: str, text: Column, needle: str, per_doc: int = 4) -> DataFrame:
    """``key, line_no, hit``: lines that hold the needle (any case) with one line around them,
    each once, for the first few hits of a document."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    hit = lines.where(F.contains(F.lower("line"), F.lit(needle.lower())))
    first = hit.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy("line_no"))).where(F.col("r") <= per_doc)
    around = first.select(key, F.explode(F.array(F.col("line_no") - 1, F.col("line_no"), F.col("line_no") + 1)).alias("line_no"), F.col("line_no").alias("at"))
    marked = around.groupBy(key, "line_no").agg(F.max(F.col("line_no") == F.col("at")).alias("hit"))
    return marked.join(lines, [key, "line_no"]).select(key, "line_no", "hit", F.length("line").alias("n_chars"))


def with_margin(ranked: DataFrame, key: str) -> DataFrame:
    """The first hit of each question with ``margin``, its score over the second's (9.9 alone)."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), key)
    second = F.lead("score").over(w)
    return ranked.withColumn("margin", F.round(F.when(second.isNull() | (second == 0), 9.9).otherwise(F.col("score") / second), 4)).withColumn("rank", F.row_number().over(w)).where("rank = 1")


def confidence(margin: Column, tier: Column, refuse: Column) -> Column:
    return F.when(refuse, "none").when((margin >= 1.5) & tier.isin("rule", "topic"), "high").when(margin >= 1.15, "medium").otherwise("low")
