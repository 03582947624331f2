"""Batches of questions against an index: lock, recall with refusal, confidence, answer cards.

Index tables stand in a folder as Parquet; a batch is answered in one plan, keyed by ``qid``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import digest, frontmatter, redact, text as T
from recollect.operators import cards as C
from recollect.operators import index as I
from recollect.operators import literal as literal_
from recollect.operators import lock as L
from recollect.operators import rank as R
from recollect.plans.place import place

# Thresholds of the refusal rules.
STRONG, WORDNESS, SCORE_MIN, SINGLE_SCORE, SMALL, CANDIDATES = 0.5, 0.12, 8.5, 25.0, 300, 80
RARE, ALIEN, OUTSIDE = 30, 2, 2
FIELDS = {"title": 4.0, "triggers": 4.0, "body": 1.0, "uni": 0.0}
#: The layout of the tables: another one means all of them are made anew.
VERSION = "recollect-3"


@dataclass
class Lexicon:
    """What is common in a language, beyond the pages: ``words(word, generic)`` of two characters, and
    ``chars(char)``. Without one, all words count as unknown and all characters as uncommon."""

    words: DataFrame
    chars: DataFrame

    @classmethod
    def of(cls, frequencies: DataFrame, generic: int = 1000, chars: int = 1500) -> Lexicon:
        """From ``frequencies(word, freq)``: the most frequent words are too general to tell anything."""
        pairs = frequencies.where(T.is_pair(F.col("word")))
        first = pairs.orderBy(F.desc("freq"), "word").limit(generic).select("word", F.lit(True).alias("generic"))
        words = pairs.select("word").distinct().join(first, "word", "left").fillna(False, ["generic"])
        each = frequencies.select(F.explode(F.regexp_extract_all("word", F.lit(f"[{T.CJK}]"), F.lit(0))).alias("char"), "freq")
        return cls(words, each.groupBy("char").agg(F.sum("freq").alias("freq")).orderBy(F.desc("freq"), "char").limit(chars).select("char"))


@dataclass
class Index:
    """Pages, document rows, any-column vocabulary, the number of pages, and the folder of the tables."""

    rows: DataFrame
    vocabulary: DataFrame
    n: int
    pages: DataFrame
    path: str

    @classmethod
    def build(cls, pages: DataFrame, prefixes: list[tuple[str, str]], triggers: DataFrame | None = None, path: str | None = None, cards: DataFrame | None = None) -> Index:
        """From ``pages(rel, content)``: secret pages stay out, texts are redacted first. The
        tables are written to ``path`` (a new shared folder if none is given) and read back.

        ``cards(rel, sha, q, a)``: the questions of those that were made from the page as it is and
        are grounded in it count as triggers of the page."""
        spark, path = pages.sparkSession, path or place(pages.sparkSession, "index")
        _purge(spark, path)
        text = redact.redact(F.col("content"))
        sha = F.array(digest.body_digest(F.col("content")), digest.short(F.col("content")))
        pages.select("rel", text.alias("content"), sha.alias("sha")).select("rel", "content", "sha", frontmatter.split_meta(F.col("content")).alias("p")).write.mode("overwrite").parquet(f"{path}/pages")
        held = spark.read.parquet(f"{path}/pages")
        parts = held.select("rel", "content", "sha", "p.meta", "p.body")
        parts = parts.where(~redact.is_secret_page(F.col("rel"), F.col("meta")["title"], F.col("meta")["secret"]))
        if cards is not None:
            asked = C.live(cards, parts).groupBy("rel").agg(F.collect_set("q").alias("words"))
            triggers = asked if triggers is None else I.alias_words(triggers, asked)
        rows = I.document_rows(parts.drop("content", "sha"), triggers)
        rows = rows.withColumn("tier", I.tier_of(F.col("rel"), F.col("status"), prefixes))
        rows.write.mode("overwrite").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        words = F.array_distinct(F.concat("title", "triggers", "body", "uni"))
        I.vocabulary(rows, "rel", words).write.mode("overwrite").parquet(f"{path}/vocabulary")
        _versioned(spark, path)
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        rows = spark.read.parquet(f"{path}/rows")
        pages = spark.read.parquet(f"{path}/pages").join(rows.select("rel"), "rel", "left_semi")
        return cls(rows, spark.read.parquet(f"{path}/vocabulary"), rows.count(), pages.select("rel", "content"), path)

    @property
    def grams(self) -> literal_.Grams:
        """The trigrams of all pages, which nothing but ``literal`` asks for: they are written when it first does,
        and stand from then on."""
        spark, at = self.pages.sparkSession, f"{self.path}/grams"
        if _exists(spark, f"{at}/version"):
            return literal_.Grams.load(spark, at, "rel")
        grams = literal_.Grams.build(self.pages, "rel", F.col("content"), at)
        _versioned(spark, at)
        return grams

    @classmethod
    def current(cls, pages: DataFrame, prefixes: list[tuple[str, str]], path: str, triggers: DataFrame | None = None, cards: DataFrame | None = None) -> Index:
        """The index that stands in ``path``, or a new one if there is none of this version; what an
        earlier version has left is deleted, as it may hold texts that were not redacted."""
        spark = pages.sparkSession
        if _exists(spark, f"{path}/version") and spark.read.parquet(f"{path}/version").first()["version"] == VERSION:
            return cls.load(spark, path)
        return cls.build(pages, prefixes, triggers, path, cards)


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _folder(spark, path)
    return fs.exists(target)


def _versioned(spark: SparkSession, path: str) -> None:
    """Written last: what stands in ``path`` is whole."""
    spark.createDataFrame([(VERSION,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{path}/version")


def _purge(spark: SparkSession, path: str) -> None:
    """The version first, so that what is left of an interrupted purge is never taken for whole."""
    for name in ("version", "grams/version", "pages", "rows", "vocabulary", "grams"):
        fs, target = _folder(spark, f"{path}/{name}")
        if fs.exists(target):
            fs.delete(target, True)


def _held(df: DataFrame, name: str) -> DataFrame:
    """Written and read back, so that later steps do not carry the plan of earlier ones."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _few(df: DataFrame) -> DataFrame:
    """Sent to every task if its rows are few."""
    return F.broadcast(df) if df.limit(R.BROADCAST_TERMS + 1).count() <= R.BROADCAST_TERMS else df


def _narrowed(index: Index, questions: DataFrame) -> Index:
    """The index with what the questions can ask of its vocabulary: their terms, the forms of latin ones, and
    the characters of pairs. Of all words it is read once."""
    term = questions.select(F.explode(T.query_terms(F.col("q"))).alias("term"))
    forms = F.when(T.is_pair(F.col("term")), F.split("term", "")).otherwise(T.latin_forms(F.col("term")))
    asked = _held(term.distinct().select(F.explode(F.array_union(F.array("term"), forms)).alias("term")).distinct(), "wanted")
    return replace(index, vocabulary=_held(index.vocabulary.join(_few(asked), "term", "left_semi"), "known"))


def analysed(index: Index, questions: DataFrame) -> DataFrame:
    """``qid, term, df, wordness, weight, titled, named, present``: the questions' terms with
    what the index knows of them."""
    raw = _held(questions.select("qid", F.explode(T.query_terms(F.col("q"))).alias("term")), "terms")
    known = index.vocabulary
    pair = T.is_pair(F.col("term"))
    t = raw.join(known, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    for k in (1, 2):  # document counts of a pair's single characters
        t = t.withColumn("_c", F.when(pair, F.substring("term", k, 1))).join(known.select(F.col("term").alias("_c"), F.col("df").alias(f"df{k}")), "_c", "left").drop("_c")
    word = F.when(pair, F.coalesce(F.try_divide(F.col("df"), F.least("df1", "df2")), F.lit(0.0))).otherwise(1.0)
    t = t.withColumn("wordness", word).withColumn("weight", F.when(pair, F.greatest(F.lit(0.2), F.least(F.lit(1.0), F.col("wordness") / 0.3))).otherwise(1.0))
    asked = _few(raw.select("term").distinct())
    titles = index.rows.select(F.explode("title").alias("term")).join(asked, "term", "left_semi").distinct().withColumn("titled", F.lit(True))
    names = index.rows.select(F.explode(F.concat("title", "triggers")).alias("term")).join(asked, "term", "left_semi").distinct().withColumn("named", F.lit(True))
    t = t.join(titles, "term", "left").join(names, "term", "left").fillna(False, ["titled", "named"])
    return t.withColumn("present", F.col("df") > 0)


def unknown_terms(index: Index, questions: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """``qid, unknown, alien``: latin words of four characters or more that stand nowhere in any form,
    and characters of pairs that stand nowhere and are not common."""
    terms = questions.select("qid", F.explode(T.query_terms(F.col("q"))).alias("term"))
    words = terms.where(F.col("term").rlike("^[a-z0-9]{4,}$") & ~F.col("term").rlike("^[0-9]+$") & ~F.col("term").isin(T.ENGLISH_FUNCTION))
    forms = words.select("qid", "term", F.explode(T.latin_forms(F.col("term"))).alias("form"))
    met = forms.join(index.vocabulary.select(F.col("term").alias("form"), "df"), "form", "left").groupBy("qid", "term").agg(F.max("df").alias("df"))
    unknown = met.groupBy("qid").agg(F.sum(F.col("df").isNull().cast("int")).alias("unknown"))
    chars = terms.where(T.is_pair(F.col("term"))).select("qid", F.explode(F.split("term", "")).alias("term")).where(~F.col("term").rlike(f"[{T.FUNCTION_CHARS}]|^$")).distinct()
    if lexicon is not None:
        chars = chars.join(lexicon.chars.select(F.col("char").alias("term")), "term", "left_anti")
    alien = chars.join(index.vocabulary.select("term"), "term", "left_anti").groupBy("qid").agg(F.count("*").alias("alien"))
    return questions.select("qid").join(unknown, "qid", "left").join(alien, "qid", "left").fillna(0, ["unknown", "alien"])


def recall(index: Index, questions: DataFrame, limit: int = 5, scope: str | None = None, gate: bool = True, lexicon: Lexicon | None = None) -> DataFrame:
    """``qid, rel, rank, score, tier, how, margin, strong, refuse, confidence`` for a batch of
    ``questions(qid, q)``. Questions without any hit have one row with confidence ``none``."""
    questions = _held(questions, "questions")
    index = _narrowed(index, questions)
    terms = analysed(index, questions)
    if lexicon is not None:
        terms = terms.join(lexicon.words.select(F.col("word").alias("term"), "generic"), "term", "left")
    else:
        terms = terms.withColumn("generic", F.lit(None).cast("boolean"))
    terms = _held(terms, "analysed")
    present = terms.where("present")
    good = (~T.is_pair(F.col("term"))) | F.col("named") | (F.col("wordness") >= WORDNESS)
    any_good = F.max(good.cast("int")).over(W.partitionBy("qid")) == 1
    used = present.withColumn("_use", F.when(any_good, good).otherwise(True)).where("_use")
    asked = used.groupBy("qid").agg(F.collect_set("term").alias("terms"))
    scored = R.bm25_first(index.rows, "rel", FIELDS, asked, CANDIDATES)
    first = _held(R.top(scored, "rel", CANDIDATES, F.round("score", 9)).withColumnRenamed("rank", "_place"), "first")
    rows = index.rows.select("rel", "tier", "how", "name", "title", "triggers", "body", "uni")
    q = questions.select("qid", "q", T.compact(F.col("q")).alias("_compact"), T.query_terms(F.col("q")).alias("_tokens"))
    hits = _few(first).join(rows, "rel").join(q, "qid")
    hits = R.rerank(hits, F.col("tier"), F.arrays_overlap("title", "_tokens"), F.col("tier") == "topic", (F.length("_compact") >= 2) & F.contains("name", F.col("_compact")))
    if scope:
        hits = hits.where((F.col("rel") == scope) | F.col("rel").startswith(f"{scope}/"))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "_place", "rel")
    hits = _held(hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).withColumn("second", F.lead("score").over(w)), "hits")
    top = hits.where("rank = 1").withColumn("margin", F.when(F.col("second").isNull() | (F.col("second") == 0), 9.9).otherwise(F.col("score") / F.col("second")))

    page = F.array_distinct(F.concat("title", "triggers", "body"))
    on_top = top.select("qid", page.alias("_page"), F.array_union(page, F.col("uni")).alias("_all"))
    pair, digits, hollow = T.is_pair(F.col("term")), F.col("term").rlike("^[0-9]+$"), F.col("term").rlike(f"[{T.FUNCTION_CHARS}]")
    heavy = (F.col("weight") >= STRONG) | F.col("titled")
    word_like = ~pair | F.lit(index.n >= SMALL) | F.col("titled") | F.col("named") | F.col("generic").isNotNull()
    strong = present.join(on_top, "qid").where(F.array_contains("_page", F.col("term")) & heavy & ~digits & ~hollow & word_like).groupBy("qid").agg(F.count("*").alias("strong"))
    seldom = F.least(F.coalesce("df1", F.lit(0)), F.coalesce("df2", F.lit(0))) < RARE
    says = F.when(~pair, ~digits).when(hollow, False).when(F.col("present"), heavy).otherwise(seldom)
    content = terms.where(says).groupBy("qid").agg(F.least(F.lit(2), F.count("*")).alias("need"))
    # Words of the language that stand nowhere, against those the first page has.
    real = terms.where(pair & (F.col("generic") == F.lit(False)) & ~F.substring("term", 1, 1).rlike(f"[{T.COUNT_CHARS}]"))
    outside = real.join(on_top, "qid").groupBy("qid").agg(F.sum((~F.col("present")).cast("int")).alias("absent"), F.sum(F.array_contains("_all", F.col("term")).cast("int")).alias("on_top"))
    judged = top.join(strong, "qid", "left").join(content, "qid", "left").join(unknown_terms(index, questions, lexicon), "qid", "left").join(outside, "qid", "left").fillna(0, ["strong", "need", "unknown", "alien", "absent", "on_top"])
    scale = min(1.0, index.n / 1000)
    s, least = F.col("score"), SCORE_MIN * scale
    one, weak = T.single_concept(F.col("q")), F.col("strong") < F.col("need")
    refuse = F.when(one, (s < least * 0.5) | ((F.col("unknown") > 0) & (F.col("strong") == 0))).otherwise(
        (s < least) | (weak & (s < SINGLE_SCORE * scale)) | (F.col("strong") == 0) | ((F.col("unknown") > 0) & (F.col("strong") <= 2)) | (weak & (F.col("alien") >= ALIEN)) | ((F.col("absent") >= OUTSIDE) & (F.col("absent") > F.col("on_top")))
    )
    judged = judged.withColumn("refuse", refuse)
    verdict = judged.select("qid", F.round("margin", 2).alias("margin"), "strong", "refuse", R.confidence(F.col("margin"), F.col("tier"), F.col("refuse") if gate else F.lit(False)).alias("confidence"))
    out = _held(hits.select("qid", "rel", "rank", "score", "tier", "how").join(verdict, "qid"), "answers")
    missing = questions.select("qid").join(out.select("qid"), "qid", "left_anti")
    none = missing.select("qid", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns if c not in ("qid", "confidence", "margin", "strong", "refuse")], F.lit(0.0).alias("margin"), F.lit(0).cast("long").alias("strong"), F.lit(True).alias("refuse"), F.lit("none").alias("confidence"))
    return out.unionByName(none)


def literal(index: Index, questions: DataFrame, scope: str | None = None, per_page: int = literal_.PER_PAGE, lines: int = literal_.LINES) -> DataFrame:
    """``qid, rel, line_no, line, hit, truncated``: lines that hold a whole question, in any case, and one line
    around them. Pages that the question's rarest trigrams do not name are not read."""
    pages = index.pages if scope is None else index.pages.where((F.col("rel") == scope) | F.col("rel").startswith(f"{scope}/"))
    return literal_.found(index.grams, pages, F.col("content"), questions.select("qid", F.trim("q").alias("needle")), per_page, lines)


def widened(index: Index, questions: DataFrame, scope: str, limit: int = 3) -> DataFrame:
    """Recall within a scope; refused questions are asked again of everything, and flagged."""
    near = recall(index, questions, limit, scope)
    lost = questions.join(near.where("confidence = 'none'").select("qid").distinct(), "qid", "left_semi")
    return near.where("confidence <> 'none'").withColumn("widened", F.lit(False)).unionByName(recall(index, lost, limit).withColumn("widened", F.lit(True)))


def bounded(index: Index, questions: DataFrame, scope: str, limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Recall within a scope, then of everything; and the lines of the scope that hold, word for
    word, the questions that both refuse."""
    hits = widened(index, questions, scope, limit)
    found = _held(hits, "bounded")
    refused = questions.join(found.where("confidence <> 'none'").select("qid").distinct(), "qid", "left_anti")
    return found, literal(index, refused, scope)


def ask(index: Index, questions: DataFrame, aliases: DataFrame, standing: DataFrame | None = None, limit: int = 3) -> DataFrame:
    """``qid, route, rel, confidence, how``: the lock's page if a name is one, else the first
    hit of recall, else a refusal."""
    hit = _held(L.locked(questions, aliases), "locked")
    how = hit.select("qid", "id", F.col("source").alias("rel"))
    how = how.join(standing.select("id", "how"), "id", "left") if standing is not None else how.withColumn("how", F.lit(None).cast("string"))
    rest = recall(index, questions.join(hit, "qid", "left_anti"), limit).where("rank = 1 or rank is null")
    found = rest.select("qid", F.when(F.col("confidence") == "none", "refused").otherwise("recall").alias("route"), F.when(F.col("confidence") != "none", F.col("rel")).alias("rel"), "confidence", "how")
    return how.select("qid", F.lit("lock").alias("route"), "rel", F.lit("exact").alias("confidence"), "how").unionByName(found)


def receipt(answers: DataFrame) -> DataFrame:
    """``qid, receipt``: ordered ``key: value`` lines."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(F.col(k).cast("string"), F.lit(""))) for k in answers.columns if k != "qid"]
    return answers.select("qid", F.concat_ws("\n", F.lit("receipt_version: v1"), *lines).alias("receipt"))


def from_receipt(receipts: DataFrame, key: str) -> DataFrame:
    """A field of a receipt, the first of its name."""
    return receipts.select("qid", F.regexp_extract("receipt", f"(?m)^{key}: (.*)$", 1).alias(key))


def cited(receipts: DataFrame, k: int = 3) -> DataFrame:
    """``qid, cited, refused`` back from receipts: the lock's page, else the pages of the first recall
    lines, else a refusal."""
    lock = F.regexp_extract("receipt", "(?m)^canonical_match: (.+)$", 1)
    hits = F.slice(F.regexp_extract_all("receipt", F.lit("(?m)^recall: (.+)$"), F.lit(1)), 1, k)
    pages = F.when(F.trim(lock) != "", F.array(F.trim(lock))).otherwise(hits)
    return receipts.select("qid", pages.alias("cited"), (F.size(pages) == 0).alias("refused"))


def status(index: Index, prefixes_of: str = "tier") -> DataFrame:
    """``tier, n``: what the index holds."""
    return index.rows.groupBy(prefixes_of).agg(F.count("*").alias("n"))


def with_cards(index: Index, hits: DataFrame, questions: DataFrame, cards: DataFrame) -> DataFrame:
    weights = analysed(index, questions).select("qid", "term", "weight")
    return hits.join(C.attach(hits.where("confidence <> 'none'"), cards, weights), ["qid", "rel"], "left")
