"""An inverted index over documents and BM25 search on it."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritrail.functions.text import content_words, stem
from veritrail.operators.shared import stage

K1, B = 1.5, 0.75


def postings(docs: DataFrame, scope: str, doc_id: str, text: str) -> DataFrame:
    """scope, doc_id, term, tf: content words, stemmed, counted per document."""
    tokens = docs.select(scope, doc_id, F.explode(content_words(text)).alias("w")).select(scope, doc_id, stem("w").alias("term"))
    return tokens.filter(F.col("term") != "").groupBy(scope, doc_id, "term").agg(F.count("*").alias("tf"))


def term_statistics(index: DataFrame, scope: str) -> DataFrame:
    """scope, term, df, occurrences."""
    return index.groupBy(scope, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


#: Version of the stored form; an index of another one is not read.
FORMAT = 1
#: Documents for which an index has one folder more, and the most folders it has.
PER_BUCKET, MOST_BUCKETS = 50_000, 1024


class Index:
    """A stored index: postings in folders by a hash of the term, document frequencies, corpus statistics."""

    def __init__(self, spark: SparkSession, path: str):
        try:
            said = spark.read.text(f"{path}/meta").first()
        except AnalysisException:
            said = None
        if said is None:  # it is written last
            raise FileNotFoundError(f"{path}: no whole index")
        meta = json.loads(said[0])
        if meta["format"] != FORMAT:
            raise ValueError(f"{path}: format {meta['format']}, this code reads {FORMAT}")
        self.scope, self.doc_id, self.buckets = meta["scope"], meta["doc_id"], meta["buckets"]
        self.postings, self.terms, self.stats = (spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "stats"))


def _bucket(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int").alias("bucket")


def store(docs: DataFrame, scope: str, doc_id: str, text: str, path: str) -> Index:
    """Write the index of ``docs`` under ``path``; it can be opened once all of it is there."""
    spark = docs.sparkSession
    sized = stage(docs.select(scope, doc_id, content_words(text).alias("ws")).withColumn("len", F.size("ws")), "sized")
    buckets = min(MOST_BUCKETS, 4 + sized.count() // PER_BUCKET)
    tokens = sized.select(scope, doc_id, "len", F.explode("ws").alias("w")).select(scope, doc_id, "len", stem("w").alias("term")).filter(F.col("term") != "")
    counted = tokens.groupBy(scope, "term", doc_id, "len").agg(F.count("*").alias("tf")).withColumn("bucket", _bucket("term", buckets))
    # a bucket is written by a few tasks, however often one of its terms comes
    counted.repartition("bucket", F.pmod(F.xxhash64(doc_id), F.lit(4))).sortWithinPartitions("bucket", scope, "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    held.groupBy(scope, "term").agg(F.count("*").alias("df")).withColumn("bucket", _bucket("term", buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    sized.groupBy(scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/stats")
    meta = json.dumps({"format": FORMAT, "scope": scope, "doc_id": doc_id, "buckets": buckets})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return Index(spark, path)


def _asked(questions: DataFrame, scope: str, question_id: str, question: str) -> DataFrame:
    words = questions.select(scope, question_id, F.explode(content_words(question)).alias("w")).select(scope, question_id, stem("w").alias("term"))
    return words.groupBy(scope, question_id, "term").agg(F.count("*").alias("times"))


def _ranked(counted: DataFrame, asked: DataFrame, df: DataFrame, stats: DataFrame, scope: str, doc_id: str, question_id: str, k: int) -> DataFrame:
    # what depends on the term alone is joined to the few query terms first
    weighed = asked.join(df, [scope, "term"]).join(stats, scope).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))))
    scores = counted.join(weighed, [scope, "term"]).groupBy(question_id, doc_id).agg(F.round(F.sum(part), 9).alias("raw"))
    ranked = scores.withColumn("rank", F.row_number().over(Window.partitionBy(question_id).orderBy(F.desc("raw"), doc_id))).filter(F.col("rank") <= k)
    best = F.max("raw").over(Window.partitionBy(question_id))
    return ranked.select(question_id, doc_id, F.round(F.col("raw") / best, 6).alias("score"), "rank")


def search_index(index: Index, questions: DataFrame, question_id: str, question: str, k: int = 24) -> DataFrame:
    """``search`` over a stored index: only the folders of the questions' terms are read."""
    asked = stage(_asked(questions, index.scope, question_id, question), "asked")
    wanted = [r[0] for r in asked.select(_bucket("term", index.buckets)).distinct().collect()]  # at most the number of buckets
    mine = lambda df: df.filter(F.col("bucket").isin(wanted)).drop("bucket")
    return _ranked(mine(index.postings), asked, mine(index.terms), index.stats, index.scope, index.doc_id, question_id, k)


def search(docs: DataFrame, questions: DataFrame, scope: str, doc_id: str, text: str, question_id: str, question: str, k: int = 24) -> DataFrame:
    """The ``k`` best documents of each question's scope: question_id, doc_id, score, rank.

    Scores are divided by the question's best, ties go to the smaller doc_id. A query term that
    comes twice counts twice. ``questions`` is the smaller side: its terms are joined to the
    tokens before these are counted, so only tokens that some question asks for are shuffled.
    """
    asked = _asked(questions, scope, question_id, question)
    wanted = asked.select(scope, "term").distinct()
    sized = docs.select(scope, doc_id, content_words(text).alias("ws")).withColumn("len", F.size("ws"))
    stats = sized.groupBy(scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    tokens = sized.select(scope, doc_id, "len", F.explode("ws").alias("w")).select(scope, doc_id, "len", stem("w").alias("term"))
    # written once: both the document frequencies and the scores come from it
    counted = stage(tokens.join(wanted, [scope, "term"], "left_semi").groupBy(scope, "term", doc_id, "len").agg(F.count("*").alias("tf")), "postings")
    df = counted.groupBy(scope, "term").agg(F.count("*").alias("df"))
    return _ranked(counted, asked, df, stats, scope, doc_id, question_id, k)
