"""Audit: integrity, explanation, write-back of answers, upserts, retraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrail.functions.text import entity_key, stable_id

#: Fixed value: characters of an answer that are kept.
ANSWER_CHARS = 4000
#: Answers that an explanation lists; their number is always told in full.
LISTED = 20


def lost_links(edges: DataFrame, facts: DataFrame, rel: str = "SUPERSEDES") -> DataFrame:
    """Edges of ``rel`` (rel, src, dst) that lead from or to a fact that is not there: rel, src, dst."""
    known = facts.select("fact_id").distinct()
    mine = edges.filter(F.col("rel") == rel).select("rel", "src", "dst").distinct()
    into = mine.join(known.select(F.col("fact_id").alias("dst")), "dst", "left_anti").select("rel", "src", "dst")
    return into.unionByName(mine.join(known.select(F.col("fact_id").alias("src")), "src", "left_anti").select("rel", "src", "dst")).distinct()


def integrity(facts: DataFrame, turns: DataFrame, verdicts: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row: facts, facts without a turn, dangling citations and edges, citations of quarantined facts, ok.

    ``edges``: rel, src, dst of stored supersessions; those that miss an end count as dangling.
    """
    known = facts.dropDuplicates(["fact_id"]).select("fact_id", "corpus", "sid", "tidx", "status")
    placed = turns.select("corpus", "sid", F.col("idx").alias("tidx")).distinct()
    lost = known.join(placed, ["corpus", "sid", "tidx"], "left_anti")
    cited = verdicts.dropDuplicates(["verdict_id"]).select("verdict_id", "answered", F.explode("citations").alias("fact_id")).filter(F.coalesce("fact_id", F.lit(0)) != 0).distinct()
    seen = cited.join(known.select("fact_id", "status"), "fact_id", "left")
    leaked = (F.col("status") == "quarantined") & F.col("answered")
    one = lambda df, **hits: df.agg(*((hits[n] if n in hits else F.lit(0).cast("long")).alias(n) for n in ("facts", "orphans", "dangling", "leaked")))
    parts = one(known, facts=F.count("*")).unionByName(one(lost, orphans=F.count("*"))).unionByName(one(seen, dangling=F.count_if(F.col("status").isNull()), leaked=F.count_if(leaked)))
    if edges is not None:
        parts = parts.unionByName(one(lost_links(edges, facts), dangling=F.count("*")))
    sums = parts.agg(*(F.sum(n).alias(n) for n in parts.columns))
    return sums.withColumn("ok", (F.col("orphans") == 0) & (F.col("dangling") == 0) & (F.col("leaked") == 0))


def explained(facts: DataFrame, turns: DataFrame, sessions: DataFrame, verdicts: DataFrame, edges: DataFrame) -> DataFrame:
    """Per fact what is known of it: fact_id, text, status, qreason, title, turn_role, turn_text, turn_ts, mentions,
    supersedes and superseded_by (ids, ascending), cited_by (the newest answers) and n_cited (all).
    """
    known = facts.dropDuplicates(["fact_id"]).select("fact_id", "corpus", "sid", "tidx", "text", "status", "qreason", F.array_join(F.array_sort(F.array_distinct(F.filter("mentions", lambda m: m.isNotNull()))), "; ").alias("mentions"))
    titles = sessions.select("corpus", "sid", "title")
    said = turns.dropDuplicates(["turn_id"]).groupBy("corpus", "sid", F.col("idx").alias("tidx")).agg(F.min(F.struct("turn_id", "turn_role", F.col("text").alias("turn_text"), F.col("ts").alias("turn_ts"))).alias("t"))
    cites = verdicts.dropDuplicates(["verdict_id"]).select("verdict_id", "ts", F.explode("citations").alias("fact_id")).distinct()
    counted = cites.groupBy("fact_id").agg(F.count("*").alias("n_cited"))
    place = F.row_number().over(Window.partitionBy("fact_id").orderBy(F.desc("ts"), "verdict_id"))
    newest = cites.withColumn("n", place).filter(F.col("n") <= LISTED).groupBy("fact_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "verdict_id"))), lambda x: x["verdict_id"].cast("string")), ";").alias("cited_by"))
    step = edges.filter(F.col("rel") == "SUPERSEDES").select("src", "dst").distinct()
    # a fact is superseded once, and supersedes the heads that stood, which are few
    ids = lambda key, other, name: step.groupBy(F.col(key).alias("fact_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(other)), lambda x: x.cast("string")), ";").alias(name))
    joined = known.join(titles, ["corpus", "sid"], "left").join(said, ["corpus", "sid", "tidx"], "left").join(ids("src", "dst", "supersedes"), "fact_id", "left").join(ids("dst", "src", "superseded_by"), "fact_id", "left").join(newest, "fact_id", "left").join(counted, "fact_id", "left")
    return joined.select("fact_id", "text", "status", "qreason", "title", "t.turn_role", "t.turn_text", "t.turn_ts", "mentions", "supersedes", "superseded_by", "cited_by", F.coalesce("n_cited", F.lit(0)).alias("n_cited"))


def recorded(verdicts: DataFrame, asked: DataFrame, warrants: DataFrame) -> dict[str, DataFrame]:
    """What an answered or declined question leaves behind: tables ``queries``, ``answers`` and ``edges``.

    ``verdicts``: id, answered, answer, citations, abstained_because, model, verified, checks, ts.
    ``asked``: id, corpus, question, as_of, names (ARRAY). Ids are hashes of what they stand for,
    so a replay writes the same rows.
    """
    rows = verdicts.dropDuplicates(["id"]).join(asked.dropDuplicates(["id"]), "id", "left")
    size = warrants.select("id", "fact_id").distinct().groupBy("id").agg(F.count("*").alias("wsize"))
    query, answer = stable_id("query", "corpus", "question", "ts"), stable_id("answer", "id")
    queries = rows.join(size, "id", "left").select(query.alias("query_id"), "corpus", F.col("question").alias("text"), "ts", F.coalesce("as_of", F.lit(0)).alias("asof"), F.coalesce("wsize", F.lit(0)).alias("wsize")).distinct()
    answers = rows.select(answer.alias("answer_id"), "corpus", F.substring(F.coalesce("answer", F.lit("")), 1, ANSWER_CHARS).alias("text"), "ts", F.when(F.col("answered"), "answered").otherwise("abstained").alias("status"), F.col("abstained_because").alias("reason"), "model", F.size(F.coalesce("citations", F.array().cast("array<bigint>"))).alias("ncit"), "verified", F.array_join(F.coalesce("checks", F.array().cast("array<string>")), ",").alias("checks"))
    link = lambda rel, df, src, dst: df.select(F.lit(rel).alias("rel"), src.alias("src"), dst.alias("dst"))
    cites = rows.select("id", F.explode("citations").alias("fact_id")).filter(F.coalesce("fact_id", F.lit(0)) != 0)
    about = rows.select("corpus", "question", "ts", F.explode("names").alias("name")).filter(entity_key("name") != "")
    edges = link("ANSWERS", rows, answer, query).unionByName(link("CITES", cites, answer, F.col("fact_id"))).unionByName(link("ASKED_ABOUT", about, query, stable_id("entity", "corpus", entity_key("name"))))
    return {"queries": queries, "answers": answers, "edges": edges.distinct()}


def retracted(facts: DataFrame, orders: DataFrame) -> DataFrame:
    """``facts`` with those that an owner took back: status, qreason and vto changed, once per fact.

    ``orders``: fact_id, rank, reason, ts. Orders below owner rank are ignored; of several the
    earliest counts (ties: the least reason). A fact that is taken back already stays as it is.
    """
    first = orders.filter(F.col("rank") >= 3).groupBy("fact_id").agg(F.min(F.struct("ts", F.coalesce("reason", F.lit("")).alias("reason"))).alias("o"))
    rows = facts.join(first, "fact_id", "left")
    change = F.col("o").isNotNull() & (F.coalesce("status", F.lit("")) != "retracted")
    new = lambda name, value: F.when(change, value).otherwise(F.col(name)).alias(name)
    values: dict[str, Column] = {"status": F.lit("retracted"), "qreason": F.col("o.reason"), "vto": F.col("o.ts")}
    return rows.select(*(new(c, values[c]) if c in values else F.col(c) for c in facts.columns))


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and those rows of ``old`` whose key it does not have; columns by name."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
