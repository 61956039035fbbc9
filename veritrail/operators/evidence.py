"""Evidence for a question: seeds, expansion, resolution in time, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veritrail.functions.text import content_words, entity_key, predicate_key, stem
from veritrail.operators.graph import ANCHOR_RELS, RETRIEVAL_RELS, entity_node, expand, fact_node
from veritrail.operators.lexical import Index, search, search_index
from veritrail.operators.shared import stage

#: Weights of the blended score.
LEXICAL, ANCHOR, NEIGHBOUR, PROXIMITY, TIER, CORROBORATION, RECENCY = 0.26, 0.10, 0.14, 0.10, 0.22, 0.06, 0.12


def fact_texts(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """What is searched per fact: its text and triple and the text of the turn it came from."""
    said = turns.dropDuplicates(["turn_id"]).groupBy("corpus", "sid", F.col("idx").alias("tidx")).agg(F.max("text").alias("said"))
    return facts.join(said, ["corpus", "sid", "tidx"], "left").select("corpus", "fact_id", F.concat_ws(" ", "text", "subj", "pred", "obj", "said").alias("body"))


def quotable(found: DataFrame, questions: DataFrame, facts: DataFrame, floor: float = 0.45, margin: float = 0.08, coverage: float = 0.5) -> DataFrame:
    """Answers that may be quoted without a model: step_id, fact_id.

    The best evidence of a question must score ``floor``, lead the next by ``margin`` and hold
    ``coverage`` of what was asked beyond the names of the subject.
    """
    top = found.filter(F.col("rank") <= 2).groupBy("step_id").agg(F.min_by("fact_id", "rank").alias("fact_id"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("next"))
    clear = top.filter((F.col("best") >= floor) & (F.col("next").isNull() | (F.col("best") - F.col("next") >= margin)))
    stems = lambda c: F.array_distinct(F.transform(content_words(c), stem))
    asked = questions.select("step_id", F.array_except(stems(F.col("question")), stems(F.coalesce("subj", F.lit("")))).alias("wanted")).filter(F.size("wanted") > 0)
    held = facts.dropDuplicates(["fact_id"]).select("fact_id", stems(F.regexp_replace(F.concat_ws(" ", "text", "subj", "pred", "obj"), "_", " ")).alias("held"))
    joined = clear.join(asked, "step_id").join(held, "fact_id")
    return joined.filter(F.size(F.array_intersect("wanted", "held")) / F.size("wanted") >= coverage).select("step_id", "fact_id")


def evidence(questions: DataFrame, facts: DataFrame, turns: DataFrame, edges: DataFrame, corroboration: DataFrame, single: DataFrame, k: int = 64, floor: float = 0.05, named: DataFrame | None = None, index: Index | None = None, counted: bool = False) -> DataFrame:
    """Ranked evidence per question: step_id, fact_id, rank, score, hops, lexical, chain.

    ``questions``: step_id, corpus, question, subj, as_of_epoch (null: now). ``single``: pred, the
    single-valued slots. Seeds are the entity of ``subj`` and those of ``named`` (seed, node), three
    steps over mentions, turns, supersessions and corroborations, the 24 best facts by BM25, and four steps around the two best of these. A candidate of a
    single-valued slot becomes the fact of its slot that held at the asked time; retracted and
    quarantined facts and those below tool rank are left out. Only facts of the question's corpus
    are candidates. A question without any has no row. ``index``: the stored index of the texts of
    the facts (``fact_texts``); without it they are read. With ``counted`` the result is one row per
    question instead: step_id, considered (candidates), refused (of what they resolve to: quarantined
    or below tool rank), warrantable (what is left to rank). ``chain`` is the way on which a candidate was
    reached first (fewest hops, then text order), with the step to the fact that took its place.
    """
    known = stage(facts.dropDuplicates(["fact_id"]), "evidence-facts")
    asked = questions.select("step_id", "corpus", "question", "subj", "as_of_epoch")
    found = search(fact_texts(known, turns), asked, "corpus", "fact_id", "body", "step_id", "question", 24) if index is None else search_index(index, asked, "step_id", "question", 24)
    hits = stage(found, "hits")
    own = asked.select("step_id", F.col("corpus").alias("own"))
    as_fact = lambda df: df.filter(F.col("node").startswith("fact:")).select(F.col("seed").alias("step_id"), F.substring("node", 6, 40).cast("long").alias("fact_id"), "hops", "path")
    seeds = asked.filter(F.col("subj").isNotNull()).select(F.col("step_id").alias("seed"), entity_node("corpus", "subj").alias("node"))
    if named is not None:
        seeds = seeds.unionByName(named)
    by_entity = as_fact(expand(seeds, edges, RETRIEVAL_RELS, 3)).select("step_id", "fact_id", "hops", "path", F.when(F.col("hops") <= 1, 1.0).otherwise(0.5).alias("anchor"), F.lit(0.0).alias("lexical"), F.lit(0.0).alias("neighbour"))
    by_text = hits.select("step_id", "fact_id", F.lit(1).alias("hops"), F.concat(F.lit("~text "), fact_node()).alias("path"), F.lit(0.0).alias("anchor"), F.col("score").alias("lexical"), F.lit(0.0).alias("neighbour"))
    strong = hits.filter((F.col("rank") <= 2) & (F.col("score") >= 0.35))
    near = as_fact(expand(strong.select(F.col("step_id").alias("seed"), fact_node().alias("node")), edges, ANCHOR_RELS, 4))
    strength = strong.groupBy("step_id").agg(F.max("score").alias("neighbour"))
    before = by_entity.select("step_id", "fact_id").unionByName(by_text.select("step_id", "fact_id")).distinct()
    fresh = near.join(before, ["step_id", "fact_id"], "left_anti").join(strength, "step_id").select("step_id", "fact_id", "hops", "path", "neighbour")
    anchored = near.join(before, ["step_id", "fact_id"], "left_semi").select("step_id", "fact_id", "hops", "path", F.lit(0.0).alias("neighbour"))
    by_anchor = fresh.unionByName(anchored).select("step_id", "fact_id", "hops", "path", F.when(F.col("hops") <= 1, 1.0).otherwise(0.5).alias("anchor"), F.lit(0.0).alias("lexical"), "neighbour")
    found = by_entity.unionByName(by_text).unionByName(by_anchor).groupBy("step_id", "fact_id").agg(F.min(F.struct("hops", "path")).alias("w"), F.max("anchor").alias("anchor"), F.max("lexical").alias("lexical"), F.max("neighbour").alias("neighbour")).select("step_id", "fact_id", "w.hops", "w.path", "anchor", "lexical", "neighbour")

    slot = ["corpus", "slot_subj", "slot_pred"]
    placed = known.select("fact_id", "corpus", entity_key("subj").alias("slot_subj"), predicate_key("pred").alias("slot_pred"), "trank", "status", "vfrom", F.coalesce("vto", F.lit(0)).alias("vto"))
    placed = placed.join(single.select(F.col("pred").alias("slot_pred"), F.lit(True).alias("single")), "slot_pred", "left").withColumn("single", F.coalesce("single", F.lit(False)))
    placed = stage(placed, "slots")
    hydrated = found.join(placed, "fact_id").join(own, "step_id").filter(F.col("corpus") == F.col("own")).drop("own")
    wanted = hydrated.filter("single").select("step_id", *slot).distinct().join(asked.select("step_id", "as_of_epoch"), "step_id")
    members = placed.filter(F.col("single") & F.col("status").isin("active", "superseded")).select(*slot, "fact_id", "vfrom", "vto")
    at = F.col("as_of_epoch")
    held = F.when(at.isNull(), F.lit(True)).otherwise((F.col("vfrom") <= at) & ((F.col("vto") == 0) | (at < F.col("vto"))))
    chosen = wanted.join(members, slot).filter(held).groupBy("step_id", *slot).agg(F.max(F.struct("vfrom", "fact_id")).alias("x")).select("step_id", *slot, F.col("x.fact_id").alias("target"))
    resolved = hydrated.join(chosen, ["step_id", *slot], "left").withColumn("target", F.when(F.col("single"), F.col("target")).otherwise(F.col("fact_id"))).filter(F.col("target").isNotNull())
    resolved = resolved.withColumn("path", F.when(F.col("target") == F.col("fact_id"), F.col("path")).otherwise(F.concat(F.col("path"), F.lit(" SUPERSEDES "), fact_node("target"))))
    folded = resolved.groupBy("step_id", F.col("target").alias("fact_id")).agg(F.min(F.struct("hops", "path")).alias("w"), F.max("anchor").alias("anchor"), F.max("lexical").alias("lexical"), F.max("neighbour").alias("neighbour")).select("step_id", "fact_id", "w.hops", "w.path", "anchor", "lexical", "neighbour")
    if counted:
        known_to = folded.join(placed.select("fact_id", "status", F.col("trank").alias("r")), "fact_id")
        refused = (F.col("status") == "quarantined") | (F.coalesce("r", F.lit(0)) < 1)
        sums = known_to.groupBy("step_id").agg(F.count_if(refused).alias("refused"), F.count_if(~refused & F.col("status").isin("active", "superseded")).alias("warrantable"))
        none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return hydrated.groupBy("step_id").agg(F.count("*").alias("considered")).join(sums, "step_id", "left").select("step_id", "considered", none("refused"), none("warrantable"))
    good = folded.join(placed.filter(F.col("status").isin("active", "superseded") & (F.col("trank") >= 1)).select("fact_id", "trank", "vfrom"), "fact_id").join(corroboration, "fact_id", "left")
    by_step = Window.partitionBy("step_id")
    dated = good.withColumn("dr", F.dense_rank().over(by_step.orderBy("vfrom"))).withColumn("most", F.max("dr").over(by_step))
    recency = (F.col("dr") - 1) / F.greatest(F.lit(1), F.col("most") - 1)
    score = (
        LEXICAL * F.col("lexical") + ANCHOR * F.col("anchor") + NEIGHBOUR * F.col("neighbour") + PROXIMITY / (1 + F.col("hops"))
        + TIER * F.col("trank") / 3 + CORROBORATION * F.least(F.coalesce("degree", F.lit(0)), F.lit(3)) / 3 + RECENCY * recency
    )
    scored = dated.withColumn("score", F.round(score, 6)).filter(F.col("score") >= floor)
    place = F.row_number().over(by_step.orderBy(F.desc("score"), "hops", F.desc("vfrom"), "fact_id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k).select("step_id", "fact_id", "rank", "score", "hops", "lexical", F.col("path").alias("chain"))
