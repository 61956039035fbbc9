"""Reconciliation of claims over time: supersession, contradiction, corroboration.

Equal triples are one claim. The claims of a slot (subject and predicate) are walked in order of
their start; those that stand are its open heads. A claim whose object has the words of a head's
object, or only some of them, restates that head: from another session it corroborates it, and if
it is not held back it becomes a head too. On a single-valued slot any other claim supersedes the
open heads, unless it is held back or one of them outranks it: then it contradicts them all.

The walk is not walked row by row. Ranks are four, so the first time each of them appears in a
slot is an aggregate, and it tells whether an earlier claim outranks a claim. Hence claims are of
three kinds: one that nothing outranks and that restates no earlier claim closes all heads and
stands alone (a reset); one that is held back or outranked and restates nothing changes nothing;
only the few that restate an earlier claim depend on which heads are open. Between two resets
without such a claim the reset before is the only head. Stretches that hold one are streamed in
order with the open heads as state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veritrail.functions.text import entity_key, predicate_key
from veritrail.operators.scans import lasts_before
from veritrail.operators.screening import admission
from veritrail.operators.shared import HOT_ROWS, lookup, stage

SLOT = ["corpus", "slot_subj", "slot_pred"]
ORDER = ["vfrom", "sidx", "tidx", "fact_id"]
#: Fixed value: what support from another session adds to a claim's confidence.
BONUS = 0.05


def merged_claims(records: DataFrame) -> DataFrame:
    """One row per (corpus, subject, predicate, object) after normalisation.

    ``records``: rec_id, corpus, subject, predicate, object, sid, valid_from, conf, entities.
    Earliest start, greatest confidence plus 0.05 for every further session (at most 1), union of
    entities, number of records and sessions. Repeated rows count once.
    """
    rows = records.dropDuplicates(["rec_id"]).select(F.coalesce("corpus", F.lit("")).alias("corpus"), entity_key(F.coalesce("subject", F.lit(""))).alias("subj"), predicate_key(F.coalesce("predicate", F.lit(""))).alias("pred"), entity_key(F.coalesce("object", F.lit(""))).alias("obj"), "sid", "valid_from", "conf", "entities")
    key = ["corpus", "subj", "pred", "obj"]
    per_session = rows.groupBy(*key, "sid").agg(F.count("*").alias("n"), F.min("valid_from").alias("vfrom"), F.max("conf").alias("conf"))
    merged = per_session.groupBy(*key).agg(F.sum("n").alias("records"), F.count("sid").alias("sessions"), F.min("vfrom").alias("vfrom"), F.max("conf").alias("conf"))
    # distinct before counting, so that no group is gathered as an array
    named = rows.select(*key, F.explode("entities").alias("e")).filter(F.col("e").isNotNull()).distinct().groupBy(*key).agg(F.count("*").cast("int").alias("n_entities"))
    bonus = BONUS * F.greatest(F.col("sessions") - 1, F.lit(0))
    return merged.join(named, key, "left").select(*key, "records", "sessions", "vfrom", F.round(F.least(F.lit(1.0), F.col("conf") + bonus), 6).alias("conf"), F.coalesce("n_entities", F.lit(0)).alias("n_entities"))


def distinct_claims(facts: DataFrame, predicates: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One claim per triple: slot, object, fact_id, order, sid, trank, conf, held_back, sessions, single.

    ``facts``: fact_id, corpus, subj, pred, obj, trank, status, vfrom, sid, sidx, tidx, conf.
    The earliest assertion stands for all (ties go to the smaller fact_id), with the greatest rank
    of them. A quarantined one is held back unless a clean repeat of higher rank clears it. Every
    further session adds to the confidence. Retracted facts and those without a start take no
    part. With ``existing`` only the slots that ``facts`` touch are claimed, from both.
    """
    keyed = lambda df: df.filter((F.coalesce("status", F.lit("")) != "retracted") & F.col("vfrom").isNotNull()).select(
        "fact_id", F.coalesce("corpus", F.lit("")).alias("corpus"), entity_key(F.coalesce("subj", F.lit(""))).alias("slot_subj"), predicate_key(F.coalesce("pred", F.lit(""))).alias("slot_pred"), entity_key(F.coalesce("obj", F.lit(""))).alias("object"),
        F.coalesce("trank", F.lit(0)).alias("trank"), F.coalesce(F.col("status") == "quarantined", F.lit(False)).alias("held_back"), "vfrom", F.coalesce("sid", F.lit("")).alias("sid"), F.coalesce("sidx", F.lit(0)).alias("sidx"), F.coalesce("tidx", F.lit(0)).alias("tidx"), F.coalesce(F.col("conf").cast("double"), F.lit(0.0)).alias("conf"),
    )
    rows = keyed(facts)
    if existing is not None:
        rows = rows.unionByName(keyed(existing).join(rows.select(*SLOT).distinct(), SLOT, "left_semi"))
    first = F.min(F.struct(*ORDER, "held_back", "sid", F.col("trank").alias("own"), "conf")).alias("x")
    clean = F.max(F.when(~F.col("held_back"), F.col("trank"))).alias("clean")
    # per session first, so that sessions are counted from one row each
    part = rows.groupBy(*SLOT, "object", "sid").agg(first, F.max("trank").alias("trank"), clean)
    whole = part.groupBy(*SLOT, "object").agg(F.min("x").alias("x"), F.max("trank").alias("trank"), F.max("clean").alias("clean"), F.count(F.when(F.col("sid") != "", 1)).alias("sessions"))
    held = F.col("x.held_back") & ~F.coalesce(F.col("clean") > F.col("x.own"), F.lit(False))
    conf = F.round(F.least(F.lit(1.0), F.col("x.conf") + BONUS * F.greatest(F.col("sessions") - 1, F.lit(0))), 6)
    single = predicates.filter(F.col("arity") == "single").select(F.col("pred").alias("slot_pred"), F.lit(True).alias("single")).distinct()
    return whole.select(*SLOT, "object", "trank", *(F.col(f"x.{c}").alias(c) for c in (*ORDER, "sid")), conf.alias("conf"), held.alias("held_back"), "sessions").join(single, "slot_pred", "left").withColumn("single", F.coalesce("single", F.lit(False)))


def restating(claims: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of claims of one slot of which one object has some of the words of the other, no others:
    later, earlier. The earlier one is not held back.

    The shorter object meets the others only at that of its words which is rarest in the slot; a
    word with more than ``hot_rows`` claims is spread over several tasks.
    """
    words = claims.filter(F.col("object") != "").withColumn("words", F.array_distinct(F.split("object", " "))).select(*SLOT, *ORDER, "held_back", "words", F.explode("words").alias("w"))
    places = words.groupBy(*SLOT, "w").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    met = lookup(words, places.withColumn("_rows", F.col("n")), [*SLOT, "w"], "_rows", hot_rows).withColumn("parts", F.ceil(F.col("n") / hot_rows).cast("int"))
    # an object that has a word of its own in the slot can be no part of another
    rarest = met.groupBy("fact_id").agg(F.min(F.struct("n", "w")).alias("r"), F.count("*").alias("shared"))
    short = met.join(rarest, "fact_id").filter((F.col("shared") == F.size("words")) & (F.col("w") == F.col("r.w"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = lambda df, name: df.select(*SLOT, "w", "part", F.struct(*ORDER).alias(f"{name}_at"), F.col("held_back").alias(f"{name}_held"), F.col("words").alias(f"{name}_words"))
    long = side(met.withColumn("part", F.pmod(F.xxhash64("fact_id"), F.col("parts")).cast("int")), "b")
    pairs = side(short, "a").join(long, [*SLOT, "w", "part"]).filter((F.size("a_words") < F.size("b_words")) & (F.size(F.array_except("a_words", "b_words")) == 0))
    after = F.col("a_at") > F.col("b_at")
    earlier_held = F.when(after, F.col("b_held")).otherwise(F.col("a_held"))
    return pairs.filter(~earlier_held).select(F.when(after, F.col("a_at.fact_id")).otherwise(F.col("b_at.fact_id")).alias("later"), F.when(after, F.col("b_at.fact_id")).otherwise(F.col("a_at.fact_id")).alias("earlier")).distinct()


def _walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stretches in order, each from its reset on: the edges of what follows. State: the open heads."""
    place, heads = None, []
    for pdf in batches:
        out = []
        for base, part, kind, fact, words, rank, sid, held in zip(*(pdf[c] for c in ("base", "part", "kind", "fact_id", "object", "trank", "sid", "held_back"))):
            mine = (fact, frozenset(words.split(" ")), rank, sid)
            if (base, part) != place:
                place, heads = (base, part), []
            if kind == "base":
                heads = [mine]
                continue
            told = part == 0 or kind != "restating"  # the same walk is made in every part
            same = [h for h in heads if mine[1] < h[1] or h[1] < mine[1]] if kind == "restating" else []
            if same:
                out += [("CORROBORATES", fact, h[0]) for h in same if told and sid and h[3] and sid != h[3]]
                if not held:
                    heads.append(mine)
                continue
            refused = held or any(h[2] > rank for h in heads)
            out += [("CONTRADICTS" if refused else "SUPERSEDES", fact, h[0]) for h in heads if told]
            if not refused:
                heads = [mine]
        yield pd.DataFrame(out, columns=["rel", "src", "dst"])


def claim_edges(claims: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges between ``distinct_claims`` (staged): rel, src (the later claim), dst (a head it met)."""
    spark = claims.sparkSession
    pairs = stage(restating(claims, hot_rows), "restating")
    again = pairs.select(F.col("later").alias("fact_id"), F.lit(True).alias("again")).distinct()
    single = claims.filter("single")
    when = F.struct(*ORDER)
    seen = single.groupBy(*SLOT).agg(F.count("*").alias("_n"), *(F.min(F.when(~F.col("held_back") & (F.col("trank") >= r), when)).alias(f"_first{r}") for r in (1, 2, 3)))
    known = lookup(single, seen.withColumn("_rows", F.col("_n")), SLOT, "_rows", hot_rows).join(again, "fact_id", "left")
    outranked = F.lit(False)
    for r in (1, 2, 3):
        outranked = outranked | ((F.col("trank") < r) & F.coalesce(F.col(f"_first{r}") < when, F.lit(False)))
    kind = F.when(F.col("again"), "restating").when(F.col("held_back") | outranked, "refused").otherwise("reset")
    kinds = known.select(*SLOT, *ORDER, "_n", kind.alias("kind"), (kind == "reset").alias("is_reset"), (kind != "refused").alias("active"))
    judged = stage(lasts_before(kinds, SLOT, ORDER, {"base": ("is_reset", "fact_id"), "recent": ("active", "fact_id")}, "_n", hot_rows).filter(F.col("base").isNotNull()).select("fact_id", *ORDER[:3], "kind", "base", "recent"), "judged")
    alone = (F.col("kind") != "restating") & (F.col("recent") == F.col("base"))
    plain = judged.filter(alone).select(F.when(F.col("kind") == "reset", "SUPERSEDES").otherwise("CONTRADICTS").alias("rel"), F.col("fact_id").alias("src"), F.col("base").alias("dst"))

    tangled = judged.filter(~alone).select("fact_id", *ORDER[:3], "kind", "base")
    sizes = tangled.groupBy("base").agg(F.count("*").alias("_rows")).withColumn("parts", F.ceil(F.col("_rows") / hot_rows).cast("int"))
    placed = lookup(tangled, sizes, ["base"], "_rows", hot_rows)
    # what moves the heads goes to every part of a stretch, the rest to one of them
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    moving = placed.filter(F.col("kind") == "restating").withColumn("part", all_parts)
    still = placed.filter(F.col("kind") != "restating").withColumn("part", F.pmod(F.xxhash64("fact_id"), F.col("parts")).cast("int"))
    bases = sizes.withColumn("part", all_parts).select("base", "part", F.col("base").alias("fact_id"), F.lit("base").alias("kind"))
    cols = ["base", "part", "fact_id", "kind"]
    held = claims.select(*ORDER, "object", "trank", "sid", "held_back")
    steps = moving.select(*cols).unionByName(still.select(*cols)).unionByName(bases).join(held, "fact_id")
    walked = steps.repartition("base", "part").sortWithinPartitions("base", "part", *ORDER).mapInPandas(_walk, "rel string, src long, dst long")

    several = pairs.join(claims.filter(~F.col("single") & (F.col("sid") != "")).select(F.col("fact_id").alias("later"), F.col("sid").alias("a")), "later").join(claims.filter(F.col("sid") != "").select(F.col("fact_id").alias("earlier"), F.col("sid").alias("b")), "earlier")
    corroborated = several.filter(F.col("a") != F.col("b")).select(F.lit("CORROBORATES").alias("rel"), F.col("later").alias("src"), F.col("earlier").alias("dst"))
    return plain.unionByName(walked).unionByName(corroborated)


def validity(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Accepted claims of single-valued slots with their period: slot, object, fact_id, vfrom, vto (0 if open)."""
    closing = edges.filter(F.col("rel") == "SUPERSEDES").join(claims.select(F.col("fact_id").alias("src"), F.col("vfrom").alias("next_from")), "src").select(F.col("dst").alias("fact_id"), "next_from")
    refused = edges.filter(F.col("rel") == "CONTRADICTS").select(F.col("src").alias("fact_id")).distinct()
    accepted = claims.filter(F.col("single") & ~F.col("held_back")).join(refused, "fact_id", "left_anti")
    vto = F.when(F.col("next_from").isNull(), F.lit(0)).otherwise(F.greatest("next_from", "vfrom"))
    return accepted.join(closing, "fact_id", "left").select(*SLOT, "object", "fact_id", "vfrom", vto.alias("vto"))


def refusals(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Supersessions that were refused: src, dst, rule. Claims that were held back anyway are left out.

    The rule is the first that admission finds, the tier floor where nothing more specific fires.
    """
    told = facts.dropDuplicates(["fact_id"])
    mine = told.filter(F.coalesce("status", F.lit("")) != "quarantined").select(F.col("fact_id").alias("src"), "text", "obj", "trank", "subj", "pred")
    other = told.select(F.col("fact_id").alias("dst"), F.col("trank").alias("target"))
    tried = edges.filter(F.col("rel") == "CONTRADICTS").join(mine, "src").join(other, "dst")
    rule = admission(F.col("text"), F.col("obj"), F.col("trank"), F.col("subj"), F.col("pred"), F.col("target"), F.lit("supersede"))["rule"]
    return tried.select("src", "dst", F.when(rule != "", rule).otherwise("tier-floor").alias("rule"))


def corroboration(edges: DataFrame) -> DataFrame:
    """fact_id and the number of claims it corroborates or is corroborated by."""
    told = edges.filter(F.col("rel") == "CORROBORATES").select("src", "dst").distinct()
    return told.select(F.explode(F.array("src", "dst")).alias("fact_id")).groupBy("fact_id").agg(F.count("*").alias("degree"))


def confidence(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """fact_id and conf of every claim, raised by what corroborates it (at most 1)."""
    raised = claims.select("fact_id", "conf").join(corroboration(edges), "fact_id", "left")
    return raised.select("fact_id", F.round(F.least(F.lit(1.0), F.col("conf") + BONUS * F.coalesce("degree", F.lit(0))), 6).alias("conf"))


def lineage(edges: DataFrame) -> DataFrame:
    """The chain of supersessions that every claim in one stands in: fact_id, older, newer (how many are
    below and above it), oldest, head (its two ends).

    Depths are doubled by joining the step table with itself (a claim d steps down meets those d
    further), so a chain of n claims takes log2(n) rounds; it ends when nothing moves any more. A
    claim that superseded several is followed through the latest of them, by fact_id.
    """
    step = edges.filter(F.col("rel") == "SUPERSEDES").groupBy("src").agg(F.max("dst").alias("dst"))
    up = edges.filter(F.col("rel") == "SUPERSEDES").groupBy(F.col("dst").alias("src")).agg(F.max("src").alias("dst"))

    def depths(links: DataFrame, name: str) -> DataFrame:
        jump = stage(links.select("src", "dst", F.lit(1).cast("long").alias("d")), "jump")
        while True:
            far = jump.select(F.col("src").alias("dst"), F.col("dst").alias("further"), F.col("d").alias("more"))
            longer = stage(jump.join(far, "dst", "left").select("src", F.coalesce("further", "dst").alias("dst"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("further").isNotNull().alias("moved")), "jump")
            if not longer.filter("moved").head(1):
                return jump.select(F.col("src").alias("fact_id"), F.col("d").alias(name), F.col("dst").alias(f"{name}_end"))
            jump = longer.drop("moved")

    return depths(step, "older").join(depths(up, "newer"), "fact_id", "full").select("fact_id", F.coalesce("older", F.lit(0)).alias("older"), F.coalesce("newer", F.lit(0)).alias("newer"), F.coalesce("older_end", "fact_id").alias("oldest"), F.coalesce("newer_end", "fact_id").alias("head"))
