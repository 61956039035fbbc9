"""The evidence graph as edge tables and bounded expansion over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrail.functions.text import entity_key
from veritrail.operators.shared import stage

#: What a walk for evidence may follow, and one from a fact.
RETRIEVAL_RELS = ("MENTIONS", "DERIVED_FROM", "SUPERSEDES", "CORROBORATES")
ANCHOR_RELS = (*RETRIEVAL_RELS, "IN_SESSION")

_NODE = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *parts)


def fact_node(fact_id: Column | str = "fact_id") -> Column:
    return _NODE("fact", F.col(fact_id).cast("string") if isinstance(fact_id, str) else fact_id.cast("string"))


def entity_node(corpus: Column | str, name: Column | str) -> Column:
    return _NODE("entity", corpus, entity_key(name))


def session_node(corpus: Column | str, sid: Column | str) -> Column:
    return _NODE("session", corpus, sid)


def edges(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """MENTIONS (fact to entity), DERIVED_FROM (fact to turn), IN_SESSION (turn to session)."""
    known = facts.dropDuplicates(["fact_id"]).select("fact_id", "corpus", "sid", "tidx", "mentions")
    said = turns.dropDuplicates(["turn_id"]).select("turn_id", "corpus", "sid", "idx")
    mentions = known.select(fact_node().alias("src"), F.col("corpus"), F.explode("mentions").alias("m")).filter(entity_key("m") != "")
    turn = _NODE("turn", F.col("turn_id").cast("string"))
    derived = known.join(said.withColumnRenamed("idx", "tidx"), ["corpus", "sid", "tidx"])
    return (
        mentions.select(F.lit("MENTIONS").alias("rel"), "src", entity_node("corpus", "m").alias("dst"))
        .unionByName(derived.select(F.lit("DERIVED_FROM").alias("rel"), fact_node().alias("src"), turn.alias("dst")))
        .unionByName(said.select(F.lit("IN_SESSION").alias("rel"), turn.alias("src"), _NODE("session", "corpus", "sid").alias("dst")))
        .distinct()
    )


def claim_links(claims: DataFrame) -> DataFrame:
    """The SUPERSEDES and CORROBORATES edges of ``reconcile.claim_edges`` as edges of the graph."""
    return claims.filter(F.col("rel").isin("SUPERSEDES", "CORROBORATES")).select("rel", fact_node("src").alias("src"), fact_node("dst").alias("dst"))


def vertices(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """node: every fact, entity, turn and session that the tables hold."""
    said = turns.select("turn_id", "corpus", "sid").distinct()
    known = facts.select("fact_id", "corpus", "mentions")
    entities = known.select("corpus", F.explode("mentions").alias("m")).filter(entity_key("m") != "").select(entity_node("corpus", "m").alias("node"))
    return entities.unionByName(known.select(fact_node().alias("node"))).unionByName(said.select(_NODE("turn", F.col("turn_id").cast("string")).alias("node"))).unionByName(said.select(_NODE("session", "corpus", "sid").alias("node"))).distinct()


def guarded(found: DataFrame, known: DataFrame) -> DataFrame:
    """Edges without loops and repeats. An end that ``known`` (node) does not have is an error.

    The check is part of the plan: an action on the result fails, naming the edge, before anything
    is written.
    """
    whole = found.filter(F.col("src") != F.col("dst")).dropDuplicates(["rel", "src", "dst"])
    there = known.select("node").distinct().withColumn("there", F.lit(True))
    both = whole.join(there.toDF("src", "src_there"), "src", "left").join(there.toDF("dst", "dst_there"), "dst", "left")
    bad = F.concat(F.lit("edge to an unknown vertex: "), F.col("rel"), F.lit(" "), F.col("src"), F.lit(" -> "), F.col("dst"))
    checked = F.when(F.col("src_there").isNull() | F.col("dst_there").isNull(), F.raise_error(bad).cast("string")).otherwise(F.col("rel"))
    return both.select(checked.alias("rel"), "src", "dst")


def two_way(found: DataFrame) -> DataFrame:
    """Every edge from either end: node, rel, next. Written bucket by bucket it serves all walks."""
    there = found.select(F.col("src").alias("node"), "rel", F.col("dst").alias("next"))
    return there.unionByName(found.select(F.col("dst").alias("node"), "rel", F.col("src").alias("next")))


def expand(seeds: DataFrame, found: DataFrame, rels: tuple[str, ...], hops: int) -> DataFrame:
    """Nodes within ``hops`` undirected steps of a seed: seed, node, hops (the fewest), path.

    ``seeds``: seed, node (hops 0). ``path`` names the nodes and relations of a shortest way, the
    least of them in text order. Every step joins only the newest frontier and keeps a node's first
    arrival, so ways that are no shortest ones are not enumerated and a hub is entered once a seed.
    """
    both = two_way(found.filter(F.col("rel").isin(*rels)))
    # repeats are dropped after each step, where they are few: a small frontier is then broadcast
    # to the edges, which are scanned but not shuffled
    frontier = seen = stage(seeds.select("seed", "node", F.lit(0).alias("hops"), F.col("node").alias("path")).distinct(), "frontier")
    for n in range(1, hops + 1):
        step = frontier.join(both, "node").select("seed", F.col("next").alias("node"), F.concat_ws(" ", "path", "rel", "next").alias("path"))
        fresh = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path"))
        # each frontier is written once, or every step would run all steps before it again
        frontier = stage(fresh.select("seed", "node", F.lit(n).alias("hops"), "path"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def between(seeds: DataFrame, targets: DataFrame, found: DataFrame, rels: tuple[str, ...], hops: int, count: int) -> DataFrame:
    """Whole ways from a seed's node to its target: seed, node, hops, path, n, the ``count`` first of each
    pair by (hops, path). No node comes twice on a way.

    ``seeds`` and ``targets``: seed, node. Only steps that still can reach the target are made: both
    ends are walked first, and a node is entered at step n only if the target is at most
    ``hops`` - n steps from it.
    """
    near = stage(expand(targets, found, rels, hops - 1).select("seed", F.col("node").alias("next"), F.col("hops").alias("left")), "near")
    both = two_way(found.filter(F.col("rel").isin(*rels)))
    goal = targets.select("seed", F.col("node").alias("goal"))
    way = stage(seeds.join(goal, "seed").select("seed", "goal", "node", F.array("node").alias("nodes"), F.col("node").alias("path")).distinct(), "way")
    out = None
    for n in range(1, hops + 1):
        step = way.filter(F.col("node") != F.col("goal")).join(both, "node").join(near, ["seed", "next"]).filter((F.col("left") <= hops - n) & ~F.array_contains("nodes", F.col("next")))
        way = stage(step.select("seed", "goal", F.col("next").alias("node"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat_ws(" ", "path", "rel", "next").alias("path")), "way")
        done = way.filter(F.col("node") == F.col("goal")).select("seed", "node", F.lit(n).alias("hops"), "path")
        out = done if out is None else out.unionByName(done)
    place = F.row_number().over(Window.partitionBy("seed", "node").orderBy("hops", "path"))
    return out.distinct().withColumn("n", place).filter(F.col("n") <= count)


def surroundings(seeds: DataFrame, found: DataFrame, hops: int = 2) -> DataFrame:
    """Every edge on a way of at most ``hops`` steps from a seed: seed, rel, src, dst.

    An edge is on one if an end lies at most ``hops`` - 1 steps away.
    """
    walked = found.filter(F.col("rel").isin(*RETRIEVAL_RELS)).select("rel", "src", "dst").distinct()
    inner = stage(expand(seeds, found, RETRIEVAL_RELS, hops - 1).select("seed", "node"), "inner")
    out = inner.join(walked, inner["node"] == walked["src"]).select("seed", "rel", "src", "dst")
    return out.unionByName(inner.join(walked, inner["node"] == walked["dst"]).select("seed", "rel", "src", "dst")).distinct()
