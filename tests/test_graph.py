"""Walks over the evidence graph."""

import itertools

import pytest

from veritrail.operators import graph

EDGES = [("MENTIONS", "fact:4", "entity:x"), ("MENTIONS", "fact:6", "entity:x"), ("MENTIONS", "fact:5", "entity:y"), ("SUPERSEDES", "fact:6", "fact:4"), ("CORROBORATES", "fact:3", "fact:1"), ("DERIVED_FROM", "fact:6", "turn:1"), ("IN_SESSION", "turn:1", "session:s")]
SCHEMA = "rel string, src string, dst string"


def ways(source, goal, rels, hops):
    steps = [(a, r, b) for r, a, b in EDGES if r in rels] + [(b, r, a) for r, a, b in EDGES if r in rels]
    out, front = [], [((source,), source)]
    for n in range(1, hops + 1):
        front = [((*nodes, b), f"{path} {r} {b}") for nodes, path in front for a, r, b in steps if a == nodes[-1] and b not in nodes and nodes[-1] != goal]
        out += [(n, path) for nodes, path in front if nodes[-1] == goal]
    return sorted(out)


def test_only_what_is_linked_both_ways(spark, rows):
    claims = spark.createDataFrame([("SUPERSEDES", 6, 4), ("CONTRADICTS", 6, 5), ("CORROBORATES", 3, 1)], "rel string, src long, dst long")
    assert rows(graph.claim_links(claims)) == [("CORROBORATES", "fact:3", "fact:1"), ("SUPERSEDES", "fact:6", "fact:4")]


def test_walk_keeps_the_first_and_least_way(spark, rows):
    found = spark.createDataFrame(EDGES, SCHEMA)
    seeds = spark.createDataFrame([(1, "fact:1"), (4, "fact:4")], "seed long, node string")
    assert rows(graph.expand(seeds, found, graph.RETRIEVAL_RELS, 2)) == [
        (1, "fact:1", 0, "fact:1"), (1, "fact:3", 1, "fact:1 CORROBORATES fact:3"), (4, "entity:x", 1, "fact:4 MENTIONS entity:x"), (4, "fact:4", 0, "fact:4"), (4, "fact:6", 1, "fact:4 SUPERSEDES fact:6"), (4, "turn:1", 2, "fact:4 SUPERSEDES fact:6 DERIVED_FROM turn:1"),
    ]


def test_whole_ways_between_two_nodes(spark, rows):
    found = spark.createDataFrame(EDGES, SCHEMA)
    for (a, b), hops in itertools.product([("entity:x", "session:s"), ("fact:4", "entity:x"), ("fact:1", "entity:y")], (1, 3, 4)):
        seeds, goals = spark.createDataFrame([(1, a)], "seed long, node string"), spark.createDataFrame([(1, b)], "seed long, node string")
        want = ways(a, b, graph.ANCHOR_RELS, hops)
        got = sorted((r["hops"], r["path"]) for r in graph.between(seeds, goals, found, graph.ANCHOR_RELS, hops, 100).collect())
        assert got == want
        assert [r["hops"] for r in graph.between(seeds, goals, found, graph.ANCHOR_RELS, hops, 1).collect()] == [h for h, _ in want[:1]]


def test_surroundings_hold_both_directions_and_second_steps(spark, rows):
    seeds = spark.createDataFrame([("fact:4", "fact:4")], "seed string, node string")
    assert rows(graph.surroundings(seeds, spark.createDataFrame(EDGES, SCHEMA))) == sorted(("fact:4", *e) for e in EDGES if e[1] in ("fact:4", "fact:6") and e[0] != "IN_SESSION")


def test_unknown_ends_are_refused(spark, rows):
    found = spark.createDataFrame([*EDGES, *EDGES, ("MENTIONS", "fact:4", "fact:4")], SCHEMA)
    nodes = sorted({x for e in EDGES for x in e[1:]})
    known = spark.createDataFrame([(n,) for n in nodes], "node string")
    assert rows(graph.guarded(found, known)) == sorted(EDGES)
    with pytest.raises(Exception, match="unknown vertex"):
        graph.guarded(found, known.filter("node <> 'turn:1'")).collect()
