import itertools
import random

from veritrail.operators import reconcile as rc
from veritrail.operators.scans import last_before

SCHEMA = "fact_id long, corpus string, subj string, pred string, obj string, trank int, status string, vfrom long, sid string, sidx int, tidx int, conf double, text string"
ARITY = [("works_at", "single"), ("lives_in", "single"), ("owns", "multi")]


def fact(i, subj, pred, obj, rank=3, status="active", vfrom=0, sid="s", sidx=0, tidx=0, conf=0.5):
    return (i, "c", subj, pred, obj, rank, status, vfrom, sid, sidx, tidx, conf, f"{subj} {pred} {obj}")


def walk(facts):
    """The ordered walk over every slot, restated one row at a time."""
    triples = {}
    for f in facts:
        if f[6] != "retracted" and f[7] is not None:
            triples.setdefault((f[1], f[2].lower(), f[3], f[4].lower()), []).append(f)
    slots = {}
    for (c, s, p, o), same in triples.items():
        first = min(same, key=lambda f: (f[7], f[9], f[10], f[0]))
        clean = max((f[5] for f in same if f[6] != "quarantined"), default=-1)
        held = first[6] == "quarantined" and not clean > first[5]
        slots.setdefault((c, s, p), []).append((first[7], first[9], first[10], first[0], frozenset(o.split()), max(f[5] for f in same), first[8], held))
    out = set()
    for (_, _, p), members in slots.items():
        heads = []
        for m in sorted(members):
            *_, fid, words, rank, sid, held = m
            same = [h for h in heads if h[4] < words or words < h[4]]
            if same:
                out |= {("CORROBORATES", fid, h[3]) for h in same if h[6] != sid}
            elif p != "owns" and (held or any(h[5] > rank for h in heads)):
                out |= {("CONTRADICTS", fid, h[3]) for h in heads}
                continue
            elif p != "owns":
                out |= {("SUPERSEDES", fid, h[3]) for h in heads}
                heads = []
            if not held:
                heads.append(m)
    return sorted(out)


def edges(spark, facts, **kw):
    claims = rc.stage(rc.distinct_claims(spark.createDataFrame(facts, SCHEMA), spark.createDataFrame(ARITY, "pred string, arity string")), "claims")
    return claims, rc.stage(rc.claim_edges(claims, **kw), "edges")


def test_order_of_arrival_does_not_matter(spark, rows):
    facts = [
        fact(1, "Nora", "works_at", "Alpha", vfrom=10, sid="s1"), fact(2, "Nora", "works_at", "Beta", vfrom=20, sid="s2", sidx=1), fact(3, "Nora", "works_at", "Gamma", vfrom=30, sid="s3", sidx=2), fact(4, "Nora", "owns", "bike", vfrom=10),
        fact(5, "Nora", "owns", "boat", vfrom=20), fact(6, "Nora", "lives_in", "Porto", vfrom=10), fact(7, "Nora", "lives_in", "Lima", rank=0, vfrom=20),
    ]
    want = [("CONTRADICTS", 7, 6), ("SUPERSEDES", 2, 1), ("SUPERSEDES", 3, 2)]
    assert walk(facts) == want
    orders = list(itertools.permutations(facts))
    random.seed(1)
    for order in random.sample(orders, 3):
        claims, found = edges(spark, list(order))
        assert rows(found) == want
    assert {(r["fact_id"], r["vfrom"], r["vto"]) for r in rc.validity(claims, found).collect()} == {(1, 10, 20), (2, 20, 30), (3, 30, 0), (6, 10, 0)}
    assert rows(rc.lineage(found)) == [(1, 0, 2, 1, 3), (2, 1, 1, 1, 3), (3, 2, 0, 1, 3)]
    assert rows(rc.refusals(spark.createDataFrame(facts, SCHEMA), found)) == [(7, 6, "tier-floor")]


def test_a_part_of_the_words_is_the_same_value(spark, rows):
    facts = [fact(1, "nora", "works_at", "Acme", vfrom=10, sid="s0"), fact(2, "nora", "works_at", "Acme Corp", vfrom=20, sid="s1", sidx=1), fact(3, "nora", "works_at", "Globex", vfrom=30, sid="s2", sidx=2), fact(4, "nora", "lives_in", "North Gate", vfrom=1), fact(5, "nora", "lives_in", "South Gate", vfrom=2)]
    claims, found = edges(spark, facts)
    assert rows(found) == [("CORROBORATES", 2, 1), ("SUPERSEDES", 3, 1), ("SUPERSEDES", 3, 2), ("SUPERSEDES", 5, 4)]
    assert rows(rc.corroboration(found)) == [(1, 1), (2, 1)]
    assert {r["fact_id"]: r["conf"] for r in rc.confidence(claims, found).collect()} == {1: 0.55, 2: 0.55, 3: 0.5, 4: 0.5, 5: 0.5}
    # in one session nothing is corroborated
    assert rows(edges(spark, [fact(1, "n", "works_at", "Acme", vfrom=1), fact(2, "n", "works_at", "Acme Corp", vfrom=2)])[1]) == []


def test_equal_triples_are_one_claim(spark, rows):
    facts = [fact(1, "nora", "works_at", "Alpha", rank=1, status="quarantined", vfrom=10, sid="s0"), fact(2, "nora", "works_at", "the ALPHA", rank=3, vfrom=40, sid="s2"), fact(3, "nora", "works_at", "Beta", rank=2, vfrom=50, sid="s3")]
    claims, found = edges(spark, facts)
    one = next(r for r in claims.collect() if r["fact_id"] == 1)
    assert (one["trank"], one["held_back"], one["sessions"], one["conf"], one["vfrom"]) == (3, False, 2, 0.55, 10)
    assert rows(found) == [("CONTRADICTS", 3, 1)]


def test_random_slots_with_a_hot_one(spark, rows):
    random.seed(7)
    facts = []
    for i in range(1500):
        subject = "hot" if i % 3 == 0 else random.choice("abcdef")
        value = " ".join(random.sample(["red", "blue", "old", "new", "far"], random.choice([1, 1, 2, 3]))) if i % 4 == 0 else f"value{random.randrange(300)}"
        facts.append((i, random.choice(["c", "d"]), subject, random.choice(["works_at", "lives_in", "owns"]), value, random.randrange(4), random.choice(["active", "active", "active", "quarantined", "retracted", "superseded"]), random.randrange(900), f"s{i % 40}", i % 9, i % 5, 0.5, ""))
    want = sorted(walk(facts), key=str)
    assert {r[0] for r in want} == {"SUPERSEDES", "CONTRADICTS", "CORROBORATES"}
    assert rows(edges(spark, facts)[1]) == want
    # every bound crossed: slots, words and stretches are spread
    assert rows(edges(spark, facts, hot_rows=5)[1]) == want


def test_against_held_claims(spark, rows):
    arity = spark.createDataFrame(ARITY, "pred string, arity string")
    held = spark.createDataFrame([fact(1, "nora", "lives_in", "Vienna", vfrom=10), fact(2, "iris", "lives_in", "Rome", vfrom=10), fact(3, "iris", "lives_in", "Oslo", vfrom=20)], SCHEMA)
    late = spark.createDataFrame([fact(9, "nora", "lives_in", "Berlin", vfrom=40)], SCHEMA)
    claims = rc.stage(rc.distinct_claims(late, arity, existing=held), "claims")
    assert sorted(r["fact_id"] for r in claims.collect()) == [1, 9]  # untouched slots stay out
    assert rows(rc.claim_edges(claims)) == [("SUPERSEDES", 9, 1)]


def test_nulls_and_empty(spark, rows):
    odd = [(1, None, None, "works_at", None, None, None, 5, None, None, None, None, None), (2, None, None, "works_at", None, None, None, 6, "s", None, None, None, None), (3, "c", "a", "works_at", "x", 3, "active", None, "s", 0, 0, 0.1, "")]
    assert rows(edges(spark, odd)[1]) == []
    claims, found = edges(spark, [])
    assert rows(found) == [] and rows(rc.corroboration(found)) == [] and rows(rc.lineage(found)) == []


def test_last_before_carries_over_partitions(spark):
    data = [("hot", i, i == 5, i) for i in range(2000)] + [("b", 0, False, 1)]
    found = last_before(spark.createDataFrame(data, "k string, o long, f boolean, v long"), ["k"], ["o"], "f", "v", "seen").collect()
    assert all(r["seen"] == (5 if r["k"] == "hot" and r["o"] > 5 else None) for r in found) and len(found) == 2001
