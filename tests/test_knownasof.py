import random

import pytest

from veritrail.operators.knownasof import PersistentTree, known_at

FACTS = "f long, k string, p string, vf long, vt long, known long, vtk long, _t string"
EVENTS = "s long, k string, p string, t long, _e string"
ARGS = (["k", "p"], "s", "t", "f", "vf", "vt", "known", "vtk")


def brute(events, facts):
    out = []
    for s, k, p, t, _ in events:
        if t is None or k is None or p is None:
            continue
        good = [
            (vf, f) for f, fk, fp, vf, vt, known, vtk, _ in facts
            if (fk, fp) == (k, p) and vf is not None and known is not None and vf <= t and known <= t and not (vt and vt <= t and vtk is not None and vtk <= t)
        ]
        if good:
            out.append((s, max(good)[1]))
    return sorted(out, key=str)


def make(seed, n, hot):
    random.seed(seed)
    pick = lambda i: "hot" if hot and i % 2 == 0 else random.choice(["a", "b", None])
    facts = []
    for i in range(n):
        vf = random.randrange(1000)
        facts.append((i, pick(i), random.choice(["x", None]) if i % 5 == 0 else "x", vf, random.choice([None, 0, vf + random.randrange(-5, 200)]), random.choice([vf, vf + 30, vf - 40, None]), random.choice([None, vf + 100, vf + 300]), "junk"))
    events = [(1000 + i, pick(i), "x", random.choice([None, random.randrange(1300), random.randrange(1300)]), "junk") for i in range(n)]
    return events, facts + facts[: n // 10]


@pytest.mark.parametrize(("hot", "slab"), [(False, 50_000), (True, 25), (True, 1)])
def test_against_brute_force(spark, rows, hot, slab):
    events, facts = make(5, 300, hot)
    found = known_at(spark.createDataFrame(events, EVENTS), spark.createDataFrame(facts, FACTS), *ARGS, slab_rows=slab)
    assert rows(found) == brute(events, facts)


def test_empty_tables(spark, rows):
    events, facts = make(1, 5, False)
    none = spark.createDataFrame([], FACTS)
    assert rows(known_at(spark.createDataFrame(events, EVENTS), none, *ARGS)) == []
    assert rows(known_at(spark.createDataFrame([], EVENTS), spark.createDataFrame(facts, FACTS), *ARGS)) == []


def test_versions_of_the_tree_stay_as_they_were():
    tree, roots, state = PersistentTree(), [0], [{}]
    random.seed(2)
    for i in range(400):
        key, end = (random.randrange(60), random.randrange(6), 0), random.randrange(80)
        roots.append(tree.put(roots[-1], key, end))
        state.append({**state[-1], key: end})
    for root, held in list(zip(roots, state))[::17]:
        for at in range(0, 80, 3):
            want = max((k for k, e in held.items() if k[0] <= at < e), default=None)
            assert tree.search(root, at) == want
