import random

from veritrail.operators.history import attribute_history, entity_states

SCHEMA = "rec long, e string, attr string, val string, a long, b long, seen long, valid_from string, _v int, _e string"
NAMES = dict(value="val", start="a", end="b", known="seen", tiebreak="rec")


def brute(data):
    best = {}
    for rec, e, attr, val, a, b, seen, *_ in data:
        if a is None:
            continue
        key = (e, attr, a)
        if key not in best or (seen, rec) > best[key][:2]:
            best[key] = (seen, rec, val, b or float("inf"))
    groups = {}
    for (e, attr, a), (_, _, val, b) in best.items():
        groups.setdefault((e, attr), []).append((a, b, val))
    out = []
    for (e, attr), items in groups.items():
        items.sort(key=lambda x: x[0])
        spans = []
        for i, (a, b, val) in enumerate(items):
            end = min(b, items[i + 1][0] if i + 1 < len(items) else float("inf"))
            if end <= a:
                continue
            if spans and spans[-1][1] == a and spans[-1][2] == val:
                spans[-1][1] = end
            else:
                spans.append([a, end, val])
        out += [(e, attr, val, a, 0 if b == float("inf") else b) for a, b, val in spans]
    return sorted(out, key=str)


def make(n, hot):
    random.seed(n)
    data = []
    for i in range(n):
        e = "hot" if hot and i % 3 == 0 else random.choice(["p", "q", None])
        a = None if i % 97 == 0 else random.randrange(0, 2 * n)
        b = random.choice([0, 0, None, (a or 0) + random.randrange(-2, 40)])
        data.append((i, e, random.choice(["x", "y"]) if e != "hot" else "x", random.choice(["u", "v", None]), a, b, random.randrange(5), "junk", 1, "junk"))
    return data + data[: n // 10]


def test_versions_against_brute_force(spark, rows):
    for n, hot in ((60, False), (3000, True)):
        data = make(n, hot)
        assert rows(attribute_history(spark.createDataFrame(data, SCHEMA), ["e", "attr"], **NAMES)) == brute(data)


def test_one_value_repeated_over_all_partitions(spark, rows):
    data = [(i, "hot", "x", "same", i, 0, 1, "", 1, "") for i in range(2000)]
    assert rows(attribute_history(spark.createDataFrame(data, SCHEMA), ["e", "attr"], **NAMES)) == [("hot", "x", "same", 0, 0)]


def test_empty(spark, rows):
    assert rows(attribute_history(spark.createDataFrame([], SCHEMA), ["e", "attr"], **NAMES)) == []


def test_states_split_at_all_boundaries_and_coalesce(spark, rows):
    data = [
        (1, "p", "x", "u", 10, 30, 1, "", 1, ""), (2, "p", "y", "w", 20, 0, 1, "", 1, ""), (3, "p", "x", None, 40, 50, 1, "", 1, ""),
        (4, "p", "z", "ignored", 5, 0, 1, "", 1, ""), (5, "q", "x", "u", 1, 2, 1, "", 1, ""),
    ]
    history = attribute_history(spark.createDataFrame(data, SCHEMA), ["e", "attr"], **NAMES)
    found = {(r["e"], r["valid_from"]): (r["valid_to"], r["state"]) for r in entity_states(history, ["e"], "attr", "val", ["x", "y"]).collect()}
    assert found == {
        ("p", 10): (20, {"x": "u"}), ("p", 20): (30, {"x": "u", "y": "w"}), ("p", 30): (40, {"y": "w"}),
        ("p", 40): (50, {"x": None, "y": "w"}), ("p", 50): (0, {"y": "w"}), ("q", 1): (2, {"x": "u"}),
    }


def test_states_of_an_entity_over_many_partitions(spark):
    data = [(i, "hot", "x" if i else "y", str(i % 7), i, 0, 1, "", 1, "") for i in range(1500)]
    history = attribute_history(spark.createDataFrame(data, SCHEMA), ["e", "attr"], **NAMES)
    found = sorted((r["valid_from"], r["valid_to"], r["state"].get("x"), r["state"].get("y")) for r in entity_states(history, ["e"], "attr", "val", ["x", "y"]).collect())
    assert len(found) == 1500 and all(r[3] == "0" for r in found) and found[-1][1] == 0
    assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
