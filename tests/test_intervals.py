import random

from veritrail.operators.intervals import periods_and_gaps

SCHEMA = "k string, p string, a long, b long, kind string, _s string, _part int"


def brute(data):
    groups = {}
    for k, p, a, b, *_ in data:
        end = b or float("inf")
        if a is not None and end > a:
            groups.setdefault((k, p), []).append((a, end))
    out = []
    for (k, p), spans in groups.items():
        spans.sort()
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        shown = [(a, 0 if b == float("inf") else b) for a, b in merged]
        out += [(k, p, "period", a, b) for a, b in shown]
        out += [(k, p, "gap", x[1], y[0]) for x, y in zip(shown, shown[1:])]
    return sorted(out, key=str)


def test_random_rows_with_a_hot_entity(spark, rows):
    random.seed(3)
    data = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else random.choice(["a", "b", None, "c"])
        a = random.randrange(0, 40_000)
        b = random.choice([a + random.randrange(1, 30), a + random.randrange(1, 30), None if i % 900 == 0 else a - 3, a])
        data.append((k, random.choice(["x", None]), a, b, "junk", "junk", 7))
    data += data[:200]
    assert rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["k", "p"], "a", "b")) == brute(data)


def test_long_span_over_many_partitions(spark, rows):
    data = [("hot", "x", 0, 5000, "", "", 1)] + [("hot", "x", i, i + 1, "", "", 1) for i in range(0, 9000, 3)]
    assert rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["k", "p"], "a", "b")) == brute(data)


def test_touching_void_open_and_null_rows(spark, rows):
    data = [("a", "x", 1, 3, "", "", 1), ("a", "x", 3, 5, "", "", 1), ("a", "x", 9, 9, "", "", 1), ("a", "x", 7, 0, "", "", 1), ("a", "x", None, 4, "", "", 1)]
    assert rows(periods_and_gaps(spark.createDataFrame(data, SCHEMA), ["k", "p"], "a", "b")) == [("a", "x", "gap", 5, 7), ("a", "x", "period", 1, 5), ("a", "x", "period", 7, 0)]


def test_empty_table(spark, rows):
    assert rows(periods_and_gaps(spark.createDataFrame([], SCHEMA), ["k", "p"], "a", "b")) == []
