import json
import random

from veritrail.llm.formatting_copies import copy_counts, formatting_copies

SCHEMA = "raw_id long, corpus string, payload string, copy_id string, _n int"


def plain(v):
    return "".join(c for c in (v or "").casefold() if c.isalnum())


def dress(record, rng):
    def messy(v):
        v = rng.choice([str.upper, str.lower, str.title, str])(v)
        return rng.choice(["", "(", "“", "  "]) + v.replace(" ", rng.choice([" ", "  ", "-", " ", ", "])) + rng.choice(["", ".", "»", " ;"])

    names = list(record)
    rng.shuffle(names)
    if rng.random() < 0.5:
        return json.dumps({n: messy(record[n]) for n in names}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))
    return "\n".join(f"{n}: {messy(record[n])}" for n in names)


def test_dressed_copies(spark, rows):
    rng = random.Random(5)
    records = [{"subject": f"Zoé Name{i}", "predicate": "lives_in", "object": f"Town {i % 7}", "text": f"It is {i} in São {i % 3}"} for i in range(40)]
    records.append({"subject": "Zoe Name1", "predicate": "lives_in", "object": "Town 1", "text": "It is 1 in São 1"})  # accents count
    records.append({"subject": "Town 1", "predicate": "lives_in", "object": "Zoé Name1", "text": "It is 1 in São 1"})  # fields count
    data, want = [], {}
    for i in range(600):
        n = 0 if i % 3 == 0 else rng.randrange(len(records))
        corpus = rng.choice(["a", "b", None])
        data.append((i, corpus, dress(records[n], rng), "junk", 1))
        want.setdefault((corpus, n), []).append(i)
    pairs = sorted(((min(v), i) for v in want.values() for i in v if i != min(v)), key=str)
    df = spark.createDataFrame(data + data[:20], SCHEMA)
    found = formatting_copies(df, "raw_id", "corpus", "payload")
    assert rows(found) == pairs
    assert rows(copy_counts(df, "raw_id", found)) == sorted(((min(v), len(v)) for v in want.values()), key=str)
    # sets above the bound are spread and give the same
    assert rows(formatting_copies(df, "raw_id", "corpus", "payload", hot_rows=7)) == pairs


def test_nothing_is_sorted(spark):
    df = spark.createDataFrame([(i, "a", f"text: {i % 3}") for i in range(30)], "raw_id long, corpus string, payload string")
    plan = formatting_copies(df, "raw_id", "corpus", "payload")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan


def test_colliding_fingerprints_are_told_apart(spark, rows, monkeypatch):
    from veritrail.llm import formatting_copies as module

    monkeypatch.setattr(module.F, "xxhash64", lambda *_: module.F.lit(16).cast("long"))
    df = spark.createDataFrame([(i, "a", f"text: {'x' * (i % 3)}y") for i in range(9)], "raw_id long, corpus string, payload string")
    assert rows(formatting_copies(df, "raw_id", "corpus", "payload")) == sorted(((i % 3, i) for i in range(3, 9)), key=str)


def test_null_empty_and_unreadable(spark, rows):
    data = [(1, "a", None, "", 0), (2, "a", "", "", 0), (3, "a", "  ", "", 0), (4, "a", "{broken", "", 0), (5, "a", "Broken!", "", 0), (6, "a", "{}", "", 0), (None, "a", "x", "", 0), (7, "a", "text: " + "w" * 100_000, "", 0)]
    assert rows(formatting_copies(spark.createDataFrame(data, SCHEMA), "raw_id", "corpus", "payload")) == [(1, 2), (1, 3), (1, 6), (4, 5)]
    assert rows(formatting_copies(spark.createDataFrame([], SCHEMA), "raw_id", "corpus", "payload")) == []
