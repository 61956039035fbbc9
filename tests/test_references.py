import random

from veritrail.operators.references import broken_references, orphan_report

REFS = "src_table string, ref_field string, src_id long, ref_id long, ts long, _id string"
PARENTS = "pid long, seen long, _n string"


def brute(refs, parents):
    first = {}
    for p, seen, _ in parents:
        if p is not None:
            at = seen if seen is not None else -(1 << 63)
            first[p] = min(first.get(p, at), at)
    out = set()
    for t, f, s, r, ts, _ in refs:
        if r and r not in first:
            out.add((t, f, s, r, "missing"))
        elif r and ts is not None and first[r] > ts:
            out.add((t, f, s, r, "late"))
    return sorted(out, key=str)


def test_runs_and_single_keys(spark, rows):
    random.seed(4)
    parents = [(i, random.choice([None, random.randrange(100)]), "") for i in range(1, 400) if i % 50] + [(random.getrandbits(62), 5, "") for _ in range(300)]
    parents += parents[:30] + [(None, 3, "")]
    some = [p[0] for p in parents]
    refs = [("t", "f", i, random.choice([None, 0, random.choice(some), random.randrange(1, 450), random.getrandbits(62), 77777]), random.choice([None, random.randrange(100)]), "") for i in range(2000)]
    refs += [("t", "g", i, 99_999_999, 1, "") for i in range(1500)] + refs[:50]
    found = broken_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), "pid", "seen")
    assert rows(found.drop("ts")) == brute(refs, parents)


def test_keys_given_one_after_another(spark, rows, monkeypatch):
    from veritrail.operators import references

    looked, real = [], references.stage

    def counting(df, tag):
        out = real(df, tag)
        if tag == "suspects":
            looked.append(out.count())
        return out

    monkeypatch.setattr(references, "stage", counting)
    parents = [(i, i * 10, "") for i in range(1, 5001)]
    refs = [("t", "f", i, i, i * 10 + 5000, "") for i in range(1, 5001)] + [("t", "g", i, i, i * 10 - 1, "") for i in range(1, 5001, 100)] + [("t", "h", 1, 5001, 1, "")]
    found = broken_references(spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), "pid", "seen")
    assert rows(found.drop("ts")) == brute(refs, parents)
    assert looked[0] < 200  # the late ones, not all


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], PARENTS)
    refs = spark.createDataFrame([("t", "f", 1, 5, 86_400, ""), ("t", "f", 2, None, 1, "")], REFS)
    broken = broken_references(refs, none, "pid", "seen")
    assert rows(broken.drop("ts")) == [("t", "f", 1, 5, "missing")]
    assert rows(orphan_report(broken)) == [("t", "f", "missing", "1970-01", 1)]
    assert rows(broken_references(spark.createDataFrame([], REFS), none, "pid", "seen")) == []
