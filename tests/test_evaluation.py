import pytest

from veritrail.functions import evaluation as ev

CASES = [
    ("14 days. 15 days (including the last day) is also acceptable.", "It took 14 days", "contained"), ("7", "seven, or 7.0 in digits", "contained"), ("about 1,200 euros", "She paid 1200", "numbers"),
    ("Business Administration", "Business", "no match"), ("the red car", "Red car!", "contained"), ("Alpha or Beta", "beta", "contained"), ("Alpha", "I don't know", "declined"), ("", "anything", "no match"), (None, "x", "no match"),
    ("a b c d e f g h", "b c d e f g z h", "overlap"),
]


@pytest.mark.parametrize(("gold", "said", "why"), CASES)
def test_judging(spark, gold, said, why):
    df = spark.createDataFrame([(gold, said)], "gold string, said string")
    r = ev.judged(df, "gold", "said").first()
    assert (r["why"], r["correct"]) == (why, why in ("contained", "numbers", "overlap"))


def test_scorecard_of_the_fixture_counts(spark):
    data = [("s", False, False, True)] * 3 + [("s", False, True, False), ("s", False, False, False), ("s", False, False, False), ("s", True, True, False), ("s", True, True, False), ("s", True, False, False), ("s", True, False, True)]
    df = spark.createDataFrame([(*d, 5.0) for d in data] + [("t", False, False, True, 0.0)], "system string, is_abstention boolean, abstained boolean, correct boolean, latency_ms double")
    found = {r["system"]: r.asDict() for r in ev.scorecard(df, "system").collect()}
    s = found["s"]
    assert (s["accuracy"], s["abstention_recall"], s["abstention_precision"], s["hallucination_rate"], s["over_refusal_rate"]) == (0.5, 0.5, 0.6667, 0.25, 0.1667)
    assert found["t"]["abstention_recall"] is None and found["t"]["mean_latency_ms"] is None


def test_quotas_sum_up_and_samples_repeat(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 == 0 else "b" if i % 3 == 1 else f"c{i % 5}") for i in range(1000)], "id long, k string")
    one, two = (sorted(tuple(r) for r in ev.stratified(rows, "id", "k", 100).collect()) for _ in range(2))
    assert one == two and len(one) == 100
    assert abs(sum(k == "a" for _, k in one) - 33) <= 1
