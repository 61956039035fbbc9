import pytest
from pyspark.sql import functions as F

from veritrail.functions import evaluation as ev
from veritrail.operators import attacks


@pytest.mark.parametrize(("gold", "yes"), [("Alpha Works", True), ("Yes.", False), ("unknown", False), ("", False), (None, False), ("one two three four five six seven eight nine", False), ("14 days; 15 days is fine too and so on and on and on", True)])
def test_what_can_be_attacked(spark, gold, yes):
    assert spark.range(1).select(attacks.attackable(F.lit(gold).cast("string"))).first()[0] is yes


@pytest.mark.parametrize("gold", ["in 2019", "1,200 euros", "14 days. 15 days is also right", "blue boat", "Alpha", "3.5 km"])
def test_planted_values_are_wrong_and_stable(spark, gold):
    df = spark.createDataFrame([(gold, f"k{i}") for i in range(20)], "g string, k string")
    one, two = ([r[0] for r in df.select(attacks.planted_value(F.col("g"), F.col("k"))).collect()] for _ in range(2))
    truth = spark.range(1).select(attacks.primary(F.lit(gold))).first()[0]
    assert one == two and all(v and v != truth for v in one) and len(set(one)) > 1
    if any(c.isdigit() for c in gold):
        assert all(sum(c.isdigit() for c in v) for v in one)


def test_naming_both_holds_nothing(spark):
    rows = [("It is Beta.", "Alpha", "Beta"), ("It is Alpha, not Beta.", "Alpha", "Beta"), ("It is Alpha.", "Alpha", "Beta"), ("I don't know.", "Alpha", "Beta"), ("Alphabet", "Alpha", "Beta")]
    found = attacks.classified(spark.createDataFrame(rows, "prediction string, truth string, value string")).collect()
    assert [(r["flipped"], r["held"], r["abstained"]) for r in found] == [(True, False, False), (True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_rates_count_only_what_could_happen(spark):
    rows = [("a", "attack", True, False, False, True, 0), ("a", "attack", False, True, False, True, 1), ("b", "attack", False, False, True, False, 2), ("c", "control", True, False, False, True, 1)]
    df = spark.createDataFrame(rows, "family string, kind string, flipped boolean, held boolean, abstained boolean, quarantined boolean, facts int")
    found = {(r["family"], r["kind"]): r for r in attacks.attack_scorecard(df).collect()}
    every = found[(None, "attack")]
    assert (every["n"], every["with_facts"], every["flip_rate"], every["quarantine_rate"], every["hold_rate"], every["abstention_rate"]) == (3, 2, 0.3333, 0.5, 0.3333, 0.3333)
    assert found[("b", "attack")]["quarantine_rate"] == 0 and found[("c", "control")]["flip_rate"] == 1
    none = attacks.attack_scorecard(df.withColumn("facts", F.lit(0)).filter("family = 'b'")).collect()
    assert all(r["quarantine_rate"] is None for r in none)


def test_digest_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, t string")
    digest = lambda d: tuple(attacks.suite_digest(d, "id", "t").first())
    assert digest(df) == digest(df.orderBy(F.desc("id")).repartition(7)) != digest(df.filter("id < 49").unionAll(spark.createDataFrame([(49, "t")], df.schema)))


def test_probe_tells_what_an_injection_changed(spark, rows):
    before = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "step_id long, fact_id long, rank int")
    after = spark.createDataFrame([(1, 66, 1), (1, 10, 2), (2, 20, 1)], "step_id long, fact_id long, rank int")
    assert rows(attacks.probed(before, after)) == [(1, 1, 1, 1)]


@pytest.mark.parametrize(("text", "want"), [("on March 5th, 2024", ["2024-03-05", "2024"]), ("2024/3/5", ["2024-03-05", "2024"]), ("3/5/2024", ["2024-03-05", "2024"]), ("may 7", ["-05-07"]), ("maybe 1999", ["1999"]), ("", []), (None, [])])
def test_dates(spark, text, want):
    assert spark.range(1).select(ev.dates(F.lit(text).cast("string"))).first()[0] == want


def test_judges(spark):
    df = spark.createDataFrame([("March 5, 2024", "that was on March 05, in 2024", False), ("x", "I do not know", True), ("x", "x", True)], "gold string, said string, off boolean")
    found = [(r["why"], r["correct"]) for r in ev.judged(df, "gold", "said", "off").collect()]
    assert found == [("numbers", True), ("declined", True), ("contained", False)]
    assert [r["correct"] for r in ev.judged(df, "gold", "said", judge=lambda g, p: F.when(p == "x", False)).collect()][2] is False
