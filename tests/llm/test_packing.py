import random
from collections import Counter

import pytest

from veritrail.llm.packing import packed, packing_report, plan, token_counts


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_plan_uses_every_length_and_fits(capacity):
    rng = random.Random(capacity)
    histogram = {s: rng.randrange(1, 40) for s in rng.sample(range(1, capacity + 1), min(capacity, 20))}
    used = Counter()
    for filled, times in plan(histogram, capacity):
        assert 0 < sum(s * n for s, n in filled.items()) <= capacity and times > 0
        for s, n in filled.items():
            used[s] += n * times
    assert used == Counter(histogram)


def test_two_shorter_ones_replace_the_shortest():
    # greedy takes 6 and 3 (room 1); 2 + 2 fill what 3 leaves
    assert [dict(f) for f, _ in plan({6: 1, 3: 1, 2: 2}, 10)][0] == {6: 1, 2: 2}


def test_containers_hold_whole_texts(spark):
    rng = random.Random(3)
    lengths = [rng.choice([0, 5, 5, 5, rng.randrange(1, 70), rng.randrange(100, 700)]) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    out = packed(df, "doc_id", {1: 64, 2: 200}).collect()
    for size_id, capacity in ((1, 64), (2, 200)):
        mine = [r for r in out if r["size_id"] == size_id]
        load = Counter()
        for r in mine:
            if r["bin_id"] >= 0:
                load[r["bin_id"]] += r["n_tokens"]
        assert max(load.values()) <= capacity
        pieces = Counter()
        for r in mine:
            pieces[r["doc_id"]] += r["n_tokens"]
            assert r["n_tokens"] == min(capacity, lengths[r["doc_id"]] - r["first_token"])
        assert pieces == Counter(dict(enumerate(lengths)))
        assert all(len([r for r in mine if r["doc_id"] == d]) == 1 for d, n in enumerate(lengths) if n <= capacity)
        assert len(load) <= -(-sum(lengths) // capacity) * 1.02 + 2
        assert sorted(load) == list(range(len(load)))


def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "hello world"), (4, "<|endoftext|>"), (5, "日本語 " * 3000), (6, "a" * 50_000)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id", "text").collect()}
    assert found[1] == 0 and 2 not in found and found[3] == 2 and found[4] > 1 and found[5] > 3000 and found[6] > 1000


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, n_tokens long")
    out = packed(none, "doc_id", {1: 64})
    assert out.collect() == []
    assert packing_report(out, spark.createDataFrame([(1, 64)], "size_id int, capacity int")).collect() == []
