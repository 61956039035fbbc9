"""Token statistics keep tokens apart, whatever the number of others."""

import xxhash

from veritrail.llm.personal import personal_spans

SCHEMA = "src string, rec_id long, text string"
SURNAMES = ["Tarvelo", "Ramisko", "Peltoma", "Wendrik"]
GIVEN = ["Nikhil", "Anna", "Clara", "Diego", "Hannah"]


def alike(token: str, slots: int = 1 << 17) -> int:
    """The first number that shares a slot with ``token`` in a table of so many."""
    slot = lambda t: xxhash.xxh64_intdigest(t.encode(), seed=42) % slots
    return next(n for n in range(10_000_000, 99_999_999) if slot(str(n)) == slot(token.lower()))


def found(spark, numbers):
    said = [f"Please copy {g} {s} on anything about it." for g in GIVEN for s in SURNAMES] + [f"Please copy {g} on anything about it." for g in GIVEN]
    said += [f"Build {n} is the last of them." for n in numbers for _ in range(40)]
    df = spark.createDataFrame([("s", i, t) for i, t in enumerate(said)], SCHEMA).coalesce(2)
    return {(r["rec_id"], r["start_pos"], r["end_pos"]) for r in personal_spans(df).collect() if r["kind"] == "person"}


def test_other_tokens_do_not_change_a_surname(spark):
    apart = found(spark, [10_000_000 + i for i in range(len(SURNAMES))])
    assert len(apart) == len(GIVEN) * (len(SURNAMES) + 1)
    assert found(spark, [alike(s) for s in SURNAMES]) == apart
