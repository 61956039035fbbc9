import random

import pytest

from veritrail.llm.truncation import cut_texts, ending, length_hazards, significant_lengths, truncation_report

WHOLE = [
    "All is well.", "ok", "Notes on the budget", "Re: winter exhibit", "It ended.\n\nBest regards\nNora Salgado", "It ended.\n\n-- \nNora\nAlpha Works", "It ended.\n\nSent from my Phone 12", "It ended.\n\nSee also https://pages.example/a",
    "List\n- one\n- two\n* three", "It ended. Who knows…", "It ended. To be continued...", "It ended.\n\n```\nselect 1\n```", "<p>It ended.</p>", "assistant: It ended.\nuser: great, bye", "“Keep it,” he said.", "It ended.\n\n[end of file]",
    "a | b | c\nd | e | f", "これは終わった。", "It ended.\n\n:)", "Is it so?", "It ended (in May).", "[1] It ended.", '{"a": [1, "b"]}', "[2024-05-01 10:00] started\n[2024-05-01 10:01] It ended.",
]
CUT = [
    "All is well. The next one bro", "All is well. The next one said that ", "It ended. The price is &#82", "It ended. The price is in the acc<br", "It ended. The second dra=", "It ended. Over ther�", "assistant: It ended.\nuser: Her colleague at the off",
    "a | b | c\nd | e", "これは終わった。次の", "It ended.\n\n```\nselect 1", "It ended. “Keep it as it was,” wrote Nora, “and", "It ended.\n\nIn practice, a copied",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole_endings(text):
    assert ending(text, text.count("```"))[0] < 2


@pytest.mark.parametrize("text", CUT)
def test_cut_endings(text):
    assert ending(text, text.count("```"))[0] == 2


SCHEMA = "doc_id long, text string, source string, _level string, unit int"


def sentences(rng, n):
    return " ".join("The " + " ".join(rng.choice(["clock", "ledger", "panel", "harbour"]) for _ in range(rng.randrange(3, 9))) + "." for _ in range(n))


def test_limit_of_a_source_is_found(spark, rows):
    rng = random.Random(1)
    data, want = [], set()
    for i in range(1500):
        text = sentences(rng, rng.randrange(1, 12))
        source = "limited" if i % 3 else None
        if source and len(text) > 200:
            text = text[:197] + "..." if i % 2 else text[:200]
            if not text.rstrip().endswith(".") or text.endswith("..."):
                want.add(i)
        data.append((i, text, source, "junk", 1))
    data += [(5000, "", "limited", "", 1), (5001, None, "limited", "", 1), (5002, '{"a": ["b. c.', "x", "", 1), (5003, '{"a": ["b"]}', "x", "", 1), (5004, "word. " * 30_000 + "And the", "x", "", 1)]
    df = spark.createDataFrame(data, SCHEMA)
    cut = cut_texts(df, "doc_id", "text", "source")
    assert {r["doc_id"] for r in cut.collect()} == want | {5002, 5004}
    report = {r["source"]: r.asDict() for r in truncation_report(df, cut, "source").collect()}
    assert report["limited"]["at_limit"] == len(want) and report[""]["cut"] == 0


def test_every_length_is_a_hypothesis(spark):
    def limits(lengths):
        df = spark.createDataFrame([("s", "chars", *x) for x in lengths], "source string, unit string, length long, n long, texts long")
        return sorted(r["length"] for r in significant_lengths(length_hazards(df)).collect())

    few = [(n, 0, 5) for n in range(100, 140, 2)]
    assert limits([*few, (120, 3, 3)][:10] + few[11:] + [(121, 3, 3)]) == [121]  # three at one length, nothing around
    many = [(n, 0, 5) for n in range(100, 9000, 2)]
    assert limits([*many, (4001, 2, 2)]) == []  # among thousands of lengths two prove nothing
    # what scatters around a limit is none itself
    assert limits([*many, (4001, 900, 900), (4005, 30, 30)]) == [4001]


def test_empty_table(spark, rows):
    assert rows(cut_texts(spark.createDataFrame([], SCHEMA), "doc_id", "text", "source")) == []
