import random
import re

from veritrail.llm.leaks import ItemIndex, leaked_passages, within_edits

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, words=13):
    runs = {}
    for i, text in items:
        w = WORD.findall((text or "").lower())
        for k in range(len(w) - words + 1):
            runs.setdefault(tuple(w[k : k + words]), set()).add(i)
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for k in range(len(w) - words + 1):
            out |= {(d, i) for i in runs.get(tuple(w[k : k + words]), ())}
    return sorted(out, key=str)


def make(rng, small):
    bank = ["a", "of", "the"] if small else [f"word{i}" for i in range(60)] + ["a", "of", "é", "日本"]
    items = [(i, " ".join(rng.choice(bank) for _ in range(rng.randrange(10, 60)))) for i in range(25)] + [(98, ""), (99, None)]
    docs = []
    for d in range(300):
        parts = [rng.choice(bank) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.6:
            w = (rng.choice(items[:25])[1]).split()
            n = rng.choice([12, 13, 14, 20, 60])
            at = rng.randrange(0, max(1, len(w) - n))
            piece = w[at : at + n]
            if rng.random() < 0.3 and len(piece) > 3:
                piece[len(piece) // 2] = "changed"
            cut = rng.randrange(0, len(parts) + 1)
            parts = parts[:cut] + [rng.choice(["“{}", "{},", "{}!", "{}"]).format(rng.choice([x, x.upper()])) for x in piece] + parts[cut:]
        docs.append((d, rng.choice([" ", "  ", "\n", "-"]).join(parts)))
    return docs + [(1000, None), (1001, "")], items


def test_against_brute_force(spark, rows):
    for seed, small in ((1, False), (2, False), (3, True)):
        docs, items = make(random.Random(seed), small)
        a = spark.createDataFrame([(*d, "junk") for d in docs + docs[:5]], "doc_id long, text string, item_id string")
        b = spark.createDataFrame([(*i, "junk") for i in items], "item_id long, text string, doc_id string")
        assert rows(leaked_passages(a, "doc_id", "text", b, "item_id", "text")) == brute(docs, items)


def test_blocks_of_items(spark, rows, monkeypatch):
    from veritrail.llm import leaks

    monkeypatch.setattr(leaks, "BLOCK_CHARS", 500)
    monkeypatch.setattr(leaks, "PASS_BLOCKS", 2)  # several passes
    docs, items = make(random.Random(4), False)
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(leaked_passages(a, "doc_id", "text", b, "item_id", "text")) == brute(docs, items)


def test_no_items(spark, rows):
    a, b = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert rows(leaked_passages(a, "doc_id", "text", b, "item_id", "text")) == []


def test_band():
    assert within_edits("kitten", "kitten", 0) and within_edits("kitten", "kittin", 1) and within_edits("kitten", "kiten", 1) and not within_edits("kitten", "kxtxen", 1)


def test_bound_stays_positive():
    assert ItemIndex([1], ["a b c d e f g h i j k l m"], 13, 24, 1).least >= 1


def test_equal_items_and_short_words(spark, rows):
    short = "a b c d e f g h i j k l m n o"
    plain = " ".join(f"word{i}" for i in range(20))
    items = [(1, plain), (2, plain.upper() + "!"), (3, short), (4, None)]
    docs = [(1, f"x {plain} y"), (2, f"x {short} y"), (3, short[:20])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(leaked_passages(a, "doc_id", "text", b, "item_id", "text")) == [(1, 1), (1, 2), (2, 3)]


def test_grams_that_many_items_share(spark, rows, monkeypatch):
    from veritrail.llm import leaks

    monkeypatch.setattr(leaks, "HITS", 50)
    common = " ".join(f"common{i}" for i in range(14))
    items = [(i, f"{common} own{i} tail") for i in range(30)]
    docs = [(d, f"intro {d} {common} end") for d in range(20)]
    found = leaks.ItemIndex([i for i, _ in items], [t for _, t in items], 13, 24, 1).leaks([t for _, t in docs])
    assert len(list(found)) == 600
