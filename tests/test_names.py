import pytest

from veritrail.functions import evaluation as ev
from veritrail.operators import lexical, names
from veritrail.operators.shared import derived, shared_dir, stage, staging

NAMES = "corpus string, norm string, name string"


def fold(spark, rows, aliases=None):
    df = spark.createDataFrame([("c", n.lower(), n) for n in rows], NAMES)
    said = None if aliases is None else spark.createDataFrame([("c", *a) for a in aliases], "corpus string, alias string, target string")
    return {r["norm"]: r["target"] for r in names.folded_names(df, aliases=said).collect()}


def test_longer_names_fold_onto_the_shorter_one(spark):
    assert fold(spark, ["Nora", "Nora Salgado", "Marloe"]) == {"nora salgado": "nora"}
    assert fold(spark, ["Nora", "Nora Salgado", "Nora Costa"]) == {}  # two compete
    assert fold(spark, ["Nora", "Nora Salgado", "Nora Salgado Costa"]) == {"nora salgado": "nora", "nora salgado costa": "nora"}
    assert fold(spark, ["Gym", "gym north"]) == {}  # no proper name


def test_stated_aliases_chains_and_circles(spark):
    assert fold(spark, ["Nora", "Nora Salgado"], [("NS", "Nora Salgado"), ("Boss", "NS")]) == {"nora salgado": "nora", "ns": "nora", "boss": "nora"}
    assert fold(spark, ["Nora", "Nora Salgado"], [("Nora Salgado", "Iris")]) == {"nora salgado": "iris"}
    assert fold(spark, ["X"], [("a1", "b1"), ("b1", "c1"), ("c1", "a1"), ("d1", "a1"), ("e1", "f1"), ("g", "g")]) == {"e1": "f1"}
    chain = [(f"k{i}", f"k{i + 1}") for i in range(40)]
    assert set(fold(spark, ["X"], chain).values()) == {"k40"}


def test_names_of_rows_keep_their_order(spark, rows):
    df = spark.createDataFrame([(1, "c", ["The Gym", "gym", None, "Ironworks Gym", ""]), (2, "d", ["Ironworks Gym"]), (3, "c", None)], "id long, corpus string, m array<string>")
    aliases = spark.createDataFrame([("c", "ironworks gym", "ironworks")], "corpus string, norm string, target string")
    assert rows(names.resolved_names(df, "id", "m", aliases)) == [(1, ["gym", "ironworks"]), (2, ["ironworks gym"])]


DOCS = [(1, "c", "The red boat sails"), (2, "c", "boats and boats"), (3, "c", ""), (4, "d", "red red"), (5, "c", None)]


def test_a_stored_index_answers_as_the_texts_do(spark, rows, tmp_path):
    docs = spark.createDataFrame(DOCS, "id long, corpus string, body string")
    asked = spark.createDataFrame([(7, "c", "red boats, red"), (8, "d", "nothing"), (9, "d", "red"), (10, "c", None)], "q long, corpus string, ask string")
    index = lexical.store(docs, "corpus", "id", "body", str(tmp_path / "i"))
    want = rows(lexical.search(docs, asked, "corpus", "id", "body", "q", "ask"))
    assert rows(lexical.search_index(index, asked, "q", "ask")) == want and {r[0] for r in want} == {7, 9}
    assert rows(lexical.search_index(lexical.Index(spark, str(tmp_path / "i")), asked, "q", "ask")) == want


def test_an_index_of_another_format_is_refused(spark, tmp_path, monkeypatch):
    lexical.store(spark.createDataFrame(DOCS, "id long, corpus string, body string"), "corpus", "id", "body", str(tmp_path / "i"))
    monkeypatch.setattr(lexical, "FORMAT", 2)
    with pytest.raises(ValueError, match="format 1"):
        lexical.Index(spark, str(tmp_path / "i"))
    with pytest.raises(FileNotFoundError):
        lexical.Index(spark, str(tmp_path / "none"))


def test_derived_tables_follow_their_sources(spark, tmp_path):
    source, made = str(tmp_path / "s"), []
    spark.range(3).write.parquet(source)

    def read():
        df = spark.read.parquet(source)
        return derived("twice", lambda: made.append(1) or df.selectExpr("id * 2 AS v"), df).count()

    assert (read(), read(), len(made)) == (3, 3, 1)
    spark.range(2).write.mode("append").parquet(source)
    assert (read(), len(made)) == (5, 2)


def test_staged_tables_end_with_their_scope(spark):
    from pathlib import Path

    shared_dir(spark)  # the folder itself outlives the scope
    with staging():
        inside = stage(spark.range(4), "scoped")
        path = Path(inside.inputFiles()[0].removeprefix("file:").replace("//", "/")).parent
        assert inside.count() == 4 and path.exists()
    assert not path.exists()


def test_unanswerable_rows_are_never_sampled_away(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i < 6) for i in range(300)], "id long, k string, off boolean")
    found = ev.sampled(df, "id", "k", "off", 40).collect()
    assert len(found) == 40 and sum(r["off"] for r in found) == 6
    many = ev.sampled(spark.createDataFrame([(i, "a", i % 2 == 0) for i in range(300)], "id long, k string, off boolean"), "id", "k", "off", 40).collect()
    assert len(many) == 40 and sum(r["off"] for r in many) == 20
    assert ev.sampled(df, "id", "k", "off", 500).count() == 300
