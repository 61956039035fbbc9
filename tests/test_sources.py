import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veritrail.sources import conversations as src
from veritrail.streaming import ingest


def test_corpus_file(spark, tmp_path):
    corpus = {
        "corpus": "c", "principal": "nora", "description": "", "sessions": [
            {"sid": "s1", "date": "2024-01-01T00:00:00Z", "title": "t", "turns": [{"role": "user", "text": "a"}, {"role": "tool", "text": "b", "origin": "https://x"}, {"role": "assistant", "text": "c", "ts": 5}]},
            {"sid": "s2", "date": "2024-01-02T00:00:00Z", "title": None, "turns": []},
        ],
    }
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    got = [(r["sid"], r["idx"], r["ts"], r["tier"]) for r in src.read_corpus(spark, str(tmp_path / "c.json")).orderBy("idx").collect()]
    assert got == [("s1", 0, 1704067200, "owner"), ("s1", 1, 1704067260, "external"), ("s1", 2, 5, "assistant")]


def haystack(**changes):
    base = {"question_id": "q1_abs", "question_type": "x", "question": "?", "answer": "a", "question_date": "2023/05/30 (Tue) 23:40", "answer_session_ids": ["b"], "haystack_dates": ["2023/05/30 (Tue) 23:40", "2023/05/29 (Mon) 01:00"], "haystack_session_ids": ["a", "b"], "haystack_sessions": [[{"role": "user", "content": "x"}], []]}
    return [base | changes]


def test_haystack_file(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps(haystack()))
    got = [(r["sid"], r["gold"], r["is_abstention"]) for r in src.read_haystacks(spark, str(tmp_path / "h.json")).orderBy("place").collect()]
    assert got == [("b", True, True), ("a", False, True)]
    (tmp_path / "bad.json").write_text(json.dumps(haystack(haystack_session_ids=["a"])))
    with pytest.raises(Exception, match="differ in length"):
        src.read_haystacks(spark, str(tmp_path / "bad.json")).collect()


def test_literals_and_replies(spark, tmp_path):
    df = spark.createDataFrame([("{'k': [{'question': 'q', 'answer': 'a', 'difficulty': 'x'}]}",), ("oops(",), (None,)], "probing_questions string")
    df.write.parquet(str(tmp_path / "p"))
    assert [tuple(r) for r in src.read_probes(spark, str(tmp_path / "p")).collect()] == [("k", "q", "a")]
    replies = spark.createDataFrame([('Sure! ```json\n{"a": {"b": "}"}}\n```',), ("none",), (None,), ('{bad {"x": 1}',)], "r string")
    assert [r[0] for r in replies.select(src.salvaged_json(F.col("r"))).collect()] == ['{"a": {"b": "}"}}', None, None, '{"x": 1}']


def test_records_resume(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([("q1", "s", 1), ("q2", "s", 2)], "qid string, system string, v int")
    src.append_records(df.limit(1), path, ["qid", "system"])
    src.append_records(df, path, ["qid", "system"])
    assert spark.read.json(path).count() == 2
    assert src.markdown_table(df.orderBy("qid")).splitlines()[2] == "| q1 | s | 1 |"
    assert src.markdown_table(df, 1).endswith("Only the first 1 of 2 rows are shown.")


def test_one_bad_turn_costs_only_itself(spark):
    def extract(pdf):
        if (pdf["v"] == 3).any():
            raise ValueError
        return pd.DataFrame({"w": pdf["v"] * 2})

    df = spark.range(6).select(F.col("id").alias("v")).coalesce(1)
    found = src.extracted(df, lambda pdf: extract(pdf).assign(v=pdf["v"]), "v long, w long").collect()
    assert sorted((r["v"], r["w"], r["failed"]) for r in found) == [(0, 0, False), (1, 2, False), (2, 4, False), (3, None, True), (4, 8, False), (5, 10, False)]


def test_sessions_in_three_dresses(spark, tmp_path):
    lines = [
        {"sid": "a", "ts": 1000, "turns": [{"text": "x"}, {"role": "tool", "text": "y", "tier": "owner"}, {"role": "user", "text": "z", "origin": "https://q", "ts": 5, "idx": 9}]}, {"id": "b", "turns": [{"role": "assistant", "text": "w"}]},
        [{"sid": "c", "role": "user", "text": "v", "ts": 70}, {"role": "user", "text": "u"}], {"sid": "d", "turns": []},
    ]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {(r["sid"], r["text"]): (r["idx"], r["ts"], r["tier"]) for r in src.load(spark, "sessions", str(tmp_path / "s.jsonl")).collect()}
    assert got == {("a", "x"): (0, 1000, "owner"), ("a", "y"): (1, 1060, "tool"), ("a", "z"): (9, 5, "external"), ("b", "w"): (0, 0, "assistant"), ("c", "v"): (0, 70, "owner"), ("c", "u"): (1, 130, "owner")}
    with pytest.raises(ValueError, match="corpus"):
        src.load(spark, "nothing", "x")


def test_trajectories(spark, tmp_path):
    (tmp_path / "q").write_text(json.dumps({"id": "1", "question_type": "x-abs", "question": "?", "answer": "a"}))
    (tmp_path / "t").write_text(json.dumps({"id": "t1", "goal": "g", "outcome": "ok", "states": [{"thought": "h", "accessibility_tree": "tree", "url": "u", "action": "click"}, {"thought": ""}]}))
    (tmp_path / "h").write_text(json.dumps({"1": ["gone", "t1"]}))
    rows = src.load(spark, "trajectories", *(str(tmp_path / n) for n in "qth")).orderBy("idx").collect()
    assert [(r["turn_role"], r["text"]) for r in rows] == [("user", "Task: g"), ("assistant", "h"), ("tool", "[u]\ntree"), ("assistant", "action: click"), ("tool", "outcome: ok")]
    assert {(r["question_id"], r["is_abstention"], r["ts"]) for r in rows} == {("1_abs", True, src.FIRST_SECOND + src.HOUR)}


def test_caches_and_seeds(spark):
    key = lambda m: src.request_key(F.lit("m"), F.lit(m), F.lit(0), F.lit(10))
    df = spark.range(1).select(key("a").alias("a"), key("b").alias("b")).first()
    assert df["a"] != df["b"] and len(df["a"]) == 64
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    own, shipped = spark.createDataFrame([("k1", "own")], "key string, reply string"), spark.createDataFrame([("k1", "old"), ("k2", "shipped")], "key string, reply string")
    assert {tuple(r) for r in src.cached_replies(asked, own, shipped).collect()} == {("k1", "own"), ("k2", "shipped"), ("k3", None)}
    assert src.seeded(own.limit(0), shipped).count() == 2 and src.seeded(own, shipped).count() == 1 and src.seeded(own, shipped, True).count() == 2


def test_rendered_turns(spark):
    rows = [(0, "user", None, 0, "u" * 900, True), (1, "assistant", None, 60, "a" * 900, False), (2, "assistant", "doc://x", 60, "b" * 900, True)]
    shown = [r["shown"] for r in src.rendered_turns(spark.createDataFrame(rows, "idx int, turn_role string, origin string, ts long, text string, claimable boolean")).orderBy("idx").collect()]
    assert shown[0] == "#0 [user] time unknown\n" + "u" * 900
    assert shown[1].startswith("#1 [assistant | context] 1970-01-01 00:01 UTC\n" + "a" * 700 + "\n[") and "a" * 701 not in shown[1]
    assert shown[2].startswith("#2 [assistant | source: doc://x]") and shown[2].endswith("b" * 900)


def commit_all(spark, path, batches, schema, **kw):
    write = ingest.upsert_sink(spark, path, "turn_id", "ts", **kw)
    for n, batch in enumerate(batches):
        write(spark.createDataFrame(batch, schema), n)


def test_the_newest_row_wins_in_any_order_of_arrival(spark, tmp_path):
    schema = "turn_id long, corpus string, ts long"
    batches = [[(1, "old", 10), (1, "new", 20), (2, "a", 5)], [(1, "late", 15), (3, "c", None)], [(2, "b", 6), (None, "x", 1)]]
    want = [(1, "new", 20), (2, "b", 6), (3, "c", None)]
    for k, order in enumerate([(0, 1, 2), (2, 1, 0), (0, 1, 2, 1, 0)]):  # the last replays batches
        path = str(tmp_path / f"t{k}")
        commit_all(spark, path, [batches[i] for i in order], schema, buckets=4)
        assert sorted(map(tuple, ingest.latest(spark, path).collect())) == want


def test_a_new_checkpoint_and_old_files(spark, tmp_path):
    schema, path = "turn_id long, corpus string, ts long", str(tmp_path / "t")
    for n in range(6):  # every sink numbers its batches from 0
        commit_all(spark, path, [[(n, "c", n)]], schema, buckets=2)
    assert sorted(r["turn_id"] for r in ingest.latest(spark, path).collect()) == list(range(6))
    names = [p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("manifest")]
    assert len(names) == ingest.KEPT
    held = {str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").glob("data-*/_b=*")}
    used = {d for n in names for d in json.loads((tmp_path / "t" / n).read_text()).values()}
    assert held == used
    # a commit that never got its manifest is not seen, and its number is used again
    (tmp_path / "t" / "data-7" / "_b=0").mkdir(parents=True)
    commit_all(spark, path, [[(9, "c", 9)]], schema, buckets=2)
    assert sorted(r["turn_id"] for r in ingest.latest(spark, path).collect()) == [*range(6), 9]


def test_late_facts_end_where_they_belong(spark, rows, tmp_path):
    schema = "fact_id long, corpus string, subj string, pred string, obj string, trank int, status string, vfrom long, sid string, sidx int, tidx int, conf double, ing long"
    arity = spark.createDataFrame([("lives_in", "single")], "pred string, arity string")
    fact = lambda i, who, obj, at: (i, "c", who, "lives_in", obj, 3, "active", at, "s", 0, 0, 0.5, i)
    batches = [[fact(1, "nora", "Rome", 10), fact(2, "nora", "Oslo", 30), fact(5, "iris", "Bonn", 1)], [fact(3, "nora", "Bern", 20)], [fact(6, "iris", "Graz", 2)]]
    facts, edges = str(tmp_path / "facts"), str(tmp_path / "edges")
    write = ingest.reconciling_sink(spark, facts, edges, arity, buckets=3)
    for n, batch in enumerate([*batches, batches[0]]):
        write(spark.createDataFrame(batch, schema), n)
    assert rows(ingest.latest(spark, edges).select("rel", "src", "dst")) == [("SUPERSEDES", 2, 3), ("SUPERSEDES", 3, 1), ("SUPERSEDES", 6, 5)]


def test_streamed_upserts_and_bursts(spark, tmp_path):
    feed, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "turn_id long, corpus string, ts long"
    for n, batch in enumerate([[(1, "c", 1_000_000), (2, "c", 1_000_060)], [(2, "c", 1_000_090), (3, "d", 10_000_000)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(feed)
        ingest.start_upserts(spark.readStream.schema(schema).parquet(feed), out, "turn_id", "ts", str(tmp_path / "cp")).awaitTermination()
        assert n == 0 or sorted(tuple(r) for r in ingest.latest(spark, out).collect()) == [(1, "c", 1_000_000), (2, "c", 1_000_090), (3, "d", 10_000_000)]
    bursts = ingest.session_activity(spark.readStream.schema(schema).parquet(feed))
    q = bursts.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert [(r["corpus"], r["turns"]) for r in spark.sql("select * from bursts").collect()] == [("c", 2)]
