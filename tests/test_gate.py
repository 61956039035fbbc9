import json

from veritrail.operators import audit, gate

REPLIES = "id long, provider string, reply string"


def reply(answer="Nora works at Alpha.", citations=(1,), sufficient=True, **more):
    return json.dumps({"answer": answer, "citations": list(citations), "sufficient": sufficient} | more)


CASES = [
    # reply or provider, what fails, reason, last of the trail
    (reply(), None, "", "citations_supported"), (None, "response_json", "malformed-response", "response_json"), ("[1, 2]", "response_json", "malformed-response", "response_json"), ('{"answer": "x"}', "response_schema", "malformed-response", "response_schema"),
    (reply(sufficient=False), "sufficient", "insufficient-evidence", "sufficient"), (reply(sufficient="true"), "sufficient", "insufficient-evidence", "sufficient"), (reply(citations=["x", None]), "citations_present", "no-citations", "citations_present"),
    (reply(citations=[1, 77]), "citations_in_warrant", "invented-citation", "citations_in_warrant"), (reply(answer="  "), "answer_text", "malformed-response", "answer_text"), (reply(answer="I don't know when."), "answer_not_refusal", "insufficient-evidence", "answer_not_refusal"),
    (reply(answer="Nora works at Alpha; there is no record of the start date."), None, "", "citations_supported"), (reply(citations=[2]), "citations_supported", "unverified-citation", "citations_supported:dropped:2:off; the point"),
    (reply(citations=[2], sufficient=False, kind="Grounded"), "citations_relevant", "unverified-citation", "citations_relevant:dropped:2:off; the point"), (reply(citations=[1], sufficient=False, kind="grounded"), None, "", "grounded_answer"),
    (reply(citations=["1", 1, 2.0, "1 "]), None, "", "citations_supported"),
]


def run(spark, replies, **kw):
    df = spark.createDataFrame(replies, REPLIES)
    warrants = spark.createDataFrame([(r[0], f) for r in replies for f in (1, 2) if r[0] != 900], "id long, fact_id long")
    supports = spark.createDataFrame([(r[0], 1, True, "") for r in replies] + [(r[0], 2, False, "off, the point") for r in replies], "id long, fact_id long, supports boolean, reason string")
    return {r["id"]: r for r in gate.decided(df, warrants, supports, **kw).collect()}


def test_every_check(spark):
    found = run(spark, [(i, None, r) for i, (r, *_) in enumerate(CASES)])
    for i, (_, failed, reason, last) in enumerate(CASES):
        r = found[i]
        assert (r["answered"], r["failed_check"], r["abstained_because"], r["checks"][-1]) == (failed is None, failed, reason, last), (i, r)
    assert found[0]["citations"] == [1] and found[0]["verified"] == 1 and found[0]["kind"] == "recall" and found[13]["kind"] == "grounded"
    assert found[0]["checks"] == [n for n, _ in gate.CHECKS[:10]]
    assert found[14]["citations"] == [1] and found[3]["answer"] is None


def test_no_evidence_and_no_model(spark):
    quotes = spark.createDataFrame([(2, 1, "Nora works at Alpha."), (3, 1, "x")], "id long, fact_id long, text string")
    found = run(spark, [(900, None, reply()), (1, "none", None), (2, "provider_unavailable", None), (3, "provider_timeout", None)], quotable=quotes)
    assert [(found[i]["answered"], found[i]["abstained_because"], found[i]["checks"][-1]) for i in (900, 1, 2, 3)] == [(False, "no-evidence", "warrant_nonempty"), (False, "model-unavailable", "extractive_answer"), (True, "", "extractive_answer"), (False, "model-unavailable", "provider_timeout")]
    assert (found[2]["answer"], found[2]["citations"], found[2]["kind"], found[2]["verified"]) == ("Nora works at Alpha.", [1], "extractive", 0)


def test_without_a_verifier_citations_stand(spark):
    df = spark.createDataFrame([(1, None, reply(citations=[2, 1]))], REPLIES)
    r = gate.decided(df, spark.createDataFrame([(1, 1), (1, 2)], "id long, fact_id long")).first()
    assert (r["answered"], r["citations"], r["verified"], r["checks"][-1]) == (True, [2, 1], 0, "answer_not_refusal")


def test_abstentions_name_what_was_searched(spark):
    verdicts = spark.createDataFrame([(1, False, "sufficient"), (2, False, "provider_timeout"), (3, True, None)], "id long, answered boolean, failed_check string")
    searched = spark.createDataFrame([(1, ["nora", None, "gym"], 2)], "id long, terms array<string>, refused long")
    texts = {r["id"]: r["text"] for r in gate.abstentions(verdicts, searched, spark.createDataFrame([(1, 5)], "id long, fact_id long")).collect()}
    assert set(texts) == {1, 2} and "'nora', 'gym': 1 related fact; none of them says" in texts[1] and "not trusted: 2." in texts[1] and "words of the question: 0 related facts; the answering step failed." in texts[2]


def test_cited_and_considered(spark, rows):
    verdicts = spark.createDataFrame([(1, [5])], "id long, citations array<long>")
    evidence = spark.createDataFrame([(1, 5, 0.9, 1, "p", 60, 0), (1, 6, 0.8, 2, "q", 0, 120)], "id long, fact_id long, score double, hops int, chain string, vfrom long, vto long")
    assert rows(gate.explained_citations(verdicts, evidence)) == [(1, 5, True, 0.9, 1, "p", "1970-01-01 00:01 UTC to open"), (1, 6, False, 0.8, 2, "q", "unknown to 1970-01-01 00:02 UTC")]


def test_carried_needs_the_whole_object(spark):
    facts = spark.createDataFrame([(1, "Alpha Works"), (2, "art"), (3, None)], "fact_id long, obj string")
    cited = spark.createDataFrame([(9, f, "It is the Alpha works, a start.") for f in (1, 2, 3, 4)], "id long, fact_id long, answer string")
    assert {r["fact_id"]: (r["supports"], r["reason"]) for r in gate.carried(cited, facts).collect()} == {1: (True, "states it"), 2: (False, "does not state it"), 3: (False, "does not state it"), 4: (False, "no such fact")}


FACTS = "fact_id long, corpus string, sid string, tidx int, status string, qreason string, vfrom long, vto long"


def test_lost_supersessions_are_told(spark, rows):
    facts = spark.createDataFrame([(1, "c", "s", 0, "active", None, 1, 0), (2, "c", "s", 0, "active", None, 2, 0)], FACTS)
    turns, none = spark.createDataFrame([("c", "s", 0)], "corpus string, sid string, idx int"), spark.createDataFrame([], "verdict_id long, answered boolean, citations array<long>")
    edges = spark.createDataFrame([("SUPERSEDES", 2, 1), ("SUPERSEDES", 2, 99), ("SUPERSEDES", 98, 1), ("CONTRADICTS", 2, 97)], "rel string, src long, dst long")
    assert rows(audit.lost_links(edges, facts)) == [("SUPERSEDES", 2, 99), ("SUPERSEDES", 98, 1)]
    assert audit.integrity(facts, turns, none).first().asDict() == {"facts": 2, "orphans": 0, "dangling": 0, "leaked": 0, "ok": True}
    assert audit.integrity(facts, turns, none, edges).first()["dangling"] == 2 and not audit.integrity(facts, turns, none, edges).first()["ok"]


def test_only_an_owner_takes_back(spark, rows):
    facts = spark.createDataFrame([(i, "c", "s", 0, "retracted" if i == 4 else "active", None, 1, 0) for i in (1, 2, 3, 4)], FACTS).select("fact_id", "status", "qreason", "vto")
    orders = spark.createDataFrame([(1, 3, "late", 9), (1, 3, "b", 7), (1, 3, "a", 7), (2, 2, "no", 1), (4, 3, "again", 8)], "fact_id long, rank int, reason string, ts long")
    assert rows(audit.retracted(facts, orders)) == [(1, "retracted", "a", 7), (2, "active", None, 0), (3, "active", None, 0), (4, "retracted", None, 0)]


def test_a_replayed_write_back_is_the_same(spark, rows):
    verdicts = spark.createDataFrame([(1, True, "x" * 5000, [5, 0, None], "", "m", 1, ["a", "b"], 7), (2, False, None, None, "no-evidence", "m", 0, None, 8)], "id long, answered boolean, answer string, citations array<long>, abstained_because string, model string, verified int, checks array<string>, ts long")
    asked = spark.createDataFrame([(1, "c", "Who?", None, ["Nora", None, "!!"]), (2, "c", "Where?", 5, None)], "id long, corpus string, question string, as_of long, names array<string>")
    one, two = (audit.recorded(v, asked, spark.createDataFrame([(1, 5), (1, 6)], "id long, fact_id long")) for v in (verdicts, verdicts.unionAll(verdicts)))
    assert {n: rows(d) for n, d in one.items()} == {n: rows(d) for n, d in two.items()}
    assert sorted(r["rel"] for r in one["edges"].collect()) == ["ANSWERS", "ANSWERS", "ASKED_ABOUT", "CITES"]
    assert {(r["status"], len(r["text"]), r["ncit"], r["checks"]) for r in one["answers"].collect()} == {("answered", 4000, 3, "a,b"), ("abstained", 0, 0, "")}
    assert {(r["asof"], r["wsize"]) for r in one["queries"].collect()} == {(0, 2), (5, 0)}
