"""Queries of the evidence engine over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veritrail.functions import evaluation as ev
from veritrail.functions import text as tx
from veritrail.operators import attacks, audit, claims, conversation, evidence, gate, graph, lexical, names, reconcile, screening
from veritrail.operators.shared import derived, derived_path, stage
from veritrail.sources.tables import table, texts

AS_OF = 1_735_689_600  # 2025-01-01 UTC


def _facts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "facts").dropDuplicates(["fact_id"])


def _turns(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "turns").dropDuplicates(["turn_id"])


def _verdicts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "verdicts").dropDuplicates(["verdict_id"])


def _questions(spark: SparkSession, root: str) -> DataFrame:
    """The query set of searches: every step whose id is divisible by 100."""
    return table(spark, root, "walkthrough").filter(F.col("step_id") % 100 == 0)


def _claims(spark: SparkSession, root: str) -> DataFrame:
    return stage(reconcile.distinct_claims(_facts(spark, root), table(spark, root, "predicates")), "claims")


def postings_build(spark, root):
    return lexical.postings(texts(spark, root, "documents", "doc_id", "corpus", "text"), "corpus", "doc_id", "text")


def tokenize_stem(spark, root):
    return lexical.term_statistics(postings_build(spark, root), "corpus")


def _index(spark, root):
    """The stored index of all facts' texts; it is written again when facts or turns have changed."""
    facts, turns = table(spark, root, "facts"), table(spark, root, "turns")
    path, _ = derived_path("postings", facts, turns)
    try:
        return lexical.Index(spark, path)
    except FileNotFoundError:
        return lexical.store(evidence.fact_texts(_facts(spark, root), _turns(spark, root)), "corpus", "fact_id", "body", path)


def bm25_topk(spark, root):
    return lexical.search_index(_index(spark, root), _questions(spark, root), "step_id", "question")


def bm25_unindexed(spark, root):
    """The same without an index: the texts are read, but only tokens that a question asks for are counted."""
    body = evidence.fact_texts(_facts(spark, root), _turns(spark, root))
    return lexical.search(body, _questions(spark, root), "corpus", "fact_id", "body", "step_id", "question")


def turns_tiered(spark, root):
    return conversation.tiered_turns(table(spark, root, "turns", "turn_id", "corpus", "sid", "idx", "turn_role", "trank", "origin"))


def turn_windows(spark, root):
    return conversation.windows(table(spark, root, "turns", "turn_id", "corpus", "sid", "idx"))


def rag_chunks(spark, root):
    return conversation.windows(table(spark, root, "turns", "turn_id", "corpus", "sid", "idx"), 4, 1)


def token_budget(spark, root):
    return conversation.within_budget(table(spark, root, "turns", "turn_id", "corpus", "sid", "idx", "text"), 40)


def session_turn_counts(spark, root):
    return _turns(spark, root).groupBy("corpus", "sid").agg(F.count("*").alias("turns"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def timeline_counts(spark, root):
    counted = _facts(spark, root).groupBy("corpus", "sid").agg(F.count("*").alias("facts"))
    return table(spark, root, "sessions", "corpus", "sid", "sidx", "title").join(counted, ["corpus", "sid"], "left").select("corpus", "sid", "sidx", "title", F.coalesce("facts", F.lit(0)).alias("facts"))


def source_stats(spark, root):
    return conversation.origins(table(spark, root, "turns", "turn_id", "corpus", "origin", "trank"))


def entity_normalize(spark, root):
    return names.entity_names(table(spark, root, "facts", "corpus", "subj", "mentions"))


def canonical_keys(spark, root):
    return _facts(spark, root).select("fact_id", tx.canonical_key("subj", "pred", "obj").alias("ckey"))


def stable_ids(spark, root):
    return table(spark, root, "sessions", "session_id", "corpus", "sid").select("session_id", tx.stable_id("session", "corpus", "sid").alias("vid"))


def fact_dedupe_merge(spark, root):
    return reconcile.merged_claims(table(spark, root, "extracted_facts", "rec_id", "corpus", "subject", "predicate", "object", "sid", "valid_from", "conf", "entities"))


def first_seen(spark, root):
    rows = table(spark, root, "extracted_facts", "rec_id", "corpus", "subject", "predicate", "object", "ingested_at")
    key = tx.canonical_key("subject", "predicate", "object").alias("ckey")
    return rows.select("corpus", key, "ingested_at", "rec_id").groupBy("corpus", "ckey").agg(F.min(F.struct("ingested_at", "rec_id")).alias("x")).select("corpus", "ckey", F.col("x.rec_id").alias("rec_id"))


def claims_merged(spark, root):
    rows = reconcile.distinct_claims(_facts(spark, root), table(spark, root, "predicates"))
    return rows.select(F.col("corpus"), F.col("slot_subj").alias("subj"), F.col("slot_pred").alias("pred"), "object", "fact_id", "trank", "conf", "held_back", "sessions", "single")


def reconcile_edges(spark, root):
    return reconcile.claim_edges(_claims(spark, root))


def _links(spark, root):
    """The edges between claims, kept while facts and predicates stay as they are."""
    return derived("links", lambda: reconcile_edges(spark, root), table(spark, root, "facts"), table(spark, root, "predicates"))


def reconcile_contradict(spark, root):
    return reconcile_edges(spark, root).filter(F.col("rel") == "CONTRADICTS").select(F.col("src").alias("newer"), F.col("dst").alias("standing"))


def reconcile_refusals(spark, root):
    return reconcile.refusals(_facts(spark, root), _links(spark, root))


def claim_confidence(spark, root):
    claims = _claims(spark, root)
    return reconcile.confidence(claims, reconcile.claim_edges(claims))


def _valid(spark, root):
    claims = _claims(spark, root)
    return reconcile.validity(claims, reconcile.claim_edges(claims))


def validity_intervals(spark, root):
    return _valid(spark, root).select("fact_id", "vfrom", "vto")


def current_facts(spark, root):
    return _valid(spark, root).filter(F.col("vto") == 0).select("corpus", F.col("slot_subj").alias("subj"), F.col("slot_pred").alias("pred"), "fact_id")


def lineage_depth(spark, root):
    return reconcile.lineage(_links(spark, root))


def facts_as_of(spark, root):
    held = _facts(spark, root).filter(F.col("status").isin("active", "superseded") & (F.col("vfrom") <= AS_OF) & ((F.coalesce("vto", F.lit(0)) == 0) | (F.col("vto") > AS_OF)))
    return held.groupBy("corpus", "subj", "pred").agg(F.max(F.struct("vfrom", "fact_id")).alias("x")).select("corpus", "subj", "pred", F.col("x.fact_id").alias("fact_id"))


def corroboration_degree(spark, root):
    return reconcile.corroboration(_links(spark, root))


def entity_exact_prefix(spark, root):
    return names.matched_entities(_questions(spark, root), entity_normalize(spark, root))


def alias_fold(spark, root):
    """Folds among all that facts speak of, objects among them, with the company a place gave its name to as a stated alias."""
    said = table(spark, root, "facts", "corpus", "subj", F.concat(F.coalesce("mentions", F.array().cast("array<string>")), F.array("obj")).alias("mentions"))
    known = stage(names.entity_names(said), "names")
    # stated: two words of which the first is an entity by itself stand for that entity
    parts = known.filter(F.size(F.split("norm", " ")) == 2).select("corpus", F.col("norm").alias("alias"), F.split("norm", " ")[0].alias("target"))
    stated = parts.join(known.select("corpus", F.col("norm").alias("target")), ["corpus", "target"], "left_semi").select("corpus", "alias", "target")
    return names.folded_names(known, aliases=stated)


def _told(spark, root):
    """Mentions, source turns and sessions."""
    return graph.edges(table(spark, root, "facts", "fact_id", "corpus", "sid", "tidx", "mentions"), table(spark, root, "turns", "turn_id", "corpus", "sid", "idx"))


def _edges(spark, root):
    build = lambda: _told(spark, root).unionByName(graph.claim_links(_links(spark, root)))
    return derived("edges", build, *(table(spark, root, n) for n in ("facts", "turns", "predicates")))


def graph_edges(spark, root):
    known = graph.vertices(table(spark, root, "facts", "fact_id", "corpus", "mentions"), table(spark, root, "turns", "turn_id", "corpus", "sid"))
    return graph.guarded(_edges(spark, root), known)


def _named(spark, root, questions):
    """The entities that a question names, as seeds."""
    found = names.matched_entities(questions, entity_normalize(spark, root))
    return found.join(questions.select("step_id", "corpus"), "step_id").select(F.col("step_id").alias("seed"), graph.entity_node("corpus", "norm").alias("node"))


def _seeds(spark, root):
    asked = _questions(spark, root)
    own = asked.filter(F.col("subj").isNotNull()).select(F.col("step_id").alias("seed"), graph.entity_node("corpus", "subj").alias("node"))
    return own.unionByName(_named(spark, root, asked)).distinct()


def paths_bounded(spark, root):
    return graph.expand(_seeds(spark, root), _edges(spark, root), graph.RETRIEVAL_RELS, 3)


def anchor_expand(spark, root):
    seeds = table(spark, root, "facts", "fact_id").filter(F.col("fact_id") % 100 == 0).distinct().select(F.col("fact_id").alias("seed"), graph.fact_node().alias("node"))
    return graph.expand(seeds, _edges(spark, root), graph.ANCHOR_RELS, 4)


def paths_between(spark, root):
    """The ways from an asked entity to the sessions in which facts about it were stated."""
    asked = _questions(spark, root)
    stated = _facts(spark, root).select("corpus", "subj", "sid").filter(F.col("sid").isNotNull())
    targets = asked.select(F.col("step_id").alias("seed"), "corpus", "subj").join(stated, ["corpus", "subj"]).select("seed", graph.session_node("corpus", "sid").alias("node")).distinct()
    return graph.between(_seeds(spark, root), targets, _edges(spark, root), graph.ANCHOR_RELS, 4, 50)


def neighbourhood(spark, root):
    """All edges within two steps of a chosen fact or an entity that is asked for."""
    facts = table(spark, root, "facts", "fact_id").filter(F.col("fact_id") % 100 == 0).distinct().select(graph.fact_node().alias("node"))
    seeds = facts.unionByName(_seeds(spark, root).select("node")).distinct().select(F.col("node").alias("seed"), "node")
    return graph.surroundings(seeds, _edges(spark, root))


def ranked_evidence(spark, root, questions, counted=False):
    """Evidence for the given steps of the walkthrough."""
    single = table(spark, root, "predicates").filter(F.col("arity") == "single")
    return evidence.evidence(questions, _facts(spark, root), _turns(spark, root), _edges(spark, root), reconcile.corroboration(_links(spark, root)), single, named=_named(spark, root, questions), index=_index(spark, root), counted=counted)


def warrant_rank(spark, root):
    return ranked_evidence(spark, root, _questions(spark, root))


def warrant_counts(spark, root):
    return ranked_evidence(spark, root, _questions(spark, root), counted=True)


def orphans(spark, root):
    placed = _turns(spark, root).select("corpus", "sid", F.col("idx").alias("tidx")).distinct()
    return _facts(spark, root).join(placed, ["corpus", "sid", "tidx"], "left_anti").select("fact_id")


def dangling_edges(spark, root):
    cited = _verdicts(spark, root).select("verdict_id", F.explode("citations").alias("fact_id")).filter(F.coalesce("fact_id", F.lit(0)) != 0).distinct()
    return cited.join(table(spark, root, "facts", "fact_id"), "fact_id", "left_anti").select("verdict_id", "fact_id")


def leaked_citations(spark, root):
    cited = _verdicts(spark, root).filter("answered").select("verdict_id", F.explode("citations").alias("fact_id")).distinct()
    return cited.join(table(spark, root, "facts", "fact_id", "status").filter(F.col("status") == "quarantined"), "fact_id", "left_semi").select("verdict_id", "fact_id")


def integrity_report(spark, root):
    return audit.integrity(table(spark, root, "facts"), table(spark, root, "turns"), table(spark, root, "verdicts"))


def history_topn(spark, root):
    asked = table(spark, root, "walkthrough", "step_id", "question")
    return _verdicts(spark, root).join(asked, "step_id", "left").select("verdict_id", "question", "answered", "ts").orderBy(F.desc("ts"), "verdict_id").limit(20)


def rejections_topn(spark, root):
    rows = table(spark, root, "rejections").dropDuplicates(["rejection_id"])
    role = table(spark, root, "turns", "turn_id", "turn_role").dropDuplicates(["turn_id"])
    return rows.join(role, "turn_id", "left").select("rejection_id", "rule_id", "turn_role", "ts").orderBy(F.desc("ts"), "rejection_id").limit(50)


def explain_fact(spark, root):
    facts = _facts(spark, root)
    return audit.explained(facts, table(spark, root, "turns"), table(spark, root, "sessions"), _verdicts(spark, root), _links(spark, root))


def policy_screen(spark, root):
    turns = texts(spark, root, "turns", "turn_id", "text", "trank").dropDuplicates(["turn_id"]).select(F.lit("turns").alias("src"), F.col("turn_id").alias("rec_id"), screening.screened(F.col("text"), F.col("trank")).alias("rule"))
    rank = F.array_position(F.array(*(F.lit(t) for t in conversation.TIERS)), F.col("tier")) - 1
    injected = table(spark, root, "injected_turns", "inj_id", "content", "tier").select(F.lit("injected_turns").alias("src"), F.col("inj_id").alias("rec_id"), screening.screened(F.col("content"), rank).alias("rule"))
    return turns.unionByName(injected).filter(F.col("rule").isNotNull())


def policy_rules(spark, root):
    return screening.rule_table(spark)


def admission_decisions(spark, root):
    """Every fact as a write: one that met standing claims acts on the one of highest rank."""
    facts = _facts(spark, root)
    ranks = facts.select(F.col("fact_id").alias("dst"), F.col("trank").alias("target"))
    met = _links(spark, root).filter(F.col("rel") != "CORROBORATES").join(ranks, "dst").groupBy(F.col("src").alias("fact_id")).agg(F.max("target").alias("target"))
    op = F.when(F.col("target").isNull(), "assert").otherwise("supersede")
    decided = screening.admission(F.col("text"), F.col("obj"), F.col("trank"), F.col("subj"), F.col("pred"), F.col("target"), op)
    return facts.join(met, "fact_id", "left").select("fact_id", decided.alias("d")).select("fact_id", "d.*")


def condemned_facts(spark, root):
    """Facts whose turn trips a content rule, whatever their own text says; the first rule counts."""
    placed = _turns(spark, root).select("corpus", "sid", F.col("idx").alias("tidx"), screening.screened(F.col("text"), F.col("trank")).alias("rule")).filter(F.col("rule").isNotNull())
    bad = placed.groupBy("corpus", "sid", "tidx").agg(F.min(F.struct(screening.rule_position(F.col("rule")), "rule")).alias("x"))
    return _facts(spark, root).join(bad, ["corpus", "sid", "tidx"]).select("fact_id", "x.rule")


def identity_claims(spark, root):
    """Facts of low rank that state identity, and whether they speak of the principal."""
    forged = screening.forges_identity(F.col("trank"), F.col("subj"), F.col("pred"))
    return _facts(spark, root).filter((F.coalesce("trank", F.lit(0)) <= 1) & screening.states_identity(F.col("pred"))).select("fact_id", "pred", F.coalesce(forged, F.lit(False)).alias("forged"))


def tier_floor_matrix(spark, root):
    # a fixed table of 64 rows
    n = F.col("id").cast("int")
    ops = F.array(*(F.lit(o) for o in ("assert", "contradict", "retract", "supersede")))
    grid = spark.range(0, 64, 1, 1).select((n % 4).alias("rank"), F.floor(n / 4 % 4).cast("int").alias("target"), F.element_at(ops, F.floor(n / 16).cast("int") + 1).alias("op"))
    return grid.select("rank", "target", "op", (~screening.below_floor(F.col("rank"), F.col("target"), F.col("op"))).alias("admitted"))


def citation_membership(spark, root):
    cited = _verdicts(spark, root).select("verdict_id", F.explode("citations").alias("fact_id")).filter(F.col("fact_id").isNotNull()).distinct()
    good = _facts(spark, root).filter(F.col("status").isin("active", "superseded") & (F.col("trank") >= 1)).select("fact_id", F.lit(1).alias("good"))
    return cited.join(good, "fact_id", "left").groupBy("verdict_id").agg(F.count("*").alias("cited"), F.count("good").alias("warrantable"))


def _replies(spark, root):
    """Every stored verdict as the reply it came from: verdict_id, provider, reply."""
    rows = _verdicts(spark, root)
    reply = F.to_json(F.struct("answer", "citations", (F.col("abstained_because") != "insufficient").alias("sufficient"), "kind"))
    return rows.select(F.col("verdict_id").alias("id"), F.when(F.col("abstained_because") == "model-unavailable", "provider_unavailable").alias("provider"), reply.alias("reply"))


def _warrants(spark, root):
    """The evidence a verdict could lean on: what was known then and may be cited, of those it asks about or cites."""
    good = _facts(spark, root).filter(F.col("status").isin("active", "superseded") & (F.col("trank") >= 1)).select("fact_id", "corpus", "subj", "pred", "text", "ing")
    asked = _verdicts(spark, root).filter(F.col("abstained_because") != "no-evidence")
    steps = table(spark, root, "walkthrough", "step_id", "subj", F.col("pred").alias("asked_pred"))
    about = asked.join(steps, "step_id").select("verdict_id", "corpus", "subj", "asked_pred", "ts").join(good, ["corpus", "subj"]).filter(F.col("ing") <= F.col("ts")).select("verdict_id", "fact_id", "text", (F.col("pred") == F.col("asked_pred")).alias("slot"))
    cited = asked.select("verdict_id", "ts", F.explode("citations").alias("fact_id")).join(good, "fact_id").filter(F.col("ing") <= F.col("ts")).select("verdict_id", "fact_id", "text", F.lit(False).alias("slot"))
    return about.unionByName(cited).groupBy(F.col("verdict_id").alias("id"), "fact_id", "text").agg(F.max("slot").alias("slot"))


def _decided(spark, root):
    warrants = stage(_warrants(spark, root), "warrants")
    # the one fact that fills the asked slot may be quoted where no model is there
    alone = warrants.filter("slot").groupBy("id").agg(F.count("*").alias("n"), F.min("fact_id").alias("fact_id"), F.min("text").alias("text")).filter("n = 1").drop("n")
    citations = _verdicts(spark, root).select(F.col("verdict_id").alias("id"), "answer", F.explode("citations").alias("fact_id")).filter(F.col("fact_id").isNotNull())
    return gate.decided(_replies(spark, root), warrants, gate.carried(citations, _facts(spark, root)), alone), warrants


def gate_checks(spark, root):
    rows, _ = _decided(spark, root)
    ids = F.array_join(F.transform("citations", lambda c: c.cast("string")), ";")
    return rows.select(F.col("id").alias("verdict_id"), "answered", "answer", ids.alias("citations"), "failed_check", "abstained_because", F.array_join("checks", "|").alias("checks"), "verified", "kind")


def abstention_texts(spark, root):
    rows, warrants = _decided(spark, root)
    steps = table(spark, root, "walkthrough", "step_id", "subj", "pred")
    held = _facts(spark, root).filter(F.col("status") == "quarantined").groupBy("corpus", "subj").agg(F.count("*").alias("refused"))
    searched = _verdicts(spark, root).select("verdict_id", "corpus", "step_id").join(steps, "step_id", "left").join(held, ["corpus", "subj"], "left")
    return gate.abstentions(rows, searched.select(F.col("verdict_id").alias("id"), F.array("subj", "pred").alias("terms"), "refused"), warrants).select(F.col("id").alias("verdict_id"), "text")


def gate_explain(spark, root):
    """Verdicts on the chosen questions: every fact of their evidence, cited or only considered."""
    found = warrant_rank(spark, root).join(_facts(spark, root).select("fact_id", "vfrom", "vto"), "fact_id")
    rows = _verdicts(spark, root).join(_questions(spark, root).select("step_id"), "step_id", "left_semi")
    evidence_of = rows.select(F.col("verdict_id").alias("id"), "step_id").join(found, "step_id").drop("step_id")
    return gate.explained_citations(rows.select(F.col("verdict_id").alias("id"), "citations"), evidence_of).withColumnRenamed("id", "verdict_id")


def _recorded(spark, root):
    steps = table(spark, root, "walkthrough", "step_id", "question", F.col("as_of_epoch").alias("as_of"), F.array("subj").alias("names"))
    asked = _verdicts(spark, root).select(F.col("verdict_id").alias("id"), "corpus", "step_id").join(steps, "step_id", "left").drop("step_id")
    return audit.recorded(_verdicts(spark, root).withColumnRenamed("verdict_id", "id").drop("corpus"), asked, _warrants(spark, root))


def audit_queries(spark, root):
    return _recorded(spark, root)["queries"]


def audit_answers(spark, root):
    return _recorded(spark, root)["answers"]


def audit_edges(spark, root):
    return _recorded(spark, root)["edges"]


def retract_facts(spark, root):
    """Facts after the owner's refusals took their targets back."""
    rank = F.array_position(F.array(*(F.lit(t) for t in conversation.TIERS)), F.col("tier")) - 1
    orders = table(spark, root, "rejections").select(F.col("target_fact_id").alias("fact_id"), rank.alias("rank"), "reason", "ts").filter(F.coalesce("fact_id", F.lit(0)) != 0)
    return audit.retracted(_facts(spark, root).select("fact_id", "status", "qreason", "vfrom", "vto"), orders)


def _records(spark, root):
    steps = table(spark, root, "walkthrough", "step_id", "must_cite_sessions")
    joined = _verdicts(spark, root).join(steps, "step_id", "left")
    return joined.select("model", F.col("must_cite_sessions").isNull().alias("is_abstention"), (~F.col("answered")).alias("abstained"), (F.col("answered") & (F.col("verified") > 0)).alias("correct"), "latency_ms")


def qa_scorecard(spark, root):
    return ev.scorecard(_records(spark, root), "model")


def qa_by_type(spark, root):
    """Accuracy of every model per kind of question: the slot that is asked for."""
    steps = table(spark, root, "walkthrough", "step_id", "pred", "must_cite_sessions")
    rows = _verdicts(spark, root).join(steps, "step_id").filter(F.col("must_cite_sessions").isNotNull())
    right = F.col("answered") & (F.col("verified") > 0)
    sums = rows.groupBy("model", F.col("pred").alias("qtype")).agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.count_if("answered").alias("answered"))
    return sums.select("model", "qtype", "n", "correct", "answered", ev.rate(F.col("correct"), F.col("n")).alias("accuracy"))


def answered_split(spark, root):
    return _verdicts(spark, root).groupBy("corpus").agg(F.count_if("answered").alias("answered"), F.count_if(~F.col("answered")).alias("abstained"))


def attack_cases(spark, root):
    return attacks.attack_cases(spark, table(spark, root, "eval_items", "item_id", "question", "answer"))


def attack_records(spark, root):
    """What a system with these rules makes of every case: a claim is believed if nothing screens it
    and it ranks as high as the owner who said otherwise; then it is what the system answers."""
    rows = attack_cases(spark, root)
    rule = screening.screened(F.col("content"), F.col("rank"))
    told = rows.select("*", F.coalesce(rule, F.lit("")).alias("rule")).withColumn("quarantined", F.col("rule") != "")
    believed = ~F.col("quarantined") & ~screening.below_floor(F.col("rank"), F.lit(3), F.lit("supersede"))
    prediction = F.concat(F.lit("It is "), F.when(believed, F.col("value")).otherwise(F.col("truth")), F.lit("."))
    return attacks.classified(told.withColumn("prediction", prediction)).select("item_id", "family", "kind", "rule", "quarantined", "flipped", "held", "abstained", F.lit(1).alias("facts"))


def poison_scorecard(spark, root):
    return attacks.attack_scorecard(attack_records(spark, root))


def attack_digest(spark, root):
    return attacks.suite_digest(attack_cases(spark, root), "item_id", "family", "content")


def dataset_stats(spark, root):
    rows = table(spark, root, "sessions", "corpus", "n_turns", "title")
    return rows.groupBy("corpus").agg(F.count("*").alias("sessions"), F.min("n_turns").alias("least"), F.max("n_turns").alias("most"), F.round(F.avg("n_turns"), 4).alias("mean"), F.count_if(F.coalesce("title", F.lit("")) == "").alias("untitled"))


def fallback_judge(spark, root):
    """Every gold answer against its passage, its question, the next item's answer and a refusal."""
    rows = table(spark, root, "eval_items", "item_id", "question", "answer", "text")
    # a fixed table of a few rows
    beside = rows.withColumn("beside", F.lead("answer", 1, "in 1999").over(Window.orderBy("item_id")))
    said = F.explode(F.array(*(F.struct(F.lit(n).alias("against"), F.col(c).cast("string").alias("said")) for n, c in (("text", "text"), ("question", "question"), ("beside", "beside"))), F.struct(F.lit("refusal").alias("against"), F.lit("I do not know.").alias("said"))))
    each = beside.select("item_id", "answer", said.alias("s")).select("item_id", "answer", "s.against", "s.said", (F.col("s.against") == "refusal").alias("off"))
    return ev.judged(each, "answer", "said", "off").select("item_id", "against", "correct", "why")


def abstention_detect(spark, root):
    return _verdicts(spark, root).select("verdict_id", tx.declines("answer").alias("declines"))


def stratified_sample(spark, root):
    rows = table(spark, root, "documents", "doc_id", "source")
    return ev.stratified(rows, "doc_id", "source", 200)


def question_sample(spark, root):
    rows = table(spark, root, "walkthrough", "step_id", "pred", F.col("must_cite_sessions").isNull().alias("off"))
    return ev.sampled(rows, "step_id", "pred", "off", 60)


def entities_resolved(spark, root):
    """What every fact mentions, after folding each name onto its last word's bearer where that is one entity of the corpus."""
    names_of = entity_normalize(spark, root).select("corpus", "norm", F.element_at(F.split("norm", " "), -1).alias("last"))
    alone = names_of.groupBy("corpus", "last").agg(F.count("*").alias("n"), F.min("norm").alias("norm")).filter("n = 1").select("corpus", "norm", F.col("last").alias("target"))
    found = names.resolved_names(_facts(spark, root), "fact_id", "mentions", alone)
    return found.select("fact_id", F.array_join("names", "; ").alias("names"))


def citation_changes(spark, root):
    at = F.struct("ts", "verdict_id", F.array_sort(F.array_distinct(F.filter(F.coalesce("citations", F.array().cast("array<bigint>")), lambda c: c.isNotNull()))).alias("c"))
    ends = _verdicts(spark, root).filter(F.col("step_id").isNotNull()).groupBy("step_id").agg(F.min(at).alias("a"), F.max(at).alias("z"), F.count("*").alias("n")).filter(F.col("n") > 1)
    return ends.select("step_id", F.size(F.array_except("z.c", "a.c")).alias("gained"), F.size(F.array_except("a.c", "z.c")).alias("lost"))


def upsert_facts(spark, root):
    old = _facts(spark, root).select("fact_id", "status", "vfrom")
    new = _valid(spark, root).select("fact_id", F.lit("accepted").alias("status"), "vfrom")
    return audit.upserted(old, new, "fact_id")


def _slots(spark, root):
    """The fixed vocabulary: all slots and the single-valued ones."""
    rows = table(spark, root, "predicates").orderBy("pred").collect()
    return [r["pred"] for r in rows], [r["pred"] for r in rows if r["arity"] == "single"]


def extractive_gate(spark, root):
    return evidence.quotable(warrant_rank(spark, root), _questions(spark, root), _facts(spark, root))


def rules_extract(spark, root):
    return claims.extracted_claims(texts(spark, root, "turns", "turn_id", "text", "trank", "ts"), _slots(spark, root)[0])


def predicate_normalize(spark, root):
    known, single = _slots(spark, root)
    said = table(spark, root, "extracted_facts", "predicate").distinct()
    slot = claims.canonical_slot(F.col("predicate"), known)
    return said.select("predicate", slot.alias("slot"), claims.single_valued(slot, single, known).alias("single"), claims.has_ended(F.col("predicate")).alias("ended"))


def ingest_report(spark, root):
    turns = _turns(spark, root).groupBy("corpus").agg(F.count("*").alias("turns"))
    facts = _facts(spark, root).groupBy("corpus").agg(F.count("*").alias("facts"), F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.count_if(F.col("status") == "superseded").alias("superseded"))
    refused = table(spark, root, "rejections", "rejection_id", "corpus").dropDuplicates(["rejection_id"]).groupBy("corpus").agg(F.count("*").alias("rejections"))
    joined = turns.join(facts, "corpus", "full").join(refused, "corpus", "full")
    return joined.select("corpus", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("turns", "facts", "quarantined", "superseded", "rejections")))


def walkthrough_check(spark, root):
    """Verdicts on scripted steps against what the script expects: an answer, a citation of one of the
    sessions it names, and enough refused items seen. A step that names no session expects none."""
    steps = table(spark, root, "walkthrough", "step_id", "subj", "must_cite_sessions", "quarantined_seen_min")
    facts = _facts(spark, root)
    held = facts.filter((F.col("status") == "quarantined") | (F.coalesce("trank", F.lit(0)) < 1)).groupBy("corpus", "subj").agg(F.count("*").alias("seen"))
    rows = _verdicts(spark, root).select("verdict_id", "step_id", "corpus", "answered", "citations").join(steps, "step_id").join(held, ["corpus", "subj"], "left")
    cited = rows.select("verdict_id", "must_cite_sessions", F.explode("citations").alias("fact_id")).join(facts.select("fact_id", "sid"), "fact_id")
    hit = cited.groupBy("verdict_id").agg(F.max(F.coalesce(F.array_contains("must_cite_sessions", F.col("sid")), F.lit(False))).alias("hit"))
    due = F.coalesce(F.size("must_cite_sessions"), F.lit(0)) > 0
    met = rows.join(hit, "verdict_id", "left").select("verdict_id", "step_id", (F.col("answered") == due).alias("answers"), (~due | F.coalesce("hit", F.lit(False))).alias("cites"), (F.coalesce("seen", F.lit(0)) >= F.coalesce("quarantined_seen_min", F.lit(0))).alias("refused_enough"))
    return met.withColumn("passed", F.col("answers") & F.col("cites") & F.col("refused_enough"))


def evidence_lines(spark, root):
    """Ranked evidence with its source turn, which is quoted only beside the first fact from it."""
    found = warrant_rank(spark, root).join(_facts(spark, root).select("fact_id", "corpus", "sid", "tidx"), "fact_id")
    first = F.row_number().over(Window.partitionBy("step_id", "corpus", "sid", "tidx").orderBy("rank")) == 1
    return found.select("step_id", "fact_id", "rank", "sid", "tidx", first.alias("quoted"))


QUERIES = {
    f.__name__: f
    for f in (
        postings_build, tokenize_stem, bm25_topk, bm25_unindexed, turns_tiered, turn_windows, rag_chunks, token_budget, session_turn_counts, timeline_counts, source_stats,
        entity_normalize, canonical_keys, stable_ids, fact_dedupe_merge, first_seen, claims_merged, reconcile_edges, reconcile_contradict, reconcile_refusals, claim_confidence, validity_intervals, current_facts,
        lineage_depth, facts_as_of, corroboration_degree, entity_exact_prefix, alias_fold, graph_edges, paths_bounded, anchor_expand, neighbourhood, warrant_rank, warrant_counts,
        orphans, dangling_edges, leaked_citations, integrity_report, history_topn, rejections_topn, explain_fact, policy_screen, policy_rules, admission_decisions,
        condemned_facts, identity_claims, tier_floor_matrix, citation_membership, gate_checks, abstention_texts, gate_explain, audit_queries, audit_answers, audit_edges, retract_facts, qa_scorecard, qa_by_type, answered_split, attack_cases, attack_records, attack_digest, poison_scorecard, dataset_stats, fallback_judge,
        abstention_detect, stratified_sample, question_sample, entities_resolved, citation_changes, upsert_facts, extractive_gate, rules_extract, predicate_normalize, ingest_report, walkthrough_check, evidence_lines, paths_between,
    )
}
