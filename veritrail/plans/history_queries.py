"""Queries of the general data-processing problems (1, 2, 5, 6, 7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.operators.history import attribute_history, entity_states
from veritrail.operators.instants import PARSER, normalised_instants
from veritrail.operators.intervals import periods_and_gaps
from veritrail.operators.knownasof import known_at
from veritrail.operators.references import broken_references, orphan_report
from veritrail.operators.shared import shared_dir
from veritrail.sources.tables import table

KEYS = ["corpus", "subject", "predicate"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "extracted_facts", "rec_id", *KEYS, "object", "valid_from", "valid_to", "ingested_at")
    single = table(spark, root, "predicates").filter(F.col("arity") == "single").select(F.col("pred").alias("predicate"))
    found = attribute_history(records.join(single, "predicate", "left_semi"), KEYS, "object", "valid_from", "valid_to", "ingested_at", "rec_id")
    return found.select(*KEYS, "valid_from", "valid_to")


def p1_entity_states(spark: SparkSession, root: str) -> DataFrame:
    records = table(spark, root, "extracted_facts", "rec_id", *KEYS, "object", "valid_from", "valid_to", "ingested_at")
    single = [r[0] for r in table(spark, root, "predicates").filter(F.col("arity") == "single").select("pred").orderBy("pred").collect()]  # the fixed vocabulary
    found = attribute_history(records.filter(F.col("predicate").isin(single)), KEYS, "object", "valid_from", "valid_to", "ingested_at", "rec_id")
    states = entity_states(found, ["corpus", "subject"], "predicate", "object", single)
    slots = F.array_join(F.transform(F.array_sort(F.map_entries("state")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return states.select("corpus", "subject", "valid_from", "valid_to", slots.alias("state"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    steps = table(spark, root, "walkthrough", "step_id", "corpus", "subj", "pred", "as_of_epoch")
    facts = table(spark, root, "facts", "fact_id", "corpus", "subj", "pred", "status", "vfrom", "vto", "vto_ing", "ing").filter(F.col("status").isin("active", "superseded"))
    return known_at(steps, facts, ["corpus", "subj", "pred"], "step_id", "as_of_epoch", "fact_id", "vfrom", "vto", "ing", "vto_ing")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    parts = (("sessions", "session_id", "raw_date"), ("walkthrough", "step_id", "as_of"), ("injected_turns", "inj_id", "raw_date"))
    rows = [
        table(spark, root, name, key, raw, "locale_tag", "tz_name").select(F.lit(name).alias("src"), F.col(key).alias("rec_id"), F.col(raw).alias("raw"), F.col("locale_tag").alias("locale"), F.col("tz_name").alias("zone"))
        for name, key, raw in parts
    ]
    # the dictionary outlives the run: what was parsed once is never parsed again
    return normalised_instants(rows[0].unionByName(rows[1]).unionByName(rows[2]), kept=f"{shared_dir(spark)}/instants-{PARSER}")


def _broken(spark: SparkSession, root: str) -> DataFrame:
    rejections = table(spark, root, "rejections", "rejection_id", "turn_id", "target_fact_id", "ts")
    verdicts = table(spark, root, "verdicts", "verdict_id", "citations", "ts")
    said = lambda df, name, field, key, ref: df.select(F.lit(name).alias("src_table"), F.lit(field).alias("ref_field"), F.col(key).alias("src_id"), ref.alias("ref_id"), "ts")
    to_turns = said(rejections, "rejections", "turn_id", "rejection_id", F.col("turn_id"))
    to_facts = said(rejections, "rejections", "target_fact_id", "rejection_id", F.col("target_fact_id")).unionByName(said(verdicts, "verdicts", "citations", "verdict_id", F.explode("citations")))
    return broken_references(to_turns, table(spark, root, "turns", "turn_id", "ing"), "turn_id", "ing").unionByName(broken_references(to_facts, table(spark, root, "facts", "fact_id", "ing"), "fact_id", "ing"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return _broken(spark, root).drop("ts")


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return orphan_report(_broken(spark, root))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    facts = table(spark, root, "facts", "corpus", "subj", "pred", "status", "vfrom", "vto").filter(F.col("status").isin("active", "superseded"))
    return periods_and_gaps(facts, ["corpus", "subj", "pred"], "vfrom", "vto")


QUERIES = {f.__name__: f for f in (p1_found, p1_entity_states, p2_found, p5_found, p6_found, p6_report, p7_found)}

_VERSIONS = """
WITH counted AS (
  SELECT corpus, subject, predicate, object, valid_from, coalesce(nullif(valid_to, 0), 9223372036854775807) AS own
  FROM extracted_facts JOIN predicates ON pred = predicate AND arity = 'single'
  QUALIFY row_number() OVER (PARTITION BY corpus, subject, predicate, valid_from ORDER BY ingested_at DESC, rec_id DESC) = 1),
spans AS (
  SELECT *, least(own, coalesce(lead(valid_from) OVER w, 9223372036854775807)) AS until
  FROM counted WINDOW w AS (PARTITION BY corpus, subject, predicate ORDER BY valid_from)),
held AS (SELECT * FROM spans WHERE until > valid_from),
marked AS (
  SELECT *, CASE WHEN lag(until) OVER w = valid_from AND lag(object) OVER w IS NOT DISTINCT FROM object THEN 0 ELSE 1 END AS fresh
  FROM held WINDOW w AS (PARTITION BY corpus, subject, predicate ORDER BY valid_from)),
labelled AS (
  SELECT *, sum(fresh) OVER (PARTITION BY corpus, subject, predicate ORDER BY valid_from ROWS UNBOUNDED PRECEDING) AS n FROM marked),
found AS (
  SELECT corpus, subject, predicate, min(object) AS object, min(valid_from) AS valid_from, max(until) AS until
  FROM labelled GROUP BY corpus, subject, predicate, n)
"""

_BROKEN = """
WITH refs AS (
  SELECT 'rejections' AS src_table, 'turn_id' AS ref_field, rejection_id AS src_id, turn_id AS ref_id, ts FROM rejections
  UNION ALL SELECT 'rejections', 'target_fact_id', rejection_id, target_fact_id, ts FROM rejections
  UNION ALL SELECT 'verdicts', 'citations', verdict_id, unnest(citations), ts FROM verdicts),
targets AS (
  SELECT 'turn_id' AS kind, turn_id AS id, min(ing) AS ing FROM turns GROUP BY turn_id
  UNION ALL SELECT 'fact', fact_id, min(ing) FROM facts GROUP BY fact_id),
broken AS (
  SELECT src_table, ref_field, src_id, ref_id, max(CASE WHEN id IS NULL THEN 'missing' ELSE 'late' END) AS state, min(ts) AS ts
  FROM refs LEFT JOIN targets ON id = ref_id AND kind = CASE WHEN ref_field = 'turn_id' THEN 'turn_id' ELSE 'fact' END
  WHERE coalesce(ref_id, 0) <> 0 AND (id IS NULL OR ing > ts)
  GROUP BY src_table, ref_field, src_id, ref_id)
"""

ORACLES = {
    "p1_found": _VERSIONS + "SELECT corpus, subject, predicate, valid_from, CASE WHEN until = 9223372036854775807 THEN 0 ELSE until END AS valid_to FROM found",
    "p1_entity_states": _VERSIONS
    + """, dates AS (
  SELECT DISTINCT corpus, subject, moment FROM (
    SELECT corpus, subject, valid_from AS moment FROM found UNION ALL SELECT corpus, subject, until FROM found WHERE until < 9223372036854775807)),
pieces AS (SELECT corpus, subject, moment, lead(moment) OVER (PARTITION BY corpus, subject ORDER BY moment) AS until FROM dates),
states AS (
  SELECT p.corpus, p.subject, p.moment, coalesce(p.until, 0) AS until, string_agg(f.predicate || '=' || f.object, '; ' ORDER BY f.predicate) AS state
  FROM pieces p JOIN found f ON f.corpus = p.corpus AND f.subject = p.subject AND f.valid_from <= p.moment AND f.until > p.moment
  GROUP BY p.corpus, p.subject, p.moment, p.until),
steps AS (
  SELECT *, CASE WHEN lag(until) OVER w = moment AND lag(state) OVER w = state THEN 0 ELSE 1 END AS fresh
  FROM states WINDOW w AS (PARTITION BY corpus, subject ORDER BY moment)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY corpus, subject ORDER BY moment ROWS UNBOUNDED PRECEDING) AS n FROM steps)
SELECT corpus, subject, min(moment) AS valid_from, CASE WHEN min(until) = 0 THEN 0 ELSE max(until) END AS valid_to, min(state) AS state
FROM runs GROUP BY corpus, subject, n""",
    "p2_found": """
SELECT step_id, fact_id FROM (
  SELECT step_id, fact_id, row_number() OVER (PARTITION BY step_id ORDER BY vfrom DESC, fact_id DESC) AS n
  FROM walkthrough w JOIN facts f ON f.corpus = w.corpus AND f.subj = w.subj AND f.pred = w.pred
  WHERE status IN ('active', 'superseded') AND vfrom <= as_of_epoch AND ing <= as_of_epoch
    AND NOT coalesce(coalesce(vto, 0) <> 0 AND vto <= as_of_epoch AND vto_ing <= as_of_epoch, false)) WHERE n = 1""",
    "p6_found": _BROKEN + "SELECT src_table, ref_field, src_id, ref_id, state FROM broken",
    "p6_report": _BROKEN + "SELECT src_table, ref_field, state, strftime(make_timestamp(ts * 1000000), '%Y-%m') AS month, count(*) AS n FROM broken GROUP BY ALL",
    "p7_found": """
WITH held AS (
  SELECT corpus, subj, pred, vfrom, CASE WHEN coalesce(vto, 0) = 0 THEN 9223372036854775807 ELSE vto END AS until FROM facts
  WHERE status IN ('active', 'superseded') AND (coalesce(vto, 0) = 0 OR vto > vfrom)),
seen AS (
  SELECT *, max(until) OVER (PARTITION BY corpus, subj, pred ORDER BY vfrom, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM held),
runs AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR vfrom > reach THEN 1 ELSE 0 END) OVER (PARTITION BY corpus, subj, pred ORDER BY vfrom, until ROWS UNBOUNDED PRECEDING) AS n FROM seen),
periods AS (SELECT corpus, subj, pred, min(vfrom) AS a, max(until) AS b FROM runs GROUP BY corpus, subj, pred, n)
SELECT corpus, subj, pred, 'period' AS kind, a AS start_s, CASE WHEN b = 9223372036854775807 THEN 0 ELSE b END AS end_s FROM periods
UNION ALL
SELECT corpus, subj, pred, 'gap', lag(b) OVER w, a FROM periods WINDOW w AS (PARTITION BY corpus, subj, pred ORDER BY a)
QUALIFY lag(b) OVER w IS NOT NULL""",
}
