"""SQL of the queries on the gate, the audit trail and the attack suite."""

from __future__ import annotations

from veritrail.functions.evaluation import _MONTHS, SEPARATORS
from veritrail.operators import attacks, gate
from veritrail.plans.reference_sql import _CLAIMS, _FACTS, _TURNS, _VERDICTS, _WARRANT, _declines, _ek, _plain
from veritrail.plans.screening_sql import _letters, _rule


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_OPENS = " OR ".join(f"starts_with(x || ' ', {_quoted(o + ' ')}) OR starts_with(x, {_quoted(o + '.')}) OR starts_with(x, {_quoted(o + ',')})" for o in gate.OPENINGS)
_LOW = "regexp_replace(regexp_replace(lower(trim(coalesce(answer, ''))), '[''’]', '', 'g'), '\\s+', ' ', 'g')"
_REASONS = " ".join(f"WHEN {_quoted(c)} THEN {_quoted(r)}" for c, r in gate.CHECKS)
_LACKS = " ".join(f"WHEN {_quoted(c)} THEN {_quoted(t)}" for c, t in gate.MISSING.items())
_ORDER = "[" + ", ".join(_quoted(c) for c, _ in gate.CHECKS[:9]) + "]"

_HELD = f"""{_FACTS}, {_VERDICTS},
good AS (SELECT * FROM facts_u WHERE status IN ('active', 'superseded') AND trank >= 1),
cites AS (SELECT verdict_id, fact_id, min(i) AS place FROM (SELECT verdict_id, unnest(citations) AS fact_id, generate_subscripts(citations, 1) AS i FROM verdicts_u) WHERE fact_id IS NOT NULL GROUP BY ALL),
may AS (SELECT * FROM verdicts_u WHERE abstained_because <> 'no-evidence'),
warrants AS (SELECT verdict_id, fact_id, text, max(slot) AS slot FROM (
  SELECT v.verdict_id, g.fact_id, g.text, g.pred = s.pred AS slot FROM may v JOIN walkthrough s USING (step_id) JOIN good g ON g.corpus = v.corpus AND g.subj = s.subj AND g.ing <= v.ts
  UNION ALL SELECT v.verdict_id, g.fact_id, g.text, false FROM may v JOIN cites c USING (verdict_id) JOIN good g ON g.fact_id = c.fact_id AND g.ing <= v.ts) GROUP BY ALL)"""
_GATE = f"""{_HELD},
alone AS (SELECT verdict_id, min(fact_id) AS q_id, min(text) AS q_text FROM warrants WHERE slot GROUP BY verdict_id HAVING count(*) = 1),
weighed AS (
  SELECT c.*, w.fact_id IS NOT NULL AS inside, {_plain('f.obj')} AS o, {_plain('v.answer')} AS a, f.fact_id IS NOT NULL AS there
  FROM cites c JOIN verdicts_u v USING (verdict_id) LEFT JOIN warrants w ON w.verdict_id = c.verdict_id AND w.fact_id = c.fact_id LEFT JOIN facts_u f ON f.fact_id = c.fact_id),
told AS (SELECT *, there AND o <> '' AND contains(' ' || a || ' ', ' ' || o || ' ') AS yes FROM weighed),
sums AS (SELECT verdict_id, count(*) AS n, count_if(NOT inside) AS invented, list(fact_id ORDER BY place) FILTER (WHERE yes) AS kept,
  list(fact_id || ':' || CASE WHEN there THEN 'does not state it' ELSE 'no such fact' END ORDER BY place) FILTER (WHERE NOT yes) AS lost FROM told GROUP BY verdict_id),
seen AS (SELECT v.*, s.* EXCLUDE (verdict_id), (SELECT count(*) FROM warrants w WHERE w.verdict_id = v.verdict_id) AS evidence, coalesce(lower(trim(kind)) = 'grounded', false) AS grounded, {_LOW} AS x, q_id, q_text
  FROM verdicts_u v LEFT JOIN sums s ON s.verdict_id = v.verdict_id LEFT JOIN alone l ON l.verdict_id = v.verdict_id),
failing AS (
  SELECT *, CASE WHEN grounded THEN 'citations_relevant' ELSE 'citations_supported' END AS final, CASE WHEN evidence = 0 THEN 'warrant_nonempty' WHEN abstained_because = 'model-unavailable' THEN 'provider_unavailable' WHEN answer IS NULL OR citations IS NULL THEN 'response_schema'
    WHEN abstained_because = 'insufficient' AND NOT grounded THEN 'sufficient' WHEN coalesce(n, 0) = 0 THEN 'citations_present' WHEN invented > 0 THEN 'citations_in_warrant' WHEN trim(answer) = '' THEN 'answer_text'
    WHEN {_OPENS} THEN 'answer_not_refusal' WHEN kept IS NULL THEN CASE WHEN grounded THEN 'citations_relevant' ELSE 'citations_supported' END END AS failed FROM seen),
verdict AS (
  SELECT *, coalesce(failed = 'provider_unavailable' AND q_id IS NOT NULL, false) AS quoting, failed IS NULL OR coalesce(failed = 'provider_unavailable' AND q_id IS NOT NULL, false) AS done FROM failing)"""

ORACLES = {
    "gate_checks": f"""WITH {_GATE}
SELECT verdict_id, done AS answered, CASE WHEN quoting THEN q_text WHEN done THEN trim(answer) END AS answer, CASE WHEN quoting THEN CAST(q_id AS VARCHAR) WHEN done THEN array_to_string(kept, ';') ELSE '' END AS citations,
  CASE WHEN NOT done THEN failed END AS failed_check, CASE WHEN done THEN '' ELSE CASE failed {_REASONS} ELSE 'model-unavailable' END END AS abstained_because,
  array_to_string(list_concat({_ORDER}[1:CASE WHEN failed = 'provider_unavailable' THEN 3 WHEN list_contains({_ORDER}, failed) THEN list_position({_ORDER}, failed) ELSE 9 END],
    CASE WHEN failed = 'provider_unavailable' THEN ['provider_unavailable', 'extractive_answer'] WHEN failed IS NULL OR failed = final
      THEN list_concat([final], list_concat(list_transform(coalesce(lost, []), lambda l: final || ':dropped:' || l), CASE WHEN failed IS NULL AND grounded THEN ['grounded_answer'] ELSE [] END)) ELSE [] END), '|') AS checks,
  CASE WHEN done AND NOT quoting THEN CAST(len(kept) AS INTEGER) ELSE 0 END AS verified, CASE WHEN quoting THEN 'extractive' WHEN NOT done THEN '' WHEN grounded THEN 'grounded' ELSE 'recall' END AS kind FROM verdict""",
    "abstention_texts": f"""WITH {_GATE}, held AS (SELECT corpus, subj, count(*) AS refused FROM facts_u WHERE status = 'quarantined' GROUP BY ALL),
t AS (SELECT v.verdict_id, failed, evidence, coalesce(refused, 0) AS refused, array_to_string(list_transform(list_filter([s.subj, s.pred], lambda t: t IS NOT NULL AND t <> ''), lambda t: '''' || t || ''''), ', ') AS terms
  FROM verdict v LEFT JOIN walkthrough s USING (step_id) LEFT JOIN held h ON h.corpus = v.corpus AND h.subj = s.subj WHERE NOT done)
SELECT verdict_id, 'Memory does not hold enough to answer that. Searched for ' || CASE WHEN terms = '' THEN 'the words of the question' ELSE terms END || ': ' || evidence || CASE WHEN evidence = 1 THEN ' related fact; ' ELSE ' related facts; ' END
  || CASE failed {_LACKS} ELSE 'the answering step failed.' END || CASE WHEN refused > 0 THEN ' Left out as not trusted: ' || refused || '.' ELSE '' END || ' Say it once and it will be kept.' AS text FROM t""",
    "gate_explain": f"""WITH {_VERDICTS}, w AS ({_WARRANT}), f AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY vfrom) = 1)
SELECT v.verdict_id, w.fact_id, coalesce(list_contains(v.citations, w.fact_id), false) AS cited, score, hops, chain,
  CASE WHEN coalesce(vfrom, 0) = 0 THEN 'unknown' ELSE strftime(make_timestamp(vfrom * 1000000), '%Y-%m-%d %H:%M') || ' UTC' END || ' to ' || CASE WHEN coalesce(vto, 0) = 0 THEN 'open' ELSE strftime(make_timestamp(vto * 1000000), '%Y-%m-%d %H:%M') || ' UTC' END AS reads
FROM verdicts_u v JOIN w ON w.step_id = v.step_id JOIN f ON f.fact_id = w.fact_id""",
    "retract_facts": f"""WITH {_FACTS}, o AS (SELECT target_fact_id AS fact_id, ts, coalesce(reason, '') AS reason FROM rejections WHERE tier = 'owner' AND coalesce(target_fact_id, 0) <> 0 QUALIFY row_number() OVER (PARTITION BY target_fact_id ORDER BY ts, coalesce(reason, '')) = 1)
SELECT f.fact_id, CASE WHEN o.fact_id IS NOT NULL THEN 'retracted' ELSE status END AS status, CASE WHEN o.fact_id IS NOT NULL AND coalesce(status, '') <> 'retracted' THEN o.reason ELSE qreason END AS qreason, vfrom, CASE WHEN o.fact_id IS NOT NULL AND coalesce(status, '') <> 'retracted' THEN o.ts ELSE vto END AS vto
FROM facts_u f LEFT JOIN o USING (fact_id)""",
    "explain_fact": f"""WITH RECURSIVE {_CLAIMS}, {_VERDICTS}, {_TURNS}, c AS (SELECT DISTINCT verdict_id, ts, fact_id FROM (SELECT verdict_id, ts, unnest(citations) AS fact_id FROM verdicts_u)),
newest AS (SELECT fact_id, verdict_id, row_number() OVER (PARTITION BY fact_id ORDER BY ts DESC, verdict_id) AS n, count(*) OVER (PARTITION BY fact_id) AS k FROM c WHERE fact_id IS NOT NULL),
citing AS (SELECT fact_id, array_to_string(list(verdict_id ORDER BY n) FILTER (WHERE n <= 20), ';') AS cited_by, max(k) AS n_cited FROM newest GROUP BY fact_id),
step AS (SELECT DISTINCT src, dst FROM edges_ WHERE rel = 'SUPERSEDES'),
said AS (SELECT corpus, sid, idx AS tidx, turn_role, text AS turn_text, ts AS turn_ts FROM turns_u QUALIFY row_number() OVER (PARTITION BY corpus, sid, idx ORDER BY turn_id) = 1)
SELECT f.fact_id, f.text, f.status, f.qreason, s.title, t.turn_role, t.turn_text, t.turn_ts, array_to_string(list_sort(list_distinct(list_filter(f.mentions, lambda m: m IS NOT NULL))), '; ') AS mentions,
  (SELECT array_to_string(list(dst ORDER BY dst), ';') FROM step WHERE src = f.fact_id) AS supersedes, (SELECT array_to_string(list(src ORDER BY src), ';') FROM step WHERE dst = f.fact_id) AS superseded_by, cited_by, coalesce(n_cited, 0) AS n_cited
FROM facts_u f LEFT JOIN sessions s ON s.corpus = f.corpus AND s.sid = f.sid LEFT JOIN said t ON t.corpus = f.corpus AND t.sid = f.sid AND t.tidx = f.tidx LEFT JOIN citing c ON c.fact_id = f.fact_id""",
}


def _id(*parts: str) -> str:
    return "CAST(concat('0x', left(sha256(concat_ws(chr(31), " + ", ".join(parts) + ")), 15)) AS BIGINT)"


_QUERY = _id("'query'", "coalesce(v.corpus, '')", "coalesce(question, '')", "coalesce(CAST(ts AS VARCHAR), '')")
_ANSWER = _id("'answer'", "CAST(v.verdict_id AS VARCHAR)")
_ASKED = "verdicts_u v LEFT JOIN walkthrough s ON s.step_id = v.step_id"
ORACLES |= {
    "audit_queries": f"WITH {_HELD} SELECT DISTINCT {_QUERY} AS query_id, v.corpus, question AS text, ts, coalesce(as_of_epoch, 0) AS asof, (SELECT count(DISTINCT fact_id) FROM warrants w WHERE w.verdict_id = v.verdict_id) AS wsize FROM {_ASKED}",
    "audit_answers": f"""WITH {_VERDICTS} SELECT {_ANSWER} AS answer_id, v.corpus, left(coalesce(answer, ''), 4000) AS text, ts, CASE WHEN answered THEN 'answered' ELSE 'abstained' END AS status, abstained_because AS reason, model, CAST(coalesce(len(citations), 0) AS INTEGER) AS ncit, verified,
  coalesce(array_to_string(checks, ','), '') AS checks FROM {_ASKED}""",
    "audit_edges": f"""WITH {_VERDICTS} SELECT DISTINCT 'ANSWERS' AS rel, {_ANSWER} AS src, {_QUERY} AS dst FROM {_ASKED}
UNION SELECT 'CITES', {_ANSWER}, fact_id FROM (SELECT verdict_id, unnest(citations) AS fact_id FROM verdicts_u) v WHERE coalesce(fact_id, 0) <> 0
UNION SELECT 'ASKED_ABOUT', {_QUERY}, {_id("'entity'", "coalesce(v.corpus, '')", _ek('subj'))} FROM {_ASKED} WHERE subj IS NOT NULL AND {_ek('subj')} <> ''""",
}


def _alternatives(x: str) -> str:
    out = f"trim(coalesce({x}, ''))"
    for mark in SEPARATORS:
        out = f"replace({out}, {_quoted(mark)}, chr(31))"
    return f"list_filter(list_concat([trim(coalesce({x}, ''))], list_transform(string_split({out}, chr(31)), lambda p: trim(p, ' .'))), lambda a: a <> '')"


def _primary(x: str) -> str:
    # the second of the distinct alternatives, in order; the whole answer where there is none
    return f"coalesce(list_extract(list_filter({_alternatives(x)}, lambda a: a <> trim({x})), 1), trim({x}), '')"


def _picked(key: str, many: int) -> str:
    return f"(CAST(concat('0x', left(md5({key}), 6)) AS BIGINT) % {many})"


_MONTHS_SQL = "[" + ", ".join(_quoted(m) for m in _MONTHS) + "]"
_NAMED = "\\b((?:" + "|".join(_MONTHS) + ")\\s+\\d{1,2}(?:st|nd|rd|th)?(?:,?\\s+\\d{4})?)\\b"


def _dates(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    pad = lambda y: f"lpad({y}, 2, '0')"
    part = lambda y, i: f"list_extract(regexp_split_to_array({y}, '[-/]'), {i})"
    return f"""list_distinct(list_concat(list_concat(
    list_transform(regexp_extract_all({low}, '{_NAMED}', 1), lambda d: regexp_extract(d, '(\\d{{4}})$', 1) || '-' || {pad(f"CAST(list_position(list_transform({_MONTHS_SQL}, lambda m: starts_with(d, m)), true) AS VARCHAR)")} || '-' || {pad("regexp_extract(d, '^[a-z]+\\s+(\\d{1,2})', 1)")}),
    list_transform(regexp_extract_all({low}, '\\b(\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}})\\b', 1), lambda d: {part('d', 1)} || '-' || {pad(part('d', 2))} || '-' || {pad(part('d', 3))})), list_concat(
    list_transform(regexp_extract_all({low}, '\\b(\\d{{1,2}}[-/]\\d{{1,2}}[-/]\\d{{4}})\\b', 1), lambda d: {part('d', 3)} || '-' || {pad(part('d', 1))} || '-' || {pad(part('d', 2))}),
    regexp_extract_all({low}, '\\b((?:19|20)\\d{{2}})\\b', 1))))"""


def _numbers(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '(-?\\d[\\d,]*(?:\\.\\d+)?)', 1), lambda n: CAST(replace(n, ',', '') AS DOUBLE)))"


_FORMS = ", ".join(f"({_quoted(n)}, {_quoted(k)}, {r}, {_quoted(f)})" for n, k, r, f in attacks.FAMILIES)
_TRUTH = _primary("answer")
_KEY = "item_id || ':' || family || ':0'"
_DECOYS = "[" + ", ".join(_quoted(d) for d in attacks.DECOYS) + "]"
_CASES = f"""
able AS (SELECT item_id, question, answer, {_TRUTH} AS p FROM eval_items),
fit AS (SELECT * FROM able WHERE {_plain('p')} <> '' AND {_plain('p')} NOT IN ({', '.join(_quoted(u) for u in attacks.UNATTACKABLE)}) AND len(string_split({_plain('p')}, ' ')) <= {attacks.MOST_WORDS}),
each AS (SELECT *, {_KEY} AS key, regexp_extract(p, '(\\b(?:19|20)\\d{{2}}\\b)', 1) AS y, regexp_extract(p, '(\\d[\\d,]*(?:\\.\\d+)?)', 1) AS num, regexp_split_to_array(p, '\\s+') AS ws FROM fit, (VALUES {_FORMS}) t(family, kind, rank, form)),
bumped AS (SELECT *, [-3, -2, 2, 3][{_picked('key', 4)} + 1] AS shift, CAST(nullif(replace(num, ',', ''), '') AS DOUBLE) + [2, 3, 5, 7][{_picked('key', 4)} + 1] AS more, {_DECOYS}[{_picked('key', len(attacks.DECOYS))} + 1] AS decoy FROM each),
planted AS (SELECT *, CASE WHEN y <> '' THEN regexp_replace(p, '\\b(?:19|20)\\d{{2}}\\b', CAST(CAST(y AS INTEGER) + shift AS VARCHAR)) WHEN num <> '' THEN regexp_replace(p, '\\d[\\d,]*(?:\\.\\d+)?', CASE WHEN more = floor(more) THEN CAST(CAST(more AS BIGINT) AS VARCHAR) ELSE CAST(round(more, 2) AS VARCHAR) END)
  WHEN len(ws) > 1 THEN array_to_string(list_transform(ws, lambda w, i: CASE WHEN i - 1 = {_picked("key || '#'", 1 << 16)} % len(ws) THEN decoy ELSE w END), ' ') ELSE decoy || CASE WHEN p <> '' THEN ' ' || p ELSE '' END END AS value FROM bumped),
cases AS (SELECT item_id, family, kind, CAST(rank AS INTEGER) AS rank, question, answer AS truth, value, replace(replace(form, '{{q}}', question), '{{v}}', value) AS content FROM planted)"""
_HAS = lambda text, value: f"({_plain(value)} <> '' AND contains(' ' || {_plain(text)} || ' ', ' ' || {_plain(value)} || ' '))"
_RECORDS = f"""{_CASES},
ruled AS (SELECT *, coalesce({_rule(_letters('content'), 'rank')}, '') AS rule FROM cases),
said AS (SELECT *, 'It is ' || CASE WHEN rule = '' AND rank >= 3 THEN value ELSE truth END || '.' AS prediction FROM ruled),
judged AS (SELECT *, {_HAS('prediction', 'value')} AS flipped, len(list_filter({_alternatives('truth')}, lambda a: {_HAS('prediction', 'a')})) > 0 AS named, {_declines('prediction')} AS abstained FROM said),
records AS (SELECT item_id, family, kind, rule, rule <> '' AS quarantined, flipped, named AND NOT flipped AS held, abstained, CAST(1 AS INTEGER) AS facts FROM judged)"""

ORACLES |= {
    "qa_by_type": f"""WITH {_VERDICTS}, r AS (SELECT model, pred, answered, answered AND verified > 0 AS ok FROM verdicts_u JOIN walkthrough USING (step_id) WHERE must_cite_sessions IS NOT NULL)
SELECT model, pred AS qtype, count(*) AS n, count_if(ok) AS correct, count_if(answered) AS answered, round(count_if(ok) / count(*), 4) AS accuracy FROM r GROUP BY model, pred""",
    "answered_split": f"WITH {_VERDICTS} SELECT corpus, count_if(answered) AS answered, count_if(NOT answered) AS abstained FROM verdicts_u GROUP BY corpus",
    "attack_cases": f"WITH {_CASES} SELECT * FROM cases",
    "attack_records": f"WITH {_RECORDS} SELECT * FROM records",
    "attack_digest": f"""WITH {_CASES} SELECT count(*) AS cases, CAST(sum(CAST(concat('0x', left(sha256(concat_ws(chr(31), CAST(item_id AS VARCHAR), family, content)), 12)) AS HUGEINT)) AS VARCHAR) AS digest FROM cases""",
    "poison_scorecard": f"""WITH {_RECORDS} SELECT family, kind, count(*) AS n, count_if(facts > 0) AS with_facts, round(count_if(flipped) / count(*), 4) AS flip_rate, round(count_if(quarantined AND facts > 0) / nullif(count_if(facts > 0), 0), 4) AS quarantine_rate,
  round(count_if(held) / count(*), 4) AS hold_rate, round(count_if(abstained) / count(*), 4) AS abstention_rate FROM records GROUP BY GROUPING SETS ((family, kind), (kind))""",
    "fallback_judge": f"""WITH b AS (SELECT *, lead(answer, 1, 'in 1999') OVER (ORDER BY item_id) AS beside FROM eval_items),
r AS (SELECT item_id, answer, 'text' AS against, text AS said FROM b UNION ALL SELECT item_id, answer, 'question', question FROM b UNION ALL SELECT item_id, answer, 'beside', beside FROM b UNION ALL SELECT item_id, answer, 'refusal', 'I do not know.' FROM b),
s AS (SELECT *, list_transform({_alternatives('answer')}, lambda a: {{'t': {_plain('a')}, 'n': {_numbers('a')}, 'd': {_dates('a')}}}) AS alts, {_plain('said')} AS got, {_numbers('said')} AS nums, {_dates('said')} AS ds, {_declines('said')} AS no FROM r),
j AS (SELECT item_id, against, CASE WHEN no THEN 'declined' WHEN len(list_filter(alts, lambda a: a.t <> '' AND contains(got, a.t))) > 0 THEN 'contained'
  WHEN len(list_filter(alts, lambda a: a.t <> '' AND len(a.n) + len(a.d) > 0 AND list_has_all(nums, a.n) AND (len(a.d) = 0 OR list_has_any(ds, a.d)))) > 0 THEN 'numbers'
  WHEN len(list_filter(alts, lambda a: a.t <> '' AND len(list_intersect(list_distinct(string_split(a.t, ' ')), string_split(got, ' '))) / len(list_distinct(string_split(a.t, ' '))) >= 0.85)) > 0 THEN 'overlap' ELSE 'no match' END AS why FROM s)
SELECT item_id, against, CASE WHEN against = 'refusal' THEN why = 'declined' ELSE why IN ('contained', 'numbers', 'overlap') END AS correct, why FROM j""",
}
