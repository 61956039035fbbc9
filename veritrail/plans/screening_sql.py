"""SQL of the queries on screening and slots, made from the same word classes and rules."""

from __future__ import annotations

from veritrail.operators import claims, screening as sc
from veritrail.plans.reference_sql import _CLAIMS, _FACTS, _TURNS, _pk


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _plain(x: str) -> str:
    x = f"translate(coalesce({x}, ''), {_quoted(sc._FROM)}, {_quoted(sc._TO)})"
    for a, b in sc._expanding():
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    x = f"translate(regexp_replace({x}, '\\p{{Cf}}', '', 'g'), {_quoted(sc.QUOTES)}, {_quoted(sc.PLAIN_QUOTES)})"
    return f"trim(regexp_replace(regexp_replace({x}, '[^\\S\\n]+', ' ', 'g'), '\\n{{2,}}', chr(10), 'g'))"


def _letters(x: str) -> str:
    x = f"lower({_plain(x)})"
    for pattern, token in sc.MARKS:
        x = f"regexp_replace({x}, {_quoted(pattern)}, {_quoted(token.replace('$1', chr(92) + '1'))}, 'g')"
    cases = " ".join(f"WHEN w IN ({_list(words.split())}) THEN '{sc.LETTERS[name]}'" for name, words in sc.CLASSES.items())
    return f"array_to_string(list_transform(regexp_extract_all({x}, {_quoted(sc.TOKEN)}), lambda w: CASE {cases} ELSE '{sc.OTHER}' END), '')"


def _rule(letters: str, rank: str | None) -> str:
    cases = " ".join(f"WHEN regexp_matches({letters}, {_quoted(sc.rule_pattern(patterns))})" + (f" AND coalesce({rank}, 0) <= {highest}" if rank and highest < 3 else "") + f" THEN '{name}'" for name, highest, _, _, patterns in sc.RULES)
    return f"CASE {cases} END"


_STATES = f"(k IN ({_list(sc.IDENTITY)}) OR regexp_matches(k, '^({'|'.join(sc.IDENTITY_STARTS)})_.') OR regexp_matches(k, '{'|'.join(sc.CREDENTIAL_PARTS)}'))"
_FORGED = f"coalesce(coalesce(trank, 0) <= 1 AND lower(trim(subj)) IN ({_list(sc.PRINCIPALS)}) AND {_STATES}, false)"
_READ = f"read_ AS (SELECT *, {_pk('pred')} AS k, {_letters('text')} AS l1, {_letters('obj')} AS l2 FROM facts_u)"
_DECIDED = f"coalesce({_rule('l1', None)}, {_rule('l2', None)}, CASE WHEN {_FORGED} THEN 'identity-forgery' END, CASE WHEN trank < target THEN 'tier-floor' END)"
_REASONS = " ".join(f"WHEN '{n}' THEN {_quoted(why)}" for n, why in [(n, why) for n, _, _, why, _ in sc.RULES] + [(n, why) for n, _, _, why in sc.STRUCTURAL])
_TIER = "CASE tier WHEN 'owner' THEN 3 WHEN 'assistant' THEN 2 WHEN 'tool' THEN 1 WHEN 'external' THEN 0 END"
_ORDER = " ".join(f"WHEN '{n}' THEN {i}" for i, (n, *_) in enumerate(sc.RULES))

_SYN = ", ".join(f"('{k}', '{v}')" for k, v in claims.SYNONYMS.items())

ORACLES = {
    "policy_screen": f"""WITH {_TURNS}, t AS (SELECT 'turns' AS src, turn_id AS rec_id, trank AS r, {_letters('text')} AS l FROM turns_u UNION ALL SELECT 'injected_turns', inj_id, {_TIER}, {_letters('content')} FROM injected_turns)
SELECT * FROM (SELECT src, rec_id, {_rule('l', 'r')} AS rule FROM t) WHERE rule IS NOT NULL""",
    "policy_rules": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {_quoted(n)}, 'content', {h}, {_quoted(s)}, {_quoted(why)}, {_quoted('; '.join(p))})" for i, (n, h, s, why, p) in enumerate(sc.RULES)
    ) + ", " + ", ".join(f"({len(sc.RULES) + i}, {_quoted(n)}, 'structural', {h}, {_quoted(s)}, {_quoted(why)}, '')" for i, (n, h, s, why) in enumerate(sc.STRUCTURAL)) + ') t(position, rule, kind, max_rank, summary, reason, patterns)',
    "admission_decisions": f"""WITH RECURSIVE {_CLAIMS}, {_READ}, met AS (SELECT src, max(trank) AS target FROM edges_ JOIN facts_u ON fact_id = dst WHERE rel <> 'CORROBORATES' GROUP BY src),
d AS (SELECT fact_id, {_DECIDED} AS r FROM read_ LEFT JOIN met ON src = fact_id)
SELECT fact_id, r IS NULL AS admitted, CASE WHEN r IS NULL THEN 'active' ELSE 'quarantined' END AS status, coalesce(r, '') AS rule, CASE r {_REASONS} ELSE '' END AS reason FROM d""",
    "reconcile_refusals": f"""WITH RECURSIVE {_CLAIMS}, {_READ}, tried AS (SELECT e.src, e.dst, a.* EXCLUDE (fact_id), b.trank AS target FROM edges_ e JOIN read_ a ON a.fact_id = e.src JOIN facts_u b ON b.fact_id = e.dst WHERE e.rel = 'CONTRADICTS' AND coalesce(a.status, '') <> 'quarantined')
SELECT src, dst, coalesce({_DECIDED}, 'tier-floor') AS rule FROM tried""",
    "condemned_facts": f"""WITH {_FACTS}, {_TURNS}, t AS (SELECT corpus, sid, idx AS tidx, {_rule(_letters('text'), 'trank')} AS rule FROM turns_u),
b AS (SELECT corpus, sid, tidx, arg_min(rule, CASE rule {_ORDER} END) AS rule FROM t WHERE rule IS NOT NULL GROUP BY ALL)
SELECT fact_id, rule FROM facts_u JOIN b USING (corpus, sid, tidx)""",
    "identity_claims": f"WITH {_FACTS}, r AS (SELECT *, {_pk('pred')} AS k FROM facts_u) SELECT fact_id, pred, {_FORGED} AS forged FROM r WHERE coalesce(trank, 0) <= 1 AND k <> '' AND {_STATES}",
    "predicate_normalize": f"""WITH syn(k, v) AS (VALUES {_SYN}), said AS (SELECT DISTINCT predicate, {_pk('predicate')} AS k, regexp_replace({_pk('predicate')}, '^(has|is|have)_', '') AS b FROM extracted_facts),
f AS (SELECT predicate, s.k AS k, coalesce(m.v, s.k) AS one, coalesce(n.v, s.b) AS two FROM said s LEFT JOIN syn m ON m.k = s.k LEFT JOIN syn n ON n.k = s.b),
c AS (SELECT predicate, k, CASE WHEN one NOT IN (SELECT pred FROM predicates) AND two IN (SELECT pred FROM predicates) AND regexp_matches(k, '^(has|is|have)_') THEN two ELSE one END AS slot FROM f)
SELECT predicate, slot, CASE WHEN slot IN (SELECT pred FROM predicates) THEN slot IN (SELECT pred FROM predicates WHERE arity = 'single')
  ELSE slot <> '' AND slot NOT IN ({_list(claims.GATHERED)}) AND (slot IN ({_list([*claims.REPLACED, *claims.OF_A_PERSON, *('has_' + s for s in claims.OF_A_PERSON)])}) OR regexp_matches(slot, '^({'|'.join(claims.CHOICE)})_.')) END AS single,
  regexp_matches(k, '^({'|'.join(claims.ENDED_FIRST)})_') OR regexp_matches(k, '_({'|'.join(claims.ENDED_LAST)})$') AS ended FROM c""",
    # newest first; a turn that would break the budget is skipped, the first one never
    "token_budget": f"""WITH RECURSIVE {_TURNS}, t AS (SELECT corpus, sid, greatest(1, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT)) AS cost, row_number() OVER (PARTITION BY corpus, sid ORDER BY idx DESC, turn_id) AS n FROM turns_u WHERE idx IS NOT NULL),
f AS (SELECT corpus, sid, n, cost AS used, CAST(1 AS BIGINT) AS kept FROM t WHERE n = 1
  UNION ALL SELECT t.corpus, t.sid, t.n, CASE WHEN f.used + cost <= 40 THEN f.used + cost ELSE f.used END, CASE WHEN f.used + cost <= 40 THEN kept + 1 ELSE kept END
  FROM f JOIN t ON t.corpus IS NOT DISTINCT FROM f.corpus AND t.sid IS NOT DISTINCT FROM f.sid AND t.n = f.n + 1)
SELECT corpus, sid, arg_max(used, n) AS used, arg_max(kept, n) AS kept, max(n) - arg_max(kept, n) AS dropped FROM f GROUP BY corpus, sid""",
}
