"""The SQL that each query of ``reference_queries`` must equal, as DuckDB runs it."""

from __future__ import annotations

from veritrail.functions.text import ABSTENTIONS, ACCENTED, PLAIN, STOPWORDS, stem_sql
from veritrail.operators.names import PROPER

_STOP = ", ".join(f"'{s}'" for s in STOPWORDS)
_NOT_STOP = f"list_filter(regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}]+'), lambda w: w NOT IN ({_STOP}))"


def _fold(x: str) -> str:
    return f"replace(translate(lower({x}), '{ACCENTED}', '{PLAIN}'), 'ß', 'ss')"


def _ek(x: str) -> str:
    a = f"regexp_replace({_fold(x)}, '[''’`]s\\b', '', 'g')"
    b = f"regexp_replace({a}, '([\\p{{L}}\\p{{N}}_])[''’`](\\s|$)', '\\1\\2', 'g')"
    c = f"trim(regexp_replace(regexp_replace({b}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"regexp_replace({c}, '^((the|a|an) )+', '')"


def _pk(x: str) -> str:
    return f"regexp_replace(regexp_replace({_fold(x)}, '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _ck(s: str, p: str, o: str) -> str:
    return f"concat_ws('|', {_ek(s)}, {_pk(p)}, {_ek(o)})"


def _plain(x: str) -> str:
    a = f"regexp_replace(lower(coalesce({x}, '')), '[’''`]', '', 'g')"
    b = f"regexp_replace({a}, '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g')"
    return f"array_to_string(list_filter(regexp_split_to_array({b}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def _declines(x: str) -> str:
    return f"({_plain(x)} = '' OR " + " OR ".join(f"contains({_plain(x)}, '{p}')" for p in ABSTENTIONS) + ")"


_FACTS = "facts_u AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY vfrom) = 1)"
_TURNS = "turns_u AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY ts) = 1)"
_VERDICTS = "verdicts_u AS (SELECT * FROM verdicts QUALIFY row_number() OVER (PARTITION BY verdict_id ORDER BY ts) = 1)"
_ASKED = "asked AS (SELECT * FROM walkthrough WHERE step_id % 100 = 0)"

_POSTINGS = f"""tokens AS (SELECT corpus, doc_id, unnest({_NOT_STOP % 'text'}) AS w FROM documents),
stems AS (SELECT corpus, doc_id, {stem_sql('w')} AS term FROM tokens),
posted AS (SELECT corpus, doc_id, term, count(*) AS tf FROM stems WHERE term <> '' GROUP BY ALL)"""

_SEARCH = f"""
said AS (SELECT corpus, sid, idx AS tidx, max(text) AS said FROM turns_u GROUP BY ALL),
bodies AS (SELECT f.corpus, fact_id, concat_ws(' ', text, subj, pred, obj, said) AS body FROM facts_u f LEFT JOIN said s ON s.corpus = f.corpus AND s.sid = f.sid AND s.tidx = f.tidx),
sized AS (SELECT corpus, fact_id, {_NOT_STOP % 'body'} AS ws FROM bodies),
stats AS (SELECT corpus, count(*) AS n, avg(len(ws)) AS avgdl FROM sized GROUP BY corpus),
btokens AS (SELECT corpus, fact_id, len(ws) AS dl, unnest(ws) AS w FROM sized),
bterms AS (SELECT corpus, fact_id, dl, {stem_sql('w')} AS term, count(*) AS tf FROM btokens GROUP BY ALL),
qtokens AS (SELECT corpus, step_id, unnest({_NOT_STOP % 'question'}) AS w FROM asked),
qterms AS (SELECT corpus, step_id, {stem_sql('w')} AS term, count(*) AS times FROM qtokens GROUP BY ALL),
dfs AS (SELECT corpus, term, count(*) AS df FROM bterms GROUP BY ALL),
raws AS (
  SELECT step_id, fact_id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS raw
  FROM qterms JOIN bterms USING (corpus, term) JOIN dfs USING (corpus, term) JOIN stats USING (corpus) GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY raw DESC, fact_id) AS rank FROM raws),
hits AS (SELECT step_id, fact_id, round(raw / max(raw) OVER (PARTITION BY step_id), 6) AS score, rank FROM places WHERE rank <= 24)"""

_ROLE = """CASE WHEN regexp_matches(coalesce(origin, ''), '^(https?|shared-document|file)://') THEN 0
  WHEN lower(trim(coalesce(turn_role, ''))) IN ('user', 'human', 'owner') THEN 3
  WHEN lower(trim(coalesce(turn_role, ''))) IN ('assistant', 'ai', 'agent', 'bot') THEN 2
  WHEN lower(trim(coalesce(turn_role, ''))) IN ('tool', 'function', 'observation') THEN 1 ELSE 0 END"""


def _windows(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
WITH {_TURNS},
placed AS (SELECT corpus, sid, idx, unnest(range(greatest(0, CAST(floor((idx - {size} + {step}) / {step}) AS BIGINT)), CAST(floor(idx / {step}) AS BIGINT) + 1)) AS win FROM turns_u WHERE idx IS NOT NULL)
SELECT corpus, sid, win AS "window", CAST(min(idx) AS BIGINT) AS first_idx, count(*) AS turns, count(*) FILTER (WHERE win = 0 OR idx >= win * {step} + {overlap}) AS claimable
FROM placed GROUP BY corpus, sid, win HAVING count(*) FILTER (WHERE win = 0 OR idx >= win * {step} + {overlap}) > 0"""


_MERGED = f"""
{_FACTS},
rows_ AS (
  SELECT fact_id, corpus, {_ek('subj')} AS slot_subj, {_pk('pred')} AS slot_pred, {_ek('obj')} AS object, coalesce(trank, 0) AS trank, coalesce(status = 'quarantined', false) AS held_back, vfrom, coalesce(sid, '') AS sid,
    coalesce(sidx, 0) AS sidx, coalesce(tidx, 0) AS tidx, coalesce(conf, 0.0) AS conf
  FROM facts_u WHERE coalesce(status, '') <> 'retracted' AND vfrom IS NOT NULL),
claims AS (
  SELECT corpus, slot_subj, slot_pred, object, fact_id, vfrom, sidx, tidx, sid, max(trank) OVER w AS trank,
    held_back AND NOT coalesce(max(CASE WHEN NOT held_back THEN trank END) OVER w > trank, false) AS held_back,
    (SELECT count(DISTINCT x.sid) FROM rows_ x WHERE x.sid <> '' AND (x.corpus, x.slot_subj, x.slot_pred, x.object) = (rows_.corpus, rows_.slot_subj, rows_.slot_pred, rows_.object)) AS sessions, conf AS own_conf,
    slot_pred IN (SELECT pred FROM predicates WHERE arity = 'single') AS single
  FROM rows_ WINDOW w AS (PARTITION BY corpus, slot_subj, slot_pred, object)
  QUALIFY row_number() OVER (PARTITION BY corpus, slot_subj, slot_pred, object ORDER BY vfrom, sidx, tidx, fact_id) = 1),
weighed AS (SELECT *, round(least(1.0, own_conf + 0.05 * greatest(sessions - 1, 0)), 6) AS conf FROM claims)"""

# the walk itself: one step per claim of a slot, the open heads as a list
_CLAIMS = f"""{_MERGED},
steps AS (SELECT *, row_number() OVER (PARTITION BY corpus, slot_subj, slot_pred ORDER BY vfrom, sidx, tidx, fact_id) AS n, list_distinct(string_split(object, ' ')) AS ws FROM claims),
walk AS (
  SELECT corpus, slot_subj, slot_pred, n, CASE WHEN held_back THEN [] ELSE [{{'f': fact_id, 'w': ws, 'r': trank, 's': sid}}] END AS heads, CAST([] AS STRUCT(rel VARCHAR, src BIGINT, dst BIGINT)[]) AS made
  FROM steps WHERE n = 1
  UNION ALL
  SELECT corpus, slot_subj, slot_pred, n,
    CASE WHEN len(same) > 0 THEN CASE WHEN held_back THEN heads ELSE list_append(heads, me) END
      WHEN NOT single THEN CASE WHEN held_back THEN heads ELSE list_append(heads, me) END
      WHEN held_back OR len(above) > 0 THEN heads ELSE [me] END,
    CASE WHEN len(same) > 0 THEN list_transform(list_filter(same, lambda h: h.s <> '' AND sid <> '' AND h.s <> sid), lambda h: {{'rel': 'CORROBORATES', 'src': fact_id, 'dst': h.f}})
      WHEN NOT single THEN [] WHEN held_back OR len(above) > 0 THEN list_transform(heads, lambda h: {{'rel': 'CONTRADICTS', 'src': fact_id, 'dst': h.f}})
      ELSE list_transform(heads, lambda h: {{'rel': 'SUPERSEDES', 'src': fact_id, 'dst': h.f}}) END
  FROM (
    SELECT s.*, w.heads, {{'f': s.fact_id, 'w': s.ws, 'r': s.trank, 's': s.sid}} AS me, list_filter(w.heads, lambda h: h.r > s.trank) AS above,
      list_filter(w.heads, lambda h: s.object <> '' AND list_extract(h.w, 1) <> '' AND (len(h.w) < len(s.ws) AND list_has_all(s.ws, h.w) OR len(s.ws) < len(h.w) AND list_has_all(h.w, s.ws))) AS same
    FROM walk w JOIN steps s ON (s.corpus, s.slot_subj, s.slot_pred) = (w.corpus, w.slot_subj, w.slot_pred) AND s.n = w.n + 1)),
edges_ AS (SELECT m.rel, m.src, m.dst FROM (SELECT unnest(made) AS m FROM walk)),
valid AS (
  SELECT c.corpus, c.slot_subj, c.slot_pred, c.fact_id, c.vfrom, CASE WHEN n.vfrom IS NULL THEN 0 ELSE greatest(n.vfrom, c.vfrom) END AS vto
  FROM claims c LEFT JOIN edges_ e ON e.rel = 'SUPERSEDES' AND e.dst = c.fact_id LEFT JOIN claims n ON n.fact_id = e.src
  WHERE c.single AND NOT c.held_back AND c.fact_id NOT IN (SELECT src FROM edges_ WHERE rel = 'CONTRADICTS')),
degrees AS (SELECT fact_id, count(*) AS degree FROM (SELECT DISTINCT src, dst, unnest([src, dst]) AS fact_id FROM edges_ WHERE rel = 'CORROBORATES') GROUP BY fact_id)"""

_NAMES = f"""
every AS (SELECT corpus, unnest(list_concat([subj], coalesce(mentions, []))) AS name FROM facts),
names AS (SELECT corpus, {_ek('name')} AS norm, min(trim(name)) AS name FROM every WHERE name IS NOT NULL GROUP BY 1, 2 HAVING {_ek('name')} <> '')"""

_EDGES = f"""
mention AS (SELECT fact_id, corpus, unnest(mentions) AS m FROM facts_u),
edges_all AS (
  SELECT 'MENTIONS' AS rel, 'fact:' || fact_id AS src, 'entity:' || corpus || ':' || {_ek('m')} AS dst FROM mention WHERE m IS NOT NULL AND {_ek('m')} <> ''
  UNION SELECT 'DERIVED_FROM', 'fact:' || fact_id, 'turn:' || turn_id FROM facts_u f JOIN turns_u t ON t.corpus = f.corpus AND t.sid = f.sid AND t.idx = f.tidx
  UNION SELECT 'IN_SESSION', 'turn:' || turn_id, 'session:' || corpus || ':' || sid FROM turns_u WHERE sid IS NOT NULL
  UNION SELECT rel, 'fact:' || src, 'fact:' || dst FROM edges_ WHERE rel IN ('SUPERSEDES', 'CORROBORATES'))"""


def _expand(name: str, seeds: str, rels: str, hops: int) -> str:
    """CTEs that end in ``name`` (seed, node, hops, path)."""
    out = f"""
{name}_both AS (SELECT src AS node, rel, dst AS next FROM edges_all WHERE rel IN ({rels}) UNION ALL SELECT dst, rel, src FROM edges_all WHERE rel IN ({rels})),
{name}_0 AS (SELECT DISTINCT seed, node, 0 AS hops, node AS path FROM ({seeds}))"""
    for n in range(1, hops + 1):
        out += f""",
{name}_{n} AS (SELECT seed, node, min(hops) AS hops, arg_min(path, (hops, path)) AS path FROM (
  SELECT * FROM {name}_{n - 1} UNION ALL SELECT seed, next, hops + 1, path || ' ' || rel || ' ' || next FROM {name}_{n - 1} JOIN {name}_both USING (node) WHERE hops = {n - 1}) GROUP BY seed, node)"""
    return out + f",\n{name} AS (SELECT * FROM {name}_{hops})"


_PHRASES = f"""
qw AS (SELECT step_id, corpus, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+') AS ws FROM asked),
starts AS (SELECT step_id, corpus, ws, unnest(range(1, len(ws) + 1)) AS i FROM qw),
grams AS (SELECT step_id, corpus, n, i, ws[i:i + n - 1] AS g FROM starts, (VALUES (1), (2), (3)) v(n) WHERE i + n - 1 <= len(ws)),
phrase AS (
  SELECT step_id, corpus, phrase, row_number() OVER (PARTITION BY step_id ORDER BY n DESC, i) AS place FROM (
    SELECT step_id, corpus, array_to_string(g, ' ') AS phrase, n, i FROM grams WHERE len(list_filter(g, lambda w: w IN ({_STOP}) OR length(w) < 2)) = 0)
  QUALIFY row_number() OVER (PARTITION BY step_id, phrase ORDER BY n DESC, i) = 1)"""
_NAMED = f"""{_NAMES}, {_PHRASES},
named_m AS (SELECT step_id, p.corpus, norm, 1 AS pass, place FROM phrase p JOIN names n ON n.corpus = p.corpus AND n.norm = p.phrase
  UNION ALL SELECT step_id, p.corpus, norm, 2, place FROM phrase p JOIN names n ON n.corpus = p.corpus AND length(phrase) >= 4 AND starts_with(n.norm, p.phrase)),
named_b AS (SELECT step_id, corpus, norm, min((pass, place)) AS best_at FROM named_m GROUP BY ALL),
named AS (SELECT step_id, corpus, norm, best_at[1] AS pass FROM named_b QUALIFY row_number() OVER (PARTITION BY step_id ORDER BY best_at, norm) <= 12)"""
_ENTITY_SEEDS = f"SELECT step_id AS seed, 'entity:' || corpus || ':' || {_ek('subj')} AS node FROM asked WHERE subj IS NOT NULL UNION SELECT step_id, 'entity:' || corpus || ':' || norm FROM named"
_CHOSEN = "SELECT fact_id AS seed, 'fact:' || fact_id AS node FROM facts_u WHERE fact_id % 100 = 0"
_RELS = "'MENTIONS', 'DERIVED_FROM', 'SUPERSEDES', 'CORROBORATES'"
_ALL = _RELS + ", 'IN_SESSION'"
_GRAPH = f"{_CLAIMS}, {_TURNS}, {_ASKED}, {_EDGES}"

_CANDIDATES = f"""WITH RECURSIVE {_GRAPH}, {_NAMED}, {_SEARCH},
{_expand('near', _ENTITY_SEEDS, _RELS, 3)},
strong AS (SELECT * FROM hits WHERE rank <= 2 AND score >= 0.35),
{_expand('tread', "SELECT step_id AS seed, 'fact:' || fact_id AS node FROM strong", _ALL, 4)},
by_entity AS (SELECT seed AS step_id, CAST(substr(node, 6) AS BIGINT) AS fact_id, hops, path, CASE WHEN hops <= 1 THEN 1.0 ELSE 0.5 END AS anchor, 0.0 AS lexical, 0.0 AS neighbour FROM near WHERE node LIKE 'fact:%'),
by_text AS (SELECT step_id, fact_id, 1 AS hops, '~text fact:' || fact_id AS path, 0.0 AS anchor, score AS lexical, 0.0 AS neighbour FROM hits),
earlier AS (SELECT step_id, fact_id FROM by_entity UNION SELECT step_id, fact_id FROM by_text),
by_anchor AS (
  SELECT w.seed AS step_id, CAST(substr(node, 6) AS BIGINT) AS fact_id, hops, path, CASE WHEN hops <= 1 THEN 1.0 ELSE 0.5 END AS anchor, 0.0 AS lexical,
    CASE WHEN e.step_id IS NULL THEN (SELECT max(score) FROM strong s WHERE s.step_id = w.seed) ELSE 0.0 END AS neighbour
  FROM tread w LEFT JOIN earlier e ON e.step_id = w.seed AND 'fact:' || e.fact_id = w.node WHERE node LIKE 'fact:%'),
found AS (SELECT step_id, fact_id, min(hops) AS hops, arg_min(path, (hops, path)) AS path, max(anchor) AS anchor, max(lexical) AS lexical, max(neighbour) AS neighbour FROM (
  SELECT * FROM by_entity UNION ALL SELECT * FROM by_text UNION ALL SELECT * FROM by_anchor) GROUP BY ALL),
slots AS (SELECT fact_id, corpus, {_ek('subj')} AS ss, {_pk('pred')} AS sp, trank, status, vfrom, coalesce(vto, 0) AS vto, {_pk('pred')} IN (SELECT pred FROM predicates WHERE arity = 'single') AS single FROM facts_u),
hydrated AS (SELECT f.*, s.corpus, s.ss, s.sp, s.single, a.as_of_epoch FROM found f JOIN slots s USING (fact_id) JOIN asked a ON a.step_id = f.step_id AND a.corpus = s.corpus),
picks AS (
  SELECT DISTINCT h.step_id, h.corpus, h.ss, h.sp, m.fact_id AS target, m.vfrom FROM hydrated h JOIN slots m ON m.corpus = h.corpus AND m.ss = h.ss AND m.sp = h.sp
  WHERE h.single AND m.status IN ('active', 'superseded') AND (as_of_epoch IS NULL OR (m.vfrom <= as_of_epoch AND (m.vto = 0 OR as_of_epoch < m.vto)))),
chosen AS (SELECT * FROM picks QUALIFY row_number() OVER (PARTITION BY step_id, corpus, ss, sp ORDER BY vfrom DESC, target DESC) = 1),
resolved AS (SELECT h.step_id, CASE WHEN h.single THEN c.target ELSE h.fact_id END AS fact_id, hops, CASE WHEN h.single AND c.target <> h.fact_id THEN path || ' SUPERSEDES fact:' || c.target ELSE path END AS path, anchor, lexical, neighbour
  FROM hydrated h LEFT JOIN chosen c ON c.step_id = h.step_id AND c.corpus = h.corpus AND c.ss = h.ss AND c.sp = h.sp),
folded AS (SELECT step_id, fact_id, min(hops) AS hops, arg_min(path, (hops, path)) AS path, max(anchor) AS anchor, max(lexical) AS lexical, max(neighbour) AS neighbour FROM resolved WHERE fact_id IS NOT NULL GROUP BY ALL)"""
_WARRANT = f"""{_CANDIDATES},
good AS (
  SELECT f.*, trank, vfrom, coalesce(degree, 0) AS degree, dense_rank() OVER (PARTITION BY step_id ORDER BY vfrom) AS dr
  FROM folded f JOIN slots USING (fact_id) LEFT JOIN degrees USING (fact_id) WHERE status IN ('active', 'superseded') AND trank >= 1),
scored AS (
  SELECT *, round(0.26 * lexical + 0.10 * anchor + 0.14 * neighbour + 0.10 / (1 + hops) + 0.22 * trank / 3 + 0.06 * least(degree, 3) / 3
    + 0.12 * ((dr - 1) / greatest(1, max(dr) OVER (PARTITION BY step_id) - 1)), 6) AS score FROM good)
SELECT step_id, fact_id, rank, score, hops, lexical, path AS chain FROM (
  SELECT *, row_number() OVER (PARTITION BY step_id ORDER BY score DESC, hops, vfrom DESC, fact_id) AS rank FROM scored WHERE score >= 0.05) WHERE rank <= 64"""

_CITED = "cited AS (SELECT DISTINCT verdict_id, answered, fact_id FROM (SELECT verdict_id, answered, unnest(citations) AS fact_id FROM verdicts_u) WHERE coalesce(fact_id, 0) <> 0)"
_PLACED = "placed AS (SELECT DISTINCT corpus, sid, idx AS tidx FROM turns)"
_LOST = "lost AS (SELECT fact_id FROM facts_u f WHERE NOT EXISTS (SELECT 1 FROM placed p WHERE p.corpus = f.corpus AND p.sid = f.sid AND p.tidx = f.tidx))"

ORACLES = {
    "postings_build": f"WITH {_POSTINGS} SELECT * FROM posted",
    "tokenize_stem": f"WITH {_POSTINGS} SELECT corpus, term, count(*) AS df, sum(tf) AS occurrences FROM posted GROUP BY corpus, term",
    "bm25_topk": f"WITH {_FACTS}, {_TURNS}, {_ASKED}, {_SEARCH} SELECT * FROM hits",
    "bm25_unindexed": f"WITH {_FACTS}, {_TURNS}, {_ASKED}, {_SEARCH} SELECT * FROM hits",
    "turns_tiered": f"""WITH {_TURNS}, ranked AS (SELECT turn_id, corpus, sid, idx, CAST(least(coalesce(trank, 0), {_ROLE}) AS INTEGER) AS rank FROM turns_u)
SELECT *, ['external', 'tool', 'assistant', 'owner'][rank + 1] AS tier FROM ranked""",
    "turn_windows": _windows(6, 2),
    "rag_chunks": _windows(4, 1),
    "session_turn_counts": f"WITH {_TURNS} SELECT corpus, sid, count(*) AS turns, min(ts) AS first_ts, max(ts) AS last_ts FROM turns_u GROUP BY corpus, sid",
    "timeline_counts": f"WITH {_FACTS} SELECT s.corpus, s.sid, s.sidx, s.title, count(f.fact_id) AS facts FROM sessions s LEFT JOIN facts_u f ON f.corpus = s.corpus AND f.sid = s.sid GROUP BY ALL",
    "source_stats": f"WITH {_TURNS} SELECT corpus, origin, count(*) AS turns, min(trank) AS rank FROM turns_u WHERE origin IS NOT NULL GROUP BY corpus, origin",
    "entity_normalize": f"WITH {_NAMES} SELECT * FROM names",
    "canonical_keys": f"WITH {_FACTS} SELECT fact_id, {_ck('subj', 'pred', 'obj')} AS ckey FROM facts_u",
    "stable_ids": "SELECT session_id, CAST(concat('0x', left(sha256(concat_ws(chr(31), 'session', corpus, sid)), 15)) AS BIGINT) AS vid FROM sessions",
    "first_seen": f"SELECT corpus, ckey, rec_id FROM (SELECT corpus, {_ck('subject', 'predicate', 'object')} AS ckey, rec_id, ingested_at FROM extracted_facts) QUALIFY row_number() OVER (PARTITION BY corpus, ckey ORDER BY ingested_at, rec_id) = 1",
    "fact_dedupe_merge": f"""
WITH records AS (SELECT corpus, {_ek('subject')} AS subj, {_pk('predicate')} AS pred, {_ek('object')} AS obj, sid, valid_from, conf, entities FROM extracted_facts QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at) = 1)
SELECT corpus, subj, pred, obj, count(*) AS records, count(DISTINCT sid) AS sessions, min(valid_from) AS vfrom,
  round(least(1.0, max(conf) + 0.05 * greatest(count(DISTINCT sid) - 1, 0)), 6) AS conf, CAST(len(list_distinct(list_filter(flatten(list(coalesce(entities, []))), lambda e: e IS NOT NULL))) AS INTEGER) AS n_entities
FROM records GROUP BY corpus, subj, pred, obj""",
    "reconcile_edges": f"WITH RECURSIVE {_CLAIMS} SELECT rel, src, dst FROM edges_",
    "reconcile_contradict": f"WITH RECURSIVE {_CLAIMS} SELECT src AS newer, dst AS standing FROM edges_ WHERE rel = 'CONTRADICTS'",
    "validity_intervals": f"WITH RECURSIVE {_CLAIMS} SELECT fact_id, vfrom, vto FROM valid",
    "current_facts": f"WITH RECURSIVE {_CLAIMS} SELECT corpus, slot_subj AS subj, slot_pred AS pred, fact_id FROM valid WHERE vto = 0",
    "lineage_depth": f"""WITH RECURSIVE {_CLAIMS}, down AS (SELECT src, max(dst) AS dst FROM edges_ WHERE rel = 'SUPERSEDES' GROUP BY src), up AS (SELECT dst AS src, max(src) AS dst FROM edges_ WHERE rel = 'SUPERSEDES' GROUP BY dst),
below AS (SELECT src, dst, 1 AS d FROM down UNION ALL SELECT b.src, s.dst, d + 1 FROM below b JOIN down s ON s.src = b.dst),
above AS (SELECT src, dst, 1 AS d FROM up UNION ALL SELECT b.src, s.dst, d + 1 FROM above b JOIN up s ON s.src = b.dst),
b AS (SELECT src, max(d) AS d, arg_max(dst, d) AS e FROM below GROUP BY src), a AS (SELECT src, max(d) AS d, arg_max(dst, d) AS e FROM above GROUP BY src)
SELECT coalesce(b.src, a.src) AS fact_id, CAST(coalesce(b.d, 0) AS BIGINT) AS older, CAST(coalesce(a.d, 0) AS BIGINT) AS newer, coalesce(b.e, a.src) AS oldest, coalesce(a.e, b.src) AS head FROM b FULL JOIN a ON a.src = b.src""",
    "facts_as_of": """SELECT corpus, subj, pred, fact_id FROM facts WHERE status IN ('active', 'superseded') AND vfrom <= 1735689600 AND (coalesce(vto, 0) = 0 OR vto > 1735689600)
QUALIFY row_number() OVER (PARTITION BY corpus, subj, pred ORDER BY vfrom DESC, fact_id DESC) = 1""",
    "corroboration_degree": f"WITH RECURSIVE {_CLAIMS} SELECT * FROM degrees",
    "claims_merged": f"WITH {_MERGED} SELECT corpus, slot_subj AS subj, slot_pred AS pred, object, fact_id, trank, conf, held_back, sessions, single FROM weighed",
    "claim_confidence": f"WITH RECURSIVE {_CLAIMS} SELECT fact_id, round(least(1.0, conf + 0.05 * coalesce(degree, 0)), 6) AS conf FROM weighed LEFT JOIN degrees USING (fact_id)",
    "entity_exact_prefix": f"WITH {_ASKED}, {_NAMED} SELECT step_id, norm, pass FROM named",
    "alias_fold": f"""WITH RECURSIVE every AS (SELECT corpus, unnest(list_concat(list_concat([subj], coalesce(mentions, [])), [obj])) AS name FROM facts),
names AS (SELECT corpus, {_ek('name')} AS norm, min(trim(name)) AS name FROM every WHERE name IS NOT NULL GROUP BY 1, 2 HAVING {_ek('name')} <> ''),
proper AS (SELECT corpus, norm, string_split(norm, ' ') AS parts FROM names WHERE regexp_matches(name, '{PROPER}')),
heads AS (SELECT corpus, norm, cut, array_to_string(parts[1:cut], ' ') AS target FROM (SELECT *, unnest(range(1, len(parts))) AS cut FROM proper WHERE len(parts) BETWEEN 2 AND 4)),
nearest AS (SELECT h.corpus, h.norm, h.target FROM heads h JOIN proper p ON p.corpus = h.corpus AND p.norm = h.target QUALIFY row_number() OVER (PARTITION BY h.corpus, h.norm ORDER BY cut DESC) = 1),
found AS (SELECT corpus, min(norm) AS norm, target FROM nearest GROUP BY corpus, target HAVING count(*) = 1),
stated AS (SELECT n.corpus, n.norm, m.norm AS target FROM names n JOIN names m ON m.corpus = n.corpus AND m.norm = string_split(n.norm, ' ')[1] WHERE len(string_split(n.norm, ' ')) = 2),
links AS (SELECT * FROM stated UNION ALL SELECT corpus, norm, target FROM found f WHERE NOT EXISTS (SELECT 1 FROM stated s WHERE s.corpus = f.corpus AND s.norm = f.norm)),
walk AS (SELECT corpus, norm, target, 1 AS n FROM links UNION ALL SELECT w.corpus, w.norm, l.target, n + 1 FROM walk w JOIN links l ON l.corpus = w.corpus AND l.norm = w.target WHERE n < 20)
SELECT corpus, norm, target FROM walk w WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.corpus = w.corpus AND l.norm = w.target)""",
    "graph_edges": f"WITH RECURSIVE {_GRAPH} SELECT * FROM edges_all",
    "paths_bounded": f"WITH RECURSIVE {_GRAPH}, {_NAMED}, {_expand('near', _ENTITY_SEEDS, _RELS, 3)} SELECT * FROM near",
    "anchor_expand": f"WITH RECURSIVE {_GRAPH}, {_expand('near', _CHOSEN, _ALL, 4)} SELECT * FROM near",
    # an edge is on a way of two steps if one of its ends is at most one step away
    "neighbourhood": f"""WITH RECURSIVE {_GRAPH}, {_NAMED}, {_expand('near', f"SELECT node AS seed, node FROM ({_ENTITY_SEEDS}) UNION SELECT node, node FROM ({_CHOSEN})", _RELS, 1)}
SELECT seed, rel, src, dst FROM near JOIN edges_all ON node = src WHERE rel IN ({_RELS}) UNION SELECT seed, rel, src, dst FROM near JOIN edges_all ON node = dst WHERE rel IN ({_RELS})""",
    "warrant_rank": _WARRANT,
    "warrant_counts": f"""{_CANDIDATES}, h AS (SELECT step_id, count(*) AS considered FROM hydrated GROUP BY step_id), s AS (SELECT step_id, status = 'quarantined' OR coalesce(trank, 0) < 1 AS off, status IN ('active', 'superseded') AS fit FROM folded JOIN slots USING (fact_id)),
c AS (SELECT step_id, count_if(off) AS refused, count_if(NOT off AND fit) AS warrantable FROM s GROUP BY step_id)
SELECT step_id, considered, coalesce(refused, 0) AS refused, coalesce(warrantable, 0) AS warrantable FROM h LEFT JOIN c USING (step_id)""",
    "orphans": f"WITH {_FACTS}, {_PLACED}, {_LOST} SELECT fact_id FROM lost",
    "dangling_edges": f"WITH {_VERDICTS}, {_CITED} SELECT verdict_id, fact_id FROM cited WHERE fact_id NOT IN (SELECT fact_id FROM facts)",
    "leaked_citations": f"WITH {_VERDICTS}, {_CITED} SELECT verdict_id, fact_id FROM cited WHERE answered AND fact_id IN (SELECT fact_id FROM facts WHERE status = 'quarantined')",
    "integrity_report": f"""WITH {_FACTS}, {_VERDICTS}, {_PLACED}, {_LOST}, {_CITED}, counts AS (
  SELECT (SELECT count(*) FROM facts_u) AS facts, (SELECT count(*) FROM lost) AS orphans, (SELECT count(*) FROM cited WHERE fact_id NOT IN (SELECT fact_id FROM facts)) AS dangling,
    (SELECT count(*) FROM cited WHERE answered AND fact_id IN (SELECT fact_id FROM facts WHERE status = 'quarantined')) AS leaked)
SELECT *, orphans = 0 AND dangling = 0 AND leaked = 0 AS ok FROM counts""",
    "history_topn": f"WITH {_VERDICTS} SELECT verdict_id, question, answered, ts FROM verdicts_u LEFT JOIN walkthrough USING (step_id) ORDER BY ts DESC, verdict_id LIMIT 20",
    "rejections_topn": f"""WITH {_TURNS}, r AS (SELECT * FROM rejections QUALIFY row_number() OVER (PARTITION BY rejection_id ORDER BY ts) = 1)
SELECT rejection_id, rule_id, turn_role, r.ts FROM r LEFT JOIN turns_u USING (turn_id) ORDER BY r.ts DESC, rejection_id LIMIT 50""",
    "tier_floor_matrix": """SELECT CAST(a AS INTEGER) AS rank, CAST(b AS INTEGER) AS target, op, NOT (op <> 'assert' AND a < b) AS admitted
FROM range(4) x(a), range(4) y(b), (VALUES ('assert'), ('contradict'), ('retract'), ('supersede')) o(op)""",
    "citation_membership": f"""WITH {_FACTS}, {_VERDICTS}, c AS (SELECT DISTINCT verdict_id, fact_id FROM (SELECT verdict_id, unnest(citations) AS fact_id FROM verdicts_u) WHERE fact_id IS NOT NULL)
SELECT verdict_id, count(*) AS cited, count(*) FILTER (WHERE status IN ('active', 'superseded') AND trank >= 1) AS warrantable FROM c LEFT JOIN facts_u USING (fact_id) GROUP BY verdict_id""",
    "qa_scorecard": f"""WITH {_VERDICTS}, r AS (SELECT model, must_cite_sessions IS NULL AS off, NOT answered AS no, answered AND verified > 0 AS yes, latency_ms FROM verdicts_u LEFT JOIN walkthrough USING (step_id)),
s AS (SELECT model, count(*) AS n, count_if(NOT off) AS answerable, count_if(off) AS abstention_items, count_if(NOT off AND yes) AS a, count_if(no) AS d, count_if(off AND no) AS e, count_if(off AND NOT no AND NOT yes) AS h, count_if(NOT off AND no) AS o, avg(CASE WHEN latency_ms > 0 THEN latency_ms END) AS l FROM r GROUP BY model)
SELECT model, n, answerable, abstention_items, round(a / nullif(answerable, 0), 4) AS accuracy, round(e / nullif(abstention_items, 0), 4) AS abstention_recall, round(e / nullif(d, 0), 4) AS abstention_precision,
  round(h / nullif(abstention_items, 0), 4) AS hallucination_rate, round(o / nullif(answerable, 0), 4) AS over_refusal_rate, round(l, 1) AS mean_latency_ms FROM s""",
    "dataset_stats": "SELECT corpus, count(*) AS sessions, min(n_turns) AS least, max(n_turns) AS most, round(avg(n_turns), 4) AS mean, count_if(coalesce(title, '') = '') AS untitled FROM sessions GROUP BY corpus",
    "abstention_detect": f"WITH {_VERDICTS} SELECT verdict_id, {_declines('answer')} AS declines FROM verdicts_u",
    "stratified_sample": """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS pool FROM c),
e AS (SELECT source, n, floor(200 * n / pool) AS base, round(200 * n / pool - floor(200 * n / pool), 12) AS rest FROM c, t),
q AS (SELECT source, least(n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= 200 - (SELECT sum(base) FROM e) THEN 1 ELSE 0 END) AS quota FROM e)
SELECT doc_id, source FROM documents JOIN q USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) <= quota""",
    "question_sample": """WITH r AS (SELECT step_id, coalesce(pred, '') AS pred, must_cite_sessions IS NULL AS off FROM walkthrough), n AS (SELECT count(*) AS n, count_if(off) AS o FROM r),
p AS (SELECT n, least(o, greatest(8, CAST(floor(60 * o / n + 0.5) AS BIGINT)), 60) AS places FROM n), c AS (SELECT pred, count(*) AS n FROM r WHERE NOT off GROUP BY pred), t AS (SELECT sum(n) AS pool FROM c),
e AS (SELECT pred, c.n, (60 - places) * c.n / pool AS exact FROM c, t, p), f AS (SELECT pred, n, floor(exact) AS base, round(exact - floor(exact), 12) AS rest FROM e),
q AS (SELECT pred, least(n, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, pred) <= (SELECT 60 - places FROM p) - (SELECT sum(base) FROM f) THEN 1 ELSE 0 END) AS quota FROM f),
a AS (SELECT step_id FROM r WHERE off QUALIFY row_number() OVER (ORDER BY md5('0:' || step_id), step_id) <= (SELECT places FROM p)),
b AS (SELECT step_id FROM r JOIN q USING (pred) WHERE NOT off QUALIFY row_number() OVER (PARTITION BY pred ORDER BY md5('0:' || step_id), step_id) <= quota)
SELECT * FROM r WHERE (SELECT n FROM n) <= 60 OR step_id IN (SELECT step_id FROM a UNION SELECT step_id FROM b)""",
    "entities_resolved": f"""WITH {_FACTS}, {_NAMES}, l AS (SELECT corpus, norm, list_extract(string_split(norm, ' '), -1) AS last FROM names), alone AS (SELECT corpus, last, min(norm) AS norm FROM l GROUP BY corpus, last HAVING count(*) = 1),
e AS (SELECT fact_id, corpus, unnest(mentions) AS m, generate_subscripts(mentions, 1) AS i FROM facts_u), k AS (SELECT fact_id, e.corpus, i, {_ek('m')} AS norm FROM e WHERE m IS NOT NULL AND {_ek('m')} <> ''),
r AS (SELECT fact_id, min(i) AS i, coalesce(a.last, k.norm) AS norm FROM k LEFT JOIN alone a ON a.corpus = k.corpus AND a.norm = k.norm GROUP BY fact_id, coalesce(a.last, k.norm))
SELECT fact_id, array_to_string(list(norm ORDER BY i), '; ') AS names FROM r GROUP BY fact_id""",
    "citation_changes": f"""WITH {_VERDICTS}, l AS (SELECT step_id, ts, verdict_id, list_distinct(list_filter(coalesce(citations, []), lambda c: c IS NOT NULL)) AS c FROM verdicts_u WHERE step_id IS NOT NULL),
e AS (SELECT step_id, arg_min(c, (ts, verdict_id)) AS a, arg_max(c, (ts, verdict_id)) AS z FROM l GROUP BY step_id HAVING count(*) > 1)
SELECT step_id, CAST(len(list_filter(z, lambda x: NOT list_contains(a, x))) AS INTEGER) AS gained, CAST(len(list_filter(a, lambda x: NOT list_contains(z, x))) AS INTEGER) AS lost FROM e""",
    "extractive_gate": f"""WITH found_w AS ({_WARRANT}),
asked_w AS (SELECT step_id, question, coalesce(subj, '') AS subj FROM walkthrough WHERE step_id % 100 = 0), facts_w AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY vfrom) = 1),
ends AS (SELECT a.step_id, a.fact_id FROM found_w a LEFT JOIN found_w b ON b.step_id = a.step_id AND b.rank = 2 WHERE a.rank = 1 AND a.score >= 0.45 AND (b.score IS NULL OR a.score - b.score >= 0.08)),
qw AS (SELECT step_id, unnest({_NOT_STOP % 'question'}) AS w FROM asked_w), nw AS (SELECT step_id, unnest({_NOT_STOP % 'subj'}) AS w FROM asked_w),
want AS (SELECT step_id, {stem_sql('w')} AS t FROM qw EXCEPT SELECT step_id, {stem_sql('w')} FROM nw),
bw AS (SELECT fact_id, unnest({_NOT_STOP % "replace(concat_ws(' ', text, subj, pred, obj), '_', ' ')"}) AS w FROM facts_w), body AS (SELECT DISTINCT fact_id, {stem_sql('w')} AS t FROM bw)
SELECT e.step_id, e.fact_id FROM ends e JOIN want w ON w.step_id = e.step_id LEFT JOIN body b ON b.fact_id = e.fact_id AND b.t = w.t GROUP BY ALL HAVING count(b.t) / count(*) >= 0.5""",
    "walkthrough_check": f"""WITH {_VERDICTS}, {_FACTS}, held AS (SELECT corpus, subj, count(*) AS seen FROM facts_u WHERE status = 'quarantined' OR coalesce(trank, 0) < 1 GROUP BY ALL),
m AS (SELECT v.verdict_id, v.step_id, v.answered, must_cite_sessions AS ms, citations, coalesce(seen, 0) AS seen, coalesce(quarantined_seen_min, 0) AS least, coalesce(len(must_cite_sessions), 0) > 0 AS due
  FROM verdicts_u v JOIN walkthrough w ON w.step_id = v.step_id LEFT JOIN held h ON h.corpus = v.corpus AND h.subj = w.subj),
k AS (SELECT *, answered = due AS answers, NOT due OR coalesce((SELECT max(list_contains(ms, f.sid)) FROM facts_u f WHERE list_contains(m.citations, f.fact_id)), false) AS cites, seen >= least AS refused_enough FROM m)
SELECT verdict_id, step_id, answers, cites, refused_enough, answers AND cites AND refused_enough AS passed FROM k""",
    "evidence_lines": f"""WITH w AS ({_WARRANT}), f AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY fact_id ORDER BY vfrom) = 1)
SELECT step_id, w.fact_id, rank, f.sid, f.tidx, row_number() OVER (PARTITION BY step_id, f.corpus, f.sid, f.tidx ORDER BY rank) = 1 AS quoted FROM w JOIN f ON f.fact_id = w.fact_id""",
    "ingest_report": f"""WITH {_FACTS}, {_TURNS}, t AS (SELECT corpus, count(*) AS turns FROM turns_u GROUP BY corpus),
f AS (SELECT corpus, count(*) AS facts, count_if(status = 'quarantined') AS quarantined, count_if(status = 'superseded') AS superseded FROM facts_u GROUP BY corpus),
r AS (SELECT corpus, count(DISTINCT rejection_id) AS rejections FROM rejections GROUP BY corpus)
SELECT corpus, coalesce(turns, 0) AS turns, coalesce(facts, 0) AS facts, coalesce(quarantined, 0) AS quarantined, coalesce(superseded, 0) AS superseded, coalesce(rejections, 0) AS rejections
FROM t FULL JOIN f USING (corpus) FULL JOIN r USING (corpus)""",
    "paths_between": f"""WITH RECURSIVE {_GRAPH}, {_NAMED}, goals AS (SELECT DISTINCT a.step_id AS seed, 'session:' || f.corpus || ':' || f.sid AS goal FROM asked a JOIN facts_u f ON f.corpus = a.corpus AND f.subj = a.subj WHERE f.sid IS NOT NULL),
both_ AS (SELECT src AS node, rel, dst AS next FROM edges_all UNION ALL SELECT dst, rel, src FROM edges_all),
ways AS (SELECT DISTINCT seed, goal, node, [node] AS nodes, node AS path, 0 AS hops FROM ({_ENTITY_SEEDS}) JOIN goals USING (seed)
  UNION ALL SELECT seed, goal, next, list_append(nodes, next), path || ' ' || rel || ' ' || next, hops + 1 FROM ways w JOIN both_ b ON b.node = w.node WHERE hops < 4 AND w.node <> goal AND NOT list_contains(nodes, next))
SELECT DISTINCT seed, node, hops, path, row_number() OVER (PARTITION BY seed, node ORDER BY hops, path) AS n FROM (SELECT DISTINCT seed, node, hops, path FROM ways WHERE node = goal AND hops > 0) QUALIFY n <= 50""",
    "upsert_facts": f"WITH RECURSIVE {_CLAIMS} SELECT fact_id, 'accepted' AS status, vfrom FROM valid UNION ALL SELECT fact_id, status, vfrom FROM facts_u WHERE fact_id NOT IN (SELECT fact_id FROM valid)",
}
