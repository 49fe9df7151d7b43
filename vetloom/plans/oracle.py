"""SQL statements of the registered queries' rules, for an engine that is not Spark."""

from __future__ import annotations

from vetloom.functions import lexicons as L
from vetloom.plans import bindings as B


def strings(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def inlist(items) -> str:
    return "(" + strings(items)[1:-1] + ")"


CUES = "|".join(L.NEGATION_CUES)
NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
DOCS = f"WITH docs AS ({B.DOCS}), n AS (SELECT doc_id, text, {NORM} AS norm FROM docs)"


def hits(words, column="norm") -> str:
    return f"list_filter({strings(words)}, lambda p: contains({column}, p))"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^\\s+|\\s+$', '', 'g')"


def some(words, column="norm") -> str:
    return f"(len({hits(words, column)}) > 0)"


def maximal(h: str) -> str:
    return f"list_filter({h}, lambda x: len(list_filter({h}, lambda y: y <> x AND contains(y, x))) = 0)"




def unnegated(p: str) -> str:
    """The phrase, where some occurrence has no cue in the 40 characters before it; else null."""
    parts = f"string_split(norm, '{p}')"
    before = f"right(array_to_string(list_slice({parts}, 1, i), '{p}'), 40)"
    return f"CASE WHEN contains(norm, '{p}') AND len(list_filter(range(1, len({parts})), lambda i: NOT regexp_matches({before}, '{CUES}'))) > 0 THEN '{p}' END"


UNNEGATED = f"list_filter([{', '.join(map(unnegated, L.DATA_SIGNALS))}], lambda x: x IS NOT NULL)"

EVIDENCE = f""", h AS (SELECT doc_id, text, norm, {UNNEGATED} AS d0, {hits(L.EXPERIENCE_SIGNALS)} AS e0 FROM n),
ev AS (SELECT doc_id, {maximal("d0")} AS d, {maximal("e0")} AS e FROM h),
verdicts AS (SELECT doc_id, d, e, CASE WHEN len(e) > 0 AND len(d) = 0 THEN 'experience_report' WHEN len(d) > 0 AND len(e) > len(d) THEN 'experience_leaning'
WHEN len(d) > 0 THEN 'data_driven' ELSE 'undetermined' END AS verdict FROM ev),
exper AS (SELECT *, CASE verdict WHEN 'experience_report' THEN 5 WHEN 'experience_leaning' THEN 3 ELSE 0 END AS score FROM verdicts)"""

LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
REFERENCES = f"""(regexp_matches(norm, '\\breferences?\\b|\\bbibliography\\b|\\breference list\\b|\\bworks cited\\b|\\bliterature cited\\b')
OR regexp_matches(lower(array_to_string(list_reverse(list_slice(list_reverse({LINES}), 1, 80)), ' ')), '\\breferences?|\\bbibliography\\b|works cited|literature cited'))"""
CITES = "regexp_matches(norm, '\\breferences\\b|\\bbibliography\\b|\\breference list\\b')"

RED = f""", f AS (SELECT doc_id, {hits(L.RED_FLAGS)} AS found, {CITES} AS cites FROM n),
red AS (SELECT doc_id, found, CASE WHEN len(found) = 0 THEN 5 WHEN cites AND len(list_filter(found, lambda x: x NOT IN {inlist(L.AI_PHRASES)})) = 0 THEN 3 ELSE 0 END AS score FROM f)"""

_ROLL = f"""regexp_extract(regexp_extract(text, '(19\\d{{2}}|20\\d{{2}}|21\\d{{2}})'), '.*')"""
TITLES = f"list_filter(list_slice({LINES}, 1, 25), lambda x: length(x) > 15 AND NOT lower(x) LIKE 'page %' AND NOT x LIKE '===== Page %')"
META = f""", m AS (SELECT n.doc_id, coalesce(nullif(trim(meta.title), ''), {TITLES}[1], '') AS title,
coalesce(nullif(trim(meta.year), ''), {_ROLL}) AS year, has_authors, coalesce(trim(journal), '') AS journal, coalesce(trim(doi), '') AS doi FROM n JOIN ({B.META}) meta ON n.doc_id = meta.doc_id),
mm AS (SELECT *, [title <> '', has_authors, year <> '', journal <> '', doi <> ''] AS has FROM m),
meta2 AS (SELECT doc_id, title, year, 2 * len(list_filter(has, lambda x: x)) AS score,
list_filter(['title', 'authors', 'year', 'journal', 'doi'], lambda x, i: has[i]) AS found, list_filter(['title', 'authors', 'year', 'journal', 'doi'], lambda x, i: NOT has[i]) AS missing FROM mm)"""

STRUCTURE = f"({REFERENCES} AND len({hits(L.STRUCTURE_WORDS)}) = 3)"
COMMUNITY = f"({some(L.COMMUNITY_SIGNALS)} AND NOT {some(L.HARMFUL_SIGNALS)})"
ETHICS = f"({some(L.ETHICS_SIGNALS)} AND NOT {some(L.HARMFUL_SIGNALS)})"

# replies: fences and thoughts go, the widest braces are read
ITEMS = f"""r AS ({B.REPLIES}),
j AS (SELECT doc_id, chunk_idx, regexp_extract(regexp_replace(regexp_replace(raw, '```(json)?', '', 'gi'), '<think>.*?</think>', '', 'gis'), '(?s)\\{{.*\\}}') AS o FROM r),
i AS (SELECT doc_id, chunk_idx, unnest(CAST(json_extract(o, '$.criteria') AS JSON[])) AS c, generate_subscripts(CAST(json_extract(o, '$.criteria') AS JSON[]), 1) - 1 AS ord FROM j WHERE o <> ''),
items AS (SELECT doc_id, chunk_idx, CAST(ord AS BIGINT) AS ord, c ->> 'name' AS name, c ->> 'score' AS score, c ->> 'max_score' AS max_score, CAST(c -> 'flags' AS VARCHAR[]) AS flags,
CAST(c -> 'hard_fail_triggered' AS BOOLEAN) AS hard, c ->> 'justification' AS why FROM i)"""

AGGREGATE = f"""{ITEMS},
spec AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {m})" for n, m, _ in L.MODEL_CRITERIA)}) s(name, most)),
lastone AS (SELECT items.*, most FROM items JOIN spec ON items.name = spec.name QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_idx, items.name ORDER BY ord DESC) = 1),
scaled AS (SELECT *, greatest(0, least(most, CASE WHEN max_score::BIGINT > 0 AND max_score::BIGINT <> most THEN round_even(score::BIGINT / max_score::BIGINT * most, 0)::BIGINT ELSE score::BIGINT END)) AS s FROM lastone),
mean AS (SELECT doc_id, name, round_even(avg(s), 0)::BIGINT AS score, bool_or(hard) AND name <> 'Peer Review Signals' AS hard_fail_triggered FROM scaled GROUP BY doc_id, name),
near AS (SELECT scaled.doc_id, scaled.name, arg_min(why, (abs(s - mean.score), chunk_idx)) AS justification FROM scaled JOIN mean ON scaled.doc_id = mean.doc_id AND scaled.name = mean.name GROUP BY ALL),
fl AS (SELECT doc_id, name, chunk_idx, unnest(flags) AS flag, generate_subscripts(flags, 1) AS k FROM scaled),
fl2 AS (SELECT doc_id, name, flag, min((chunk_idx, k)) AS place FROM fl WHERE lower(flag) NOT IN {inlist(L.DROPPED_FLAGS)} AND name <> 'Peer Review Signals' GROUP BY ALL),
fl3 AS (SELECT doc_id, name, list(flag ORDER BY place) AS flags FROM fl2 GROUP BY ALL),
agg AS (SELECT mean.*, coalesce(fl3.flags, []) AS flags, justification FROM mean JOIN near USING (doc_id, name) LEFT JOIN fl3 USING (doc_id, name))"""

_M = [n for n, _, _ in L.MODEL_CRITERIA]


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _quoted(items: str) -> str:
    return f"('[' || array_to_string(list_transform({items}, lambda x: CASE WHEN contains(x, chr(39)) THEN chr(34) || x || chr(34) ELSE chr(39) || x || chr(39) END), ', ') || ']')"


_FIXED = [_text(L.WHY_FIXED[n]) for n in _M]
WHYS = f"""CASE WHEN o0 THEN {_FIXED[0]} ELSE j0 END AS why1, {_FIXED[1]} AS why2, CASE WHEN o2 THEN {_FIXED[2]} ELSE j2 END AS why3, CASE WHEN o3 THEN {_FIXED[3]} ELSE j3 END AS why4,
'Metadata present: ' || {_quoted("present")} || '. Missing: ' || {_quoted("missing")} || '.' AS why5,
CASE c6 WHEN 0 THEN {_text(L.WHY_RED)} WHEN 3 THEN {_text(L.WHY_CAUTION)} ELSE {_text(L.WHY_NO_RED)} END AS why6,
CASE verdict {" ".join(f"WHEN '{k}' THEN {_text(v)}" for k, v in L.WHY_VERDICT.items())} END AS why7,
CASE WHEN domain THEN {_text(L.WHY_DOMAIN)} || {_quoted("keywords")} || '.' ELSE {_text(L.WHY_NO_DOMAIN)} END AS why8"""
BOARD = f"""{DOCS}{EVIDENCE}{RED}{META}, {AGGREGATE},
answered AS (SELECT DISTINCT doc_id FROM items),
w AS (SELECT doc_id, {", ".join(f"max(CASE WHEN name = '{n}' THEN score END) AS s{k}, bool_or(name = '{n}' AND hard_fail_triggered) AS h{k}, max(CASE WHEN name = '{n}' THEN len(flags) END) AS f{k}, max(CASE WHEN name = '{n}' THEN justification END) AS j{k}" for k, n in enumerate(_M))} FROM agg GROUP BY doc_id),
b0 AS (SELECT n.doc_id, {STRUCTURE} AS o0, {COMMUNITY} AS o2, {ETHICS} AS o3, {some(L.DOMAIN_KEYWORDS)} AS domain, answered.doc_id IS NULL AS lost,
{", ".join(f"coalesce(s{k}, 0) AS s{k}, coalesce(h{k}, false) AS h{k}, coalesce(f{k}, 0) AS f{k}, CASE WHEN answered.doc_id IS NULL THEN {_text(L.WHY_LOST)} ELSE coalesce(j{k}, {_text(L.WHY_NOT_NAMED)}) END AS j{k}" for k in range(4))},
{hits(L.DOMAIN_KEYWORDS)} AS keywords, meta2.found AS present, verdict,
meta2.score AS c5, meta2.missing, red.score AS c6, red.found, exper.score AS c7, exper.d, exper.e
FROM n JOIN meta2 USING (doc_id) JOIN red USING (doc_id) JOIN exper USING (doc_id) LEFT JOIN w USING (doc_id) LEFT JOIN answered ON n.doc_id = answered.doc_id),
b1 AS (SELECT *, CASE WHEN o0 THEN 20 ELSE s0 END AS c1, s1 AS c2, CASE WHEN o2 THEN greatest(18, s2) ELSE s2 END AS c3, CASE WHEN o3 THEN greatest(8, s3) ELSE s3 END AS c4,
{WHYS},
list_filter([CASE WHEN h0 AND NOT o0 THEN '{_M[0]}' END, CASE WHEN h2 AND NOT o2 THEN '{_M[2]}' END, CASE WHEN h3 AND NOT o3 THEN '{_M[3]}' END, CASE WHEN c6 = 0 THEN 'Red Flag Absence' END], lambda x: x IS NOT NULL) AS fails,
list_filter([CASE WHEN h0 AND NOT o0 THEN '{_M[0]} — ' || why1 END, CASE WHEN h2 AND NOT o2 THEN '{_M[2]} — ' || why3 END, CASE WHEN h3 AND NOT o3 THEN '{_M[3]} — ' || why4 END, CASE WHEN c6 = 0 THEN 'Red Flag Absence — ' || why6 END], lambda x: x IS NOT NULL) AS failures FROM b0),
board AS (SELECT *, CAST(c1 + c2 + c3 + c4 + c5 + c6 + c7 AS BIGINT) AS total_score, round_even(CAST(c1 + c2 + c3 + c4 + c5 + c6 + c7 AS DOUBLE) * 100 / 100, 1) AS pct,
CASE WHEN len(fails) > 0 OR c1 + c2 + c3 + c4 + c5 + c6 + c7 < 60 THEN 'REJECTED' WHEN c1 + c2 + c3 + c4 + c5 + c6 + c7 <= 75 THEN 'MANUAL_REVIEW' ELSE 'APPROVED' END AS outcome FROM b1)"""

REASON = """CASE WHEN len(fails) > 0 THEN 'Hard-fail criterion triggered: ' || array_to_string(failures, '; ')
WHEN total_score < 60 THEN format('Accumulated score {}/100 ({:.1f}%) is below the reject threshold of 60.', total_score, pct)
WHEN total_score <= 75 THEN format('Accumulated score {}/100 ({:.1f}%) is in the manual review band (60-75).', total_score, pct) END"""

TRIPLE = f"""t AS ({B.TRIPLES}), q AS ({B.QUESTIONS}), g AS ({B.GENERATED}),
ent AS (SELECT lower(subject) AS entity FROM t UNION SELECT lower(object) FROM t),
found AS (SELECT qid, entity FROM q JOIN ent ON contains(lower(question), entity)),
hit AS (SELECT DISTINCT qid, t.* FROM t JOIN found ON entity = lower(subject) OR entity = lower(object)),
scored AS (SELECT *, (SELECT count(*) FROM found WHERE found.qid = hit.qid AND (contains(lower(subject), entity) OR contains(lower(object), entity))) AS score FROM hit),
strong AS (SELECT qid, 'entity' AS match_type, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rank, pos, subject, predicate, object, sentence_ref FROM scored QUALIFY rank <= 10),
weak AS (SELECT qid, 'predicate' AS match_type, 0::BIGINT AS score, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank, pos, subject, predicate, object, sentence_ref
FROM t JOIN q ON contains(lower(question), lower(predicate)) WHERE qid NOT IN (SELECT qid FROM found) QUALIFY rank <= 10),
concept AS (SELECT * FROM strong UNION ALL SELECT * FROM weak),
hint AS (SELECT qid, lower(nullif(regexp_extract(generated_query, '(?i)CONTAINS\\s*[''"]([^''"]+)[''"]', 1), '')) AS e, upper(nullif(regexp_extract(generated_query, '(?i)\\[r:([^\\]]+)\\]', 1), '')) AS p FROM g WHERE generated_query <> ''),
cypher AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank, pos, subject, predicate, object FROM t JOIN hint
ON (e IS NULL OR contains(lower(subject), e) OR contains(lower(object), e)) AND (p IS NULL OR predicate = p) QUALIFY rank <= 10)"""

COMPARED = f"""{TRIPLE},
both_ways AS (SELECT qid, count(*) AS overlap FROM (SELECT qid, list_sort([subject, predicate, object]) AS s FROM concept INTERSECT SELECT qid, list_sort([subject, predicate, object]) FROM cypher) GROUP BY qid),
compared AS (SELECT q.qid, question, (SELECT count(*) FROM concept WHERE concept.qid = q.qid) AS concept_count, (SELECT count(*) FROM cypher WHERE cypher.qid = q.qid) AS cypher_count,
coalesce(overlap, 0) AS overlap, coalesce((SELECT string_agg(entity, '; ' ORDER BY entity) FROM found WHERE found.qid = q.qid), '') AS concept_entities FROM q LEFT JOIN both_ways ON q.qid = both_ways.qid)"""

ANSWERED = f"""{TRIPLE}, answered AS (SELECT q.qid, question, max(match_type) IS DISTINCT FROM 'entity' AS is_gap, count(rank) AS triples_returned,
CASE WHEN max(match_type) = 'entity' THEN string_agg('(' || subject || ') -[' || predicate || ']-> (' || object || ')' || CASE WHEN sentence_ref <> '' THEN chr(10) || '  // Source: ' || sentence_ref ELSE '' END || chr(10), chr(10) ORDER BY rank)
ELSE 'I don''t have information on that.' END AS response FROM q LEFT JOIN concept ON q.qid = concept.qid GROUP BY q.qid, question)"""

LINE = r"\(([^)]+)\)\s*-\s*\[:?([^\]]+)\]\s*->\s*\(([^)]+)\)"
LOCATION = r"""\|\s*[Ll][Oo][Cc][Aa][Tt][Ii][Oo][Nn]:\s*["]?(.*?)["]?(?:\s*\([Pp][Aa][Gg][Ee]\s*(\d+)\))?$"""
LINE_TRIPLES = f"""x AS (SELECT c_custkey, page_num, substr(raw, strpos(raw, '(')) AS raw FROM ({B.LINES})),
l AS (SELECT c_custkey, page_num, trim(unnest(string_split(raw, chr(10)))) AS line, generate_subscripts(string_split(raw, chr(10)), 1) - 1 AS k FROM x),
lt AS (SELECT c_custkey, CAST(k AS BIGINT) AS line_no, trim(regexp_extract(line, '{LINE}', 1)) AS subject, upper(trim(regexp_extract(line, '{LINE}', 2))) AS predicate, trim(regexp_extract(line, '{LINE}', 3)) AS object,
'Page ' || CASE WHEN regexp_extract(line, '{LOCATION}', 2) <> '' THEN regexp_extract(line, '{LOCATION}', 2) ELSE page_num::VARCHAR END AS source_section, 'High' AS confidence,
CASE WHEN regexp_matches(line, '{LOCATION}') THEN trim(regexp_extract(line, '{LOCATION}', 1)) WHEN contains(line, '|') THEN trim(substr(line, strpos(line, '|') + 1)) ELSE 'NO_REFERENCE' END AS sentence_ref
FROM l WHERE regexp_matches(line, '{LINE}')),
lines AS (SELECT *, '(' || subject || ')-[:' || predicate || ']->(' || object || ')' AS passage FROM lt)"""

BLOCK = r"\(([^)]+)\)\s*-\s*\[([^\]]+)\]\s*->\s*\(([^)]+)\)"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
BLOCK_TRIPLES = f"""x AS ({B.BLOCKS}), parts AS (SELECT s_suppkey, page_num, string_split_regex(raw, '(?i)\\n\\s*// PASSAGE:') AS ps FROM x),
bl AS (SELECT s_suppkey, page_num, unnest(ps) AS block, generate_subscripts(ps, 1) - 1 AS k FROM parts),
bp AS (SELECT *, {_STRIP.format("string_split(block, chr(10) || '// SENTENCE REF:')[1]")} AS passage FROM bl WHERE regexp_matches(block, '\\S')),
blocks AS (SELECT s_suppkey, CAST(k AS BIGINT) AS block_no, {", ".join(f"CASE WHEN regexp_matches(passage, '{BLOCK}') THEN trim(regexp_extract(passage, '{BLOCK}', {i})) ELSE 'UNKNOWN' END AS {n}" for i, n in ((1, "subject"), (2, "predicate"), (3, "object")))},
'Page ' || page_num AS source_section, CASE WHEN regexp_matches(passage, '{BLOCK}') THEN 'High' ELSE 'Low' END AS confidence, passage,
CASE WHEN contains(block, '// SENTENCE REF:') THEN {_STRIP.format("string_split(string_split(block, '// SENTENCE REF:')[2], chr(10) || '// SOURCE:')[1]")} ELSE '' END AS sentence_ref,
CASE WHEN contains(block, '// SOURCE:') THEN {_STRIP.format("string_split(block, '// SOURCE:')[2]")} ELSE 'Unknown' END AS source FROM bp)"""


def chars(size: int, overlap: int, pages: str = B.PAGES) -> str:
    return f"""WITH p AS ({pages}), s AS (SELECT *, unnest(range(0, length(content), {size - overlap})) AS st FROM p WHERE regexp_matches(content, '\\S'))
SELECT doc_id, CAST(page_num AS BIGINT) AS page_num, CAST(st // {size - overlap} AS BIGINT) AS chunk_idx, {_STRIP.format(f"substr(content, st + 1, {size})")} AS chunk FROM s"""


PAGE_ROWS = f"""SELECT doc_id, unnest([1, 2, 3])::BIGINT AS page_num, unnest(list_slice(string_split_regex(text, '===== Page \\d+ =====\\n'), 2, 4)) AS content FROM ({B.MARKED})"""

WORDS = f"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
c AS (SELECT doc_id, ws, unnest(range(0, len(ws), {L.WORD_CHUNK - L.WORD_OVERLAP})) AS st FROM w),
chunks AS (SELECT doc_id, CAST(st // {L.WORD_CHUNK - L.WORD_OVERLAP} AS BIGINT) AS chunk_idx, array_to_string(list_slice(ws, st + 1, st + {L.WORD_CHUNK}), ' ') AS chunk FROM c)"""

RELATION = "regexp_replace(upper({}), '[^A-Z0-9_]', '_', 'g')"
EDGES = f"t AS ({B.TRIPLES}), e AS (SELECT DISTINCT subject AS src, {RELATION.format('predicate')} AS rel, object AS dst FROM t)"

_NAMES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.PREDICATE_NAMES.items())


def audit_list(items) -> str:
    return "(" + ", ".join("'" + x + "'" for x in items) + ")"


ORACLE: dict[str, str] = {
    "text_normalise": f"{DOCS} SELECT doc_id, norm FROM n",
    "red_flag_criterion": f"{DOCS}{RED} SELECT doc_id, score::BIGINT AS score, score = 0 AS triggered, array_to_string(found, '; ') AS flags FROM red",
    "experience_verdict": f"{DOCS}{EVIDENCE} SELECT doc_id, verdict, score::BIGINT AS score, array_to_string(list_sort(d), '; ') AS data_hits, array_to_string(list_sort(e), '; ') AS experience_hits FROM exper",
    "domain_relevance": f"{DOCS} SELECT doc_id, {some(L.DOMAIN_KEYWORDS)} AS relevant, len({hits(L.DOMAIN_KEYWORDS)})::BIGINT AS keywords, array_to_string({hits(L.DOMAIN_KEYWORDS)}, '; ') AS found FROM n",
    "reference_section": f"{DOCS} SELECT doc_id, {REFERENCES} AS has_references, {CITES} AS cites_references FROM n",
    "metadata_completeness": f"{DOCS}{META} SELECT doc_id, title, year, score::BIGINT AS score, score >= 5 AS passed, array_to_string(found, '; ') AS found, array_to_string(missing, '; ') AS missing FROM meta2",
    "author_candidates": f"SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'alba rivas cortez; ' WHEN 2 THEN 'Prof John Smith; ' WHEN 4 THEN 's: alba and cortez; ' ELSE '' END || 'Dr. Jane Quinn Doe' AS authors FROM documents",
    "word_chunks": f"WITH {WORDS} SELECT * FROM chunks",
    "char_chunks_1500": chars(L.BLOCK_CHUNK, L.BLOCK_OVERLAP),
    "char_chunks_2500": chars(L.LINE_CHUNK, L.LINE_OVERLAP),
    "page_split": PAGE_ROWS,
    "page_chunks": chars(L.BLOCK_CHUNK, L.BLOCK_OVERLAP, PAGE_ROWS),
    "line_triples": f"WITH {LINE_TRIPLES} SELECT * FROM lines",
    "block_triples": f"WITH {BLOCK_TRIPLES} SELECT * FROM blocks",
    "unknown_rate": f"WITH {BLOCK_TRIPLES} SELECT count(*) AS triples, count_if(subject = 'UNKNOWN')::BIGINT AS unknown, count_if(subject = 'UNKNOWN') / count(*) AS rate FROM blocks",
    "known_triples": f"WITH {BLOCK_TRIPLES} SELECT s_suppkey, block_no, subject, predicate, object FROM blocks WHERE subject <> 'UNKNOWN'",
    "extraction_stats": f"WITH {LINE_TRIPLES} SELECT count(*) AS raw_triples, count(DISTINCT (lower(subject), predicate, lower(object))) AS unique_triples FROM lines",
    "dedupe_prefer_high": f"""WITH d AS ({B.DUPLICATES}), k AS (SELECT *, lower({_strip('subject')}) AS a, lower({_strip('predicate')}) AS b, lower({_strip('object')}) AS c FROM d),
f AS (SELECT a, b, c, min(pos) AS pos, coalesce(min(CASE WHEN confidence = 'High' THEN pos END), min(pos)) AS best FROM k GROUP BY a, b, c)
SELECT f.pos, subject, predicate, object, confidence, sentence_ref FROM f JOIN d ON d.pos = f.best""",
    "dedupe_longest_ref": f"""WITH d AS ({B.DUPLICATES}), f AS (SELECT min(pos) AS pos, arg_min(pos, (-length(sentence_ref), pos)) AS best FROM d GROUP BY lower(subject), predicate, lower(object))
SELECT f.pos, subject, predicate, object, confidence, sentence_ref FROM f JOIN d ON d.pos = f.best""",
    "export_numbering": f"""WITH {LINE_TRIPLES}, p AS (SELECT *, 'paper' || (c_custkey % 7) AS paper FROM lines)
SELECT (SELECT count(*) FROM p o WHERE o.paper = p.paper AND (o.c_custkey, o.line_no) <= (p.c_custkey, p.line_no)) AS extraction_number, paper, subject, predicate, object, source_section, confidence, passage, sentence_ref FROM p""",
    "load_triples": f"""SELECT pos, {_strip('subject')} AS subject, {_strip('predicate')} AS predicate, {_strip('object')} AS object, coalesce({_strip('sentence_ref')}, '') AS sentence_ref, coalesce(source_section, 'Unknown') AS source_section,
coalesce(confidence, 'Medium') AS confidence FROM ({B.RAW_TRIPLES}) WHERE {_strip('subject')} <> '' AND {_strip('predicate')} <> '' AND {_strip('object')} <> ''""",
    "enriched_triples": "SELECT n_nationkey AS doc_id, c_name AS subject, 'lives' AS predicate, c_mktsegment AS object, n_name AS source_title, n_regionkey::VARCHAR AS source_publication FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "audit_clean": f"""WITH a AS ({B.AUDITED}) SELECT DISTINCT subject, CASE predicate {_NAMES} ELSE predicate END AS predicate, object FROM a
WHERE coalesce(subject, 'nan') NOT IN {audit_list(L.AUDIT_SUBJECTS)} AND coalesce(subject, 'nan') NOT IN {audit_list(L.AUDIT_NON_CORE_SUBJECTS)} AND predicate NOT IN {audit_list(L.AUDIT_PREDICATES)}
AND len(list_filter({strings(L.AUDIT_OBJECT_MARKERS)}, lambda m: contains(lower(coalesce(object, 'nan')), m))) = 0
AND (coalesce(subject, '') ILIKE '%garo%' OR coalesce(subject, '') ILIKE '%mandi%' OR predicate ILIKE '%garo%' OR predicate ILIKE '%mandi%' OR coalesce(object, '') ILIKE '%garo%' OR coalesce(object, '') ILIKE '%mandi%')""",
    "graph_nodes": f"WITH t AS ({B.TRIPLES}) SELECT subject AS name FROM t UNION SELECT object FROM t",
    "graph_edges": f"WITH {EDGES} SELECT * FROM e",
    "graph_upsert": f"WITH {EDGES}, old AS (SELECT DISTINCT subject, {RELATION.format('predicate')}, object FROM t WHERE pos % 3 = 0) SELECT * FROM e EXCEPT SELECT * FROM old",
    "edge_count": f"WITH {EDGES} SELECT count(*) AS edges FROM e",
    "graph_browse": f"WITH {EDGES} SELECT * FROM e ORDER BY src, rel, dst LIMIT 100",
    "entity_index": f"WITH t AS ({B.TRIPLES}), m AS (SELECT lower(subject) AS entity, pos FROM t UNION ALL SELECT lower(object), pos FROM t) SELECT entity, count(*) AS mentions, min(pos) AS first_pos, max(pos) AS last_pos FROM m GROUP BY entity",
    "kg_schema": f"WITH t AS ({B.TRIPLES}) SELECT DISTINCT predicate FROM t ORDER BY predicate LIMIT 20",
    "concept_retrieve": f"WITH {TRIPLE} SELECT qid, match_type, score, rank, pos, subject, predicate, object FROM strong",
    "predicate_fallback": f"WITH {TRIPLE} SELECT qid, match_type, score, rank, pos, subject, predicate, object FROM weak",
    "cypher_retrieve": f"WITH {TRIPLE} SELECT * FROM cypher",
    "retrieval_compare": f"WITH {COMPARED} SELECT * FROM compared",
    "compare_totals": f"WITH {COMPARED} SELECT sum(concept_count)::BIGINT AS concept_total, sum(cypher_count)::BIGINT AS cypher_total, sum(overlap)::BIGINT AS overlap_total, sum(concept_count - overlap)::BIGINT AS concept_unique, sum(cypher_count - overlap)::BIGINT AS cypher_unique FROM compared",
    "answer_gap": f"WITH {ANSWERED} SELECT qid, is_gap, triples_returned FROM answered",
    "format_answer": f"WITH {ANSWERED} SELECT qid, response FROM answered",
    "gap_log": f"WITH {ANSWERED} SELECT question AS text, '2026-01-01T00:00:00+00:00' AS timestamp, true AS no_match, 'concept' AS approach, triples_returned FROM answered WHERE is_gap",
    "out_of_scope": f"WITH {ANSWERED} SELECT count_if(is_gap)::BIGINT AS passed, count(*) AS questions FROM answered WHERE qid IN (3, 5)",
    "verdict_parse": f"WITH {ITEMS} SELECT doc_id, chunk_idx, ord, name, score, max_score, array_to_string(flags, '; ') AS flags, hard FROM items",
    "verdict_aggregate": f"WITH {AGGREGATE} SELECT doc_id, name, score, array_to_string(flags, '; ') AS flags, hard_fail_triggered, justification FROM agg",
    "structure_override": f"{DOCS} SELECT doc_id, {STRUCTURE} AS applies FROM n",
    "community_override": f"{DOCS} SELECT doc_id, {COMMUNITY} AS applies FROM n",
    "ethics_override": f"{DOCS} SELECT doc_id, {ETHICS} AS applies FROM n",
    "scoreboard": f"{BOARD} SELECT doc_id, {', '.join(f'c{k}::BIGINT AS c{k}' for k in range(1, 8))}, 0::BIGINT AS c8, total_score, 100::BIGINT AS max_possible, pct AS score_pct, array_to_string(fails, '; ') AS hard_fails, outcome FROM board",
    "criteria_detail": f"""{BOARD} SELECT doc_id, unnest({strings([*_M, *L.CODE_CRITERIA])}) AS name,
unnest([s0 > 0 OR o0, s1 > 0, s2 > 0 OR o2, s3 > 0 OR o3, c5 >= 5, c6 > 0, true, true]) AS passed, unnest([h0 AND NOT o0, false, h2 AND NOT o2, h3 AND NOT o3, false, c6 = 0, false, false]) AS hard_fail_triggered,
unnest([CASE WHEN lost THEN 1 ELSE f0 END, CASE WHEN lost THEN 1 ELSE f1 END, CASE WHEN lost THEN 1 ELSE f2 END, CASE WHEN lost THEN 1 ELSE f3 END, len(missing), len(found), (len(d) > 0)::INT + (len(e) > 0)::INT, (NOT domain)::INT])::BIGINT AS flag_count FROM board""",
    "outcome_counts": f"{BOARD} SELECT outcome, count(*) AS documents, sum(total_score)::BIGINT AS points FROM board GROUP BY outcome",
    "fallback_scoreboard": f"""{DOCS}{EVIDENCE}{RED}, own AS (SELECT n.doc_id, red.score AS r,
CASE WHEN {STRUCTURE} THEN 20 ELSE 0 END + CASE WHEN {COMMUNITY} THEN 18 ELSE 0 END + CASE WHEN {ETHICS} THEN 8 ELSE 0 END + red.score + exper.score
+ CASE WHEN len({TITLES}) > 0 THEN 2 ELSE 0 END + CASE WHEN {_ROLL} <> '' THEN 2 ELSE 0 END AS total
FROM n JOIN red USING (doc_id) JOIN exper USING (doc_id))
SELECT doc_id, 'Model unavailable' AS flag, 0::BIGINT AS peer_score, total::BIGINT AS total_score, CASE WHEN r = 0 OR total < 60 THEN 'REJECTED' WHEN total <= 75 THEN 'MANUAL_REVIEW' ELSE 'APPROVED' END AS outcome FROM own""",
    "manual_override": "SELECT doc_id, 'APPROVED' AS outcome, -1::BIGINT AS total_score, 0::BIGINT AS criteria_count FROM documents",
    "review_queue": f"{BOARD} SELECT '20260101_000000' AS timestamp, doc_id, 'é a-b.' || doc_id AS paper_name, 'papers/é a-b.' || doc_id || '.pdf' AS paper_path, 'a-model' AS model_used, total_score AS accumulated_score, 100::BIGINT AS max_possible, pct AS score_pct, '' AS hard_fail_criteria, {REASON} AS review_reason, 'PENDING' AS status, '' AS override_by, '' AS override_note FROM board WHERE outcome = 'MANUAL_REVIEW'",
    "log_record": f"""{BOARD} SELECT doc_id, '20260101_000000_' || CASE outcome WHEN 'REJECTED' THEN 'rejection' WHEN 'APPROVED' THEN 'approval' ELSE 'review' END || '_é_a-b_' || doc_id || '.json' AS file_name, outcome, total_score, 100::BIGINT AS max_possible,
'papers/é a-b.' || doc_id || '.pdf' AS paper, 'é a-b.' || doc_id AS paper_name, '20260101_000000' AS timestamp, 'a-model' AS model_used, total_score AS accumulated_score,
pct AS score_pct, len(fails)::BIGINT AS hard_fail_count, array_to_string(fails, '; ') AS hard_fail_criteria, '60' AS reject_below, '60-75' AS manual_review_band, '75' AS auto_approve_above,
CASE WHEN outcome = 'REJECTED' THEN {REASON} END AS rejection_reason, CASE WHEN outcome = 'MANUAL_REVIEW' THEN {REASON} END AS review_reason,
array_to_string([{", ".join(f"why{k}" for k in range(1, 9))}], ' | ') AS justifications, CASE WHEN lost THEN 'fallback | fallback | fallback | fallback' ELSE 'model | model | model | model' END || ' | code | code | code | code' AS evaluators,
CASE outcome WHEN 'REJECTED' THEN 'REJECTED — paper skipped. Review the hard-fail criteria and criterion justifications before reconsidering this source.' WHEN 'APPROVED' THEN 'APPROVED — paper passed the scoreboard and is ready for knowledge graph extraction.' ELSE 'MANUAL REVIEW — extraction is held pending human review.' END AS next_steps FROM board""",
    "batch_status": f"{BOARD} SELECT CASE WHEN doc_id % 10 = 9 THEN 'ERROR' ELSE replace(outcome, '_', ' ') END AS status, count(*) AS documents FROM board GROUP BY 1",
    "pending_extraction": f"{BOARD} SELECT doc_id FROM board WHERE outcome = 'APPROVED' AND doc_id % 2 = 1",
    "decision_overlay": f"{BOARD} SELECT doc_id, outcome, CASE WHEN doc_id % 5 <> 0 THEN outcome WHEN doc_id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS final_outcome FROM board",
    "prompt_render": f"WITH {WORDS} SELECT doc_id, chunk_idx, 'Read part ' || chunk_idx || ' of document ' || doc_id || '.' || chr(10) || chr(10) || 'Passage:' || chr(10) || chunk || chr(10) AS prompt FROM chunks",
    "clean_relations": f"SELECT DISTINCT p_type, {RELATION.format('p_type')} AS relation FROM part",
    "elapsed_labels": "SELECT DISTINCT l_linenumber * 22.25::DOUBLE AS seconds, CASE WHEN seconds < 60 THEN format('{:.2f} sec', seconds) ELSE format('{}m {:.2f}s', floor(seconds / 60)::BIGINT, seconds - 60 * floor(seconds / 60)) END AS label FROM lineitem",
}
