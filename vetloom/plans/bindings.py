"""Inputs of the registered queries, made from the star-schema and text tables by SQL that any engine reads.

The texts of the documents table hold none of the phrases that vetting looks for, so each document
gets an ending chosen by its id; triples are read off the star schema; model replies are formatted
from events, customers and suppliers, and good ones from a third of the documents, so that every outcome occurs.
"""

from __future__ import annotations

ENDINGS = [
    " Abstract introduction conclusion references ",
    " in my experience this personal reflection and anecdotal evidence shows ",
    " no methodology was used; without a research design we believe ",
    " press release: buy now ",
    " generated by chatgpt ",
    " as an ai language model ... references and bibliography ",
    " Data   collection and thematic analysis with participants and informed consent ",
    " garo community members and indigenous knowledge, interviews ",
    " this essay argues, in our opinion; a survey of respondents, lack of sampling ",
    " exploitative misrepresentation of participants ",
    " published 2019, abstract, introduction, conclusion, works cited ",
    " ",
]

DOCS = f"""SELECT doc_id, concat(text, CASE doc_id % {len(ENDINGS)} {" ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(ENDINGS))} END) AS text FROM documents"""

META = """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'A title that the caller knows' WHEN doc_id % 7 = 1 THEN '  ' END AS title,
CASE WHEN doc_id % 5 = 0 THEN '1987' END AS year, CASE WHEN doc_id % 3 = 0 THEN source END AS journal,
CASE WHEN doc_id % 4 = 0 THEN concat('10.1/', doc_id) ELSE '' END AS doi, doc_id % 2 = 0 AS has_authors FROM documents"""

AUTHORED = """SELECT doc_id, concat('Some heading', chr(10), CASE doc_id % 5 WHEN 0 THEN 'Author: Dr. Jane Quinn Doe, of here'
WHEN 1 THEN '** by: alba  rivas cortez *' WHEN 2 THEN 'author Prof John Smith' WHEN 3 THEN 'no names' ELSE 'authors: alba and cortez' END,
chr(10), 'Corresponding author: Dr. Jane Quinn Doe', chr(10), text) AS text FROM documents"""

MARKED = """SELECT doc_id, concat('front matter', chr(10), '===== Page 1 =====', chr(10), substr(text, 1, 400), chr(10), '===== Page 2 =====', chr(10), '  ', '===== Page 3 =====', chr(10),
substr(text, 401)) AS text FROM documents"""

PAGES = "SELECT doc_id, doc_id % 7 + 1 AS page_num, text AS content FROM documents"

TRIPLES = """SELECT CAST(n_nationkey AS BIGINT) AS pos, n_name AS subject, 'IS_IN_REGION' AS predicate, r_name AS object, concat('n', n_nationkey) AS sentence_ref FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 1000000 + c_custkey, c_name, 'lives_in', n_name, concat('c', c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 2000000000 + s_suppkey, s_name, 'BASED_IN', n_name, '' FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT 3000000000 + p_partkey, p_name, 'HAS_BRAND', p_brand, concat('p', p_partkey) FROM part"""

RAW_TRIPLES = """SELECT c_custkey AS pos, concat(' ', chr(9), c_name, chr(10), ' ') AS subject, CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'lives_in' END AS predicate,
CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE n_name END AS object, CASE WHEN c_custkey % 2 = 0 THEN ' a line ' END AS sentence_ref,
CASE WHEN c_custkey % 3 = 0 THEN 'Page 3' END AS source_section, CASE WHEN c_custkey % 5 = 0 THEN 'High' END AS confidence
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

AUDITED = """SELECT CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN 'Study' WHEN 1 THEN 'GaroReligion' WHEN 2 THEN 'GaroPeople' WHEN 3 THEN NULL WHEN 4 THEN 'Mandi' ELSE n_name END AS subject,
CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN 'SPEAKS' WHEN 1 THEN 'IS_A' WHEN 2 THEN 'HAS_LANGUAGE' WHEN 3 THEN 'KNOWS_GARO' ELSE concat('REL_', c_nationkey) END AS predicate,
CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'a JOURNAL of note' WHEN 1 THEN 'the mandi hills' WHEN 2 THEN NULL ELSE n_name END AS object
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

DUPLICATES = """SELECT CAST(event_id AS BIGINT) AS pos, concat(CASE WHEN event_id % 2 = 0 THEN 'User ' ELSE 'user ' END, user_id % 40) AS subject, event_type AS predicate,
concat('Thing', event_id % 3, CASE WHEN event_id % 4 = 0 THEN ' ' WHEN event_id % 4 = 1 THEN chr(9) ELSE '' END) AS object, CASE WHEN event_id % 9 = 8 THEN 'High' ELSE 'Low' END AS confidence,
substr('abcdefghijklmnop', 1, CAST(event_id % 16 AS INT)) AS sentence_ref FROM events"""

LINES = """SELECT c_custkey, CAST(c_custkey % 9 AS BIGINT) AS page_num, concat('Sure, [thinking] here: (', c_name, ')', CASE CAST(c_custkey % 5 AS INT)
WHEN 0 THEN concat('-[lives_in]->(', n_name, ') | Location: "seen in ', n_name, '" (Page ', c_custkey % 30, ')')
WHEN 1 THEN concat(' - [:In] -> ( ', n_name, ' )')
WHEN 2 THEN concat('-[: in ]->(', n_name, ')| some text ')
WHEN 3 THEN concat('-[in]->(', n_name, ') | location: no quotes')
ELSE ' no triple' END, chr(10), 'junk', chr(10), '  (', n_name, ')-[HAS]->(', c_mktsegment, ')') AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey"""

BLOCKS = """SELECT s_suppkey, CAST(s_suppkey % 9 AS BIGINT) AS page_num, concat(CASE WHEN s_suppkey % 4 = 0 THEN 'Preamble' ELSE '' END, chr(10), '// PASSAGE: (', s_name, ')-[BASED_in]->(', n_name, ')',
chr(10), '// SENTENCE REF: it says ', n_name, chr(10), '// SOURCE: a book', chr(10), ' // passage: no triple', chr(10), '// SENTENCE REF: nothing') AS raw
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

REPLIES = """SELECT user_id AS doc_id, event_id AS chunk_idx, CASE WHEN event_id % 17 = 0 THEN 'no json' ELSE concat('<think>{ not this }</think>```json', chr(10), '{"criteria": [',
'{"name": "Structural Completeness", "score": ', event_id % 6, ', "max_score": 5, "justification": "s', event_id, '", "flags": ["a', event_id % 2, '", "Hard_Fail"], "hard_fail_triggered": ', CASE WHEN event_id % 19 = 0 THEN 'true' ELSE 'false' END, '}, ',
'{"name": "Structural Completeness", "score": ', event_id % 23, ', "max_score": 20, "justification": "t', event_id, '", "flags": ["b"], "hard_fail_triggered": false}, ',
'{"name": "Peer Review Signals", "score": ', event_id % 7, ', "max_score": 7, "justification": "p", "flags": ["c"], "hard_fail_triggered": true}, ',
'{"name": "Ethical Source Handling & Consent", "score": ', event_id % 40, ', "max_score": 15, "justification": "e', event_id % 3, '", "flags": [], "hard_fail_triggered": false}',
']}', chr(10), '```') END AS raw FROM events
UNION ALL SELECT doc_id, CAST(-1 AS BIGINT), concat('{"criteria": [{"name": "Structural Completeness", "score": 5, "max_score": 5, "justification": "whole ', doc_id, '", "flags": [], "hard_fail_triggered": false}, ',
'{"name": "Peer Review Signals", "score": 18, "max_score": 20, "justification": "a journal", "flags": [], "hard_fail_triggered": false}, ',
'{"name": "Authorship & Community Alignment (IKAT)", "score": ', doc_id % 26, ', "max_score": 25, "justification": "k', doc_id, '", "flags": ["d"], "hard_fail_triggered": ', CASE WHEN doc_id % 31 = 0 THEN 'true' ELSE 'false' END, '}]}') FROM documents WHERE doc_id % 3 = 1"""

QUESTIONS = """SELECT CAST(1 AS BIGINT) AS qid, 'Who lives in NATION_12 of ASIA?' AS question UNION ALL SELECT 2, 'Which BASED_IN facts are there?'
UNION ALL SELECT 3, 'What is the capital of France?' UNION ALL SELECT 4, 'Tell me about EUROPE' UNION ALL SELECT 5, 'Who am I?'"""

GENERATED = """SELECT CAST(1 AS BIGINT) AS qid, 'MATCH (s)-[r:lives_in]->(o) WHERE s CONTAINS ''NATION_12'' RETURN s' AS generated_query
UNION ALL SELECT 2, 'MATCH (s)-[r:BASED_IN]->(o) RETURN s' UNION ALL SELECT 3, '' UNION ALL SELECT 4, 'where o contains "europe"' UNION ALL SELECT 5, 'RETURN nothing at all'"""
