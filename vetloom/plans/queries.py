"""The registered queries: operators applied to the bound inputs, results as plain columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetloom.functions import chunking as C
from vetloom.functions import lexicons as L
from vetloom.functions import parsing as P
from vetloom.functions import text as T
from vetloom.operators import retrieval as R
from vetloom.operators import triples as TR
from vetloom.operators import vetting as V
from vetloom.plans import bindings as B
from vetloom.sources.model import prompt

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STAMP = "20260101_000000"
MODEL = "a-model"


def bound(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A binding over the tables it names."""
    words = set(sql.replace("(", " ").replace(")", " ").split())
    for t in words & set(TABLES):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda sql: bound(spark, sf_dir, sql))
    return f


def joined(c: Column | str) -> Column:
    return F.array_join(c, "; ")


def normal(t) -> DataFrame:
    return t(B.DOCS).select("doc_id", "text", T.normalise(F.col("text")).alias("norm"))


@query
def text_normalise(t):
    return normal(t).select("doc_id", "norm")


@query
def red_flag_criterion(t):
    score, triggered, found = V.red_flags(F.col("norm"))
    return normal(t).select("doc_id", score.cast("long").alias("score"), triggered.alias("triggered"), joined(found).alias("flags"))


@query
def experience_verdict(t):
    rows = V.with_evidence(normal(t))
    v = V.verdict(F.col("data"), F.col("experience"))
    return rows.select("doc_id", v.alias("verdict"), V.experience_score(v).cast("long").alias("score"), joined(F.array_sort("data")).alias("data_hits"), joined(F.array_sort("experience")).alias("experience_hits"))


@query
def domain_relevance(t):
    found = T.hits(F.col("norm"), L.DOMAIN_KEYWORDS)
    return normal(t).select("doc_id", (F.size(found) > 0).alias("relevant"), F.size(found).cast("long").alias("keywords"), joined(found).alias("found"))


@query
def reference_section(t):
    return t(B.DOCS).select("doc_id", T.has_reference_section(F.col("text")).alias("has_references"), T.cites_references(T.normalise(F.col("text"))).alias("cites_references"))


@query
def metadata_completeness(t):
    rows = t(B.DOCS).join(t(B.META), "doc_id")
    title = T.first_present(F.col("title"), T.inferred_title(F.col("text")))
    year = T.first_present(F.col("year"), T.first_year(F.col("text")))
    authors = F.when(F.col("has_authors"), F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))
    score, passed, found, missing = V.metadata(title, authors, year, F.col("journal"), F.col("doi"))
    return rows.select("doc_id", title.alias("title"), year.alias("year"), score.cast("long").alias("score"), passed.alias("passed"), joined(found).alias("found"), joined(missing).alias("missing"))


@query
def author_candidates(t):
    return t(B.AUTHORED).select("doc_id", joined(T.author_candidates(F.col("text"), ("alba", "cortez"), 3)).alias("authors"))


@query
def word_chunks(t):
    return C.word_chunks(t("SELECT doc_id, text FROM documents"), L.WORD_CHUNK, L.WORD_OVERLAP)


@query
def char_chunks_1500(t):
    return C.char_chunks(t(B.PAGES), L.BLOCK_CHUNK, L.BLOCK_OVERLAP)


@query
def char_chunks_2500(t):
    return C.char_chunks(t(B.PAGES), L.LINE_CHUNK, L.LINE_OVERLAP)


@query
def page_split(t):
    return C.pages(t(B.MARKED))


@query
def page_chunks(t):
    return C.char_chunks(C.pages(t(B.MARKED)), L.BLOCK_CHUNK, L.BLOCK_OVERLAP)


def lines(t) -> DataFrame:
    replies = t(B.LINES).withColumn("raw", P.without_reasoning(F.col("raw")))
    return P.line_triples(replies, ("c_custkey",))


@query
def line_triples(t):
    return lines(t)


@query
def block_triples(t):
    return P.block_triples(t(B.BLOCKS), ("s_suppkey",))


@query
def unknown_rate(t):
    return TR.unknown_rate(block_triples(t))


@query
def known_triples(t):
    return TR.known(block_triples(t)).select("s_suppkey", "block_no", "subject", "predicate", "object")


@query
def extraction_stats(t):
    rows = lines(t).withColumn("pos", F.col("c_custkey") * 100 + F.col("line_no"))
    return TR.extraction_stats(rows, TR.longest_reference(rows))


@query
def dedupe_prefer_high(t):
    return TR.prefer_high(t(B.DUPLICATES))


@query
def dedupe_longest_ref(t):
    return TR.longest_reference(t(B.DUPLICATES))


@query
def export_numbering(t):
    rows = lines(t).withColumn("pos", F.col("c_custkey") * 100 + F.col("line_no")).withColumn("paper", F.concat(F.lit("paper"), F.col("c_custkey") % 7))
    return TR.numbered(rows)


@query
def load_triples(t):
    return TR.load(t(B.RAW_TRIPLES))


@query
def enriched_triples(t):
    rows = t("SELECT c_nationkey AS doc_id, c_name AS subject, 'lives' AS predicate, c_mktsegment AS object FROM customer")
    return TR.enrich(rows, t("SELECT n_nationkey AS doc_id, n_name AS source_title, CAST(n_regionkey AS VARCHAR(5)) AS source_publication FROM nation"))


@query
def audit_clean(t):
    return TR.audit(t(B.AUDITED))


@query
def graph_nodes(t):
    return TR.nodes(t(B.TRIPLES))


@query
def graph_edges(t):
    return TR.edges(t(B.TRIPLES))


@query
def graph_upsert(t):
    return TR.upsert(TR.edges(t(B.TRIPLES).where("pos % 3 = 0")), TR.edges(t(B.TRIPLES)))


@query
def edge_count(t):
    return TR.edges(t(B.TRIPLES)).agg(F.count("*").alias("edges"))


@query
def graph_browse(t):
    return TR.browse(TR.edges(t(B.TRIPLES)))


@query
def entity_index(t):
    return TR.mentions(t(B.TRIPLES)).groupBy("entity").agg(F.count("*").alias("mentions"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query
def kg_schema(t):
    return TR.predicate_list(t(B.TRIPLES))


@query
def concept_retrieve(t):
    return R.by_concepts(t(B.QUESTIONS), t(B.TRIPLES)).where("match_type = 'entity'")


@query
def predicate_fallback(t):
    return R.by_concepts(t(B.QUESTIONS), t(B.TRIPLES)).where("match_type = 'predicate'")


@query
def cypher_retrieve(t):
    return R.by_hints(t(B.GENERATED), t(B.TRIPLES))


@query
def retrieval_compare(t):
    q, triples = t(B.QUESTIONS), t(B.TRIPLES)
    return R.compared(q, R.by_concepts(q, triples), R.by_hints(t(B.GENERATED), triples), R.found_entities(q, triples))


@query
def compare_totals(t):
    return R.totals(retrieval_compare(t))


def answered(t) -> DataFrame:
    q, triples = t(B.QUESTIONS), t(B.TRIPLES)
    rows = R.by_concepts(q, triples).join(triples.select("pos", "sentence_ref"), "pos")
    return R.answers(q, rows)


@query
def answer_gap(t):
    return answered(t).select("qid", "is_gap", "triples_returned")


@query
def format_answer(t):
    return answered(t).select("qid", "response")


@query
def gap_log(t):
    return R.gap_log(answered(t), "concept", F.lit("2026-01-01T00:00:00+00:00"))


@query
def out_of_scope(t):
    return R.refused(answered(t).where("qid IN (3, 5)"))


@query
def verdict_parse(t):
    rows = V.parsed_criteria(t(B.REPLIES))
    return rows.select("doc_id", "chunk_idx", "ord", F.col("item.name").alias("name"), F.col("item.score").alias("score"), F.col("item.max_score").alias("max_score"), joined("item.flags").alias("flags"), F.col("item.hard_fail_triggered").alias("hard"))


@query
def verdict_aggregate(t):
    return V.model_criteria(t(B.REPLIES)).withColumn("flags", joined("flags"))


def overrides(t, test) -> DataFrame:
    return normal(t).select("doc_id", test.alias("applies"))


@query
def structure_override(t):
    return overrides(t, V.structure_override(F.col("text"), F.col("norm")))


@query
def community_override(t):
    return overrides(t, V.community_override(F.col("norm")))


@query
def ethics_override(t):
    return overrides(t, V.ethics_override(F.col("norm")))


def board(t) -> DataFrame:
    meta = t(B.META).withColumn("authors", F.when(F.col("has_authors"), F.array(F.lit("A"))).otherwise(F.array().cast("array<string>"))).drop("has_authors")
    return V.scoreboard(t(B.DOCS), t(B.REPLIES), meta)


@query
def scoreboard(t):
    scores = [F.col("criteria")[i]["score"].alias(f"c{i + 1}") for i in range(8)]
    return board(t).select("doc_id", *scores, "total_score", "max_possible", "score_pct", joined("hard_fails").alias("hard_fails"), "outcome")


@query
def criteria_detail(t):
    rows = board(t).select("doc_id", F.explode("criteria").alias("c"))
    return rows.select("doc_id", "c.name", "c.passed", "c.hard_fail_triggered", F.size("c.flags").cast("long").alias("flag_count"))


@query
def outcome_counts(t):
    return board(t).groupBy("outcome").agg(F.count("*").alias("documents"), F.sum("total_score").alias("points"))


@query
def fallback_scoreboard(t):
    rows = V.scoreboard(t(B.DOCS), t(B.REPLIES).where("doc_id < 0"))
    return rows.select("doc_id", F.col("criteria")[1]["flags"][0].alias("flag"), F.col("criteria")[1]["score"].alias("peer_score"), "total_score", "outcome")


@query
def manual_override(t):
    return V.overridden(t(B.DOCS))


def path() -> Column:
    return F.concat(F.lit("papers/é a-b."), F.col("doc_id"), F.lit(".pdf"))


@query
def review_queue(t):
    return V.review_queue(board(t), F.lit(STAMP), path(), F.lit(MODEL))


@query
def log_record(t):
    rows = V.records(board(t), F.lit(STAMP), path(), F.lit(MODEL))
    each = [F.array_join(F.col(f"criteria.{c}"), " | ").alias(n) for c, n in (("justification", "justifications"), ("evaluated_by", "evaluators"))]
    rows = rows.select("*", *each, *[F.col(f"thresholds.{c}").cast("string").alias(c) for c in ("reject_below", "manual_review_band", "auto_approve_above")])
    return rows.drop("criteria", "thresholds").withColumn("hard_fail_criteria", joined("hard_fail_criteria"))


@query
def batch_status(t):
    rows = t("SELECT doc_id FROM documents").join(board(t).where("doc_id % 10 <> 9").select("doc_id", "outcome"), "doc_id", "left")
    return rows.groupBy(V.status(F.col("outcome")).alias("status")).agg(F.count("*").alias("documents"))


@query
def pending_extraction(t):
    return V.pending(board(t), t("SELECT doc_id FROM documents WHERE doc_id % 2 = 0")).select("doc_id")


@query
def decision_overlay(t):
    made = t("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS manual_decision FROM documents WHERE doc_id % 5 = 0")
    return V.with_decisions(board(t), made).select("doc_id", "outcome", "final_outcome")


@query
def prompt_render(t):
    rows = word_chunks(t)
    return rows.select("doc_id", "chunk_idx", prompt("Read part {n} of document {d}.\n\nPassage:\n{chunk}\n", n=F.col("chunk_idx").cast("string"), d=F.col("doc_id").cast("string"), chunk=F.col("chunk")).alias("prompt"))


@query
def clean_relations(t):
    return t("SELECT DISTINCT p_type FROM part").select("p_type", P.clean_relation(F.col("p_type")).alias("relation"))


@query
def elapsed_labels(t):
    return t("SELECT DISTINCT CAST(l_linenumber AS DOUBLE) * 22.25 AS seconds FROM lineitem").select("seconds", P.duration(F.col("seconds")).alias("label"))
