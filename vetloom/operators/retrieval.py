"""Questions answered from triples: by entities in the question, or by hints of a generated query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.functions.lexicons import TOP_K
from vetloom.functions.parsing import entity_hint, predicate_hint
from vetloom.operators.triples import entities, mentions

#: Queries up to which those without a predicate are broadcast.
MOST_HINTS = 10_000
NO_MATCH = "I don't have information on that."


def found_entities(questions: DataFrame, triples: DataFrame) -> DataFrame:
    """(qid, entity): the entities that lie in a question as substrings, inside words too."""
    return lying_in(questions.select("qid", F.lower("question").alias("q")), entities(triples), "entity")


def lying_in(questions: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(qid, name): the distinct names that lie in questions(qid, q) as substrings.

    Each question's substrings of the lengths that occur among the names are joined with equal ones, so no
    question meets every name, whichever side is large.
    """
    lengths = names.select(F.length(name).alias("n")).where("n IS NOT NULL").distinct()
    # lengths are few, at most as many as a question has characters
    longest = questions.agg(F.max(F.length("q"))).first()[0] or 0
    found = sorted(r.n for r in lengths.where(F.col("n") <= longest).collect())
    rows = questions.withColumn("n", F.explode(F.array(*[F.lit(n) for n in found]).cast("array<int>"))).where(F.length("q") >= F.col("n"))
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("q") - F.col("n") + 1)))
    parts = rows.select("qid", F.substr("q", F.col("at"), F.col("n")).alias(name)).distinct()
    return parts.join(names.select(name).distinct(), name).select("qid", name)


def _top(rows: DataFrame, *order: Column, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def by_concepts(questions: DataFrame, triples: DataFrame, k: int = TOP_K) -> DataFrame:
    """qid, match_type, score, rank and the triple: those that name most of the question's entities, or, without any
    entity, those whose predicate lies in the question."""
    found = found_entities(questions, triples)
    # only triples that have a found entity as subject or object can be retrieved
    at = found.join(mentions(triples), "entity").select("qid", "pos").distinct()
    listed = found.groupBy("qid").agg(F.collect_set("entity").alias("found"))
    rows = at.join(triples, "pos").join(listed, "qid")
    s, o = F.lower("subject"), F.lower("object")
    score = F.size(F.filter("found", lambda e: F.contains(s, e) | F.contains(o, e))).cast("long")
    best = _top(rows.withColumn("score", score), F.col("score").desc(), F.col("pos"), k=k).withColumn("match_type", F.lit("entity"))
    left = questions.join(listed, "qid", "left_anti").select("qid", F.lower("question").alias("q"))
    names = lying_in(left, triples.select(F.lower("predicate").alias("p")), "p")
    weak = triples.withColumn("p", F.lower("predicate")).join(names, "p")
    weak = _top(weak.withColumn("score", F.lit(0).cast("long")), F.col("pos"), k=k).withColumn("match_type", F.lit("predicate"))
    names_out = ["qid", "match_type", "score", "rank", "pos", "subject", "predicate", "object"]
    return best.select(*names_out).union(weak.select(*names_out))


def by_hints(queries: DataFrame, triples: DataFrame, k: int = TOP_K) -> DataFrame:
    """qid, rank and the triples that fit the hints of queries(qid, generated_query); an absent hint restricts nothing."""
    few = queries.limit(MOST_HINTS + 1).count() <= MOST_HINTS
    hints = queries.where("generated_query <> ''").select("qid", entity_hint(F.col("generated_query")).alias("e"), predicate_hint(F.col("generated_query")).alias("p"))
    s, o = F.lower("subject"), F.lower("object")
    fits = F.col("e").isNull() | F.contains(s, "e") | F.contains(o, "e")
    # hints with a predicate meet its triples alone; the few others, of queries one by one, meet all
    told = triples.join(hints.where("p IS NOT NULL"), F.col("predicate") == F.col("p")).where(fits)
    free = triples.join(F.broadcast(hints.where("p IS NULL")) if few else hints.where("p IS NULL"), fits)
    return _top(told.union(free), F.col("pos"), k=k).select("qid", "rank", "pos", "subject", "predicate", "object")


def compared(questions: DataFrame, concept: DataFrame, hinted: DataFrame, found: DataFrame) -> DataFrame:
    """For each question: rows of both ways, what they share whatever the order of parts, and the entities found."""
    part = lambda df: df.select("qid", F.array_join(F.array_sort(F.array("subject", "predicate", "object")), "\x1f").alias("t"))
    shared = part(concept).intersect(part(hinted)).groupBy("qid").agg(F.count("*").alias("overlap"))
    counts = [concept.groupBy("qid").agg(F.count("*").alias("concept_count")), hinted.groupBy("qid").agg(F.count("*").alias("cypher_count")), shared]
    names = found.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("entity")), "; ").alias("concept_entities"))
    rows = questions.select("qid", "question")
    for c in counts:
        rows = rows.join(c, "qid", "left")
    return rows.join(names, "qid", "left").fillna(0, ["concept_count", "cypher_count", "overlap"]).fillna("", ["concept_entities"])


def totals(comparison: DataFrame) -> DataFrame:
    c, h, o = (F.sum(x) for x in ("concept_count", "cypher_count", "overlap"))
    return comparison.agg(c.alias("concept_total"), h.alias("cypher_total"), o.alias("overlap_total"), (c - o).alias("concept_unique"), (h - o).alias("cypher_unique"))


def answers(questions: DataFrame, retrieved: DataFrame) -> DataFrame:
    """qid, question, is_gap, triples_returned and response. Nothing retrieved, or a match by predicate alone, is a gap."""
    line = F.concat(F.lit("("), F.col("subject"), F.lit(") -["), F.col("predicate"), F.lit("]-> ("), F.col("object"), F.lit(")"))
    extra = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))) for c, label in (("sentence_ref", "  // Source: "), ("source_section", "  // Page: ")) if c in retrieved.columns]
    block = F.concat(F.concat_ws("\n", line, *extra), F.lit("\n"))
    match = F.max("match_type") if "match_type" in retrieved.columns else F.max(F.lit("entity"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n")
    rows = questions.join(retrieved.groupBy("qid").agg(F.count("*").alias("n"), match.alias("match"), text.alias("text")), "qid", "left")
    gap = F.col("n").isNull() | (F.col("match") != "entity")
    return rows.select("qid", "question", gap.alias("is_gap"), F.coalesce("n", F.lit(0)).cast("long").alias("triples_returned"), F.when(gap, NO_MATCH).otherwise(F.col("text")).alias("response"))


def gap_log(answered: DataFrame, approach: str, stamp: Column) -> DataFrame:
    rows = answered.where("is_gap")
    return rows.select(F.col("question").alias("text"), stamp.alias("timestamp"), F.lit(True).alias("no_match"), F.lit(approach).alias("approach"), "triples_returned")


def refused(answered: DataFrame) -> DataFrame:
    """How many questions failed gracefully."""
    return answered.agg(F.count_if(F.col("is_gap") & (F.col("response") == NO_MATCH)).alias("passed"), F.count("*").alias("questions"))
