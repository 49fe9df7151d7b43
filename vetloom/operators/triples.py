"""Triples: loading, numbering, deduplicating, auditing, and the graph of nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.functions import lexicons as L
from vetloom.functions.chunking import strip
from vetloom.functions.parsing import clean_relation

EXPORT = ["extraction_number", "paper", "subject", "predicate", "object", "source_section", "confidence", "passage", "sentence_ref"]


def load(raw: DataFrame) -> DataFrame:
    """Stripped triples with defaults, complete ones only."""
    parts = [strip(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("subject", "predicate", "object", "sentence_ref")]
    rows = raw.select("pos", *parts, F.coalesce("source_section", F.lit("Unknown")).alias("source_section"), F.coalesce("confidence", F.lit("Medium")).alias("confidence"))
    return rows.where("subject <> '' AND predicate <> '' AND object <> ''")


def known(triples: DataFrame) -> DataFrame:
    """Without the triples that no parser could read."""
    return triples.where("subject <> 'UNKNOWN'")


def enrich(triples: DataFrame, meta: DataFrame, key: str = "doc_id") -> DataFrame:
    """Document metadata attached to each triple."""
    return triples.join(meta, key)


def _first_place(triples: DataFrame, key: list[Column], best: list[Column], pos: str) -> DataFrame:
    """The triple of each key with the least of best, at the place of the key's first; keys with a null go.

    Both are sums that are made before rows are moved, so a key that very many rows share costs no task more.
    """
    names = [f"k{i}" for i in range(len(key))]
    others = [c for c in triples.columns if c != pos]
    rows = triples.select(*[k.alias(n) for k, n in zip(key, names)], F.col(pos).alias("at_"), F.struct(*best, F.col(pos)).alias("by_"), F.struct(*others).alias("row_"))
    rows = rows.where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    kept = rows.groupBy(*names).agg(F.min("at_").alias(pos), F.min_by("row_", "by_").alias("row_"))
    return kept.select(*[F.col(pos) if c == pos else F.col(f"row_.{c}") for c in triples.columns])


def prefer_high(triples: DataFrame, pos: str = "pos") -> DataFrame:
    """One triple for each subject, predicate and object (stripped, lower-cased): the first of high confidence, else the first."""
    key = [F.lower(strip(F.col(c))) for c in ("subject", "predicate", "object")]
    return _first_place(triples, key, [~F.col("confidence").eqNullSafe("High")], pos)


def longest_reference(triples: DataFrame, pos: str = "pos") -> DataFrame:
    """One triple for each lower-cased subject, verbatim predicate and lower-cased object: that of the longest reference."""
    return _first_place(triples, [F.lower("subject"), F.col("predicate"), F.lower("object")], [-F.coalesce(F.length("sentence_ref"), F.lit(0))], pos)


def numbered(triples: DataFrame, paper: str = "paper", pos: str = "pos") -> DataFrame:
    """The export form: numbered from 1 within each paper, defaults filled, other columns left out."""
    defaults = {"source_section": "Unknown", "confidence": "Medium", "passage": "", "sentence_ref": ""}
    rows = triples.withColumn("extraction_number", F.row_number().over(Window.partitionBy(paper).orderBy(pos)).cast("long"))
    return rows.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c) for c in EXPORT])


def _outside(c: str, words: Sequence[str]) -> Column:
    # a missing cell counts as the text nan, so it stays
    return ~F.coalesce(F.col(c), F.lit("nan")).isin(list(words))


def audit(
    triples: DataFrame,
    keywords: Sequence[str] = L.AUDIT_KEYWORDS,
    subjects: Sequence[str] = L.AUDIT_SUBJECTS,
    predicates: Sequence[str] = L.AUDIT_PREDICATES,
    markers: Sequence[str] = L.AUDIT_OBJECT_MARKERS,
    non_core: Sequence[str] = L.AUDIT_NON_CORE_SUBJECTS,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Triples about the keywords, without listed subjects, predicates and object markers, predicates renamed, rows distinct.

    All tests are of one filter on the original columns; renaming comes after.
    """
    names = L.PREDICATE_NAMES if names is None else names
    about = "(?i)" + "|".join(keywords)
    mentions = F.lit(False)
    for c in ("subject", "predicate", "object"):
        mentions = mentions | F.rlike(F.coalesce(F.col(c), F.lit("nan")), F.lit(about))
    marked = F.rlike(F.coalesce(F.col("object"), F.lit("nan")), F.lit("(?i)" + "|".join(markers)))
    rows = triples.where(_outside("subject", [*subjects, *non_core]) & _outside("predicate", predicates) & ~marked & mentions)
    renamed = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    p = F.coalesce(F.col("predicate"), F.lit("nan"))
    return rows.withColumn("predicate", F.coalesce(F.try_element_at(renamed, p), p)).dropDuplicates()


def nodes(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("subject").alias("name")).union(triples.select("object")).distinct()


def edges(triples: DataFrame) -> DataFrame:
    return triples.select(F.col("subject").alias("src"), clean_relation(F.col("predicate")).alias("rel"), F.col("object").alias("dst")).distinct()


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that a distinct table lacks: what a merge would create."""
    return new.distinct().join(existing, [new[c].eqNullSafe(existing[c]) for c in new.columns], "left_anti")


def browse(edge_table: DataFrame, limit: int = 100) -> DataFrame:
    """The first edges in a total order."""
    return edge_table.orderBy("src", "rel", "dst").limit(limit)


def entities(triples: DataFrame) -> DataFrame:
    return triples.select(F.lower("subject").alias("entity")).union(triples.select(F.lower("object"))).distinct()


def mentions(triples: DataFrame, pos: str = "pos") -> DataFrame:
    """(entity, pos) of every mention; a triple whose subject is its object is there twice."""
    return triples.select(F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("entity"), pos)


def predicate_list(triples: DataFrame, most: int = 20) -> DataFrame:
    """The first distinct predicates in order, one row each, for prompts; aggregated before the sort."""
    return triples.select("predicate").distinct().orderBy("predicate").limit(most)


def unknown_rate(triples: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("subject") == "UNKNOWN")
    return triples.agg(F.count("*").alias("triples"), bad.alias("unknown"), (bad / F.count("*")).alias("rate"))


def extraction_stats(raw: DataFrame, unique: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("raw_triples")).crossJoin(unique.agg(F.count("*").alias("unique_triples")))  # one row each
