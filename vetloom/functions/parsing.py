"""Model output and query text parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions.chunking import strip

CRITERION = "name string, score string, max_score string, justification string, flags array<string>, hard_fail_triggered boolean"

def triple_grammar(before_label: str = "") -> str:
    """(entity)-[label]->(entity), with white space around the arrows."""
    # fixed values: the brackets and arrows of a triple as models are told to write them
    entity, label = r"\(([^)]+)\)", rf"\[{before_label}([^\]]+)\]"
    return r"\s*".join([entity, "-", label, "->", entity])


LINE_TRIPLE, BLOCK_TRIPLE = triple_grammar(":?"), triple_grammar()
# fixed values: marks in replies
THINKING, FENCE, LANGUAGES = ("<think>", "</think>"), "```", ("cypher", "json")
PASSAGE, SENTENCE, SOURCE = "// PASSAGE:", "// SENTENCE REF:", "// SOURCE:"
PAGE = r"(?i)\s*\(page\s*(\d+)\)$"


def after(text: Column, mark: str) -> Column:
    """What follows the first of the marks, stripped; null without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, strip(F.substr(text, at + len(mark))))


def json_object(raw: Column) -> Column:
    """The widest {...} of a reply without code fences and <think> parts; null without one."""
    text = F.regexp_replace(raw, rf"(?i){FENCE}(?:json)?", "")
    text = F.regexp_replace(text, rf"(?is){THINKING[0]}.*?{THINKING[1]}", "")
    first, to = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    return F.when((first > 0) & F.contains(text, F.lit("}")) & (to > first), F.substr(text, first, to - first + 1))


def criteria(raw: Column) -> Column:
    """The criteria of a reply; null where nothing parses or the object has none."""
    fields = ", ".join(c.strip().replace(" ", ": ", 1) for c in CRITERION.split(","))
    return F.from_json(json_object(raw), f"criteria array<struct<{fields}>>", {"allowSingleQuotes": "false"})["criteria"]


def rescaled(score: Column, returned_max: Column, most: Column) -> Column:
    """A score on the criterion's own scale, clamped; what is no number counts 0."""
    raw, scale = score.try_cast("double").cast("long"), returned_max.try_cast("double").cast("long")
    scaled = F.when((scale > 0) & (scale != most), F.bround(F.try_divide(raw, scale) * most)).otherwise(raw)
    return F.coalesce(F.greatest(F.lit(0), F.least(scaled.cast("long"), most.cast("long"))), F.lit(0)).cast("long")


def without_reasoning(raw: Column) -> Column:
    """From the first '(', or else the first '[', or else the first '{'; then without a code fence around it."""
    cut = raw
    for mark in ("{", "[", "("):
        at = F.instr(raw, mark)
        cut = F.when(at > 0, F.substr(raw, at)).otherwise(cut)
    inner = F.substr(cut, F.lit(len(FENCE) + 1))
    for name in LANGUAGES:
        inner = F.when(inner.startswith(name), F.substr(inner, F.lit(len(name) + 1))).otherwise(inner)
    inner = F.when(inner.startswith("\n"), F.substr(inner, F.lit(2))).otherwise(inner)
    cut = F.when(cut.startswith(FENCE), inner).otherwise(cut)
    return strip(F.when(cut.endswith(FENCE), F.substr(cut, F.lit(1), F.length(cut) - len(FENCE))).otherwise(cut))


def passage(s: Column, p: Column, o: Column) -> Column:
    return F.format_string("(%s)-[:%s]->(%s)", s, p, o)


def line_triples(replies: DataFrame, keys: tuple[str, ...], raw_col: str = "raw", page_col: str = "page_num") -> DataFrame:
    """One row for each line '(S)-[:P]->(O) | Location: "..." (Page N)', in the order of lines."""
    line = strip(F.col("line"))
    rows = replies.select(*keys, page_col, F.posexplode(F.split(F.col(raw_col), "\n")).alias("line_no", "line")).withColumn("line", line)
    rows = rows.where(F.rlike("line", F.lit(LINE_TRIPLE)))
    s, p, o = (strip(F.regexp_extract("line", LINE_TRIPLE, k)) for k in (1, 2, 3))
    bar = F.instr("line", "|")
    located = r"(?i)\|\s*Location:\s*(.*)$"
    place = F.when(F.rlike("line", F.lit(located)), F.regexp_extract("line", located, 1))
    # a page in brackets ends the place; quotes around what is left go
    quoted = F.regexp_replace(F.regexp_replace(place, PAGE, ""), '^"', "")
    reference = F.coalesce(strip(F.regexp_replace(quoted, '"$', "")), F.when(bar > 0, strip(F.substr(F.col("line"), bar + 1))), F.lit("NO_REFERENCE"))
    page = F.coalesce(F.nullif(F.regexp_extract(place, PAGE, 1), F.lit("")), F.col(page_col).cast("string"))
    rows = rows.select(*keys, F.col("line_no").cast("long"), s.alias("subject"), F.upper(p).alias("predicate"), o.alias("object"), F.concat(F.lit("Page "), page).alias("source_section"), F.lit("High").alias("confidence"), reference.alias("sentence_ref"))
    return rows.withColumn("passage", passage(F.col("subject"), F.col("predicate"), F.col("object")))


def block_triples(replies: DataFrame, keys: tuple[str, ...], raw_col: str = "raw", page_col: str = "page_num") -> DataFrame:
    """One row for each block that isn't blank; a block without a triple gives an UNKNOWN one of low confidence."""
    rows = replies.select(*keys, page_col, F.posexplode(F.split(F.col(raw_col), rf"(?i)\n\s*{PASSAGE}")).alias("block_no", "block"))
    rows = rows.where(F.rlike("block", F.lit(r"(?U)\S")))
    block = F.col("block")
    text = strip(F.substring_index(block, f"\n{SENTENCE}", 1))
    sentence = F.coalesce(strip(F.substring_index(after(block, SENTENCE), f"\n{SOURCE}", 1)), F.lit(""))
    source = F.coalesce(after(block, SOURCE), F.lit("Unknown"))
    rows = rows.withColumn("passage", text)
    good = F.rlike("passage", F.lit(BLOCK_TRIPLE))
    parts = [F.when(good, strip(F.regexp_extract("passage", BLOCK_TRIPLE, k))).otherwise("UNKNOWN").alias(n) for k, n in ((1, "subject"), (2, "predicate"), (3, "object"))]
    section = F.concat(F.lit("Page "), F.col(page_col).cast("string"))
    return rows.select(*keys, F.col("block_no").cast("long"), *parts, section.alias("source_section"), F.when(good, "High").otherwise("Low").alias("confidence"), "passage", sentence.alias("sentence_ref"), source.alias("source"))


def clean_relation(relation: Column) -> Column:
    return F.regexp_replace(F.upper(relation), "[^A-Z0-9_]", "_")


def entity_hint(query: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(query, r"(?i)CONTAINS\s*['\"]([^'\"]+)['\"]", 1), F.lit("")))


def predicate_hint(query: Column) -> Column:
    return F.upper(F.nullif(F.regexp_extract(query, r"(?i)\[r:([^\]]+)\]", 1), F.lit("")))


def duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("long")
    return F.when(seconds < 60, F.format_string("%.2f sec", seconds)).otherwise(F.format_string("%dm %.2fs", minutes, seconds - 60 * minutes))
