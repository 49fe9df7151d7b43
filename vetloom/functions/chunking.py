"""Overlapping windows of words and characters, and pages out of marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = r"===== Page \d+ =====\n"


def word_chunks(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_idx and chunk: windows of words joined by a space, one every size - overlap words."""
    words = F.filter(F.split(text_col, r"(?U)\s+"), lambda x: x != "")
    rows = docs.select(id_col, words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.size("words") - 1, F.lit(size - overlap))
    return rows.select(id_col, "words", F.posexplode(starts).alias("chunk_idx", "start")).select(
        id_col, F.col("chunk_idx").cast("long"), F.array_join(F.slice("words", F.col("start") + 1, F.lit(size)), " ").alias("chunk")
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def char_chunks(pages: DataFrame, size: int, overlap: int, keys: tuple[str, ...] = ("doc_id", "page_num"), text_col: str = "content") -> DataFrame:
    """keys, chunk_idx and the stripped chunk: windows of characters of each page that isn't blank; blank chunks stay."""
    rows = pages.where(F.rlike(text_col, F.lit(r"(?U)\S")))
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(size - overlap))
    rows = rows.select(*keys, text_col, F.posexplode(starts).alias("chunk_idx", "start"))
    chunk = strip(F.substring(F.col(text_col), F.col("start") + 1, F.lit(size)))
    return rows.select(*keys, F.col("chunk_idx").cast("long"), chunk.alias("chunk"))


def pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, page_num and content of each marked page; text before the first marker is dropped."""
    numbers = F.regexp_extract_all(text_col, F.lit(r"===== Page (\d+) =====\n"), 1)
    parts = F.split(text_col, PAGE)
    rows = docs.select(id_col, numbers.alias("numbers"), parts.alias("parts")).where(F.size("numbers") > 0)
    rows = rows.select(id_col, F.explode(F.arrays_zip("numbers", F.slice("parts", F.lit(2), F.size("numbers")).alias("contents"))).alias("p"))
    return rows.select(id_col, F.col("p.numbers").cast("long").alias("page_num"), F.col("p.contents").alias("content"))
