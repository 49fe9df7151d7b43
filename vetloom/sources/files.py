"""Sources and sinks: documents, triples and records as files that Spark reads and writes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The page marker put before each page's text.
MARKER = "\n===== Page {} =====\n"

TRIPLES = "extraction_number int, paper string, subject string, predicate string, object string, source_section string, confidence string, passage string, sentence_ref string"

LOG = """paper string, paper_name string, timestamp string, model_used string, outcome string, accumulated_score int,
total_score int, max_possible int, score_pct double, hard_fail_count int, hard_fail_criteria array<string>,
thresholds struct<reject_below: int, manual_review_band: string, auto_approve_above: int>, rejection_reason string,
review_reason string, next_steps string, icat_flags array<string>,
criteria array<struct<name: string, score: int, max_score: int, passed: boolean, hard_fail: boolean, hard_fail_triggered: boolean,
evaluated_by: string, justification: string, flags: array<string>, passed_minimum: boolean, hard_fail_gate: boolean,
gate_triggered: boolean, details: string>>"""


def documents(spark: SparkSession, folder: str, parse: Callable[[bytes], list[str]] | None = None, glob: str = "*.pdf") -> DataFrame:
    """path, name and text of the files of a folder, pages parted by markers.

    parse gives the texts of a file's pages; without one, files are read as one page of UTF-8. A
    file that cannot be parsed has an empty text. Pages without text have no marker, but count.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    rows = rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for content in pdf["content"]:
                try:
                    found = parse(bytes(content)) if parse else [bytes(content).decode("utf-8", "replace")]
                except Exception:  # any parser may fail in any way, and one bad file is no reason to lose the others
                    found = []
                texts.append("".join(MARKER.format(k) + t for k, t in enumerate(found, 1) if t))
            yield pd.DataFrame({"path": pdf["path"], "name": pdf["name"], "text": texts})

    return rows.mapInPandas(run, "path string, name string, text string")


def with_override(meta: DataFrame, override: DataFrame, key: str = "name") -> DataFrame:
    """Metadata with a table of corrections by file name laid over it."""
    rows = meta.join(override.select(key, *[F.col(c).alias(f"{c}_") for c in override.columns if c != key]), key, "left")
    return rows.select(*[F.coalesce(f"{c}_", c).alias(c) if c in override.columns and c != key else F.col(c) for c in meta.columns])


def triples_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of triples with quoted and multi-line cells; every column stays text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def triples_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of triples; a relation is taken as predicate."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.withColumnRenamed("relation", "predicate") if "relation" in rows.columns else rows


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation records of every layout in the present one; older names of fields are filled into the newer."""
    rows = spark.read.schema(LOG).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    fields = {"passed": "passed_minimum", "hard_fail": "hard_fail_gate", "hard_fail_triggered": "gate_triggered", "justification": "details"}
    names = ["name", "score", "max_score", *fields, "evaluated_by", "flags"]
    newer = lambda c: F.struct(*[F.coalesce(c[n], c[fields[n]]).alias(n) if n in fields else c[n].alias(n) for n in names])
    return rows.withColumn("criteria", F.transform("criteria", newer))


def write_export(export: DataFrame, path: str, kind: str = "csv") -> None:
    """The export as CSV with a header, or as JSON lines."""
    if kind == "csv":
        export.write.csv(path, header=True, escape='"')
    else:
        export.write.json(path)


def json_array(export: DataFrame, by: str = "paper", order: str = "extraction_number") -> DataFrame:
    """One JSON array a paper."""
    rows = export.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in export.columns if c != order]))).alias("rows"))
    return rows.select(by, F.to_json("rows").alias("json"))


def write_records(records: DataFrame, path: str) -> None:
    """Records by outcome, one JSON line each."""
    records.write.mode("append").partitionBy("outcome").json(path)


def append(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Append to a log or queue."""
    writer = rows.write.mode("append")
    writer.csv(path, header=True) if kind == "csv" else writer.json(path)


def upsert_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Append the nodes and edges that the graph's tables lack."""
    from vetloom.operators.triples import upsert

    spark = nodes.sparkSession
    for name, new in (("nodes", nodes), ("edges", edges)):
        target = f"{path}/{name}"
        jpath = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)
        (upsert(spark.read.parquet(target), new) if there else new.distinct()).write.mode("append").parquet(target)
