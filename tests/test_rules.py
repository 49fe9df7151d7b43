"""Small cases of rules, and files."""

import json

from pyspark.sql import functions as F

from vetloom.functions import parsing as P
from vetloom.functions import text as T
from vetloom.operators import triples as TR
from vetloom.operators import vetting as V
from vetloom.sources import files, model
from vetloom.streaming.batch import vet_new


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def test_half_even(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, 12.5, 13.5)], "x double").select(T.half_even(F.col("x")).alias("y"))
    assert [r.y for r in rows.collect()] == [0, 2, 2, 12, 14]


def test_bands(spark):
    rows = spark.createDataFrame([(59, False), (60, False), (75, False), (76, False), (90, True)], "s int, h boolean")
    assert [r.o for r in rows.select(V.outcome(F.col("h"), F.col("s")).alias("o")).collect()] == ["REJECTED", "MANUAL_REVIEW", "MANUAL_REVIEW", "APPROVED", "REJECTED"]


def test_negation(spark):
    test = T.unnegated(F.col("t"), "methodology")
    assert one(spark, test, t="we used a methodology") is True
    assert one(spark, test, t="no clear methodology") is False
    assert one(spark, test, t="the piano methodology") is False  # a cue inside a word counts
    assert one(spark, test, t="no methodology. " + "x" * 50 + " methodology") is True
    assert one(spark, test, t=None) is None


VERDICTS = {
    "In my experience of these villages, and from my own perspective, this is a personal reflection with anecdotal commentary.": "experience_report",
    "Methodology. Semi-structured interviews with participants, a household survey and thematic analysis; data collection took weeks.": "data_driven",
    "A personal reflection, in my opinion; this narrative account is anecdotal, but it has one questionnaire and no sampling.": "experience_leaning",
    "A short note on festivals.": "undetermined",
    "There was no methodology and no survey here.": "undetermined",
}


def test_verdicts(spark):
    df = spark.createDataFrame([(t,) for t in VERDICTS], "t string").withColumn("norm", T.normalise(F.col("t")))
    rows = V.with_evidence(df).select("t", V.verdict(F.col("data"), F.col("experience")).alias("v"))
    assert {r.t: r.v for r in rows.collect()} == VERDICTS


def test_stem(spark):
    for path, name in (("a/b.c.pdf", "b.c"), ("x", "x"), ("a/.pdf", ".pdf"), ("a/b.", "b.")):
        assert one(spark, V.stem(F.col("t")), t=path) == name


def test_maximal(spark):
    rows = spark.createDataFrame([(["interview", "interviews", "survey", "in-depth interview"],)], "h array<string>")
    assert rows.select(T.maximal(F.col("h")).alias("m")).first().m == ["interviews", "survey", "in-depth interview"]


def test_title_and_references(spark):
    text = "\n===== Page 1 =====\nshort\nPage 12 of a long heading\nA title of some length\n"
    assert one(spark, T.inferred_title(F.col("t")), t=text) == "A title of some length"
    assert one(spark, T.inferred_title(F.col("t"), skip_markers=False), t=text) == "===== Page 1 ====="
    assert one(spark, T.has_reference_section(F.col("t")), t="it is referenced") is True  # the looser test of the tail
    assert one(spark, T.has_reference_section(F.col("t")), t="") is False


LINES = {
    '(A b)-[lives_in]->(C) | Location: "he said" (Page 5)': ("A b", "LIVES_IN", "C", "he said", "Page 5"),
    "(A)-[:X_Y]->(B)": ("A", "X_Y", "B", "NO_REFERENCE", "Page 9"),
    "(A) - [R] -> (B) | foo": ("A", "R", "B", "foo", "Page 9"),
    "junk": None,
    "(A)-[r]->(B) | location: no quotes": ("A", "R", "B", "no quotes", "Page 9"),
    'x (A)-[r]->(B) | Location: "q | r" (page 7)': ("A", "R", "B", "q | r", "Page 7"),
    '(A)-[: r ]->(B)|Location:"z" trailing': ("A", "R", "B", 'z" trailing', "Page 9"),
}


def test_line_parser(spark):
    df = spark.createDataFrame([(i, 9, line) for i, line in enumerate(LINES)], "k int, page_num int, raw string")
    got = {r.k: (r.subject, r.predicate, r.object, r.sentence_ref, r.source_section) for r in P.line_triples(df, ("k",)).collect()}
    assert got == {i: v for i, v in enumerate(LINES.values()) if v}


def test_block_parser(spark):
    raw = "intro\n// PASSAGE: (A)-[r]->(B)\n// SENTENCE REF: s\n// SOURCE: one\ntwo"
    df = spark.createDataFrame([(1, 2, raw), (2, 2, "// PASSAGE: (A)-[r]->(B)"), (3, 2, None)], "k int, page_num int, raw string")
    got = sorted((r.k, r.block_no, r.subject, r.confidence, r.passage, r.sentence_ref, r.source) for r in P.block_triples(df, ("k",)).collect())
    assert got == [(1, 0, "UNKNOWN", "Low", "intro", "", "Unknown"), (1, 1, "A", "High", "(A)-[r]->(B)", "s", "one\ntwo"), (2, 0, "A", "High", "// PASSAGE: (A)-[r]->(B)", "", "Unknown")]


def test_reply_parser(spark):
    good = {"name": "Structural Completeness", "score": 4, "max_score": 5, "justification": "j", "flags": ["hard_fail", "x", "x"], "hard_fail_triggered": True}
    replies = [(1, 0, "<think>{a}</think>```json\n" + json.dumps({"criteria": [good]}) + "\n```"), (1, 1, "nothing"), (2, 0, "{'criteria': []}"), (3, 0, json.dumps({"criteria": []}))]
    df = spark.createDataFrame(replies, "doc_id long, chunk_idx long, raw string")
    rows = V.model_criteria(df).collect()
    assert [(r.doc_id, r.score, r.flags, r.hard_fail_triggered, r.justification) for r in rows] == [(1, 16, ["x"], True, "j")]


def test_reasoning(spark):
    strip = P.without_reasoning(F.col("t"))
    assert one(spark, strip, t="so [x] then (A)-[r]->(B)\n```") == "(A)-[r]->(B)"
    assert one(spark, strip, t='{"a": [1]}') == "[1]}"
    assert one(spark, strip, t="plain") == "plain"


def test_audit_keeps_blank_objects_and_is_idempotent(spark):
    rows = [("GaroPeople", "SPEAKS", None), ("GaroPeople", "SPEAKS", None), (None, "KNOWS", "mandi"), ("Study", "X", "garo"), ("Garo", "X", "a Journal")]
    df = spark.createDataFrame(rows, "subject string, predicate string, object string")
    once = TR.audit(df)
    assert sorted(map(str, map(tuple, once.collect()))) == sorted(map(str, [("GaroPeople", "speaks", None), (None, "KNOWS", "mandi")]))
    assert sorted(map(str, TR.audit(once).collect())) == sorted(map(str, once.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"first\fsecond\f\ffourth")
    (tmp_path / "in/b.pdf").write_bytes(b"\xff")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    got = {r.name: r.text for r in files.documents(spark, str(tmp_path / "in"), lambda b: b.decode().split("\f")).collect()}
    assert got == {"a.pdf": "\n===== Page 1 =====\nfirst\n===== Page 2 =====\nsecond\n===== Page 4 =====\nfourth", "b.pdf": ""}
    old = {"paper": "p", "outcome": "REJECTED", "criteria": [{"name": "n", "score": 1, "passed_minimum": True, "hard_fail_gate": True, "gate_triggered": False, "details": "d"}]}
    new = {"paper": "q", "outcome": "APPROVED", "criteria": [{"name": "n", "score": 1, "passed": False, "hard_fail": False, "hard_fail_triggered": False, "justification": "j"}]}
    (tmp_path / "logs").mkdir()
    for k, x in enumerate((old, new)):
        (tmp_path / f"logs/{k}.json").write_text(json.dumps(x, indent=1))
    rows = {r.paper: r.criteria[0] for r in files.logs(spark, str(tmp_path / "logs")).collect()}
    assert rows["p"].passed and rows["p"].justification == "d" and not rows["q"].passed and rows["q"].justification == "j"
    (tmp_path / "t.json").write_text('[\n{"subject": "a", "relation": "r", "object": "b"}\n]')
    assert files.triples_json(spark, str(tmp_path / "t.json")).select("predicate").first()[0] == "r"


def test_graph_upsert(spark, tmp_path):
    path = str(tmp_path / "graph")
    for rows in ([("a", "r", "b")], [("a", "r", "b"), ("b", "r", "c"), ("b", "r", "c")]):
        t = spark.createDataFrame(rows, "subject string, predicate string, object string")
        files.upsert_graph(TR.nodes(t), TR.edges(t), path)
    assert spark.read.parquet(path + "/nodes").count() == 3 and spark.read.parquet(path + "/edges").count() == 2


def test_live_client_tries_again(spark):
    df = spark.createDataFrame([("a",), ("b",)], "prompt string")
    got = {r.prompt: r.raw for r in model.live(df, lambda p: p.upper() if p == "a" else 1 / 0, "query").collect()}
    assert got == {"a": "A", "b": ""}


def test_stream_vets_new_files_once(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, "text")], "doc_id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        vet_new(spark, str(tmp_path / "in"), "doc_id long, text string", V.overridden, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1]
