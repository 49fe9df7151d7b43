"""The scoreboard: eight criteria, overrides, totals, bands and records. One pass over texts, one sum by document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetloom.functions import lexicons as L
from vetloom.functions import text as T
from vetloom.functions.parsing import criteria, rescaled

CRITERION = "name string, score long, max_score long, passed boolean, hard_fail boolean, hard_fail_triggered boolean, evaluated_by string, justification string, flags array<string>"


def _criterion(name: str, score: Column, most: int, passed: Column, hard: bool, triggered: Column, by: Column, why: Column, flags: Column) -> Column:
    parts = [F.lit(name), score.cast("long"), F.lit(most).cast("long"), passed, F.lit(hard), triggered, by, F.coalesce(why, F.lit("")), flags]
    return F.struct(*[p.alias(f.split()[0]) for p, f in zip(parts, CRITERION.split(", "))])


def quoted(items: Column) -> Column:
    """A list of plain strings as a record shows it."""
    mark = lambda x: F.when(F.contains(x, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(mark(x), x, mark(x))), ", "), F.lit("]"))


def metadata(title: Column, authors: Column, year: Column, journal: Column, doi: Column) -> tuple[Column, Column, Column, Column]:
    """Score, passed, and the found and missing fields; '' and an empty list count as missing."""
    present = {"title": T.first_present(title) != "", "authors": F.coalesce(F.size(authors), F.lit(0)) > 0}
    present |= {n: T.first_present(c) != "" for n, c in (("year", year), ("journal", journal), ("doi", doi))}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in present.items()]))
    missing = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in present.items()]))
    score = 2 * F.size(found)
    return score, score >= 5, found, missing


def red_flags(text: Column, phrases: Sequence[str] = L.RED_FLAGS, ai: Sequence[str] = L.AI_PHRASES) -> tuple[Column, Column, Column]:
    """Score, whether the hard fail is triggered, and the phrases found, of a normalised text."""
    found = T.hits(text, phrases)
    serious = T.any_of(text, [p for p in phrases if p not in ai])
    none = F.size(found) == 0
    cautious = ~none & ~serious & T.cites_references(text)
    return F.when(none, 5).when(cautious, 3).otherwise(0), ~none & ~cautious, found


def with_evidence(rows: DataFrame, text: str = "norm", data: Sequence[str] = L.DATA_SIGNALS, experience: Sequence[str] = L.EXPERIENCE_SIGNALS) -> DataFrame:
    """rows with data and experience: maximal hits of data signals that aren't negated, and of experience signals.

    The hits are columns of their own first, so that they are found once and not for each comparison.
    """
    rows = rows.withColumn("data", T.unnegated_hits(F.col(text), data)).withColumn("experience", T.hits(F.col(text), experience))
    return rows.withColumn("data", T.maximal(F.col("data"))).withColumn("experience", T.maximal(F.col("experience")))


def verdict(data: Column, experience: Column) -> Column:
    d, e = F.size(data), F.size(experience)
    return F.when((e > 0) & (d == 0), "experience_report").when((d > 0) & (e > d), "experience_leaning").when(d > 0, "data_driven").otherwise("undetermined")


def experience_score(of_verdict: Column) -> Column:
    return F.when(of_verdict == "experience_report", 5).when(of_verdict == "experience_leaning", 3).otherwise(0)


def structure_override(full_text: Column, text: Column) -> Column:
    return T.has_reference_section(full_text) & T.all_of(text, L.STRUCTURE_WORDS)


def community_override(text: Column) -> Column:
    return T.any_of(text, L.COMMUNITY_SIGNALS) & ~T.any_of(text, L.HARMFUL_SIGNALS)


def ethics_override(text: Column) -> Column:
    return T.any_of(text, L.ETHICS_SIGNALS) & ~T.any_of(text, L.HARMFUL_SIGNALS)


def parsed_criteria(replies: DataFrame) -> DataFrame:
    """doc_id, chunk_idx, ord and the item of each criterion in replies(doc_id, chunk_idx, raw); replies without any are failures."""
    rows = replies.select("doc_id", "chunk_idx", F.posexplode(criteria(F.col("raw"))).alias("ord", "item"))
    return rows.select("doc_id", "chunk_idx", F.col("ord").cast("long"), "item")


def model_criteria(replies: DataFrame) -> DataFrame:
    """doc_id, name, score, flags, hard_fail_triggered and justification of each expected criterion with a reply.

    A name twice in one reply: the last counts. Scores are rescaled and averaged, ties to even; flags
    keep their first places; the justification is that of the chunk nearest to the average.
    """
    known = F.create_map(*[F.lit(x) for name, most, _ in L.MODEL_CRITERIA for x in (name, most)])
    rows = parsed_criteria(replies).withColumn("name", F.col("item.name"))
    rows = rows.where(F.col("name").isin([n for n, _, _ in L.MODEL_CRITERIA]))
    rows = rows.groupBy("doc_id", "chunk_idx", "name").agg(F.max_by("item", "ord").alias("item"))
    most = F.element_at(known, F.col("name"))
    score = rescaled(F.col("item.score"), F.col("item.max_score"), most)
    chunk = F.struct(F.col("chunk_idx").alias("chunk"), score.alias("score"), F.coalesce("item.flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("item.hard_fail_triggered", F.lit(False)).alias("hard"), F.coalesce("item.justification", F.lit("")).alias("why"))
    rows = rows.groupBy("doc_id", "name").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.bround(F.avg(score)).cast("long").alias("score"))
    quiet = F.col("name") == "Peer Review Signals"
    flags = F.array_distinct(F.filter(F.flatten(F.col("chunks.flags")), lambda f: ~F.lower(f).isin(L.DROPPED_FLAGS)))
    nearest = F.array_min(F.transform("chunks", lambda c: F.struct(F.abs(c["score"] - F.col("score")).alias("gap"), c["chunk"].alias("chunk"), c["why"].alias("why"))))
    return rows.select(
        "doc_id", "name", "score", F.when(quiet, F.array().cast("array<string>")).otherwise(flags).alias("flags"),
        (~quiet & F.exists("chunks", lambda c: c["hard"])).alias("hard_fail_triggered"), nearest["why"].alias("justification"),
    )


def scoreboard(docs: DataFrame, replies: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """doc_id, criteria with their justifications, total_score, max_possible, score_pct, hard_fails and outcome of docs(doc_id, text).

    meta(doc_id, title, authors, year, journal, doi) holds what the caller knows. Documents without
    any usable reply get zeros for the model's criteria.
    """
    by_name = model_criteria(replies)
    scored = by_name.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("score", "flags", "hard_fail_triggered", "justification")))).alias("model"))
    answered = parsed_criteria(replies).select("doc_id").distinct().withColumn("answered", F.lit(True))
    rows = docs.select("doc_id", "text").withColumn("norm", T.normalise(F.col("text"))).withColumn("split", T.lines(F.col("text")))
    rows = with_evidence(rows)
    text, norm, split = (F.col(c) for c in ("text", "norm", "split"))
    flags = F.struct(*[c.alias(n) for c, n in zip(red_flags(norm), ("score", "triggered", "found"))])
    # what the texts say, in few bytes; no text is moved
    rows = rows.select(
        "doc_id", "data", "experience", flags.alias("red"), T.hits(norm, L.DOMAIN_KEYWORDS).alias("domain"),
        (T.has_reference_section(text, norm, split) & T.all_of(norm, L.STRUCTURE_WORDS)).alias("structure"), community_override(norm).alias("community"), ethics_override(norm).alias("ethics"),
        T.inferred_title(text, split=split).alias("own_title"), T.first_year(text).alias("own_year"), T.author_candidates(text, most=3, split=split).alias("own_authors"),
    )
    title, year, authors = F.col("own_title"), F.col("own_year"), F.col("own_authors")
    journal = doi = F.lit("")
    if meta is not None:
        rows = rows.join(meta, "doc_id", "left")
        title, year = T.first_present(F.col("title"), title), T.first_present(F.col("year"), year)
        authors = F.when(F.size("authors") > 0, F.col("authors")).otherwise(authors)
        journal, doi = F.col("journal"), F.col("doi")
    rows = rows.join(answered, "doc_id", "left").join(scored, "doc_id", "left")
    overrides = {
        "Structural Completeness": (F.col("structure"), F.lit(20)),
        "Authorship & Community Alignment (IKAT)": (F.col("community"), F.lit(18)),
        "Ethical Source Handling & Consent": (F.col("ethics"), F.lit(8)),
    }
    out = []
    lost = F.col("answered").isNull()
    by_model, by_code = F.when(lost, "fallback").otherwise("model"), F.lit("code")
    for name, most, hard in L.MODEL_CRITERIA:
        own = F.try_element_at(F.col("model"), F.lit(name))
        score, triggered = F.coalesce(own["score"], F.lit(0)), F.coalesce(own["hard_fail_triggered"], F.lit(False))
        flags = F.when(lost, F.array(F.lit("Model unavailable"))).otherwise(F.coalesce(own["flags"], F.array().cast("array<string>")))
        if name == "Peer Review Signals":
            hard, triggered = False, F.lit(False)
        passed = score > 0
        why = F.when(lost, L.WHY_LOST).when(own.isNull(), L.WHY_NOT_NAMED).otherwise(own["justification"])
        if name in L.WHY_FIXED:
            why = F.when(overrides[name][0] if name in overrides else F.lit(True), L.WHY_FIXED[name]).otherwise(why)
        if name in overrides:
            applies, least = overrides[name]
            score = F.when(applies, F.greatest(score, least)).otherwise(score)
            triggered, passed = triggered & ~applies, passed | applies
        out.append(_criterion(name, score, most, passed, hard, triggered, by_model, why, flags))
    no = F.lit(False)
    empty = F.array().cast("array<string>")
    m_score, m_passed, present, missing = metadata(title, authors, year, journal, doi)
    m_why = F.concat(F.lit("Metadata present: "), quoted(present), F.lit(". Missing: "), quoted(missing), F.lit("."))
    out.append(_criterion(L.CODE_CRITERIA[0], m_score, 10, m_passed, False, no, by_code, m_why, F.transform(missing, lambda x: F.concat(F.lit("Missing: "), x))))
    r_score, triggered, found = (F.col(f"red.{c}") for c in ("score", "triggered", "found"))
    r_why = F.when(triggered, L.WHY_RED).when(F.size(found) > 0, L.WHY_CAUTION).otherwise(L.WHY_NO_RED)
    out.append(_criterion(L.CODE_CRITERIA[1], r_score, 5, ~triggered, True, triggered, by_code, r_why, F.transform(found, lambda x: F.concat(F.lit("Red flag: '"), x, F.lit("'")))))
    of_verdict = verdict(F.col("data"), F.col("experience"))
    e_why = F.element_at(F.create_map(*[F.lit(x) for kv in L.WHY_VERDICT.items() for x in kv]), of_verdict)
    first = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(F.array_sort(c), 1, 8), ", ")))
    out.append(_criterion(L.CODE_CRITERIA[2], experience_score(of_verdict), 5, F.lit(True), False, no, by_code, e_why, F.array_compact(F.array(first("Experience signals: ", F.col("experience")), first("Data-driven signals: ", F.col("data"))))))
    relevant = F.size("domain") > 0
    d_why = F.when(relevant, F.concat(F.lit(L.WHY_DOMAIN), quoted(F.col("domain")), F.lit("."))).otherwise(L.WHY_NO_DOMAIN)
    out.append(_criterion(L.CODE_CRITERIA[3], F.lit(0), 0, F.lit(True), False, no, by_code, d_why, F.when(relevant, empty).otherwise(F.array(F.lit("No configured domain keywords found")))))
    rows = rows.select("doc_id", F.array(*out).alias("criteria"))
    return totals(rows)


def totals(rows: DataFrame) -> DataFrame:
    """Sums, share and outcome of rows with an array of criteria."""
    add = lambda field: F.aggregate(F.transform("criteria", lambda c: c[field]), F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("total_score", add("score")).withColumn("max_possible", add("max_score"))
    rows = rows.withColumn("hard_fails", F.transform(F.filter("criteria", lambda c: c["hard_fail"] & c["hard_fail_triggered"]), lambda c: c["name"]))
    return rows.withColumn("score_pct", T.percent(F.col("total_score"), F.col("max_possible"))).withColumn("outcome", outcome(F.size("hard_fails") > 0, F.col("total_score")))


def outcome(hard_fail: Column, score: Column, reject_below: int = L.REJECT_BELOW, review_up_to: int = L.REVIEW_UP_TO) -> Column:
    return F.when(hard_fail | (score < reject_below), "REJECTED").when(score <= review_up_to, "MANUAL_REVIEW").otherwise("APPROVED")


def reason(board: DataFrame) -> Column:
    """Why a document isn't approved; null if it is."""
    # fixed values: the texts of a record
    share = F.concat(F.lit("Accumulated score "), F.col("total_score"), F.lit("/"), F.col("max_possible"), F.lit(" ("), F.format_string("%.1f", F.col("score_pct")), F.lit("%) "))
    hard = F.filter("criteria", lambda c: c["hard_fail"] & c["hard_fail_triggered"])
    failed = F.concat(F.lit("Hard-fail criterion triggered: "), F.array_join(F.transform(hard, lambda c: F.concat(c["name"], F.lit(" — "), c["justification"])), "; "))
    below = F.concat(share, F.lit(f"is below the reject threshold of {L.REJECT_BELOW}."))
    band = F.concat(share, F.lit(f"is in the manual review band ({L.REJECT_BELOW}-{L.REVIEW_UP_TO})."))
    return F.when(F.size("hard_fails") > 0, failed).when(F.col("total_score") < L.REJECT_BELOW, below).when(F.col("total_score") <= L.REVIEW_UP_TO, band)


def next_steps() -> Column:
    # fixed values: the texts of a record
    return (
        F.when(F.col("outcome") == "REJECTED", "REJECTED — paper skipped. Review the hard-fail criteria and criterion justifications before reconsidering this source.")
        .when(F.col("outcome") == "MANUAL_REVIEW", "MANUAL REVIEW — extraction is held pending human review.")
        .otherwise("APPROVED — paper passed the scoreboard and is ready for knowledge graph extraction.")
    )


def log_type() -> Column:
    return F.when(F.col("outcome") == "REJECTED", "rejection").when(F.col("outcome") == "MANUAL_REVIEW", "review").otherwise("approval")


def stem(path: Column) -> Column:
    """A path's last part without its last suffix; a leading or trailing dot starts none."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]+$", "")


def records(board: DataFrame, stamp: Column, path: Column, model_used: Column) -> DataFrame:
    """The whole evaluation record of each document, with its doc_id and file name."""
    file_name = F.concat(stamp, F.lit("_"), log_type(), F.lit("_"), T.safe_name(stem(path)), F.lit(".json"))
    band = F.lit(f"{L.REJECT_BELOW}-{L.REVIEW_UP_TO}")
    thresholds = F.struct(F.lit(L.REJECT_BELOW).alias("reject_below"), band.alias("manual_review_band"), F.lit(L.REVIEW_UP_TO).alias("auto_approve_above"))
    why = reason(board)
    return board.select(
        "doc_id", file_name.alias("file_name"), path.alias("paper"), stem(path).alias("paper_name"), stamp.alias("timestamp"), model_used.alias("model_used"), "outcome",
        F.col("total_score").alias("accumulated_score"), "total_score", "max_possible", "score_pct", F.size("hard_fails").cast("long").alias("hard_fail_count"), F.col("hard_fails").alias("hard_fail_criteria"),
        thresholds.alias("thresholds"), F.when(F.col("outcome") == "REJECTED", why).alias("rejection_reason"), F.when(F.col("outcome") == "MANUAL_REVIEW", why).alias("review_reason"),
        "criteria", next_steps().alias("next_steps"),
    )


def review_queue(board: DataFrame, stamp: Column, path: Column, model_used: Column) -> DataFrame:
    """The queue's twelve columns for documents that wait for a reviewer, after their doc_id."""
    rows = board.where("outcome = 'MANUAL_REVIEW'")
    return rows.select(
        "doc_id", stamp.alias("timestamp"), stem(path).alias("paper_name"), path.alias("paper_path"), model_used.alias("model_used"), F.col("total_score").alias("accumulated_score"), "max_possible", "score_pct",
        F.array_join("hard_fails", "; ").alias("hard_fail_criteria"), reason(rows).alias("review_reason"), F.lit("PENDING").alias("status"), F.lit("").alias("override_by"), F.lit("").alias("override_note"),
    )


def status(of_outcome: Column) -> Column:
    """A batch's label; what has no outcome failed, and isn't taken for a rejection."""
    return F.when(of_outcome == "APPROVED", "APPROVED").when(of_outcome == "MANUAL_REVIEW", "MANUAL REVIEW").when(of_outcome == "REJECTED", "REJECTED").otherwise("ERROR")


def pending(board: DataFrame, done: DataFrame) -> DataFrame:
    """Approved documents whose extraction isn't there yet."""
    return board.where("outcome = 'APPROVED'").join(done, "doc_id", "left_anti")


def overridden(docs: DataFrame) -> DataFrame:
    """A manual override: approved without reading, no criteria, total -1, no record."""
    return docs.select("doc_id", F.lit("APPROVED").alias("outcome"), F.lit(-1).cast("long").alias("total_score"), F.lit(0).cast("long").alias("criteria_count"))


def with_decisions(board: DataFrame, decisions: DataFrame) -> DataFrame:
    """Manual decisions(doc_id, manual_decision) laid over outcomes."""
    return board.join(decisions, "doc_id", "left").withColumn("final_outcome", F.coalesce("manual_decision", "outcome"))
