"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a queue of its documents in a shuffled order, served up to REPEATS times over.
A serving's virtual finish time is the source's words up to its end divided by the source's
target. All servings are range-sorted by it over all sources, and the mix is what comes first
until the total budget, the sum of all sizes, is spent. The targets add up to the budget, so it
is spent at virtual time 1: a serving that is under way then is cut in two, words up to that time
and the rest, so that a source's words miss its target by a part of a document no more. Servings
that begin later are never reached. The words that targets leave over in rounding, fewer than
there are sources, go to those rests.

Targets: sources by code point of their name, null last, weigh 5, 2, 1, repeating, and share
all words by weight. No target passes REPEATS times its source's size; what is above goes to
the other sources by weight until none is above. That fixed point is found in closed form: in
the order of size / weight the capped sources come first, so one pass of running sums over the
sources, one row each, finds how many are capped. The sources must fit one task; documents needn't.

Running sums are made in two steps, sums of ranges and then inside a range: over a source's
documents by ranges of the shuffle key, and over all servings by RANGES equal ranges of virtual
time, each of which holds about as many words as any other, whatever the sources. So no source,
key or range, however large, meets in one task; rows of one doc_id, null ones too, are told apart
by their size and a number of their own in the shuffle key.

Defined results: null texts have size 0, documents of size 0 take nothing and are in no mix;
null is a source of its own; a null doc_id is shuffled as an empty one; repeated rows are served
one by one, in the order of their number; ties of finish time go by source and place in its queue; an
empty table gives an empty table; a text of any length is read once; columns of documents with
names used here are kept as they are by mixed() and ignored by plan().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vetloom.session import materialise

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Ranges of virtual time up to its end.
RANGES = 4096
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text, which is the number of places where one starts."""
    # white space becomes one space a run; in most runs it is one already
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))
    spaces = F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.when(plain == "", 0).otherwise(spaces + 1).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """uid, doc_id, source and size of each row of docs, written, so that a row keeps its uid; all that plan() needs."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.col("source"), words(F.col("text")).alias("size"))
    return materialise(rows, "sizes")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target of each source of sizes(source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - repeats * F.coalesce(F.sum("source_size").over(below), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("free", repeats * F.col("source_size") >= F.col("level") * F.col("weight"))
        # the level of the first source that isn't capped is that of all that follow
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("level")))).over(everything)["level"])
    )
    target = F.least(F.col("level") * F.col("weight"), (repeats * F.col("source_size")).cast("double"))
    return per.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def queued(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """rows(uid, doc_id, source, size) with source_size, target and served_before, the words of the source ahead of it."""
    # repeated ids are shuffled by their sizes too, and only rows alike in both by their number
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("shuffle_key", key).withColumn("bucket", F.concat(F.substring("shuffle_key", 1, 2), F.substring(F.md5(F.col("size").cast("string")), 1, 2)))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goal = targets(buckets, weights, repeats).select(F.col("source").alias("s"), "source_size", "target")
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("shuffle_key", "doc_id", "size", "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("served_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(ahead, rows["source"].eqNullSafe(ahead["s"]) & (rows["bucket"] == ahead["b"])).drop("s", "b")
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["s"])).drop("s")
    return rows.withColumn("served_before", F.col("served_before") + F.col("ahead")).drop("shuffle_key", "bucket", "ahead")


def servings(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """queued() rows, one for each part of a serving that may be reached, with turn, finish, words and how many are taken.

    A row without any such part stays once, with turn null and nothing taken.
    """
    budget = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    rows = queued(rows, weights, repeats)
    whole, size = F.floor("target"), F.col("size")

    def parts(turn: int) -> list[Column]:
        start = F.col("served_before") + turn * F.col("source_size")
        first = F.greatest(F.lit(0), F.least(size, whole - start))
        part = lambda at, n: F.struct(F.lit(turn).alias("turn"), start.alias("start"), (at / F.col("target")).alias("finish"), n.cast("long").alias("words"))
        return [
            F.when(first > 0, part(start + first, first)),
            F.when((start <= whole) & (whole < start + size), part(start + size, size - first)),
        ]

    found = F.array_compact(F.array(*[p for c in range(repeats) for p in parts(c)]))
    rows = rows.withColumn("part", F.explode_outer(found)).select("*", "part.*").drop("part")
    # ranges of virtual time; after its end the rests, a row a source at most; rows without parts are dealt out below 0
    at = F.when(F.col("finish") <= 1, F.floor(F.col("finish") * RANGES)).otherwise(RANGES + 1)
    rows = rows.withColumn("range", F.coalesce(F.when(F.col("words").isNotNull(), at), -1 - F.pmod(F.xxhash64("uid"), F.lit(RANGES))))
    rows = materialise(rows, "servings")
    sums = rows.groupBy("range").agg(F.sum("words").alias("words"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range
    ahead = sums.select(F.col("range").alias("r"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "start", "uid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("spent", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    rows = rows.join(F.broadcast(ahead), rows["range"] == ahead["r"]).join(F.broadcast(budget))
    left = F.col("budget") - F.col("ahead") - F.col("spent")
    taken = F.greatest(F.lit(0), F.least(F.coalesce("words", F.lit(0)), left)).cast("long")
    return rows.withColumn("taken", taken).drop("r", "range", "ahead", "spent", "budget")


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """uid, doc_id, source, size, source_size, target and taken of each row that sized() gives."""
    same = [F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")]
    return servings(rows, weights, repeats).groupBy("uid").agg(*same, F.sum("taken").alias("taken"))


def schedule(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The mix itself: a row for each part of a serving, with turn, words taken and virtual finish time, range-sorted by that time."""
    return servings(sized(docs), weights, repeats).where("taken > 0").orderBy("finish", F.col("source").asc_nulls_last(), "start")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The documents of the mix as rows with docs' own columns: a row for each serving of which the mix takes at least half."""
    kept = materialise(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "docs")
    rows = kept.select("uid", "row.doc_id", "row.source", words(F.col("row.text")).alias("size"))
    turns = servings(materialise(rows, "sizes"), weights, repeats).groupBy("uid", "turn").agg(F.sum("taken").alias("taken"), F.first("size").alias("size"))
    times = turns.where("taken > 0 AND 2 * taken >= size").groupBy("uid").agg(F.count("*").cast("int").alias("times"))
    return kept.join(times, "uid").withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


def plan_sql(weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> str:
    """The digest of plan() as SQL over documents, with windows over a whole source and over all servings instead of ranges."""
    listed = ", ".join(f"{float(w)}" for w in weights)
    turns = ", ".join(str(c) for c in range(repeats))
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k, row_number() OVER () AS uid FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([{listed}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT)::DOUBLE AS weight FROM s),
n AS (SELECT *, {repeats} * source_size AS most, sum(source_size) OVER () AS total,
             row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k,
             count(*) OVER () AS sources FROM w),
l AS (SELECT a.k, min((a.total - coalesce((SELECT sum(b.most) FROM n b WHERE b.k < a.k), 0))::DOUBLE) /
             (SELECT sum(b.weight) FROM n b WHERE b.k >= a.k) AS level FROM n a GROUP BY a.k),
f AS (SELECT l.level FROM l JOIN n USING (k) WHERE n.most >= l.level * n.weight ORDER BY n.k LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((SELECT level FROM f) * weight, most::DOUBLE), 0) AS target FROM n),
p AS (SELECT d.uid, d.doc_id, d.size, d.source, t.source_size, t.target, floor(t.target)::BIGINT AS whole,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k[1:2], md5(d.size::VARCHAR)[1:2], d.k, d.doc_id NULLS FIRST, d.size, d.uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT uid, source, target, size, whole, before + turn * source_size AS start FROM p, (SELECT unnest([{turns}]) AS turn)),
c AS (SELECT *, greatest(0, least(size, whole - start)) AS first FROM v),
q AS (SELECT uid, source, start, (start + first) / target AS finish, first AS words FROM c WHERE first > 0
      UNION ALL SELECT uid, source, start, (start + size) / target, size - first FROM c WHERE start <= whole AND whole < start + size),
z AS (SELECT uid, words, coalesce(sum(words) OVER (ORDER BY finish, source NULLS LAST, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM q),
m AS (SELECT uid, sum(greatest(0, least(words, (SELECT sum(size) FROM d) - spent)))::BIGINT AS taken FROM z GROUP BY uid)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(m.taken, 0)::BIGINT AS taken FROM p LEFT JOIN m USING (uid)
"""
