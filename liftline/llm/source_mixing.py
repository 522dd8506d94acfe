"""Mixing sources to target weights as a time-varying curriculum, in DataFrame functions only.

Each source has a weight, which fixes its target share of words, and a linear
schedule, which fixes when in training its words are due. A source's documents
are put in a fixed hash order; a document's place in the source's cumulative
words, sent through the inverse of the integrated schedule, is its training
position in [0, 1]; the result is range-sorted by position.

Defined results: null text or a text of white space has size 0 and takes 0
words; a null source is a source of its own, after all others; repeated rows
are rows of their own; ties in the hash order, which is of doc_id and text, fall
to doc_id, then size (rows that still tie are equal in all that counts here);
nulls are left out of the hash; an empty table gives no rows. Other columns are
carried along, but for those named like a result of this operator, which are
replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftline.llm.common import materialise, table, unpacked, whole

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: Slopes of the weight schedules 1 + a * (2t - 1), by source: early, even, late.
SLOPES = (-0.8, 0.0, 0.8)
#: Documents in one piece of a source's prefix sum.
PIECE = 1024
_HASH_DIGITS = 13  # hex digits: 52 bits, exact as a double


def _cycle(values: tuple, rank: Column) -> Column:
    """The values in turn, for ranks 1, 2, ..."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def targets(by_source: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """skey, source_size -> with weight, slope, target.

    What caps cut off is shared again by weight until none is above its cap. That ends where every source has
    min(cap, weight * level) for one level: sources by cap / weight, the first level below the next ratio holds.
    One row per source stands in these windows, never a row per document.
    """
    ranked = by_source.withColumn("r", F.row_number().over(Window.orderBy("skey")))
    w = ranked.select("skey", "source_size", "r", _cycle(weights, F.col("r")).cast("double").alias("weight"), _cycle(SLOPES, F.col("r")).alias("slope"), (F.col("source_size") * F.lit(cap)).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    w = w.withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn("all_weight", F.sum("weight").over(whole))
    w = w.withColumn("level", (F.col("total") - F.col("full_before")) / (F.col("all_weight") - F.col("weight_before")))
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(whole))
    return w.select("skey", "source_size", "weight", "slope", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * F.col("level"))).alias("target"))


def position(share: Column, slope: Column) -> Column:
    """The t at which t + slope * (t * t - t), the integral of the schedule, reaches a share of the demand."""
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / F.when(slope == 0, F.lit(1.0)).otherwise(2 * slope))


RESULTS = ["mix_size", "source_size", "target", "taken", "position"]


def placed(docs: DataFrame, columns: list[str], weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """kept_row (a struct of the columns) with mix_size, source_size, target, taken, position; range-sorted by position.

    taken: words that the mix takes of the document, whole passes first, then the rest of the target in hash
    order, so that a source's sum is its target rounded down. A prefix sum over a source, however large, is made of
    pieces of about PIECE documents and of one row per piece. The document is due at the middle of its first copy.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))  # null after all others
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), "text").cast("binary"))
    n_pieces = max(1, -(-docs.count() // PIECE))
    sized = docs.select(whole(docs, columns).alias("kept_row"), F.col("doc_id").alias("mix_id"), size.alias("mix_size"), key.alias("mix_key"), F.conv(F.substring(digest, 1, _HASH_DIGITS), 16, 10).cast("long").alias("mix_hash"))
    sized = sized.withColumn("mix_piece", F.floor(F.col("mix_hash") * F.lit(n_pieces / 16.0**_HASH_DIGITS)))
    if "text" not in columns:  # narrow rows: the texts are read and counted once
        sized = materialise(sized)
    pieces = materialise(sized.groupBy("mix_key", "mix_piece").agg(F.sum("mix_size").alias("mix_sum")))
    plan = targets(pieces.groupBy(F.col("mix_key").alias("skey")).agg(F.sum("mix_sum").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("mix_key").orderBy("mix_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("mix_before", F.coalesce(F.sum("mix_sum").over(before), F.lit(0).cast("long"))).drop("mix_sum")
    pieces = pieces.join(plan.select(F.col("skey").alias("mix_key"), "source_size", "target", F.col("slope").alias("mix_slope")), "mix_key")
    inner = Window.partitionBy("mix_key", "mix_piece").orderBy("mix_hash", "mix_id", "mix_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.join(pieces, ["mix_key", "mix_piece"]).withColumn("mix_at", F.col("mix_before") + F.coalesce(F.sum("mix_size").over(inner), F.lit(0).cast("long")))
    goal, passes = F.floor("target"), F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = goal - passes * F.col("source_size")
    rows = rows.withColumn("taken", (passes * F.col("mix_size") + F.greatest(F.lit(0), F.least(F.col("mix_size"), left - F.col("mix_at")))).cast("long"))
    due = (F.col("mix_at") + F.least("mix_size", "taken") / 2.0) / F.when(goal > 0, goal)
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, position(F.least(due, F.lit(1.0)), F.col("mix_slope"))))
    return rows.orderBy(F.col("position").asc_nulls_last(), "mix_id").select("kept_row", *RESULTS)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not said), but for those named like a result, with the results of ``placed``."""
    keep = [c for c in keep or docs.columns if c not in RESULTS]
    return placed(docs, keep, weights, share, cap).select(*unpacked("kept_row", keep), *RESULTS)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).withColumnRenamed("mix_size", "size")


QUERIES = {"op7_source_mixing": op7_source_mixing}


def _sql_cycle(values: tuple, rank: str) -> str:
    return reduce(lambda rest, k: f"CASE WHEN ({rank} - 1) % {len(values)} = {k} THEN {values[k]!r} ELSE {rest} END", range(len(values)), "NULL")


ORACLES = {
    "op7_source_mixing": f"""
WITH sized AS (
    SELECT doc_id, coalesce('=' || source, '~') AS skey, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
           substr(md5(concat_ws(':', doc_id::VARCHAR, text)), 1, {_HASH_DIGITS}) AS h
    FROM documents
), src AS (
    SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) AS r FROM sized GROUP BY skey
), w AS (
    SELECT skey, source_size, ({_sql_cycle(WEIGHTS, 'r')})::DOUBLE AS weight, ({_sql_cycle(SLOPES, 'r')})::DOUBLE AS slope, source_size * {CAP}::DOUBLE AS most FROM src
), ordered AS (
    SELECT *, coalesce(sum(most) OVER o, 0)::DOUBLE AS full_before, coalesce(sum(weight) OVER o, 0)::DOUBLE AS weight_before,
           (sum(source_size) OVER ())::DOUBLE * {SHARE}::DOUBLE AS total, sum(weight) OVER () AS all_weight
    FROM w WINDOW o AS (ORDER BY most / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
    SELECT *, (total - full_before) / (all_weight - weight_before) AS own FROM ordered
), plan AS (
    SELECT skey, source_size, slope, least(most, weight * (SELECT max(own) FROM levels WHERE own <= most / weight)) AS target FROM levels
), placed AS (
    SELECT s.doc_id, s.size, p.source_size, p.target, p.slope, floor(p.target)::BIGINT AS goal,
           (CASE WHEN p.source_size > 0 THEN floor(floor(p.target) / p.source_size) ELSE 0 END)::BIGINT AS passes,
           (coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS placed_at
    FROM sized s JOIN plan p USING (skey)
), taken AS (
    SELECT *, (passes * size + greatest(0, least(size, goal - passes * source_size - placed_at)))::BIGINT AS taken FROM placed
), due AS (
    SELECT *, least((placed_at + least(size, taken) / 2.0::DOUBLE) / CASE WHEN goal > 0 THEN goal END, 1.0::DOUBLE) AS y FROM taken
)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN y ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * y) - (1 - slope)) / (2 * slope) END END AS position
FROM due"""
}
