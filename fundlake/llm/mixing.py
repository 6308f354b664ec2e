"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A source's target is its share of all words by weight, at most `most` times its own size; what that cuts off is shared
again among the others. Whole rounds of a source are taken as often as they fit; the rest of the budget is met by the
documents whose 30-bit hash lies below the source's threshold. The threshold is found without sorting documents: words
are summed by source and the first ten bits of the hash, the bucket in which the running sum passes the budget is
found, and only that bucket's documents are summed again by the next ten bits, and once more. Whether the documents of
the last boundary value belong to the mix is decided by which total is nearer to the target.

The hash is of the id, so that reruns agree and copies of a text are told apart; a null id is replaced by the text.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, the last; repeated rows share
their fate; an empty table gives no rows; extra columns are ignored.
The tables of sources and of buckets have one row per source and 1024 rows per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundlake.llm.common import split_join, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
_BITS = 10
_LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """A name for the source that is never null and keeps the order of code points, null last."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source_size, target) from (src, size): targets rise with one level for all until they meet their limits."""
    by_size = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    ranked = by_size.withColumn("place", F.row_number().over(Window.orderBy("src")) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", (F.col("source_size") * most).cast("double"))
    # In the order in which limits are met: what the sources before are held to, and the weight of those from here on.
    order = Window.orderBy(F.col("most") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (ranked
              .withColumn("total", F.sum("source_size").over(everything).cast("double"))
              .withColumn("held", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))))
    ranked = ranked.withColumn("level", (F.col("total") - F.col("held")) / F.col("open"))
    fits = F.col("level") * F.col("weight") <= F.col("most")
    # the first source that stays within its limit tells the level of all that follow
    first = F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), "src", "level"))).over(everything)
    ranked = ranked.withColumn("level", first["level"])
    return ranked.select("src", "source_size", F.least(
        "most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"))


def _thresholds(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, rounds, below, equal): the number of whole rounds, the hash below which a document is taken once more,
    and whether documents of that very hash are."""
    plan = targets.select(
        "src", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("rounds"),
        "source_size", "target")
    state = plan.select("src", "rounds", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("left"),
                        F.lit(0).cast("long").alias("below"))
    rows = slim
    for level in range(_LEVELS):
        shift = _BITS * (_LEVELS - 1 - level)
        summed = (rows.groupBy("src", F.shiftright("hash", shift).alias("bucket"))
                  .agg(F.sum("size").alias("words")))
        running = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = summed.withColumn("until", F.sum("words").over(running))
        crossing = (summed.join(state.select("src", "left"), "src").where(F.col("until") > F.col("left"))
                    .groupBy("src").agg(F.min_by(F.struct("bucket", "words", "until"), "bucket").alias("at")))
        state = stored(state.join(crossing, "src", "left").select(
            "src", "rounds", (F.col("left") - F.coalesce(F.col("at.until") - F.col("at.words"), F.lit(0))).alias("left"),
            # without a crossing (nothing left to take from) no document stands at the boundary
            F.coalesce(F.col("at.bucket"), F.lit(0).cast("long")).alias("below"), F.col("at.words").alias("words")))
        if level < _LEVELS - 1:
            rows = split_join(rows, state.select("src", F.col("below").alias("bucket")), "src").where(
                F.shiftright("hash", shift) == F.col("bucket")).drop("bucket")
    return state.select("src", "rounds", "below", F.coalesce(F.col("words") - F.col("left") < F.col("left"), F.lit(False)).alias("equal"))


def _measured(docs: DataFrame) -> DataFrame:
    """The documents with src, size and hash."""
    identity = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return docs.withColumns({
        "src": _source_key(F.col("source")), "size": word_count(F.col("text")),
        "hash": F.shiftright(F.conv(F.substring(F.md5(identity), 1, 8), 16, 10).cast("long"), 32 - _BITS * _LEVELS)})


def _repeats() -> Column:
    more = (F.col("hash") < F.col("below")) | ((F.col("hash") == F.col("below")) & F.col("equal"))
    return (F.col("rounds") + F.when(more & (F.col("size") > 0), 1).otherwise(0)).cast("long")


def _planned(docs: DataFrame, weights: tuple[float, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(the measures of every document without its text, one row per source with its target and thresholds)."""
    slim = stored(_measured(docs.select("doc_id", "source", "text")).drop("text"))
    targets = stored(source_targets(slim, weights, most))
    return slim, stored(targets.join(_thresholds(slim, targets), "src"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (the source's), taken, repeats."""
    slim, plan = _planned(docs, weights, most)
    return split_join(slim, plan, "src").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * _repeats()).alias("taken"), _repeats().alias("repeats"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix with doc_id, text, lang, source, n_chars, their size and how often each is taken."""
    _, plan = _planned(docs, weights, most)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    measured = _measured(docs.select(*columns))
    return split_join(measured, plan, "src").select(*columns, "size", _repeats().alias("repeats")).where("repeats > 0")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::UBIGINT::BIGINT) >> 2 AS hash
  FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS weight
      FROM d GROUP BY src),
l AS (SELECT arg_min(level, (3.0 * source_size / weight, src)) AS level FROM (
        SELECT a.src, a.weight, a.source_size,
               ((SELECT sum(source_size) FROM s) - coalesce(sum(3.0 * b.source_size) FILTER (b.before), 0))::DOUBLE
                 / (sum(b.weight) FILTER (NOT b.before)) AS level
        FROM s a, LATERAL (SELECT o.weight, o.source_size,
                                  (3.0 * o.source_size / o.weight, o.src) < (3.0 * a.source_size / a.weight, a.src) AS before FROM s o) b
        GROUP BY ALL) WHERE level * weight <= 3.0 * source_size),
t AS (SELECT src, source_size, least(3.0 * source_size, coalesce(level * weight, 3.0 * source_size))::DOUBLE AS target FROM s, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t),
r AS (SELECT d.*, p.source_size, p.target, p.rounds, p.target - p.rounds * p.source_size AS rest,
             sum(size) OVER (PARTITION BY src ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until,
             sum(size) OVER (PARTITION BY src, hash) AS here
      FROM d JOIN p USING (src))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (rounds + CASE WHEN until <= rest OR (until - here <= rest AND until - rest < rest - (until - here)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""
