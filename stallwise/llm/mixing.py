"""Mixing sources to target weights over a time-varying curriculum.

Each source has a weight and a schedule: its share of demand at training time t in 0..1 is proportional
to ``1 + slope * (2t - 1)``, so a negative slope means early and a positive slope late. The integral over
the whole training is the source's target. A source's documents stand in a fixed pseudo-random order; the
word at offset o of that order, over all repeats, is due at the time t at which the source's cumulative
demand reaches o, found by inverting the integral. All sources' demand up to t is the training position
of a document, and documents are range-sorted by it.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words. A target
stops at ``epochs`` times its source; the excess goes to the others by weight. Sorting sources by
limit / weight gives the level at which none is above, with running sums instead of rounds.

How it scales. Texts are read once for their sizes. The running sum over a source is split: sums per
(source, hash bucket), their running sum, and one within each bucket, so a source with a third of all rows is
4096 window groups. Only the table of sources, one row each, is ranked as a whole; weights are given by
that rank, and a mix names its sources, so their number does not grow with the documents.

Edge cases. Null and empty texts have size 0 and are never taken; a source or table of such texts only has
target 0 and no positions. An empty table gives no rows. Repeated
rows count each. The last document a target reaches is taken in part.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, kept, register, table

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)


def _pick(values, place: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), place.cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, epochs: int = 3) -> DataFrame:
    """source, source_size, target, slope and the two coefficients of the total demand in t and t squared."""
    named = Window.orderBy(F.col("source").isNull(), "source")
    rest = Window.orderBy("ratio", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
         .withColumn("place", F.row_number().over(named))
         .withColumn("weight", _pick(weights, (F.col("place") - 1) % len(weights) + 1))
         .withColumn("slope", _pick(slopes, (F.col("place") - 1) % len(slopes) + 1))
         .withColumn("most", epochs * F.col("source_size"))
         .withColumn("ratio", F.col("most") / F.col("weight"))
         .withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(done), F.lit(0)))
                     / F.sum("weight").over(rest))
         .withColumn("open", F.col("level") <= F.col("ratio"))
         .withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "place", "level"))).over(every)["level"])
         .withColumn("target", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("most").cast("double"))))
    return s.select("source", "source_size", "target", "slope",
                    F.sum(F.col("target") * (1 - F.col("slope"))).over(every).alias("linear"),
                    F.sum(F.col("target") * F.col("slope")).over(every).alias("square"))


def _due(offset: Column) -> Column:
    """Training position at which a source's demand reaches an offset."""
    a = F.col("slope")
    u = offset / F.nullif(F.col("target"), F.lit(0.0))
    t = F.when(a == 0, u).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * F.when(a == 0, 1.0).otherwise(a)))
    return F.floor(F.col("linear") * t + F.col("square") * t * t)


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, epochs: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and per repeat the words taken and the training
    position (``shares``); sorted by the first position, documents not taken last."""
    rows = kept(sized(docs), "sizes")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.withColumn("key", key).withColumn("cell", F.substring("key", 1, 3))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    targets = kept(source_targets(rows, weights, slopes, epochs).withColumnRenamed("source", "s2"), "targets")
    rows = (rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
            .join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
            .join(targets, F.col("source").eqNullSafe(F.col("s2")))
            .withColumn("offset", F.col("base") + F.col("inner")))
    need = F.round("target").cast("bigint")
    share = [F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), need - (F.col("offset") + e * F.col("source_size")))) for e in range(epochs)]
    shares = F.array(*(F.struct(n.alias("words"), _due(F.col("offset") + e * F.col("source_size")).alias("position")) for e, n in enumerate(share)))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", sum(share[1:], share[0]).alias("taken"),
                       F.filter(shares, lambda x: x["words"] > 0).alias("shares"))
    return rows.orderBy(F.get("shares", F.lit(0))["position"].asc_nulls_last(), "doc_id")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM g),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, [-0.5::DOUBLE, 0.0, 0.5][(place - 1) % 3 + 1] AS slope, 3 * source_size AS most FROM r),
q AS (SELECT *, most / weight AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - (coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE)
      / (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM q),
v AS (SELECT source, source_size, slope, CASE WHEN level <= ratio THEN weight * (first_value(level) OVER (ORDER BY level > ratio, ratio, place)) ELSE most::DOUBLE END AS target FROM l),
x AS (SELECT *, (sum(target * (1 - slope)) OVER ())::DOUBLE AS lin, (sum(target * slope) OVER ())::DOUBLE AS sq FROM v),
o AS (SELECT d.doc_id, d.size, x.*, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
e AS (SELECT *, round(target)::BIGINT AS need FROM o),
f AS (SELECT *, CASE WHEN size = 0 THEN NULL WHEN need > off + 2 * source_size THEN 2 WHEN need > off + source_size THEN 1 WHEN need > off THEN 0 END AS last FROM e),
u AS (SELECT *, CASE WHEN last IS NOT NULL THEN off / nullif(target, 0) END AS u1, (off + last * source_size) / nullif(target, 0) AS u2 FROM f),
t AS (SELECT *, CASE WHEN slope = 0 THEN u1 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u1) - (1 - slope)) / (2 * slope) END AS t1,
      CASE WHEN slope = 0 THEN u2 ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * u2) - (1 - slope)) / (2 * slope) END AS t2 FROM u),
p AS (SELECT *, floor(lin * t1 + sq * t1 * t1)::BIGINT AS first_position, floor(lin * t2 + sq * t2 * t2)::BIGINT AS last_position FROM t)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, need - off)) + greatest(0, least(size, need - off - source_size))
        + greatest(0, least(size, need - off - 2 * source_size)))::BIGINT AS taken, first_position, last_position
FROM p"""


@register("op5_source_mix", SQL)
def op5_source_mix(spark, sf_dir):
    """What each document gives, and the training positions of its first and last repeat (null: never taken)."""
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken",
                       F.get("shares", F.lit(0))["position"].alias("first_position"),
                       F.get("shares", F.size("shares") - 1)["position"].alias("last_position"))
