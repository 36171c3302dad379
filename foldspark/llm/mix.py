"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each source's target is filled by whole epochs over all its documents, then by documents in the
order of exponential keys -ln(u)/weight, prefix-summed until the budget; the document at the
boundary is cut to the words still wanted, so that taken words equal the floor of the target.
u comes from md5 of the doc_id and a seed: reruns agree. Null sources form one source, null or
empty texts have size 0 and are never taken. Rows without a doc_id share one draw and are mixed like
others; repeated doc_ids and ties of keys are ordered by doc_id (null first), then size. Documents
without a weight weigh 1; those whose weight is not above 0 come after all others. Extra columns,
whatever their names, don't matter; an empty table gives an empty result.

A hot source is split into key ranges of bounded size before prefix sums. The logarithm of an
exponential key, whatever its weight, has a density of at most 1/e; so has any mixture of weights.
Ranges of equal width in that logarithm thus hold a bounded number of rows, without a pass for
quantiles; their number and their rows both grow as the square root of a source beyond ROWS**2 rows.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from foldspark.llm.common import words

#: Weights of sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Rows that a key range is laid out for, at least.
ROWS = 2000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source its size, rows and target: share by weight, stopped at ``most`` times its size.

    The repeated resharing of the excess ends where every target is min(cap, level * weight); the
    level is found by sorting sources by cap / weight. One row per source, so one small window.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = by.withColumn("w", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("open", F.col("ratio") > F.col("level"))
    top = F.min(F.when(F.col("open"), F.struct("ratio", "level"))).over(every)
    capped = (~F.col("open")) | top.isNull()
    return s.withColumn("target", F.when(capped, F.col("cap")).otherwise(top["level"] * F.col("w"))).select("source", "source_size", "n", "target")


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, seed: str = "mix", rows_per_range: int = ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs.

    ``quality`` (doc_id, weight > 0) scales the keys; documents without one weigh 1.
    """
    d = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    if quality is not None:
        q = quality.where("doc_id is not null").groupBy("doc_id").agg(F.max("weight").alias("weight"))
        d = d.join(q, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        d = d.withColumn("weight", F.lit(1.0))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52 + 1))
    d = d.withColumn("key", F.when(F.col("weight") > 0, -F.log(u) / F.nullif("weight", F.lit(0.0))).otherwise(F.lit(float("inf"))))
    t = targets(d, weights).withColumnsRenamed({"source": "_s"})
    d = d.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    d = d.withColumn("full", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("long"))
    d = d.withColumn("rest", F.floor("target") - F.col("full") * F.col("source_size"))
    rows = F.greatest(F.lit(float(rows_per_range)), F.sqrt("n"))
    place = F.floor(F.log(F.greatest("key", F.lit(1e-300))) * F.col("n") / (rows * math.e))
    d = d.withColumn("part", F.when(F.col("key") < float("inf"), place))
    ranges = d.groupBy("source", "part").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("source").orderBy(F.col("part").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(F.col("source").alias("_s"), F.col("part").alias("_p"), F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
    d = d.join(ranges, F.col("source").eqNullSafe(F.col("_s")) & F.col("part").eqNullSafe(F.col("_p")))
    inside = W.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("rest") - F.col("base") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.least("size", F.greatest(left, F.lit(0))).cast("long")
    return d.withColumn("extra", extra).select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("extra")).alias("taken"), F.col("full").alias("epochs"))


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good, 0.5 for poor; the best of repeated labels holds."""
    return labels.where("doc_id is not null and quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


SQL_WORDS = "len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))"
SQL = f"""
WITH q AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END) AS weight FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (SELECT documents.doc_id, source, {SQL_WORDS}::BIGINT AS size,
  -ln((('0x' || substr(md5('mix:' || coalesce(documents.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370497.0::DOUBLE) / coalesce(q.weight, 1.0::DOUBLE) AS key
  FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM r
  WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT min(struct_pack(ratio := ratio, level := level)) AS top FROM l WHERE ratio > level),
t AS (SELECT source, source_size, CASE WHEN ratio > level AND top IS NOT NULL THEN top.level * w ELSE cap END AS target FROM l, o),
f AS (SELECT d.doc_id, d.size, d.key, t.source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_epochs FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, floor(target)::BIGINT - full_epochs * source_size - coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM f)
SELECT doc_id, size, source_size, target, (full_epochs * size + least(size, greatest(room, 0)))::BIGINT AS taken FROM p
"""
