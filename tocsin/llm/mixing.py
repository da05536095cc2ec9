"""Mixing sources to target weights: capped water-filling, seeded repetitions.

Each source has a weight and holds ``size`` words; the mix takes ``share``
times all words.  Targets are proportional to the weights, but no source is
repeated more than ``max_epochs`` times: sources above that are clamped and
the excess goes to the others by weight until none is above.  The end of this
iteration is a water level L with ``target = min(cap, L * weight)``; it is
found in one pass over the sources sorted by ``cap / weight``.

A source's target is met by whole repetitions of all its documents and one
fractional repetition: documents in the order of a seeded hash until the
remaining words are taken.  The cut hash is found without sorting a source:
sizes are summed per (source, hash bucket), the running sum names the bucket
of the cut, and only that bucket (1/4096 of the source) is put in order.
Whether a document is taken is then a function of its source, its hash and
two numbers per source, so nothing is joined per document.

Defined cases: null text has size 0; a null source is a source of its own,
ordered last; sources without words get target 0; documents with equal ids
(repeated rows, null ids) have hashes of their own, ordered among each other by
their place in the table's files, so a source of one id is cut like any other; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tocsin.llm.common import NOT_BLANK, stored, text_of
from tocsin.llm.exact_dedup import located

WEIGHT_CYCLE = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20240
BUCKET_DIGITS = 3  # hex digits of the hash that name a bucket: 4096 per source


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NOT_BLANK)).cast("long")


def seeded_hash(seed: int = SEED) -> Column:
    """Of a located row: the hash of its id, then that of its place."""
    by_id = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.concat(by_id, F.lpad(F.hex(F.xxhash64("file", "row")), 16, "0"))


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """Weights by the rank of the source in code-point order, null last."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    return sources.withColumn("weight", F.element_at(weights, (rank % len(cycle) + 1).cast("int")))


def fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) with the column ``target``.

    The windows run over one row per source."""
    every = Window.partitionBy()
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    s = (sources
         .withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
         .withColumn("_ratio", F.col("_cap") / F.col("weight"))
         .withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(every)
                                - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
                     / F.sum("weight").over(onward))
         .withColumn("_first", F.row_number().over(order)))
    # The first source that the level does not reach ends the clamping.
    holds = F.when(F.col("_level") <= F.col("_ratio"), F.col("_first"))
    s = s.withColumn("_stop", F.min(holds).over(every))
    level = F.max(F.when(F.col("_first") == F.col("_stop"), F.col("_level"))).over(every)
    target = F.least(F.col("_cap"), F.coalesce(level * F.col("weight"), F.col("_cap")))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target")


def plan_mix(sized: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS,
             cycle: tuple[int, ...] = WEIGHT_CYCLE) -> DataFrame:
    """One row per source: target, whole repetitions and the cut hash.

    ``sized``: (source, size, hash), read twice."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (fill(cycled_weights(sources, cycle), share, max_epochs)
            .withColumn("whole", F.when(F.col("source_size") > 0,
                                        F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
            .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size")))
    plan = stored(plan, "mix-targets")
    bucket = F.substring("hash", 1, BUCKET_DIGITS)
    run = Window.partitionBy("source").orderBy("bucket")
    cut = (sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
           .withColumn("upto", F.sum("words").over(run))
           .withColumnRenamed("source", "_s"))
    cut = (cut.join(plan.select("source", "goal"), F.col("_s").eqNullSafe(F.col("source")))
           .where((F.col("upto") - F.col("words") < F.col("goal")) & (F.col("upto") >= F.col("goal")))
           .select("source", "bucket", "goal", (F.col("upto") - F.col("words")).alias("base")))
    near = (sized.withColumnRenamed("source", "_s")
            .join(cut, F.col("_s").eqNullSafe(F.col("source")) & (bucket == F.col("bucket")))
            .groupBy("source", "bucket", "goal", "base", "hash").agg(F.sum("size").alias("words"))
            .withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("hash")))
            # half of the document at the cut must fit: the nearest sum is taken
            .withColumn("fits", F.col("base") + F.col("upto") - F.col("words") / 2 < F.col("goal"))
            .groupBy("source", "bucket").agg(F.max(F.when(F.col("fits"), F.col("hash"))).alias("last"))
            .select(F.col("source").alias("_s"), F.coalesce("last", "bucket").alias("cut")))
    plan = (plan.join(near, F.col("_s").eqNullSafe(F.col("source")), "left")
            .select(F.col("source").alias("mix_source"), "source_size", "target", "whole", "cut"))
    # Written, its size is known to the planner: the documents needn't move to meet
    # a row per source unless there are very many sources.
    return stored(plan, "mix-cuts")


def copies_of(source_hash: Column) -> Column:
    """How often the mix takes a document, given the plan's columns beside it."""
    return F.col("whole") + F.when(source_hash <= F.col("cut"), 1).otherwise(0)


def sized_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return located(docs, F.col("source")).select("doc_id", "source", word_count(text_of()).alias("size"),
                                                 seeded_hash(seed).alias("hash"))


def mix(docs: DataFrame, seed: int = SEED, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken."""
    sized = stored(sized_documents(docs, seed), "mix-sizes")
    plan = plan_mix(sized, share, max_epochs)
    return (sized.join(plan, F.col("source").eqNullSafe(F.col("mix_source")))
            .withColumn("copies", copies_of(F.col("hash")))
            .select("doc_id", "size", "source", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def mixed_documents(docs: DataFrame, seed: int = SEED, share: float = SHARE,
                    max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns unchanged."""
    plan = plan_mix(stored(sized_documents(docs, seed).drop("doc_id"), "mix-sizes"), share, max_epochs)
    own = docs.columns
    rows = located(docs, F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col("source").alias("_source"))
    rows = rows.select("_row", "_source", seeded_hash(seed).alias("_hash"))
    return (rows.join(plan, F.col("_source").eqNullSafe(F.col("mix_source")))
            .withColumn("_copies", copies_of(F.col("_hash")).cast("int"))
            .where("_copies > 0")
            .select(F.explode(F.array_repeat(F.col("_row"), F.col("_copies"))).alias("_row"))
            .select(*[F.col("_row").getField(c).alias(c) for c in own]))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{NOT_BLANK}')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM r)
              - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
              row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY k LIMIT 1) * weight, cap)) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
h AS (SELECT source, hash, sum(size) AS words FROM d GROUP BY source, hash),
c AS (SELECT source, hash, words, sum(words) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM h),
x AS (SELECT c.source, c.hash, whole, source_size, target,
             CASE WHEN target - whole * source_size > 0
                   AND coalesce(base, 0) + words / 2.0 < target - whole * source_size THEN 1 ELSE 0 END AS one
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST((whole + one) * size AS BIGINT) AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.hash = x.hash
"""
