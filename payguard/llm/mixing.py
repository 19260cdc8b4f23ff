"""Mixing sources to target weights, by hash-threshold histograms.

Each source gets whole epochs as often as its target holds its size. For the rest of the
target, documents are taken whose hash lies at or below a threshold. The threshold comes
from histograms: words summed by source and hash bucket, the bucket found in which the
budget ends, and only that bucket refined, 12 bits of the hash at a time. Nothing is
sorted but the at most 4096 bucket sums of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, whole, written

BITS, LEVELS = 12, 5


def hash60(key: Column) -> Column:
    """60 bits of the MD5 of a key's text; a null key counts as empty."""
    return F.conv(F.substring(F.md5(whole(key.cast("string")).cast("binary")), 1, 15), 16, 10).cast("long")


def weighted_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Weights repeat over the sources by code point, null last. ``share`` of all words is dealt
    by weight; a target stops at ``cap`` times its source's size and the excess is dealt again.
    With sources by size/weight, the level at which the dealing ends is the greatest of
    (what is left) / (weight that is left), so no loop is needed. One row a source.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight)
    before = W.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    s = s.select(
        "source", "source_size", "w",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("gone"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_gone"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("w").over(everything).alias("all_w"),
    )
    level = (share * F.col("all_size") - cap * F.col("gone")) / (F.col("all_w") - F.col("w_gone"))
    s = s.withColumn("level", F.max(level).over(everything))
    return s.select("source", "source_size", F.least(cap * F.col("source_size"), F.col("level") * F.col("w")).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, h, size) and (source, source_size, target) -> targets with ``epochs`` and ``h_most``.

    A row is taken ``epochs`` times, and once more where h <= h_most.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = targets.withColumn("epochs", epochs).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))
    t = written(t, "targets")
    state = None
    for level in range(LEVELS):
        rest = BITS * (LEVELS - level - 1)
        bucket = F.shiftright("h", rest).alias("bucket")
        if state is None:
            sums = sized.groupBy("source", bucket).agg(F.sum("size").alias("sum"))
            state = t.select(F.col("source").alias("s"), "left")
            sums = sums.join(state, sums["source"].eqNullSafe(state["s"]))
        else:
            here = sized.join(state, sized["source"].eqNullSafe(state["s"]) & (F.shiftright("h", rest + BITS) == F.col("prefix")))
            sums = here.groupBy("s", "left", bucket).agg(F.sum("size").alias("sum"))
        sums = sums.withColumn("upto", F.sum("sum").over(W.partitionBy("s").orderBy("bucket")))
        found = F.struct("bucket", "upto", "sum", "left")
        end = sums.groupBy("s").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("left"), found)), F.max(found)).alias("e"))
        left = F.col("e.left") - (F.col("e.upto") - F.col("e.sum"))
        state = written(end.select("s", left.alias("left"), F.col("e.bucket").alias("prefix"), F.col("e.sum").alias("last")), "boundary")
    near = F.col("last") - F.col("left") < F.col("left")
    most = state.select("s", F.when(near, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("h_most"))
    return t.join(most, t["source"].eqNullSafe(most["s"]), "left").drop("s", "left")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """documents -> doc_id, size, source, source_size, target, taken (words taken, repeats counted).

    Null text has size 0, a null source is a source of its own, rows that share a doc_id share
    their hash and so are taken together; an empty table gives an empty result.
    """
    sized = written(docs.select("doc_id", "source", n_words("text").alias("size"), hash60(F.col("doc_id")).alias("h")), "mix")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cut = thresholds(sized, weighted_targets(sizes, weights, share, cap)).withColumnRenamed("source", "s")
    copies = F.col("epochs") + (F.col("h") <= F.coalesce("h_most", F.lit(-1))).cast("long")
    return sized.join(cut, sized["source"].eqNullSafe(cut["s"])).select(
        "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, a document that is taken twice as two rows; columns as in ``docs``.

    Only the thresholds are joined to the texts, one row a source.
    """
    h = hash60(F.col("doc_id"))
    sized = written(docs.select("source", n_words("text").alias("size"), h.alias("h")), "mix")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cut = thresholds(sized, weighted_targets(sizes, **how)).withColumnRenamed("source", "s")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("of"), h.alias("h"))
    copies = F.col("epochs") + (F.col("h") <= F.coalesce("h_most", F.lit(-1))).cast("long")
    joined = rows.join(cut, rows["of"].eqNullSafe(cut["s"])).select("row", copies.cast("int").alias("n"))
    return joined.withColumn("n", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
g AS (SELECT *, coalesce(sum(source_size) OVER b, 0)::DOUBLE AS gone, coalesce(sum(w) OVER b, 0.0)::DOUBLE AS w_gone,
        (sum(source_size) OVER ())::DOUBLE AS all_size, (sum(w) OVER ())::DOUBLE AS all_w
      FROM w WINDOW b AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max((1.5::DOUBLE * all_size - 2.0::DOUBLE * gone) / (all_w - w_gone)) OVER () AS level FROM g),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * w) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
c AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        (sum(size) OVER (PARTITION BY d.source ORDER BY h))::DOUBLE AS upto, (sum(size) OVER (PARTITION BY d.source, h))::DOUBLE AS own
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto < rest OR (upto - own < rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
