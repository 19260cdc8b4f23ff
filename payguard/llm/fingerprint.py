"""Document fingerprints: a threshold-scaled sketch of five-word shingles.

Every shingle hash below a fixed fraction of the hash range is kept, whatever the length of
the text, so sketches of very unequal documents compare and merge by plain set operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import whole, words, written

SHINGLE, FRACTION = 5, 1 / 4


def sketch(word_hashes: Column, fraction: float = FRACTION) -> Column:
    """Word hashes of a text -> its sketch: sorted distinct shingle hashes under the threshold.

    Fewer than five words are one shingle. A text none of whose hashes is low keeps its least
    one, so that no text with words has an empty sketch; a text without words has.
    """
    limit = int(fraction * 2**64) - 2**63
    n = F.size(word_hashes)
    long = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(SHINGLE)]))
    short = F.array(F.xxhash64(F.concat_ws(",", F.transform(word_hashes, lambda h: h.cast("string")))))
    every = F.when(n >= SHINGLE, long).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    low = F.array_sort(F.array_distinct(F.filter(every, lambda h: h < limit)))
    return F.when((F.size(low) == 0) & (n > 0), F.array(F.array_min(every))).otherwise(low)


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def with_sketch(frame: DataFrame, text: str, out: str) -> DataFrame:
    f = frame.withColumn("_hw", hashed(F.col(text)))
    return f.withColumn(out, sketch(F.col("_hw"))).drop("_hw")


def resemblance(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sketches; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """The part of ``a`` found in ``b``; 1 for an empty ``a``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def printed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _blocked(docs: DataFrame, per_block: int) -> DataFrame:
    """Adds block (array of longs, in the order of known, doc_id, tie) of about ``per_block`` rows.

    Blocks are equal widths of ids; one that has over four times its share is cut again, by its
    own ids or, where it has one id only, by hashes of texts, until none is left that can be
    cut. Even ids need no second cut. Only rows wholly alike stay together.
    """
    low, high, n = docs.agg(F.min("doc_id").cast("double"), F.max("doc_id").cast("double"), F.count(F.lit(1))).first()
    width = max(1.0, ((high or 0.0) - (low or 0.0) + 1) * per_block / max(n, 1))
    block = F.coalesce(F.floor((F.col("doc_id").cast("double") - F.lit(low or 0.0)) / width), F.lit(-1))
    docs = docs.withColumn("block", F.array(block.cast("long")))
    while True:
        ends = [f("doc_id").alias(f"{c}_id") for f, c in ((F.min, "low"), (F.max, "high"))] + [f("tie").alias(f"{c}_tie") for f, c in ((F.min, "low"), (F.max, "high"))]
        full = docs.groupBy("block").agg(F.count(F.lit(1)).alias("n"), *ends)
        full = full.filter((F.col("n") > 4 * per_block) & (F.coalesce(F.col("low_id") < F.col("high_id"), F.lit(False)) | (F.col("low_tie") < F.col("high_tie"))))
        full = written(full, "full")
        if full.isEmpty():
            return docs
        cut = lambda at: F.floor((F.col({"id": "doc_id", "tie": "tie"}[at]).cast("double") - F.col(f"low_{at}")) / F.greatest((F.col(f"high_{at}").cast("double") - F.col(f"low_{at}") + 1) * per_block / F.col("n"), F.lit(1.0)))
        part = F.coalesce(F.when(F.col("low_id") < F.col("high_id"), cut("id")).otherwise(cut("tie")), F.lit(0)).cast("long")
        both = docs.join(full.withColumnRenamed("block", "of"), F.col("block") == F.col("of"), "left")
        docs = both.withColumn("block", F.concat("block", F.array(part))).select(*docs.columns)


def with_next(docs: DataFrame, per_block: int = 4096) -> DataFrame:
    """(doc_id, text) -> doc_id, text, sketch, next_text, next_sketch by descending doc_id.

    Rows are windowed in blocks of about ``per_block`` rows, null ids last. The head of each
    block also closes the block above it (the top one closes the lowest), so one shuffle of
    the texts shows every row its next. Finding those heads moves ids only.
    """
    docs = docs.select("doc_id", whole("text").alias("text"), F.col("doc_id").isNotNull().alias("known"), F.xxhash64(whole("text")).alias("tie"))
    docs = _blocked(docs, per_block)
    place = F.struct("known", "doc_id", "tie")
    heads = docs.groupBy("block").agg(F.max(place).alias("head"))
    group = F.shiftright(F.get("block", F.lit(0)), 12)
    above = F.lag("block").over(W.partitionBy(group).orderBy(F.desc("block")))
    groups = heads.groupBy(group.alias("g")).agg(F.min("block").alias("lowest"))
    by_group = W.orderBy(F.desc("g"))
    up = F.coalesce(F.lag("lowest").over(by_group), F.min("lowest").over(W.partitionBy()))
    groups = groups.select("g", up.alias("up"))
    closes = heads.withColumn("above", above).withColumn("g", group).join(groups, "g")
    closes = written(closes.select("head", F.coalesce("above", "up").alias("to")), "heads")
    ends = docs.join(closes, F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("tie") == F.col("head.tie")))
    ends = ends.dropDuplicates(["to"]).select("doc_id", "text", "known", "tie", F.col("to").alias("block"), F.lit(1).alias("end"))
    rows = with_sketch(docs.withColumn("end", F.lit(0)).select(*ends.columns).union(ends), "text", "sketch")
    order = W.partitionBy("block").orderBy("end", F.desc("known"), F.desc("doc_id"), F.desc("tie"))
    after = F.lead(F.struct("text", "sketch")).over(order)
    out = rows.withColumn("after", after).filter("end = 0")
    return out.select("doc_id", "text", "sketch", F.col("after.text").alias("next_text"), F.col("after.sketch").alias("next_sketch"))


def compare(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_chars, edited text and sketches, with their likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's. Null text is empty; rows that share a doc_id follow each
    other by the hash of their texts; one row alone is its own next.
    """
    f = with_next(docs).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    f = f.withColumn("edited", F.concat(F.left("text", F.col("n_chars") - half), F.left("next_text", half)))
    f = with_sketch(f, "edited", "edited_sketch")
    return f.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )
