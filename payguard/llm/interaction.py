"""Filter interaction audit: what five filters remove in each of their 120 orders.

A document's failed filters are a mask of five bits, so that a part's documents are at most 32
weighted rows. Masks and orders meet in a min-plus product: a mask costs nothing at the filters
it fails and is endless at the others, an order says at which step each filter comes (the
inverse permutation), and the least sum is the step that removes the mask. That step drives
weighted scatter counts of what is removed, and what is redundant lies before a filter's step.

Whether a text repeats an earlier document's is told from digests: documents are summed by
digest, part, mask and labels before digests meet, so many copies of a text are few rows.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import UPPER, n_words, whole, words

FILTERS = "ABCDE"
ORDERS = list(permutations(range(5)))
#: POSITIONS[o, f]: the step, from 1, at which order o has filter f. FAILS[m, f]: 0 where mask m fails f.
POSITIONS = np.argsort(np.array(ORDERS), axis=1) + 1.0
FAILS = np.where((np.arange(32)[:, None] >> np.arange(5)) & 1 == 1, 0.0, np.inf)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(i, k) and (j, k) -> (i, j): the least a[i, k] + b[j, k]."""
    return (a[:, None, :] + b[None, :, :]).min(2)


#: The step at which an order removes a mask; endless for the mask that fails nothing.
STEPS = min_plus(FAILS, POSITIONS)


def failures(text: Column) -> Column:
    """The bits of filters A to D that a text fails, A lowest."""
    n, distinct = n_words(text), F.size(F.array_distinct(words(text)))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    tests = (n < 200, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 3 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
    return sum((F.when(test, 1 << bit).otherwise(0) for bit, test in enumerate(tests)), F.lit(0))


def histogram(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic (long): documents by the filters that they fail.

    A null text is empty, a null lang the empty part. Rows alike in doc_id and text repeat no
    smaller id, nor does a null doc_id, which comes before none. Of several labels of a
    document any that says good or toxic counts.
    """
    text = whole("text")
    slim = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    each = slim.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("of"))
    said = lambda c: F.max(F.col(c).eqNullSafe(1).cast("int"))
    marks = marks.agg(said("quality").alias("is_good"), said("toxic").alias("is_toxic"))
    of = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("none:"), F.hex("digest")))  # rows without id meet no label, and are spread
    marked = each.withColumn("of", of).join(marks, "of", "left").fillna(0, ["is_good", "is_toxic"])
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least")
    unnamed = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed")
    alike = marked.groupBy("digest", "part", "mask", "is_good", "is_toxic").agg(F.sum("n").alias("n"), least, unnamed)
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    own = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    split = alike.withColumn("first", first).withColumn("own", own)
    both = F.array(F.struct(F.col("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    rows = split.select("part", "is_good", "is_toxic", F.inline(both)).filter("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("is_good")).alias("good"), F.sum(F.col("n") * F.col("is_toxic")).alias("toxic"))


def report(part: pd.DataFrame) -> pd.DataFrame:
    """The 600 rows of one part from its at most 32 masks."""
    weights = np.zeros((3, 32), np.int64)
    weights[:, part["mask"].to_numpy()] = part[["n", "good", "toxic"]].to_numpy(np.int64).T
    gone = np.isfinite(STEPS)
    mask, order = np.nonzero(gone)
    step = STEPS[gone].astype(int) - 1
    lost = np.zeros((3, len(ORDERS), 5), np.int64)  # documents, good ones, toxic ones by order and step
    for i in range(3):
        np.add.at(lost[i], (order, step), weights[i, mask])
    fails = FAILS == 0
    early = STEPS[:, :, None] < POSITIONS[None, :, :]  # mask, order, filter: gone before the filter's step
    redundant = np.einsum("m,mof->of", weights[0], early & fails[:, None, :])
    shapley = np.zeros(5, np.int64)
    np.add.at(shapley, np.array(ORDERS), lost[0])
    out = []
    for o, names in enumerate(ORDERS):
        kept = weights[0].sum() - np.cumsum(lost[0, o])
        for k, f in enumerate(names):
            counts = (kept[k], lost[0, o, k], redundant[o, f], weights[0, 1 << f], lost[1, o, k], lost[2, o, k], shapley[f])
            out.append((part["part"].iloc[0], "".join(FILTERS[i] for i in names), k + 1, *counts))
    return pd.DataFrame(out, columns=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and counts: 600 rows a part; none for an empty table."""
    return histogram(docs, labels).groupBy("part").applyInPandas(report, REPORT)


SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(ws) < 200 AS fa, 100 * len(list_distinct(ws)) < 50 * len(ws) AS fb,
  100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd, coalesce(w.doc_id > first_id, false) AS fe FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
h AS (SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS t(f)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f AS a, f AS b, f AS c, f AS d, f AS e
  WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
r AS (SELECT h.*, filter_order, least(CASE WHEN fa THEN position('A' IN filter_order) ELSE 9 END, CASE WHEN fb THEN position('B' IN filter_order) ELSE 9 END, CASE WHEN fc THEN position('C' IN filter_order) ELSE 9 END,
  CASE WHEN fd THEN position('D' IN filter_order) ELSE 9 END, CASE WHEN fe THEN position('E' IN filter_order) ELSE 9 END) AS gone FROM h, o),
s AS (SELECT r.*, s.step, substr(filter_order, s.step, 1) AS f FROM r, (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step) AS s),
g AS (SELECT *, CASE f WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END AS fails, CAST(fa AS INT) + CAST(fb AS INT) + CAST(fc AS INT) + CAST(fd AS INT) + CAST(fe AS INT) AS n_fails FROM s),
c AS (SELECT part, filter_order, step, f, CAST(sum(CASE WHEN gone > step THEN n ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN gone = step THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails AND n_fails = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN gone = step THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM g GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM c"""
