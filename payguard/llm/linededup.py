"""Line dedup by overlapping three-line windows.

Every run of three consecutive lines of a text is hashed; windows are counted over the whole
corpus with their first occurrence in the order of (doc_id, hash of the text, line). A later
occurrence of a repeated window covers its three lines; covered positions are merged and the
lines taken out. Window counts are pre-aggregated before the shuffle, and a hot window has
one row on the right of the join, so a skewed left side can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole, written

LINES = 3


def _key() -> list:
    return [F.col("doc_id").alias("id"), F.xxhash64(F.col("doc_id"), whole("text")).alias("k")]


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> id, k, gone: the sorted positions of lines to take out, for texts that lose any.

    Rows alike in doc_id and text are one document here: they get the same verdict, and are
    no occurrence of each other.
    """
    lines = docs.select(*_key(), F.split(whole("text"), "\n", -1).alias("l")).filter(F.size("l") >= LINES)
    three = lambda i: [F.get("l", i + j) for j in range(LINES)]
    # two hashes of 64 bits: one alone would clash in a large corpus, and a clash removes lines
    hashes = F.transform(F.sequence(F.lit(0), F.size("l") - LINES), lambda i: F.struct(F.xxhash64(*three(i)).alias("h"), F.xxhash64(F.lit("other"), *three(i)).alias("g")))
    windows = written(lines.select("id", "k", F.posexplode(hashes).alias("p", "w")).select("id", "k", "p", "w.h", "w.g"), "windows")
    at = F.struct("id", "k", "p")
    firsts = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).filter("n > 1").select("h", "g", "first")
    firsts = written(firsts, "firsts")  # a plain table on the right, so that a hot window's rows can be split
    later = windows.join(firsts, ["h", "g"]).filter(at > F.col("first")).select("id", "k", "p")
    gone = F.flatten(F.collect_set(F.array(*[F.col("p") + j for j in range(LINES)])))
    return later.groupBy("id", "k").agg(F.array_sort(F.array_distinct(gone)).alias("gone"))


def _joined(rows: DataFrame, docs: DataFrame) -> DataFrame:
    gone = covered(docs)
    both = rows.join(gone.withColumnRenamed("id", "gone_id").withColumnRenamed("k", "gone_k"),
                     (F.col("k") == F.col("gone_k")) & F.col("id").eqNullSafe(F.col("gone_id")), "left")
    lines = F.split("t", "\n", -1)
    marks = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    kept = F.array_join(F.transform(marks, lambda i: F.get(F.col("lines"), i)), "\n")
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), lines))
    return both.withColumn("left", F.when(F.col("gone").isNull(), F.col("t")).otherwise(kept))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, text (what is left; null stays null), n_lines, n_removed (long).

    Lines are what ``\\n`` divides, compared as they are. Texts under three lines have no
    window and stay whole. A window that repeats within one text is a later occurrence as well.
    """
    out = _joined(docs.select("doc_id", *_key(), F.col("text").alias("t")), docs)
    n_lines = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", "\n", -1))).cast("long")
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    return out.select("doc_id", F.col("left").alias("text"), n_lines.alias("n_lines"), removed.alias("n_removed"))


def deduped_documents(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages of lines taken out; columns as in ``docs``.

    n_chars, where there is one, is counted again.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_key(), F.col("text").alias("t"))
    out = _joined(rows, docs)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("left").alias("text"))
        elif c == "n_chars":
            changed = F.length("left").cast(docs.schema["n_chars"].dataType)
            cols.append(F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(changed).alias("n_chars"))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, (l[p] || chr(10) || l[p + 1] || chr(10) || l[p + 2]) AS win
      FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS p FROM d WHERE len(l) >= 3)),
r AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS nth FROM w) WHERE nth > 1),
g AS (SELECT DISTINCT doc_id, p + j AS p FROM r, (SELECT unnest([0, 1, 2]) AS j)),
a AS (SELECT doc_id, list(p) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN a.gone IS NULL THEN d.text
            ELSE coalesce(array_to_string([x.t FOR x IN [{'t': l[i], 'i': i} FOR i IN generate_series(1, len(l))] IF NOT list_contains(a.gone, x.i)], chr(10)), '') END AS text,
       coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(len(a.gone), 0)::BIGINT AS n_removed
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
