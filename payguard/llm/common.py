"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what separates words, in every contract.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Setting by which a job's shuffle files go as it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: str | Column) -> Column:
    return F.filter(F.split(whole(text), SPACE), lambda w: w != "")


def n_words(text: str | Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; a temporary one only where none is set, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The shuffle files of the job go when it ends, as nothing but the table is read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a written table that nothing reads any more."""
    files = df.inputFiles()
    if files:
        jvm = df.sparkSession.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def top(df: DataFrame, score: str, most: int, *key: str) -> DataFrame:
    """The ``most`` rows of the greatest positive scores (all, where there are fewer).

    Histograms find the score from which on there are no more: over eighths of powers of two,
    then finer ones of the bucket in which the bound falls, last by hash of ``key`` among equal
    scores. Only a bucket that no level can split stays out whole: under 2**-24 of those equals.
    Nothing is sorted, and what reaches the driver are the histograms.
    """
    h = F.xxhash64(*key)
    part = lambda at: F.shiftrightunsigned(h, at).bitwiseAND(F.lit(4095))
    levels = [F.floor(8 * F.log2(score)), F.floor(8192 * F.log2(score)), part(52), part(40)]
    df = df.filter(F.col(score) > 0)
    taken, edge = F.lit(False), F.lit(True)
    for level in levels:
        sums = {r.b: r.n for r in df.filter(edge).groupBy(level.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        at = None
        for b in sorted(sums, reverse=True):
            if sums[b] > most:
                at = b
                break
            most -= sums[b]
        if at is None:
            return df.filter(taken | edge)
        taken, edge = taken | (edge & (level > at)), edge & (level == at)
    return df.filter(taken)
