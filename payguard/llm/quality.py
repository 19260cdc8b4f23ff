"""Quality rules: plain base rules, then robust multivariate outliers by language and source.

The statistics of a text are transformed into a vector. In each (lang, source) a minimum-
covariance-determinant estimate is reached by concentration steps: from a start, take the
three quarters of the rows of the smallest distances, estimate mean and covariance on them,
measure again. Three starts (medians with median deviations, and the moments of either half of
the rows by hash) take two steps each; the one of the least determinant goes on. A document is
rejected where its squared Mahalanobis distance, scaled to a chi-square median, is beyond a
far tail of the chi-square distribution. All of it is grouped sums and mergeable quantiles;
the group estimates are joined back to the rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, whole, words, written

#: Fixed value: median of the chi-square distribution with 4 degrees of freedom.
CHI_MEDIAN = 3.3567
#: Standard deviation that each part of the vector has at least, in its own unit.
FLOORS = {"x0": 0.25, "x1": 0.05, "x2": 0.4, "x3": 0.12}
X = tuple(FLOORS)
#: Chance that an ordinary text is taken for an outlier.
TAIL = 1e-14


def chi_square_cut(tail: float) -> float:
    """What a chi-square with 4 degrees of freedom exceeds with probability ``tail``."""
    low, high = 0.0, 2000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if math.exp(-mid / 2) * (1 + mid / 2) > tail else (low, mid)
    return high


def statistics(text: str = "text", frame: DataFrame | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) to a frame.

    The positions of repeated three-word windows come from one sort of the text's own
    window hashes, and only where a hash repeats at all.
    """
    t = whole(text)
    f = frame.withColumn("_w", words(text)).withColumn("n_words", F.size("_w").cast("long"))
    f = f.withColumn("word_chars", F.length(F.translate(t, SPACE_CHARS, "")).cast("long"))
    f = f.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
    f = f.withColumn("_l", F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0))
    f = f.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    f = f.withColumn("_h", F.when(F.size("_w") >= 3, hashes).otherwise(F.array().cast("array<bigint>")))
    ordered = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    f = f.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ordered))
    same = lambda i, j: F.coalesce(F.get("_s", i)["h"] == F.get("_s", j)["h"], F.lit(False))
    found = F.filter("_s", lambda s, i: same(i, i - 1) | same(i, i + 1))
    f = f.withColumn("_p", F.array_sort(F.transform(found, lambda s: s["i"])))
    gaps = F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(p - F.get("_p", i - 1), F.lit(3))))
    f = f.withColumn("n_repeat_words", F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    return f.drop("_w", "_l", "_h", "_s", "_p")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_vector(f: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return (
        f.withColumn("x0", F.log1p(n))
        .withColumn("x1", F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n))
        .withColumn("x2", F.log1p(1000 * F.col("n_symbols") / n))
        .withColumn("x3", F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n))))
    )


def distance(f: DataFrame, out: str) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution with the group's Cholesky factor."""
    f = f.withColumns({f"_c{i}": F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)})
    for i in range(len(X)):
        gone = reduce(lambda a, j: a + F.col(f"l{i}{j}") * F.col(f"_y{j}"), range(i), F.lit(0.0))
        f = f.withColumn(f"_y{i}", (F.col(f"_c{i}") - gone) / F.col(f"l{i}{i}"))
    f = f.withColumn(out, sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(len(X))), F.lit(0.0)))
    return f.drop(*[f"_c{i}" for i in range(len(X))], *[f"_y{i}" for i in range(len(X))])


P = range(len(X))
MEANS, FACTORS = [f"m{i}" for i in P], [f"l{i}{j}" for i in P for j in range(i + 1)]


def _factor(moments: DataFrame) -> DataFrame:
    """g, s, m_i, c_ij -> m_i and the Cholesky factor l_ij; no variance is under its floor."""
    f = moments
    for i in P:
        for j in range(i + 1):
            gone = reduce(lambda a, k: a + F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.lit(0.0))
            rest = F.col(f"c{i}{j}") - gone
            least = FLOORS[X[i]] ** 2
            f = f.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(least))) if i == j else rest / F.col(f"l{j}{j}"))
    return f.select("g", "s", *MEANS, *FACTORS)


def _grouped(v: DataFrame, g: DataFrame) -> DataFrame:
    return v.join(g, v["lang"].eqNullSafe(g["g_lang"]) & v["source"].eqNullSafe(g["g_source"]), "left")


def _moments(v: DataFrame) -> DataFrame:
    aggs = [F.avg(X[i]).alias(f"m{i}") for i in P]
    aggs += [(F.covar_pop(X[i], X[j]) if i != j else F.var_pop(X[i])).alias(f"c{i}{j}") for i in P for j in range(i + 1)]
    return v.groupBy("g", "s").agg(*aggs)


def _levels(v: DataFrame, min_rows: int) -> tuple[DataFrame, DataFrame]:
    """(g_lang, g_source, g): the estimate that each group takes; (g_lang, g_source, g): those it is a part of.

    A group takes its own, that of its language where it has under ``min_rows`` rows, and that of
    the whole table where the language has too. Estimates that no group takes are not made.
    """
    own = v.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(F.count(F.lit(1)).alias("n"))
    own = written(own, "groups")
    lang = own.groupBy(F.col("g_lang").alias("w_lang")).agg(F.sum("n").alias("n_lang"))
    sized = own.join(lang, F.col("g_lang").eqNullSafe(F.col("w_lang"))).crossJoin(own.agg(F.sum("n").alias("n_all")))
    keys = [F.to_json(F.struct(F.lit(i).alias("level"), *c)) for i, c in enumerate((["g_lang", "g_source"], ["g_lang"], []))]
    g = F.when(F.col("n") >= min_rows, keys[0]).when(F.col("n_lang") >= min_rows, keys[1]).when(F.col("n_all") >= min_rows, keys[2])
    sized = written(sized.select("g_lang", "g_source", g.alias("g"), F.array(*keys).alias("keys")), "levels")
    taken = sized.select("g_lang", "g_source", "g").filter("g is not null")
    parts = sized.select("g_lang", "g_source", F.explode("keys").alias("g")).join(taken.select("g").distinct(), "g", "left_semi")
    return taken, written(parts, "parts")


def _median(x: str | Column) -> Column:
    return F.percentile_approx(x, 0.5, 10000)


def _starts(v: DataFrame) -> DataFrame:
    """g, s, m_i, l_ij: medians with median deviations (s = 0), moments of the halves by hash (1, 2)."""
    mid = written(v.groupBy("g").agg(*[_median(x).alias(f"m{i}") for i, x in enumerate(X)]), "medians")
    mad = v.join(mid, "g").groupBy("g", *MEANS).agg(*[_median(F.abs(F.col(x) - F.col(f"m{i}"))).alias(f"d{i}") for i, x in enumerate(X)])
    spread = lambda i: F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[X[i]]))
    first = mad.select("g", F.lit(0).alias("s"), *MEANS, *[(spread(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in P for j in range(i + 1)])
    halves = _factor(_moments(v.withColumn("s", (1 + F.pmod(F.xxhash64(*X), F.lit(2))).cast("int"))))
    return first.union(halves)


def _step(v: DataFrame, g: DataFrame, part: float) -> DataFrame:
    """A concentration step: the estimates on the rows within each one's quantile of distance."""
    near = distance(v.join(g, "g"), "d2")
    limit = written(near.groupBy("g", "s").agg(F.percentile_approx("d2", part, 10000).alias("q")), "limits")
    inside = near.join(limit, ["g", "s"]).filter(F.col("d2") <= F.col("q")).select("g", "s", *X)
    return written(_factor(_moments(inside)), "step")  # a small table, so that plans stay short


def estimates(v: DataFrame, trials: int = 2, steps: int = 3, part: float = 0.75, min_rows: int = 40) -> DataFrame:
    """Estimates by (lang, source) from the vectors of the rows that pass the base rules; one row a group.

    Groups under ``min_rows``, too few for a covariance, have that of their language or of the
    whole table. Only where the table itself has fewer such rows is there none.
    """
    taken, parts = _levels(v, min_rows)
    v = written(_grouped(v, parts).filter("g is not null").select("g", *X), "grouped")
    g = written(_starts(v), "starts")
    for _ in range(trials):
        g = _step(v, g, part)
    determinant = reduce(lambda a, i: a * F.col(f"l{i}{i}") * F.col(f"l{i}{i}"), P, F.lit(1.0))
    best = g.groupBy("g").agg(F.min(F.struct(determinant.alias("det"), "s", *MEANS, *FACTORS)).alias("b"))
    g = written(best.select("g", "b.s", *[f"b.{c}" for c in (*MEANS, *FACTORS)]), "least")
    for _ in range(steps):
        g = _step(v, g, part)
    near = distance(v.join(g, "g"), "d2")
    scale = near.groupBy("g").agg(F.greatest(_median("d2") / CHI_MEDIAN, F.lit(1.0)).alias("scale"))
    return written(taken.join(g.drop("s").join(scale, "g"), "g").drop("g"), "mcd")


def _verdict(f: DataFrame, g: DataFrame, cut: float) -> DataFrame:
    f = distance(_grouped(f, g), "d2").withColumn("outlyingness", F.col("d2") / F.col("scale"))
    kept = ~F.col("base_failed") & (F.coalesce("outlyingness", F.lit(0.0)) <= cut)
    return f.withColumn("kept", kept)


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """documents -> doc_id, the five statistics, base_failed, outlyingness (null: no estimate, in a table of few rows), kept.

    Rejected are rows beyond the ``tail`` of a chi-square, so that even of a hundred thousand
    million ordinary texts none is likely to go. Null text counts as empty and fails; null lang or source
    is a group of its own; repeated rows are judged each; a text's length changes nothing but its
    statistics. Empty tables give empty results; other columns are not looked at.
    """
    f = statistics(frame=docs.select("doc_id", "lang", "source", "text")).drop("text")
    v = written(with_vector(f).withColumn("base_failed", base_failed()), "quality")
    g = estimates(v.filter(~F.col("base_failed")).select("lang", "source", *X))
    out = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "outlyingness", "kept"]
    return _verdict(v, g, chi_square_cut(tail)).select(*out)


def kept_documents(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The documents that ``judge`` keeps, with their columns.

    Rows are written once with their vectors: the statistics are worked out once, no filter is
    pushed into their expressions, and only the group estimates meet the texts.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "lang", "source", "text")
    f = with_vector(statistics(frame=rows).drop("text")).withColumn("base_failed", base_failed())
    v = written(f.select("row", "lang", "source", "base_failed", *X), "quality")
    g = estimates(v.filter(~F.col("base_failed")).select("lang", "source", *X))
    return _verdict(v, g, chi_square_cut(tail)).filter("kept").select("row.*")
