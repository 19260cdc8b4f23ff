"""Completion of SimHash links: near copies by exact Jaccard similarity of five-word shingles.

A SimHash within few bits misses most edited copies, and a trie of wider budget compares nearly
all prefixes. Further candidates come in three steps, and each is confirmed on the shingle sets.

First, texts that share a bucket meet the bucket's least text: ``BANDS`` keys, each of ``ROWS``
minimum hashes, so that a pair of similarity 0.8 shares none with a chance of 1e-7. That links large
groups of near copies at a row a text and bucket.

Second, in buckets that still hold several components, all meet the best-linked texts and a few that a
hash picks: what a group's least text did not reach, as the group has grown away from it. Again
rows are in proportion to texts and buckets.

Then the texts of buckets that still hold several components (a template, say, filled in anew each
time) are joined by prefixes, exactly. Shingles are ordered by how many components have them. A
pair of 0.8 or more has its first common shingle among the first fifth of the larger text and the first ninth
of the smaller, and far enough ahead in both for the rest to suffice. Shingles of one component only
are in no key, so members of a component don't meet, and texts that share a template but have more than a
ninth of their own never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, written
from .components import components

WORDS, BANDS, ROWS, SEED = 5, 40, 5, 42
#: Texts of a bucket that a hash picks for all others to meet.
CHANCE = 3
_rnd = np.random.default_rng(SEED)
_A = _rnd.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rnd.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingle_hashes(text: str, n: int = WORDS) -> np.ndarray:
    """The hashes of all shingles of a text, repeats included; a text of fewer words is one shingle."""
    w, h = text.encode("utf-8", "surrogatepass").lower().split(), xxhash.xxh64_intdigest
    return np.array([h(b" ".join(w[i : i + n]), SEED) for i in range(max(1, len(w) - n + 1))], np.uint64)


def shingles(text: str) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text))


def majority(hashes: np.ndarray, part: int = 1 << 16) -> int:
    """The SimHash: a bit is set where more than half of the hashes have it; as a signed integer."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), part):
        counts += np.unpackbits(hashes[i : i + part].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def bucket_keys(s: np.ndarray, part: int = 2048) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(s), part):
        least = np.minimum(least, (s[i : i + part, None] * _A + _B).min(0))
    raw = least.astype("<u8").tobytes()
    return [_signed(xxhash.xxh64_intdigest(raw[8 * ROWS * j : 8 * ROWS * (j + 1)], j)) for j in range(BANDS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.StructType().add("u", T.BinaryType()).add("n", T.IntegerType()).add("f", T.LongType()).add("keys", T.ArrayType(T.LongType())))
def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """u: a hash of the shingle set, of 128 bits, n: its size, f: the SimHash, keys: the buckets."""
    for texts in batches:
        rows = []
        for hashes in map(shingle_hashes, texts):
            s = np.unique(hashes)
            rows.append((xxhash.xxh3_128_digest(s.tobytes(), SEED), len(s), majority(hashes), bucket_keys(s)))
        yield pd.DataFrame(rows, columns=["u", "n", "f", "keys"])


@F.pandas_udf(T.ArrayType(T.LongType()))
def shingle_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([shingles(t).view(np.int64) for t in texts])


def fitting(pairs: DataFrame) -> DataFrame:
    """(a, na, b, nb): distinct pairs whose sizes allow a similarity of 0.8."""
    return pairs.filter((5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))).select("a", "na", "b", "nb").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, na, b, nb) and (u, n, s) -> (a, b): pairs of similarity 0.8 or more, 9 x common >= 4 x (na + nb)."""
    side = lambda x: sets.select(F.col("u").alias(x), F.col("s").alias("s" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def bucketed(texts: DataFrame) -> DataFrame:
    """(u, n, keys) -> (k, u, n, a, na), written: the rows of buckets that several texts share, with the least text of each."""
    rows = texts.select(F.explode("keys").alias("k"), "u", "n")
    heads = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("u", "n")).alias("m")).filter("c > 1")
    heads = written(heads.select("k", F.col("m.u").alias("a"), F.col("m.n").alias("na")), "heads")
    shared = written(rows.join(heads, "k"), "bucketed")
    discard(heads)
    return shared


def unsettled(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Buckets and (node, root) -> (u, c): texts, with their component, of buckets that hold several components."""
    at = buckets.select("k", "u").join(roots, F.col("u") == F.col("node"), "left").select("k", "u", F.coalesce("root", "u").alias("c"))
    mixed = at.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("k")
    return at.join(mixed, "k").select("u", "c").distinct()


def prefix_pairs(texts: DataFrame) -> DataFrame:
    """(u, n, c, s) -> (a, na, b, nb): every pair of different components that may be alike to 0.8.

    A shingle's place in a text counts those before it in the common order: by components that
    have it, then by value. From the first common shingle on, what is left of the shorter rest must suffice.
    """
    tokens = texts.select("u", "n", "c", F.explode("s").alias("h"))
    common = tokens.select("h", "c").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    common = written(common, "common")
    ordered = tokens.join(common, "h").groupBy("u", "n", "c").agg(F.array_sort(F.collect_list(F.struct("m", "h"))).alias("t"))
    n, own = F.col("n"), F.col("n") - F.size("t")
    probed, indexed = n - F.ceil(4 * n / 5) + 1, n - F.ceil(8 * n / 9) + 1
    first = F.slice("t", 1, F.greatest(probed - own, F.lit(0)).cast("int"))
    rows = ordered.select("u", "n", "c", own.alias("own"), indexed.alias("indexed"), F.posexplode(first).alias("i", "x"))
    rows = written(rows.select(F.col("x.h").alias("h"), "u", "n", "c", (F.col("own") + F.col("i")).alias("at"), (F.col("own") + F.col("i") < F.col("indexed")).alias("indexed")), "prefixes")
    small = rows.filter("indexed").select("h", *[F.col(x).alias(f"{x}_a") for x in ("u", "n", "c", "at")])
    large = rows.select("h", *[F.col(x).alias(f"{x}_b") for x in ("u", "n", "c", "at")])
    ahead = F.struct("n_a", "u_a") < F.struct("n_b", "u_b")
    enough = 9 * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= 4 * (F.col("n_a") + F.col("n_b"))
    met = small.join(large, "h").filter((F.col("c_a") != F.col("c_b")) & ahead & (5 * F.col("n_a") >= 4 * F.col("n_b")) & enough)
    pairs = written(met.select(F.col("u_a").alias("a"), F.col("n_a").alias("na"), F.col("u_b").alias("b"), F.col("n_b").alias("nb")).distinct(), "pairs")
    discard(common)
    discard(rows)
    return pairs


def hub_pairs(buckets: DataFrame, roots: DataFrame, found: DataFrame) -> DataFrame:
    """Buckets, (node, root) and links (a, b) -> (a, na, b, nb): texts with the best-linked text of a bucket that holds several components.

    They meet that text, the best-linked one of its component, and ``CHANCE`` texts of the bucket
    that a hash picks, so there are a fixed number of rows a text and bucket. A text with many links is near
    the middle of its group, and one near the rim may be alike to a few others only.
    """
    linked = found.select(F.explode(F.array("a", "b")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    named = buckets.select("k", "u", "n").join(roots.select(F.col("node").alias("u"), "root"), "u", "left").join(linked, "u", "left")
    at = named.select("k", "u", "n", F.coalesce("root", "u").alias("c"), F.coalesce("d", F.lit(0)).alias("d"))
    best = F.max(F.struct("d", "u", "n"))
    middle = at.groupBy("c").agg(best.alias("middle"))
    text = F.struct("d", "u", "n", "c")
    chance = [F.min_by(text, F.xxhash64("k", "u", F.lit(i))) for i in range(CHANCE)]
    hubs = at.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(text).alias("hub"), F.array(*chance).alias("others")).filter("low <> high AND hub.d > 0")
    hubs = hubs.select("k", "hub", "others", F.col("hub.c").alias("c")).join(middle, "c")
    centre = F.struct("middle.d", "middle.u", "middle.n", "c")
    hubs = hubs.select("k", F.array_distinct(F.concat(F.array("hub", centre), "others")).alias("with"))
    met = at.select("k", F.col("u").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb")).join(hubs, "k").select("b", "nb", "cb", F.explode("with").alias("m"))
    return fitting(met.filter("m.c <> cb").select(F.col("m.u").alias("a"), F.col("m.n").alias("na"), "b", "nb"))


def raised(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Written (node, root) and further written links (a, b) -> (node, root), written: components of both; the tables given go."""
    if links.isEmpty():
        discard(links)
        return roots
    named = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias("root_" + x))
    lifted = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = written(components(lifted), "roots")
    higher = roots.join(above.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    fresh = above.join(roots, "node", "left_anti")
    both = written(higher.union(fresh), "roots")
    for used in (roots, above, links):
        discard(used)
    return both


def classes(texts: DataFrame, candidates: DataFrame, set_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, n, keys), candidates (a, na, b, nb) -> (node, root), written: components of all pairs of similarity 0.8 or more.

    ``set_of`` gives the shingle sets (u, n, s) of some texts (u).
    """
    buckets = bucketed(texts)
    star = buckets.select("a", "na", F.col("u").alias("b"), F.col("n").alias("nb"))
    pairs = written(fitting(candidates.union(star)), "pairs")
    nodes = buckets.select("u").union(pairs.select("a")).union(pairs.select("b")).distinct()
    sets = written(set_of(nodes), "sets")
    found = written(confirmed(pairs, sets), "links")
    discard(pairs)
    roots = written(components(found), "roots")
    pairs = written(hub_pairs(buckets, roots, found), "pairs")
    discard(found)
    roots = raised(roots, written(confirmed(pairs, sets), "links"))
    discard(pairs)
    pairs = prefix_pairs(unsettled(buckets, roots).join(sets, "u"))
    later = written(confirmed(pairs, sets), "links")
    for used in (pairs, sets, buckets):
        discard(used)
    return raised(roots, later)
