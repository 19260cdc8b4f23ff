"""SimHash near-dedup by a binary trie that is joined with itself.

A text's fingerprint has a bit set where more than half of its three-word shingle hashes have
it. Two differing bits leave three of five blocks equal, so there are ten tries, one for each
choice of three blocks that come first: similar fingerprints share the leading 38 bits in one
of them, a node that is paired with itself, at no cost. Node pairs are then traversed
together, a few levels a join: the children of both nodes meet, differing bits are added to
what the pair has, and pairs over the budget are pruned. A self-pair goes on only where two
fingerprints lie below it. A node has at most 2**step children and few partners within the
budget, and chance meetings of 38 bits are few, so no key of these joins and no level grows as
the square of the data. Copies share one fingerprint and take part once.

Links of two bits miss most edited copies: where a corpus is deduplicated (``one_of_each``),
the trie's links over five-word shingles are confirmed on the shingle sets, and what it misses
of similarity 0.8 or more is added by minimum hashes and a join of prefixes (``jaccard.py``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jaccard
from .common import discard, whole, written
from .components import components

#: (first bit from the left, size) of each block; the orders of blocks that the tries have.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
ORDERS = [(*first, *(b for b in range(5) if b not in first)) for first in combinations(range(5), 3)]
ROOT_BITS, STEPS = 38, (9, 9, 8)
SEED = 42


def fingerprint(text: str, n: int = 3, part: int = 1 << 16) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, np.int64), max(1, len(w) - n + 1)
    for at in range(0, total, part):
        hashes = np.array([h(b" ".join(w[i : i + n]), SEED) for i in range(at, min(total, at + part))], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint(t or "") for t in texts], dtype="int64")


def _reordered(f: Column, order: tuple[int, ...], back: bool = False) -> Column:
    """The bits of f with its blocks in another order, or of such bits in their own order."""
    parts, at = [], 0
    for block in order:
        start, size = BLOCKS[block]
        here, there = (at, start) if back else (start, at)
        bits = F.shiftrightunsigned(f, 64 - here - size).bitwiseAND(F.lit((1 << size) - 1).cast("long"))
        parts.append(F.shiftleft(bits, 64 - there - size))
        at += size
    return reduce(Column.bitwiseOR, parts)


def links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Distinct (f) -> (a, b): pairs of fingerprints that differ in 1 to ``budget`` (at most 2) bits."""
    each = F.array(*[F.struct(F.lit(r).alias("r"), _reordered(F.col("f"), order).alias("v")) for r, order in enumerate(ORDERS)])
    leaves = prints.select(F.inline(each))
    depth, pairs = ROOT_BITS, None
    for step in STEPS:
        deeper = depth + step
        node, child = F.shiftrightunsigned("v", 64 - depth), F.shiftrightunsigned("v", 64 - deeper)
        kids = leaves.groupBy("r", node.alias("p"), child.alias("c")).agg(F.count(F.lit(1)).alias("n"))
        if pairs is None:
            pairs = kids.groupBy("r", "p").agg(F.sum("n").alias("n")).filter("n > 1")
            pairs = pairs.select("r", F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0).alias("d"))
        left = kids.select("r", F.col("p").alias("a"), F.col("c").alias("ca"), F.col("n").alias("na"))
        right = kids.select("r", F.col("p").alias("b"), F.col("c").alias("cb"), F.col("n").alias("nb"))
        fresh = F.lit((1 << step) - 1).cast("long")
        d = F.col("d") + F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")).bitwiseAND(fresh))
        ordered = (F.col("a") != F.col("b")) | (F.col("ca") < F.col("cb")) | ((F.col("ca") == F.col("cb")) & (F.col("na") > 1))
        met = pairs.join(left, ["r", "a"]).join(right, ["r", "b"]).filter(ordered & (d <= budget))
        deep = written(met.select("r", F.col("ca").alias("a"), F.col("cb").alias("b"), d.cast("int").alias("d")), "trie")
        if depth > ROOT_BITS:
            discard(pairs)
        depth, pairs = deeper, deep
    own = lambda c: F.get(F.array(*[_reordered(F.col(c), order, back=True) for order in ORDERS]), F.col("r"))
    return pairs.filter("d > 0").select(own("a").alias("a"), own("b").alias("b"))


def classes(docs: DataFrame, budget: int = 2) -> DataFrame:
    """documents -> doc_id, f (fingerprint, bigint), component_id (least doc_id reachable).

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id is least
    of nothing: a class of such rows only has a null component_id.
    """
    prints = written(docs.select("doc_id", fingerprints(whole("text")).alias("f")), "prints")
    distinct = written(prints.groupBy("f").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("f"), budget))
    roots = distinct.join(found, F.col("f") == F.col("node"), "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    roots = written(roots, "roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(roots.join(ids, "root").select("f", "component_id"), "f").select("doc_id", "f", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row left of each class of near copies; columns as in ``docs``.

    Near copies are texts of five-word Jaccard similarity 0.8 or more, and what such links reach.
    The least doc_id stays, null last; of rows that share it the one with the least hash of
    its text, and of wholly equal rows one. Null and empty texts are one class. An empty table
    stays empty.
    """
    key = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), whole("text"))))
    sketched = written(docs.select("doc_id", key.alias("k"), jaccard.sketches(whole("text")).alias("s")).select("doc_id", "k", "s.*"), "sketches")
    # equal sets are one text, that of its least row
    texts = written(sketched.groupBy("u").agg(F.min(F.struct("k", "n", "f", "keys")).alias("m")).select("u", "m.*"), "distinct")
    heads = written(texts.groupBy("f").agg(F.min(F.struct("u", "n")).alias("m")).select("f", "m.u", "m.n"), "heads")
    alike = texts.join(heads.toDF("f", "a", "na"), "f").select("a", "na", F.col("u").alias("b"), F.col("n").alias("nb"))
    near = links(heads.select("f")).distinct()
    near = near.join(heads.toDF("a", "ua", "na"), "a").join(heads.toDF("b", "ub", "nb"), "b").select(F.col("ua").alias("a"), "na", F.col("ub").alias("b"), "nb")

    def set_of(nodes: DataFrame) -> DataFrame:
        wanted = texts.join(nodes, "u").select("k", "u", "n")
        rows = docs.select(key.alias("k"), whole("text").alias("text")).join(wanted, "k")
        return rows.dropDuplicates(["u"]).select("u", "n", jaccard.shingle_sets("text").alias("s"))

    found = jaccard.classes(texts.select("u", "n", "keys"), alike.union(near), set_of)
    discard(texts)
    discard(heads)
    roots = sketched.select("doc_id", "k", "u").join(found, F.col("u") == F.col("node"), "left").select("doc_id", "k", F.coalesce("root", "u").alias("root"))
    first = roots.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k")).alias("m"))
    keep = first.select(F.col("m.doc_id").alias("keep_id"), F.col("m.k").alias("keep_k"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), key.alias("k"))
    left = rows.join(keep, (F.col("k") == F.col("keep_k")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return left.dropDuplicates(["id", "k"]).select("row.*")
