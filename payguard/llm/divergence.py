"""Source divergence audit: how far the sources of a language lie apart in their words.

Each kept term is a row of counts by source. The rows go into a frequent-pattern tree: a path
of the sources that have the term, in order, each with its count; equal beginnings are one
path, and a node knows how many terms pass through it. For two sources the sum over all terms
is what it were without any occurrence, plus what each source's own counts change, plus a
correction for terms that both have; the last comes once for every node and ancestor, times the
node's terms.

The rows are counted (equal rows are one, with their multiplicity) and sorted by path, so that a
task needs of the tree only the path to the current node: a node is complete when the next row
leaves it. What a task hands on are sums by pair of sources. All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

UNIT, MORE, LEAST_DOCS, RANKS = 1_000_000_000, 2, 10, 10
#: Bytes of UTF-8 to those of terms: A-Z lower-cased, other bytes below 128 become spaces.
_TERM = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(raw: bytes, part: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about ``part`` bytes."""
    raw, at = raw.translate(_TERM), 0
    while at < len(raw):
        end = raw.find(b" ", at + part)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def counted(docs: DataFrame, most: int = 600_000) -> DataFrame:
    """(lang, source, text) -> lang, source, term, n (occurrences), docs (documents with it).

    A task sums up to ``most`` terms before it hands them on, so nothing is summed again before
    the exchange.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in sums.items():
                term = pa.array(list(n), pa.binary()).cast(pa.string())
                both = [pa.array(np.fromiter(x, np.int64, len(n))) for x in (n.values(), map(seen.__getitem__, n))]
                if n:
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), pa.repeat(source, len(n)), term, *both], names=["lang", "source", "term", "n", "docs"])
            sums.clear()

        for batch in batches:
            for lang, source, raw in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
                n, seen = sums.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for some in terms(raw):
                    n.update(some)
                    own.update(some)
                seen.update(own)
            if sum(len(n) for n, _ in sums.values()) > most:
                yield from told()
        yield from told()

    key = ("lang", "source", "term")
    parts = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.repartition(*key).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(count: str | Column, total: str) -> Column:
    """1 + floor(UNIT * (count + 2) / total); null where total is 0."""
    c = F.col(count) if isinstance(count, str) else count
    of = F.nullif(F.col(total), F.lit(0))
    wide = F.call_function("div", F.lit(UNIT).cast("decimal(12,0)") * (c + MORE).cast("decimal(20,0)"), of.cast("decimal(20,0)"))
    return 1 + F.when(c < 9 * UNIT, F.call_function("div", UNIT * (c + MORE), of)).otherwise(wide)


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class Tree:
    """Sums over node-ancestor combinations of paths that come in order; only the current path is held."""

    def __init__(self, lang: str, most: int = 1 << 18):
        self.lang, self.most = lang, most
        self.path: list[tuple[str, int]] = []
        self.items: list[int] = []
        self.passing: list[int] = []
        self.known: dict[str, int] = {}
        self.source, self.p, self.p0 = [], [], []
        self.nodes, self.ancestors, self.depths, self.counts = [], [], [], []
        self.sums: Counter = Counter()

    def insert(self, path: list[tuple[str, int, int, int]], multiplicity: int) -> None:
        keys = [(source, n) for source, n, _, _ in path]
        same = 0
        while same < min(len(keys), len(self.path)) and keys[same] == self.path[same]:
            same += 1
        self.leave(same)
        for source, _, p, p0 in path[same:]:
            self.items.append(len(self.p))
            self.source.append(self.known.setdefault(source, len(self.known)))
            self.p.append(p)
            self.p0.append(p0)
            self.passing.append(0)
        self.path = keys
        if self.passing:
            self.passing[-1] += multiplicity

    def leave(self, depth: int) -> None:
        """Closes the nodes below a depth; a node's terms pass through the one above it too."""
        while len(self.items) > depth:
            node, n = self.items.pop(), self.passing.pop()
            self.nodes.append(node)
            self.ancestors.extend(self.items)
            self.depths.append(len(self.items))
            self.counts.append(n)
            if self.passing:
                self.passing[-1] += n
        del self.path[depth:]
        if len(self.ancestors) > self.most:
            self.add_up()

    def add_up(self) -> None:
        """The corrections of all closed nodes with all their ancestors, added by pair of sources."""
        source, p, p0 = (np.array(x, np.int64) for x in (self.source, self.p, self.p0))
        b, a = np.repeat(np.array(self.nodes, np.int64), self.depths), np.array(self.ancestors, np.int64)
        if len(a):
            both = _between(p[a], p[b]) - _between(p[a], p0[b]) - _between(p0[a], p[b]) + _between(p0[a], p0[b])
            pairs, place = np.unique(source[a] * len(self.known) + source[b], return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, place, both * np.repeat(np.array(self.counts, np.int64), self.depths))
            names = list(self.known)
            for pair, s in zip(pairs.tolist(), sums.tolist()):
                self.sums[names[pair // len(names)], names[pair % len(names)]] += s
        kept = self.items
        self.source, self.p, self.p0 = ([x[i] for i in kept] for x in (self.source, self.p, self.p0))
        self.items = list(range(len(kept)))
        self.nodes, self.ancestors, self.depths, self.counts = [], [], [], []

    def told(self) -> pd.DataFrame:
        self.leave(0)
        self.add_up()
        return pd.DataFrame([(self.lang, a, b, s) for (a, b), s in self.sums.items()], columns=["lang", "a", "b", "value"])


def corrections(paths: DataFrame) -> DataFrame:
    """lang, path (array of source, n, p, p0 by source), terms -> lang, a, b, value: a before b in code point order."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = None
        for batch in batches:
            for lang, path, n in zip(batch["lang"], batch["path"], batch["terms"]):
                if tree is None or tree.lang != lang:
                    if tree is not None:
                        yield tree.told()
                    tree = Tree(lang)
                tree.insert([(x["source"], x["n"], x["p"], x["p0"]) for x in path], n)
        if tree is not None:
            yield tree.told()

    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    return ordered.mapInPandas(walk, "lang string, a string, b string, value long")


def audit(docs: DataFrame) -> DataFrame:
    """documents -> lang, source, part ('pair' or 'term'), item, value, rank.

    Null text, lang and source are empty. Rows alike count each. A language without kept terms
    has pairs of value 0 and no terms. A term's row holds one count a source, so sources should
    be domains or feeds, not millions of hosts: the pairs are as many as their square.
    """
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = counted(plain).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("cells"))
    rows = written(rows.filter(F.col("docs") >= LEAST_DOCS).select("lang", "term", "cells"), "term_rows")
    cells = rows.select("lang", "term", F.inline("cells"))
    vocabulary = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = groups.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["total", "v"])
    groups = groups.withColumn("bottom", F.col("total") + MORE * F.col("v"))
    groups = written(groups.select("lang", "source", "v", "bottom", _p(F.lit(0).cast("long"), "bottom").alias("p0")), "groups")
    whole_lang = groups.groupBy("lang").agg(F.sum(F.col("bottom") - MORE * F.col("v")).alias("n"), F.max("v").alias("v"))
    whole_lang = whole_lang.select("lang", (F.col("n") + MORE * F.col("v")).alias("lang_bottom"))

    known = cells.join(groups, ["lang", "source"]).withColumn("p", _p("n", "bottom"))
    path = F.array_sort(F.collect_list(F.struct("source", "n", "p", "p0"))).alias("path")
    paths = known.groupBy("lang", "term").agg(path).groupBy("lang", "path").agg(F.count(F.lit(1)).alias("terms"))
    both = corrections(paths)

    other = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("q0"), "v")
    alone = known.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("source", "a")
    alone = alone.join(other.drop("v"), "lang").filter("a <> b")
    alone = alone.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * (_f(F.col("p"), F.col("q0")) - _f(F.col("p0"), F.col("q0")))).alias("value"))
    changes = both.union(alone).select("lang", F.inline(F.array(F.struct("a", "b", "value"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "value"))))
    none = groups.select("lang", F.col("source").alias("a"), "p0").join(other, "lang").filter("a <> b")
    none = none.select("lang", "a", "b", F.coalesce(F.col("v") * _f(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    pairs = none.union(changes).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))

    spread = known.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")).join(whole_lang, "lang").select("lang", "term", _p("lang_n", "lang_bottom").alias("q"))
    lifted = known.join(spread, ["lang", "term"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank)
    return columns(pairs, "pair").union(columns(lifted, "term").filter(F.col("rank") <= RANKS))


SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS s FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(n.n, 0) + 2)::HUGEINT // (coalesce(s.s, 0) + 2 * v.v)::HUGEINT AS BIGINT) AS p FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS (SELECT x.lang, x.term, 1 + CAST(1000000000 * (x.n + 2)::HUGEINT // (y.n + 2 * v.v)::HUGEINT AS BIGINT) AS q FROM (SELECT lang, term, sum(n) AS n FROM n GROUP BY ALL) AS x JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY ALL) AS y ON y.lang = x.lang JOIN v ON v.lang = x.lang),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pair AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) AS x WHERE part = 'pair' OR rank <= 10"""
