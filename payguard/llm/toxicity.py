"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Feature counts (words, word prefixes) come from all labelled training documents, in Spark.
Features that mark toxic documents give weak token tags; a chain with two tags is fitted on
them on a bounded sample of documents. Every line of every text is then tagged: forward and
backward odds run over all lines of a batch at once, one token position at a time. Marginals
make the document's score and the offsets of offending tokens.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import top, whole, words, written

EDGES = ".,;:!?\"'()[]{}|*#$%&<>-_"
PREFIX = 4
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def token(raw: str) -> str:
    return raw.lower().strip(EDGES)


def features(word: str) -> tuple[str, ...]:
    if len(word) < 2:
        return ()
    return ("w:" + word, "p:" + word[:PREFIX]) if len(word) > PREFIX else ("w:" + word,)


def feature_table(docs: DataFrame, most: int = 4000, least_docs: int = 4, least_z: float = 5.0) -> list[tuple[str, float]]:
    """(text, toxic) of all training rows -> the strongest features with their log odds.

    Document counts by feature cover every row; the list is cut to the ``most`` features of
    the greatest z, which bounds what comes to the driver.
    """
    clean = F.transform(words(F.lower(whole("text"))), lambda w: F.btrim(w, F.lit(EDGES)))
    seen = F.array_distinct(F.filter(clean, lambda w: F.length(w) >= 2))
    prefixes = F.transform(F.filter(seen, lambda w: F.length(w) > PREFIX), lambda w: F.concat(F.lit("p:"), F.left(w, F.lit(PREFIX))))
    both = F.concat(F.transform(seen, lambda w: F.concat(F.lit("w:"), w)), F.array_distinct(prefixes))
    sums = docs.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, n = float(sums[0]), float(sums[1])
    if not 0 < toxic < n:
        return []
    f = docs.select("toxic", F.explode(both).alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"))
    f = f.filter(F.col("n") >= least_docs)
    share = toxic / n
    odds = F.log((F.col("t") + 2 * share) / (F.col("n") - F.col("t") + 2 * (1 - share))) - math.log(share / (1 - share))
    z = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    f = f.select("f", odds.alias("odds"), F.abs(z).alias("z")).filter(F.col("z") >= least_z)
    rows = top(written(f, "features"), "z", most, "f").collect()
    return [(r.f, r.odds) for r in sorted(rows, key=lambda r: (-r.z, r.f))]


class Chain:
    """Two tags; a token's log odds are the sum of its features' weights and a bias."""

    def __init__(self, names: list[str]):
        self.index = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros(len(names) + 1)  # the last is the bias
        self.moves = np.log(np.array([[0.98, 0.02], [0.6, 0.4]]))  # log of the turn from tag to tag
        self.calibration = np.array([0.0, 0.0, -2.0])

    def ids(self, raw: str) -> tuple[int, ...]:
        return tuple(self.index[f] for f in features(token(raw)) if f in self.index)

    def odds(self, sparse: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        at, feature = sparse
        e = np.full(n, self.weights[-1])
        np.add.at(e, at, self.weights[feature])
        return np.clip(e, -30, 30)

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log odds of all tokens and the lengths of their lines -> probability of tag 1, forward and backward odds."""
        t = np.exp(self.moves)
        lift, starts = np.exp(e), np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, int)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        forward, backward = np.empty(len(e)), np.ones(len(e))
        longest = int(lengths[0]) if len(lengths) else 0
        alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
        for k in range(longest):
            at = starts[: alive[k]] + k
            before = forward[at - 1] if k else None
            forward[at] = lift[at] * (1.0 if k == 0 else (t[0, 1] + t[1, 1] * before) / (t[0, 0] + t[1, 0] * before))
        for k in range(longest - 2, -1, -1):
            at = starts[: alive[k + 1]] + k
            after = lift[at + 1] * backward[at + 1]
            backward[at] = (t[1, 0] + t[1, 1] * after) / (t[0, 0] + t[0, 1] * after)
        both = forward * backward
        return both / (1 + both), forward, backward

    def fit(self, sparse: tuple[np.ndarray, np.ndarray], tags: np.ndarray, lengths: np.ndarray, rounds: int = 80, rate: float = 0.2, ridge: float = 0.02) -> None:
        """Maximum likelihood by Adam: observed less expected features and moves."""
        at, feature = sparse
        n, inner = len(tags), np.ones(len(tags), bool)
        inner[np.cumsum(lengths) - 1] = False
        here = np.flatnonzero(inner)
        theta = np.concatenate((self.weights, self.moves.ravel()))
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            self.weights, self.moves = theta[:-4], theta[-4:].reshape(2, 2)
            e = self.odds(sparse, n)
            p, forward, backward = self.marginals(e, lengths)
            gap = tags - p
            g = np.zeros_like(theta)
            np.add.at(g, feature, gap[at])
            g[len(self.weights) - 1] = gap.sum()
            t, after = np.exp(self.moves), np.exp(e[here + 1]) * backward[here + 1]
            pairs = np.stack([np.full(len(here), t[0, 0]), t[0, 1] * after, forward[here] * t[1, 0], forward[here] * t[1, 1] * after])
            expected = pairs @ (1 / pairs.sum(0))
            observed = np.bincount((2 * tags[here] + tags[here + 1]).astype(int), minlength=4)
            g[-4:] = observed - expected
            g = g - ridge * theta * np.r_[np.ones(len(self.weights) - 1), np.zeros(5)]  # no prior on bias and moves
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.weights, self.moves = theta[:-4], theta[-4:].reshape(2, 2)

    def calibrate(self, x: np.ndarray, toxic: np.ndarray, weight: np.ndarray, rounds: int = 400) -> None:
        """Logistic regression of document labels on what marginals add up to.

        A document weighs what its label was sampled at, inversely, so that a score means the
        same whatever part of each label the sample holds.
        """
        b, weight = self.calibration, weight / weight.mean()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            w = weight * p * (1 - p) + 1e-6
            step = np.linalg.solve((x * w[:, None]).T @ x + 0.02 * len(x) / 100 * np.eye(3), x.T @ (weight * (toxic - p)) - 0.02 * len(x) / 100 * b)
            b = b + step
            if np.abs(step).max() < 1e-6:
                break
        self.calibration = b


def tokens_of(texts: list[str], ids_of) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Sparse features of all tokens of all lines, the lines' lengths, the documents' token counts."""
    at, feature, lengths, counts, n = [], [], [], [], 0
    for text in texts:
        before = n
        for line in text.split("\n"):
            raw = TOKEN.findall(line)
            if not raw:
                continue
            for i, ids in enumerate(map(ids_of, raw)):
                for f in ids:
                    at.append(n + i)
                    feature.append(f)
            lengths.append(len(raw))
            n += len(raw)
        counts.append(n - before)
    return (np.array(at, int), np.array(feature, int)), np.array(lengths, int), np.array(counts, int)


def summed(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """By document: log of expected toxic tokens (of those over 0.2), greatest marginal, 1."""
    doc = np.repeat(np.arange(len(counts)), counts)
    strong = np.bincount(doc, np.where(p > 0.2, p, 0.0), len(counts))
    top = np.zeros(len(counts))
    np.maximum.at(top, doc, p)
    return np.stack([np.log1p(strong), top, np.ones(len(counts))], 1)


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 4000, broadcast_rows: int = 2_000_000) -> Chain:
    """A chain fitted on rows of ``labels`` whose crc32(doc_id) mod 5 is not 0.

    Features are counted over all those rows; the fit takes about ``most_docs`` documents, half
    of them toxic where there are as many, those whose hashed ids are low, and scores are
    calibrated to the shares that the labels have among all rows. Labels are broadcast
    only up to ``broadcast_rows`` rows; beyond, the join is a shuffle.
    """
    taught = labels.filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 != 0")
    taught = taught.groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("int").alias("toxic"))
    few = taught.limit(broadcast_rows + 1).count() <= broadcast_rows
    rows = docs.select("doc_id", "text").join(F.broadcast(taught) if few else taught, F.col("doc_id") == F.col("of"))
    named = feature_table(rows)
    chain = Chain([f for f, _ in named])
    marks = {i for i, (_, odds) in enumerate(named) if odds > 2.0}
    kinds = {r.toxic: r.n for r in taught.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares, part = {kind: min(1.0, most_docs / 2 / n) for kind, n in kinds.items()}, F.lit(0.0)
    for kind, share in shares.items():
        part = F.when(F.col("toxic") == kind, share).otherwise(part)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < part * 1_000_003)
    sample = sample.select("doc_id", whole("text").alias("text"), "toxic")
    sample = sorted(sample.collect(), key=lambda r: (r.doc_id, r.text))
    if not named or not sample:
        return chain
    sparse, lengths, counts = tokens_of([r.text for r in sample], chain.ids)
    toxic = np.array([r.toxic for r in sample], float)
    tags = np.zeros(int(counts.sum()))
    tags[[a for a, f in zip(*sparse) if f in marks]] = 1.0
    tags *= np.repeat(toxic, counts)
    if len(tags) == 0:
        return chain
    chain.fit(sparse, tags, lengths)
    p, _, _ = chain.marginals(chain.odds(sparse, len(tags)), lengths)
    chain.calibrate(summed(p, counts), toxic, np.array([1 / shares[r.toxic] for r in sample]))
    return chain


SCORED = T.StructType().add("score", "double").add("spans", "string")


def score(docs: DataFrame, chain: Chain, tag: float = 0.5, part: int = 1000, cached: int = 400_000) -> DataFrame:
    """documents -> doc_id, held_out, score, predicted, spans (start:end of offending tokens, code points).

    Null and empty texts get the score of no toxic token. Without features (no labels of both
    kinds) every document gets that score. Repeated rows are scored each.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(SCORED)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, known = model.value, {}

        def ids_of(raw: str) -> tuple[int, ...]:
            ids = known.get(raw)
            if ids is None:
                if len(known) >= cached:
                    known.clear()
                ids = known[raw] = c.ids(raw)
            return ids

        for texts in batches:
            out = []
            for k in range(0, len(texts), part):
                some = [t or "" for t in texts.iloc[k : k + part]]
                sparse, lengths, counts = tokens_of(some, ids_of)
                p, _, _ = c.marginals(c.odds(sparse, int(counts.sum())), lengths)
                scores = 1 / (1 + np.exp(-np.clip(summed(p, counts) @ c.calibration, -30, 30)))
                first = np.concatenate(([0], np.cumsum(counts)))
                hits = np.flatnonzero(p > tag)
                for i, text in enumerate(some):
                    own = hits[np.searchsorted(hits, first[i]) : np.searchsorted(hits, first[i + 1])] - first[i]
                    spans = ""
                    if len(own):
                        places = [m.span() for m in TOKEN.finditer(text)]
                        spans = ",".join(f"{places[j][0]}:{places[j][1]}" for j in own)
                    out.append((scores[i], spans))
            yield pd.DataFrame(out, columns=SCORED.names)

    s = docs.select("doc_id", scored(whole("text")).alias("s")).select("doc_id", "s.*")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return s.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
