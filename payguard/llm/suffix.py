"""Suffix-array dedup of repeated byte strings, by common-prefix interval trees.

Every string of ``LEAST`` bytes holds its least-hashed 32-byte gram, wherever it stands, so two
copies of a string share that anchor. Anchors are found in all texts, each with a hash of what
surrounds it as far as a repeat can reach. Where all occurrences of a gram have the same
surroundings no bytes are looked at; where they differ, one text of each kind gives its bytes.
The suffixes that begin with one gram are one interval of the corpus's suffix array: each such
bucket is sorted and its common prefixes scanned with a stack into an interval tree; in each
interval the texts to the left are sorted and scanned in turn, and where they differ (the left
extension is diverse) a maximal repeat ends. Those of ``LEAST`` bytes or more are groups with
all their occurrences. A bucket with very many different surroundings is split; windows that
several of its parts have are then found by one count over all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, whole, written

LEAST, GRAM = 200, 32
SPAN = LEAST - GRAM  # how far a repeat may reach from its anchor, on either side
BLOCK = 1 << 16
BASE = 0x9E3779B97F4A7C15
U64 = np.uint64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    ones = np.ones(n, U64)
    with np.errstate(over="ignore"):
        up, down = ones.copy(), ones.copy()
        up[1:], down[1:] = U64(BASE), U64(inverse)
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


POWERS = _powers(BLOCK + 4 * LEAST)


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every n-byte string of a byte array (at most a block and its edges)."""
    if len(data) < n:
        return np.zeros(0, U64)
    up, down = POWERS
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[n:] - sums[:-n]) * down[: len(data) - n + 1]
    h ^= h >> U64(31)
    h *= U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(29))


def _slide(x: np.ndarray, n: int, least: Callable) -> np.ndarray:
    """``least`` over every n neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        x, width = least(x[:-width], x[width:]), 2 * width
    return least(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of all grams that are least in some window of LEAST bytes."""
    places, hashes, window = [], [], SPAN + 1
    for start in range(0, len(data), BLOCK):
        low = max(0, start - LEAST)
        h = rolling(data[low : start + BLOCK + LEAST], GRAM)
        if len(h) < window:
            continue
        m = _slide(h, window, np.minimum)
        edge = np.zeros(window - 1, U64)
        most = _slide(np.concatenate((edge, m, edge)), window, np.maximum)[: len(h)]
        at = np.flatnonzero(h == most)
        at = at[(at + low >= start) & (at + low < start + BLOCK)]
        places.append(at + low)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(hashes).view(np.int64)


def _bytes_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow string column."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ka, kb, text) -> (ka, kb, p, h, c, onward): the anchors of texts of LEAST bytes or more.

    c is a hash of the surroundings, from min(p, SPAN) bytes before to ``onward`` bytes from the anchor.
    """
    names = ["ka", "kb", "p", "h", "c", "onward"]
    for batch in batches:
        ka, kb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        at, data = _bytes_column(batch.column(2))
        if len(at) < 2 or at[-1] - at[0] < LEAST:
            continue
        place, h = anchors(data[at[0] : at[-1]])
        place = place + at[0]
        doc = np.searchsorted(at, place, side="right") - 1
        fits = (place + GRAM <= at[doc + 1]) & (at[doc + 1] - at[doc] >= LEAST)
        place, h, doc = place[fits], h[fits], doc[fits]
        start, end = np.maximum(at[doc], place - SPAN), np.minimum(at[doc + 1], place + LEAST)
        view = memoryview(data)
        for i in range(0, len(place), 100_000):
            s = slice(i, i + 100_000)
            c = [_digest(view[a:b], p - a) for a, b, p in zip(start[s].tolist(), end[s].tolist(), place[s].tolist())]
            columns = [ka[doc[s]], kb[doc[s]], (place[s] - at[doc[s]]).astype(np.int32), h[s], np.array(c, np.int64), (end[s] - place[s]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _digest(surroundings: bytes | memoryview, left: int) -> int:
    return xxhash.xxh64_intdigest(surroundings, left) - (1 << 63)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, marks of p, h, c, n, parts) -> (h, part, parts, c, n, left, context), one row a mark."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        at, data = _bytes_column(batch.column(0))
        view = memoryview(data)
        rows: list[tuple] = []
        for i in range(batch.num_rows):
            lo, hi = int(at[i]), int(at[i + 1])
            for m in batch.column(1)[i].as_py():
                start, end = max(lo, lo + m["p"] - SPAN), min(hi, lo + m["p"] + LEAST)
                rows.append((m["h"], m["c"] % m["parts"], m["parts"], m["c"], m["n"], lo + m["p"] - start, bytes(view[start:end])))
            if len(rows) >= 20_000:
                yield _batch(rows, kinds, CONTEXT)
                rows = []
        if rows:
            yield _batch(rows, kinds, CONTEXT)


CONTEXTS = "h long, part int, parts int, c long, n long, left int, context binary"
CONTEXT = [c.split()[0] for c in CONTEXTS.split(", ")]


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(prefixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix lengths of neighbours in a sorted list -> (length, first, last) of each interval, by stack."""
    stack: list[tuple[int, int]] = [(-1, 0)]
    for i, length in enumerate([*prefixes, 0]):
        first = i
        while stack[-1][0] > length:
            deep, first = stack.pop()
            yield deep, first, i
        if stack[-1][0] < length and i < len(prefixes):
            stack.append((length, first))
    while len(stack) > 1:
        deep, first = stack.pop()
        yield deep, first, len(prefixes)


def groups(contexts: list[tuple[int, bytes, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(left, context, copies) of one gram's different surroundings -> maximal repeats (before, onward, members).

    A repeat of LEAST bytes or more: its members share ``before`` bytes up to the anchor and
    ``onward`` bytes from it on. An interval of the sorted right sides shares its length to the
    right; the intervals of its members' left sides, read backwards, end where these differ.
    Copies of one surrounding share all of it.
    """
    rights = [c[left:] for left, c, _ in contexts]
    lefts = [c[:left][::-1] for left, c, _ in contexts]
    for i, (left, c, n) in enumerate(contexts):
        if n > 1 and len(c) >= LEAST:
            yield left, len(c) - left, [i]
    order = sorted(range(len(contexts)), key=rights.__getitem__)
    prefixes = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    rank = {i: r for r, i in enumerate(sorted(order, key=lefts.__getitem__))}
    for onward, first, last in intervals(prefixes):
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        shared = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for before, low, high in intervals(shared):
            if before + onward >= LEAST:
                yield before, onward, members[low : high + 1]


def repeats(contexts: list[tuple[int, bytes, int]]) -> list[tuple[int, int]]:
    """The most bytes (before, from) the anchor that each member has in some group; (0, 0): in none."""
    found = [(0, 0)] * len(contexts)
    for before, onward, members in groups(contexts):
        for i in members:
            found[i] = (max(found[i][0], before), max(found[i][1], onward))
    return found


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CONTEXTS`` sorted by bucket -> (h, c, before, onward) of occurrences in repeats."""
    kinds, names = [pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["h", "c", "before", "onward"]
    out: list[tuple] = []
    for h, members in _by_bucket(batches):
        for r, (before, onward) in zip(members, repeats([(m[5], m[6], m[4]) for m in members])):
            if onward:
                out.append((h, r[3], before, onward))
        if len(out) > 20_000:
            yield _batch(out, kinds, names)
            out = []
    if out:
        yield _batch(out, kinds, names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CONTEXTS`` sorted by bucket -> (h, c, string_id, before, onward), a row a member of a maximal repeat.

    A repeat is given as far as its bucket's gram is least in it: that far every occurrence has
    the gram as an anchor, so none is missing; beyond, it is given under its other anchors.
    """
    kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["h", "c", "string_id", "before", "onward"]
    for h, members in _by_bucket(batches):
        out = set()
        for before, onward, some in groups([(m[5], m[6], m[4]) for m in members]):
            left, context = members[some[0]][5:7]
            grams = rolling(np.frombuffer(context, np.uint8), GRAM)
            less = np.flatnonzero(grams < grams[left])
            low = max([left - before, *(less[less < left] + 1)])
            high = min([left + onward, *(less[less > left] + GRAM - 1)])
            if high - low >= LEAST:
                string_id = _digest(context[low:high], left - low)
                out |= {(h, members[i][3], string_id, int(left - low), int(high - left)) for i in some}
        if out:
            yield _batch(list(out), kinds, names)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(len(CONTEXT))))

    for (h, _), group in groupby(rows(), key=lambda r: (r[0], r[1])):
        yield h, list(group)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CONTEXTS`` -> (h, c, before, w): a hash of every LEAST-byte window around the anchor whose own
    least gram is there, so that a window is looked for under one gram only; w depends on ``before``
    too, as a window with two equal grams is one occurrence, not two."""
    names = ["h", "c", "before", "w"]
    for batch in batches:
        some = [(h, c, left, x) for h, _, _, c, _, left, x in zip(*(batch.column(i).to_pylist() for i in range(len(CONTEXT)))) if len(x) >= LEAST]
        for k in range(0, len(some), 128):  # contexts one after the other, in one array
            hs, cs, lefts, texts = zip(*some[k : k + 128])
            data = np.frombuffer(b"".join(texts), np.uint8)
            sizes = np.array([len(x) for x in texts])
            starts = np.cumsum(sizes) - sizes
            grams, windows = rolling(data, GRAM), sizes - LEAST + 1
            of = np.repeat(np.arange(len(sizes)), windows)
            at = starts[of] + np.arange(len(of)) - (np.cumsum(windows) - windows)[of]
            anchor = (starts + np.array(lefts))[of]
            before = anchor - at
            own = (before >= 0) & (before <= SPAN) & (_slide(grams, SPAN + 1, np.minimum)[at] == grams[anchor])
            of, at, before = of[own], at[own], before[own]
            w = rolling(data, LEAST)[at] ^ (before.astype(U64) * U64(BASE))
            columns = [np.array(hs, np.int64)[of], np.array(cs, np.int64)[of], before.astype(np.int32), w.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)


def _between_parts(split: DataFrame) -> DataFrame:
    """(h, c, before, onward) of windows that occur with several surroundings of a bucket in parts."""
    windows = written(split.mapInArrow(_windows, "h long, c long, before int, w long"), "windows")
    again = windows.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "w")
    met = windows.join(written(again, "shared_windows"), ["h", "w"])
    return met.groupBy("h", "c").agg(F.max("before").alias("before"), (LEAST - F.min("before")).alias("onward"))


def found_anchors(docs: DataFrame) -> DataFrame:
    """(ka, kb, text) -> the anchors of all texts, as a written table."""
    return written(docs.select("ka", "kb", "text").mapInArrow(_find, "ka long, kb long, p int, h long, c long, onward int"), "anchors")


def contexts(docs: DataFrame, found: DataFrame, differ: DataFrame, most: int) -> DataFrame:
    """``CONTEXTS``: the bytes around the anchors of grams that ``differ`` (a table of h), one row a different surrounding.

    Texts that are alike give theirs once, before they are shuffled.
    """
    # one key of both, so that the sum is dealt out anew and a hot gram's side of the join can be split
    marked = found.join(differ, "h").groupBy(F.struct("h", "c").alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ka", "kb", "p")).alias("m"))
    marked = written(marked.select("of.h", "of.c", "n", "m.ka", "m.kb", "m.p"), "surroundings")
    hot = marked.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > most)
    hot = written(hot.select("h", F.ceil(F.col("m") / most).cast("int").alias("parts")), "hot")
    marks = marked.join(hot, "h", "left").groupBy("ka", "kb").agg(
        F.collect_list(F.struct("p", "h", "c", "n", F.coalesce("parts", F.lit(1)).alias("parts"))).alias("marks")
    )
    texts = docs.groupBy("ka", "kb").agg(F.first("text").alias("text"))
    out = texts.join(marks, ["ka", "kb"]).select("text", "marks").mapInArrow(_cut, CONTEXTS)
    out = written(out, "contexts", compression="zstd")
    discard(marked)
    return out


def _sorted(bucketed: DataFrame) -> DataFrame:
    return bucketed.repartition("h", "part").sortWithinPartitions("h", "part")


def _grams(found: DataFrame) -> DataFrame:
    """(h, n, c, alike, before, onward) of the grams that occur again; alike: all in one surrounding."""
    again = found.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), (F.min("c") == F.max("c")).alias("alike"),
        F.min(F.least(F.col("p"), F.lit(SPAN))).alias("before"), F.min("onward").alias("onward"),
    )
    return written(again.filter("n > 1"), "again")


def removals(docs: DataFrame, most: int = 512) -> DataFrame:
    """(ka, kb, text) -> ka, kb, spans (array of s, e): the covered stretches of the texts that lose some; one row a text.

    ``most`` is the number of different surroundings of one gram that a part of its bucket has.
    """
    found = found_anchors(docs)
    again = _grams(found)
    bucketed = contexts(docs, found, again.filter(~F.col("alike")).select("h"), most)
    answers = _sorted(bucketed).mapInArrow(_buckets, "h long, c long, before int, onward int")
    answers = answers.union(_between_parts(bucketed.filter("parts > 1")))
    answers = answers.union(again.filter(F.col("alike") & (F.col("before") + F.col("onward") >= LEAST)).select("h", "c", "before", "onward"))
    answers = answers.groupBy("h", "c").agg(F.max("before").alias("before"), F.max("onward").alias("onward"))
    answers = written(answers, "repeats")
    discard(bucketed)
    spans = found.drop("onward").join(answers, ["h", "c"]).select("ka", "kb", F.struct((F.col("p") - F.col("before")).alias("s"), (F.col("p") + F.col("onward")).alias("e")).alias("x"))
    spans = written(spans.groupBy("ka", "kb").agg(F.collect_set("x").alias("spans")), "spans")
    for used in (found, again, answers):
        discard(used)
    return spans


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), ka, kb: two independent 64-bit hashes of the text."""
    t = whole("text")
    return docs.select("doc_id", t.alias("text"), F.xxhash64(t).alias("ka"), F.xxhash64(F.lit("other"), t).alias("kb"))


def _remove(with_text: bool) -> Callable:
    """(doc_id, text, spans) -> doc_id, n_bytes, n_removed, n_spans, the digest of the rest and the rest."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 3, pa.string(), pa.binary()]
        for batch in batches:
            at, data = _bytes_column(batch.column(1))
            view, rows = memoryview(data), []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                text, merged = view[int(at[i]) : int(at[i + 1])], []
                for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                edges = [0, *(x for m in merged for x in m), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if rows:
                columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return remove


def dedup_strings(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans (long), kept_sha256, kept (the bytes left, null unless ``with_text``).

    Null text is empty. Texts under LEAST bytes lose nothing. Rows alike in text are as many
    occurrences and lose everything they share, which is all. Empty tables give empty results;
    columns other than doc_id and text are not looked at.
    """
    keyed = _keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    both = keyed.join(removals(keyed.select("ka", "kb", "text")), ["ka", "kb"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def maximal_repeats(docs: DataFrame, most: int = 512) -> DataFrame:
    """documents -> string_id, length, doc_id, start: the groups of repeats with all their occurrences.

    A row is one occurrence of a maximal repeat around its least gram; a long repeat is given in
    overlapping stretches around several. Of a bucket in parts the groups are the LEAST-byte
    windows that its texts share.
    """
    keyed = _keyed(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    texts = keyed.select("ka", "kb", "text")
    found = found_anchors(texts)
    again = _grams(found)
    bucketed = contexts(texts, found, again.select("h"), most)
    whole_buckets = _sorted(bucketed.filter("parts = 1")).mapInArrow(_groups, "h long, c long, string_id long, before int, onward int")
    windows = bucketed.filter("parts > 1").mapInArrow(_windows, "h long, c long, before int, w long")
    shared = windows.groupBy(F.col("h").alias("sh"), F.col("w").alias("sw")).agg(F.count(F.lit(1)).alias("n"))
    split = windows.join(shared, (F.col("h") == F.col("sh")) & (F.col("w") == F.col("sw")))
    copies = found.groupBy(F.col("h").alias("ch"), F.col("c").alias("cc")).agg(F.count(F.lit(1)).alias("copies"))
    split = split.join(copies, (F.col("h") == F.col("ch")) & (F.col("c") == F.col("cc"))).filter("n > 1 or copies > 1")
    split = split.select("h", "c", F.col("w").alias("string_id"), "before", (LEAST - F.col("before")).alias("onward"))
    members = written(whole_buckets.union(split), "members")
    at = found.select("ka", "kb", "p", "h", "c").join(members, ["h", "c"])
    rows = at.join(keyed.select("doc_id", "ka", "kb"), ["ka", "kb"])
    return rows.select("string_id", (F.col("before") + F.col("onward")).alias("length"), "doc_id", (F.col("p") - F.col("before")).alias("start")).distinct()
