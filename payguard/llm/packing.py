"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Each partition of the documents packs its own pieces by best fit, largest first. Bins that
are nearly full leave; the others, as items of their fill, meet those of neighbouring groups
in a tree of merges, each a best-fit round over whole bins. After any best-fit round at most
one bin of a group is half empty or emptier, and only such a bin can join another. A round
over ``fan`` groups so fills at most ``fan`` hosts; whatever a half-empty bin fits into, it
fits into any of the emptiest bins of the same group. A group that hands on its emptiest bins,
more than a round can fill, hands on every join that all its bins would allow, and no task
grows with the input. The tree's rounds move bins, not pieces: a piece learns its sequence in one join.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import whole, written

LENGTH, END_ID = 1024, 2
PIECES = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long"
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
BIN_BITS = 33


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    stands for itself, the other bytes in turn for the characters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Texts to the tokenizer file's ids, as little-endian 32-bit bytes.

    The file's added tokens are cut out of a text first, leftmost and longest; what is between
    them is run by tiktoken over the file's vocabulary and merge ranks, whose ids are the same
    and which takes a quarter of the time of the library the file is written for. Where no two
    white-space characters meet, the pattern needs no look-ahead.
    """

    #: The pattern of byte-level BPE, and all white space it knows.
    BEGIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|"
    RARE = "\t\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        if any(t[flag] for t in model["added_tokens"] for flag in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("added tokens that take in white space or other forms are not supported")
        self.added = special
        longest_first = sorted(special, key=len, reverse=True)
        self.split = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if special else None
        byte = _bytes_of()
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        make = lambda end: tiktoken.Encoding("file", pat_str=self.BEGIN + end, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.full = make(r"\s"), make(r"\s+(?!\S)|\s+")

    def encode(self, text: str) -> bytes:
        if self.split is None or not self.split.search(text):
            return self._between(text)
        parts = self.split.split(text)
        return b"".join(array("I", [self.added[x]]).tobytes() if i % 2 else self._between(x) for i, x in enumerate(parts))

    def _between(self, text: str) -> bytes:
        meets = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or any(c in text for c in self.RARE)
        ids = (self.full if meets else self.plain).encode_ordinary(text)
        return array("I", ids).tobytes()


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only longer ones are cut, the rest goes first."""
    if n <= length:
        return [(0, n)]
    first = n % length
    return ([(0, first)] if first else []) + [(s, length) for s in range(first, n, length)]


def best_fit(sizes: list[int], length: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    """Items, largest first, into the fullest bin that takes them -> bin and offset of each item, fill of each bin."""
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    room: list[int] = []  # distinct residuals, ascending
    at: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        k = bisect_left(room, size)
        if k < len(room):
            left = room[k]
            b = at[left].pop()
            if not at[left]:
                del at[left]
                room.pop(k)
        else:
            b, left = len(fills), length
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if (rest := left - size) > 0:
            if rest not in at:
                insort(room, rest)
                at[rest] = []
            at[rest].append(b)
    return bins, offsets, fills


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) -> pieces with their partition's best-fit bin and offset (``PIECES``).

    A partition is packed as it is read, so the texts are not shuffled; it holds its pieces'
    lengths, not their ids. Null text is empty and one end token long.
    """
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(path), TaskContext.get().partitionId()
        end = array("I", [END_ID]).tobytes()
        found: list[tuple] = []
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    ids = encoder.encode(text) + end
                    for j, (start, n) in enumerate(cuts(len(ids) // 4, length)):
                        found.append((doc_id, j, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
        if found:
            bins, offsets, _ = best_fit([f[3] for f in found], length)
            for k in range(0, len(found), 50_000):
                some = found[k : k + 50_000]
                columns = [[part] * len(some), *zip(*some), [(part << BIN_BITS) + b for b in bins[k : k + 50_000]], offsets[k : k + 50_000]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], PIECE_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).mapInArrow(pack, PIECES)


def merges(bins: DataFrame, fan: int = 8, hand_on: int = 64, nearly: float = 0.98, length: int = LENGTH) -> DataFrame:
    """(part, bin, fill) -> bin, sequence, shift: for bins that joined another, round by round."""
    spark = bins.sparkSession
    parts = bins.agg(F.max("part")).first()[0]
    moved = spark.createDataFrame([], "bin long, sequence long, shift long")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["fill", "bin"], ascending=[False, True])
        items, offsets, fills = best_fit(frame["fill"].tolist(), length)
        frame["to"], frame["shift"] = items, offsets
        frame["sequence"] = frame.groupby("to")["bin"].transform("first")
        frame["now"] = [fills[b] for b in items]
        return frame[["grp", "bin", "sequence", "shift", "now"]].astype("int64")

    def emptiest(df: DataFrame) -> DataFrame:
        """What a group hands on: its ``hand_on`` emptiest bins that are not nearly full."""
        nth = F.row_number().over(W.partitionBy("part").orderBy("fill", "bin"))
        return df.filter(F.col("fill") < nearly * length).withColumn("nth", nth).filter(F.col("nth") <= hand_on).drop("nth")

    state = written(emptiest(bins), "underfull")
    while parts is not None and parts > 0:
        grouped = state.select(F.floor(F.col("part") / fan).cast("long").alias("grp"), "bin", "fill")
        done = written(grouped.groupBy("grp").applyInPandas(join, "grp long, bin long, sequence long, shift long, now long"), "merged")
        step = done.filter("bin <> sequence").select("bin", "sequence", "shift")
        # what joined before goes along with the bin it is in
        carried = moved.alias("m").join(step.alias("s"), F.col("m.sequence") == F.col("s.bin"), "left").select(
            F.col("m.bin"), F.coalesce("s.sequence", "m.sequence").alias("sequence"), (F.col("m.shift") + F.coalesce("s.shift", F.lit(0))).alias("shift")
        )
        moved = written(carried.union(step), "moved")
        tops = done.filter("bin = sequence").select(F.col("grp").alias("part"), "bin", F.col("now").alias("fill"))
        state = written(emptiest(tops), "underfull")
        parts //= fan
    return moved


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """documents -> doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row a piece.

    Rows that repeat are packed each. An empty table gives no pieces.
    """
    out = written(pieces(docs, path), "pieces")
    moved = merges(out.groupBy("part", "bin").agg(F.sum("length").alias("fill")))
    both = out.join(moved.withColumnRenamed("bin", "from"), F.col("bin") == F.col("from"), "left")
    return both.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
