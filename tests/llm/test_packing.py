import random
import zlib

import numpy as np
from payguard.llm import packing
from tokenizers import Tokenizer


def test_round_trip_and_fill(spark, sf):
    odd = [(10**15 + 1, None), (None, ""), (-3, "a  b \n c\n\n d\t e <|endoftext|> it's"), (-4, " lead and trail "), (-5, "x y z 　q\x1c r \x85"), (-6, "é  ü  ")]
    odd += [(-20, "<|endoftext|>"), (-21, "<|endoftext|> at the start"), (-22, "at the end  <|endoftext|>"), (-23, "twice <|endoftext|><|endoftext|>\n\n<|endoftext|> more"), (-24, "<|endoftext| <|endoftext|>|> <|ENDOFTEXT|>"), (-25, "<|endoftext|>" * 1500)]
    odd += [(-7 - i, "w " * n) for i, n in enumerate((1023, 1024, 2047, 3000))]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).repartition(6)
    model = Tokenizer.from_file(packing.tokenizer_path())
    want = {}
    for r in docs.collect():
        ids = model.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id] = ids
    got = packing.pack(docs).collect()
    sequences, by_doc = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for doc_id, rows in by_doc.items():
        at, ids = 0, np.array(want[doc_id], "<u4")
        for i, r in enumerate(sorted(rows, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (i, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            assert r.length == 1024 or i == 0
            at += r.length
        assert at == len(ids) and (len(ids) > 1024 or len(rows) == 1)
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.05 * -(-total // 1024) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_best_fit():
    rnd = random.Random(5)
    sizes = [rnd.randint(1, 1024) for _ in range(3000)]
    bins, offsets, fills = packing.best_fit(sizes)
    assert max(fills) <= 1024 and sum(fills) == sum(sizes)
    assert sum(f <= 512 for f in fills) <= 1
    assert len(fills) <= 1.02 * sum(sizes) / 1024 + 1


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "same text", "x", 3)] * 40 + [(None, "same text", "x", 3)] * 2 + [(2, "word " * 5000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string, part long").repartition(3)
    got = packing.pack(docs).collect()
    assert sum(r.doc_id == 1 for r in got) == 40 and sum(r.doc_id is None for r in got) == 2
    places = [(r.sequence_id, at) for r in got for at in range(r.offset, r.offset + r.length)]
    assert len(set(places)) == len(places) == 42 * 3 + 5002


def test_handing_on_few_bins_loses_none(spark):
    """Bins of hundreds of partitions, each packed by best fit: 64 a group join as many as all would."""
    rnd = random.Random(11)
    bins = []
    for part in range(300):
        large = rnd.random() < 0.5
        _, _, fills = packing.best_fit([rnd.randint(520, 1000) if large else rnd.randint(1, 1024) for _ in range(rnd.randint(1, 200))])
        bins += [(part, (part << packing.BIN_BITS) + b, f) for b, f in enumerate(fills)]
    fills = {b: f for _, b, f in bins}
    df = spark.createDataFrame(bins, "part long, bin long, fill long")
    moved = packing.merges(df).collect()
    sequences = {b: [(0, f)] for b, f in fills.items()}
    for r in moved:
        sequences[r.sequence].append((r.shift, fills[r.bin]))
        del sequences[r.bin]
    for s in sequences.values():
        at = 0
        for shift, fill in sorted(s):
            assert shift == at
            at += fill
        assert at <= 1024
    assert len(moved) >= packing.merges(df, hand_on=10**9, nearly=1.0).count() - 3 > 50
