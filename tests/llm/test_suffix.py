import hashlib
import random
from collections import Counter

import pytest
from payguard.llm import suffix


def brute(texts):
    """By position: is the 200-byte string that starts here also one that starts elsewhere?"""
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_intervals():
    got = sorted(suffix.intervals([3, 5, 5, 1, 4]))
    assert got == sorted([(5, 1, 3), (3, 0, 3), (4, 4, 5), (1, 0, 5)])


@pytest.mark.parametrize("most", [512, 3])
def test_equals_brute_force(spark, sf, most, monkeypatch):
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, other = word(260), word(199)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(5000 + i, word(rnd.randint(0, 300)) + passage[rnd.randint(0, 9) : 260 - rnd.randint(0, 9)] + word(rnd.randint(0, 300))) for i in range(25)]
    rows += [(6000 + i, word(150) + other + word(20)) for i in range(4)]
    rows += [(7000, None), (7001, ""), (7002, "z" * 900), (7003, "xy" * 350), (7004, passage), (7005, passage), (7006, word(500)), (7006, "same " * 60), (None, "nul " * 90)]
    rows += [(8000, "exactly alike " * 30)] * 2
    kept = suffix.removals
    monkeypatch.setattr(suffix, "removals", lambda d: kept(d, most))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r)[:5] for r in suffix.dedup_strings(docs).collect()), key=str)
    want = [(i, *b) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows]))]
    assert got == sorted(want, key=str)


def test_empty(spark):
    assert suffix.dedup_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("most", [512, 3])
def test_groups_hold_all_occurrences(spark, most):
    rnd = random.Random(3)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = word(240)
    rows = [(i, word(rnd.randint(0, 90)) + passage + word(rnd.randint(0, 90))) for i in range(9)]
    rows += [(20 + i, word(50) + passage[: 215 + i] + word(60)) for i in range(3)] + [(30, word(400)), (31, None), (32, "twice alike " * 20), (33, "twice alike " * 20)]
    texts = dict(rows)
    found = suffix.maximal_repeats(spark.createDataFrame(rows, "doc_id long, text string"), most).collect()
    groups, covered = {}, {i: bytearray(len(t or "")) for i, t in rows}
    for r in found:
        groups.setdefault((r.string_id, r.length), []).append((r.doc_id, r.start))
        covered[r.doc_id][r.start : r.start + r.length] = b"\1" * r.length
    for (_, length), places in groups.items():
        strings = {texts[i][s : s + length] for i, s in places}
        assert length >= 200 and len(strings) == 1
        string = strings.pop()  # every occurrence in the corpus, not just neighbours
        every = [(i, s) for i, t in rows if t for s in range(len(t) - length + 1) if t.startswith(string, s)]
        assert len(every) > 1 and sorted(places) == sorted(every)
    want = {i: b[1] for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows]))}
    assert {i: sum(c) for i, c in covered.items()} == want
