import random

import xxhash
from payguard.llm import simhash


def slow(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """Classes of (doc_id, fingerprint) by all pairs."""
    of = {d: d for d, _ in prints}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, (a, x) in enumerate(prints):
        for b, y in prints[:i]:
            if (x ^ y).bit_count() <= 2:
                p, q = sorted((root(a), root(b)))
                of[q] = p
    return {d: root(d) for d, _ in prints}


def test_links_reach_every_pair_within_two_bits(spark):
    rnd = random.Random(1)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    prints = set(seeds)
    for s in seeds:
        for _ in range(6):
            x = s
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "f long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(df).collect()}
    want = {tuple(sorted((signed(x), signed(y)))) for i, x in enumerate(prints) for y in prints[:i] if (x ^ y).bit_count() <= 2}
    assert got == want


def test_classes_equal_brute_force(spark, sf):
    odd = [(-1, None), (-2, ""), (-3, " \t"), (-4, "one"), (-5, "ONE"), (-6, "É é"), (-7, "x y z w " * 400)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = docs.collect()
    prints = [(r.doc_id, slow(r.text)) for r in rows]
    want = brute(sorted(prints))
    got = {r.doc_id: (r.f % (1 << 64), r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {d: (f, want[d]) for d, f in prints}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, f long, k string, s int")
    assert simhash.classes(empty).count() == 0 and simhash.one_of_each(empty).collect() == []
    rows = [(None, "alone and null", 1, "a", 2), (None, "alone and null", 1, "a", 2), (5, "a b c", 1, "a", 2), (5, "a b c", 1, "a", 2), (3, "A B c", 2, "b", 3), (7, "", 0, None, None), (6, None, 0, None, None)]
    docs = spark.createDataFrame(rows, empty.schema)  # extra columns have the names that are used inside
    got = sorted(((r.doc_id, r.component_id) for r in simhash.classes(docs).collect()), key=str)
    assert got == sorted([(None, None), (None, None), (5, 3), (5, 3), (3, 3), (7, 6), (6, 6)], key=str)
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[4], rows[6]], key=str)
