import random

from payguard.llm import mixing


def test_taken_words_come_near_targets(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(600, None, "c"), (None, "x y", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    total = sum(r.size for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert abs(sum(v[0].target for v in by.values()) - 1.5 * total) < 1e-6
    for v in by.values():
        assert v[0].target <= 2 * v[0].source_size + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)


def test_documents_of_the_mix(spark):
    docs = spark.createDataFrame([(i, "a b c", "s" if i % 3 else "t", 5) for i in range(90)], "doc_id long, text string, source string, mix_n int")
    taken = sum(r.copies for r in mixing.mix(docs).collect())
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.count() == taken
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
