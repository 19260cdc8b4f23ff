import hashlib
import random

from payguard.llm import fingerprint
from payguard.llm.queries import op6_document_fingerprints
from pyspark.sql import functions as F


def shingles(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def test_next_edit_and_likeness(spark, sf):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows.sort(key=lambda r: -r[0])
    got = {r.doc_id: r for r in op6_document_fingerprints(spark, sf).collect()}
    assert len(got) == len(rows)
    errors = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text), shingles(edited)
        true = len(a & b) / max(1, len(a | b)) if a | b else 1.0
        if len(a | b) > 400:
            errors.append(abs(r.near_edited - true))
        if text == edited:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.2


def test_blocks_ties_nulls_and_empty(spark):
    rows = [(i * 10**9, f"t{i} " * 9) for i in range(-40, 40)] + [(0, "again"), (0, "again"), (None, "n"), (5, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r.next_text for r in fingerprint.with_next(docs, per_block=4).collect()}
    full = [(r.doc_id, r.text) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).orderBy(F.desc_nulls_last("doc_id"), F.desc("t")).collect()]
    seen = {}
    for a, b in zip(full, full[1:] + full[:1]):
        seen.setdefault(a, set()).add(b[1])
    assert fingerprint.with_next(docs, per_block=4).count() == len(rows)
    assert all(got[k] in v for k, v in seen.items())
    assert fingerprint.compare(docs.limit(0)).count() == 0
    one = fingerprint.compare(docs.limit(1)).first()
    assert one.near_next == 1.0


def test_uneven_ids_fall_in_even_blocks(spark):
    """One id far off, many rows of one id, many without: the next document is right, and blocks stay small."""
    rnd = random.Random(8)
    ids = [*range(900), 10**15, *[77] * 300, *[None] * 200, *[10**12 + 3 * i for i in range(300)]]
    rows = [(i, f"text {n} " + " ".join(rnd.choice("abcdef") for _ in range(9)), "x", 1) for n, i in enumerate(ids)] + [(5, "wholly alike", "x", 1)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, tie int").repartition(3)
    keyed = docs.select("doc_id", "text", F.col("doc_id").isNotNull().alias("known"), F.xxhash64("text").alias("tie"))
    sizes = fingerprint._blocked(keyed, 20).groupBy("block").count().collect()
    assert max(r["count"] for r in sizes) <= 80 and sum(r["count"] for r in sizes) == len(rows)
    ties = {r.text: r.tie for r in keyed.collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]), reverse=True)
    want = sorted(((i, t), order[(n + 1) % len(order)][1]) for n, (i, t, *_) in enumerate(order) if i is not None)
    got = fingerprint.with_next(docs, 20).collect()
    assert len(got) == len(rows)
    assert sorted(((r.doc_id, r.text), r.next_text) for r in got if r.doc_id is not None) == want
    assert sorted(r.next_text for r in got) == sorted(r[1] for r in rows)
