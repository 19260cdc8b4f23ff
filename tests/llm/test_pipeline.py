import random
from collections import Counter

import corpus_pipeline
from payguard.llm import quality
from payguard.llm.common import table, written

from .test_linededup import brute as brute_lines
from .test_jaccard import brute as brute_near_copies
from .test_quality import brute as brute_statistics


def test_stages_follow_each_other(spark, sf):
    at = table(spark, sf, "documents")
    columns, rows = at.columns, [at.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = written(stage(spark, at, sf), name)
        assert at.columns == columns, name
        rows.append(at.collect())
    start, good, lines, single, mixed = rows
    verdicts = {d.doc_id: d.kept for d in quality.judge(table(spark, sf, "documents")).collect()}
    for d in start:
        n, _, _, _, again = brute_statistics(d.text)
        assert any(g.doc_id == d.doc_id for g in good) == verdicts[d.doc_id] and (not verdicts[d.doc_id] or (n >= 50 and 2 * again <= n))
    want = brute_lines([(d.doc_id, d.text) for d in good])
    assert {d.doc_id: d.text for d in lines} == {k: v[0] for k, v in want.items()}
    assert sorted(d.doc_id for d in single) == brute_near_copies([(d.doc_id, d.text) for d in lines])
    taken = Counter(d.doc_id for d in mixed)
    assert set(taken) <= {d.doc_id for d in single} and max(taken.values()) <= 2
    words = {d.doc_id: brute_statistics(d.text)[0] for d in single}
    got, whole = sum(words[k] * n for k, n in taken.items()), sum(words.values())
    assert abs(got - 1.5 * whole) <= 20 * max(words.values()) / 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, sf).collect()
    assert Counter(p.doc_id for p in pieces if p.piece == 0) == taken
    assert quality.judge(table(spark, sf, "documents").limit(3)).count() == 3


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k long, u long, n long, root long, id long, row long, size long, piece long"


def test_run_on_odd_rows_and_clashing_columns(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda n: "\n".join(" ".join(f"w{rnd.randrange(4000)}" for _ in range(12)) for _ in range(n))
    good = [(i, text(10 + i % 7), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])) for i in range(60)]
    odd = [(100, None, "en", "a"), (101, "", None, None), (None, None, None, None), (102, "a b", "en", "a"), (None, text(12), "en", "a"), good[0], good[0], (103, good[1][1], "de", "b"), (104, text(1500), "en", "a")]
    rows = [(*r, len(r[1] or ""), *[7] * 8) for r in good + odd]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(p.doc_id for p in got if p.piece == 0)
    assert set(ids) <= {*range(60), None, 103, 104} and not set(ids) & {100, 101, 102}
    # line dedup empties 103, whose lines all repeat those of 1: what is left is the end token
    assert all(p.length == 1 for p in got if p.doc_id == 103) and max(ids.values()) <= 2
    full = {}
    for p in got:
        full.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in full.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
