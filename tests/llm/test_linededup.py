from payguard.llm import linededup


def brute(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc_id] = (None if text is None else left, 0 if text is None else len(lines), len(gone))
    return out


def test_equals_brute_force(spark, sf):
    odd = [(1000, None), (1001, ""), (1002, "a\nb\nc\na\nb\nc"), (1003, "x\na\nb\nc"), (1004, "\n\n\n\n"), (1005, "a\nb"), (1006, "q\n\n\n")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = brute([tuple(r) for r in docs.collect()])
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.dedup_lines(docs).collect()} == want


def test_columns_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc", 5, "z"), (1, "a\nb\nc", 5, "z"), (None, "a\nb\nc\nd", 7, "z")], "doc_id long, text string, n_chars long, gone string")
    got = linededup.deduped_documents(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "", 0, "z"), (1, "", 0, "z"), (None, "a\nb\nc\nd", 7, "z")]
    assert linededup.deduped_documents(docs.limit(0)).count() == 0
