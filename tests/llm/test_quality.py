import collections
import math
import random
import re

import numpy as np
from payguard.llm import quality
from payguard.llm.common import written
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WORD, text)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_statistics_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(None, None, None, None), (-1, "", "en", "s"), (-2, "a b c a b c a b c", None, "s"), (-3, " \n\n x \n x \r\n", "en", None), (-3, "é|é é", "en", "s")]
    rows = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    want = sorted(((d.doc_id, *brute(d.text)) for d in rows.collect()), key=str)
    out = quality.judge(rows).collect()
    assert sorted(((d.doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words) for d in out), key=str) == want
    for d in out:
        assert d.base_failed == (d.n_words < 50 or 100 * d.n_repeat_words > 50 * d.n_words)
        assert not (d.base_failed and d.kept)


def test_symbol_junk_goes_and_plain_text_stays(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60 + i % 50)), "en", "s", 1) for i in range(200)]
    junk = [(1000 + i, " ".join(f"w{i}{k}&&&" for k in range(80)), "en", "s", 1) for i in range(5)]
    docs = spark.createDataFrame(plain + junk, "doc_id long, text string, lang string, source string, row int")
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    assert sorted(r.doc_id for r in quality.judge(docs).filter("kept").collect()) == list(range(200))


def test_junk_in_small_groups_goes_by_wider_estimates(spark):
    plain = lambda i: " ".join(f"word{(i * 7 + k * k) % 997}" for k in range(60 + i % 50))
    junk = lambda i: " ".join(f"w{i}{k}&&&" for k in range(80))
    rows = [(i, plain(i), "en", "s") for i in range(200)]
    small = [("en", "rare"), ("en", None), ("xx", "s"), (None, "s"), (None, None)]
    for n, (lang, source) in enumerate(small):
        rows += [(1000 + 10 * n + i, plain(i), lang, source) for i in range(3)] + [(2000 + n, junk(n), lang, source)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = quality.judge(docs).collect()
    assert all(d.outlyingness is not None for d in out)
    good = sorted(d for d, *_ in rows if d < 2000)
    assert sorted(d.doc_id for d in out if d.kept) == good
    assert sorted(d.doc_id for d in quality.kept_documents(docs).collect()) == good


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judge(docs).count() == 0 and quality.kept_documents(docs).count() == 0


def robust(x, hashes, part=0.75):
    """One group's estimate and squared distances, with numpy: three starts, the least determinant goes on."""
    floors = list(quality.FLOORS.values())
    quantile = lambda a, p: np.sort(a)[max(0, math.ceil(p * len(a)) - 1)]

    def factor(mean, cov):
        low = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                rest = cov[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = math.sqrt(max(rest, floors[i] ** 2)) if i == j else rest / low[j, j]
        return mean, low

    d2 = lambda e: (np.linalg.solve(e[1], (x - e[0]).T) ** 2).sum(0)
    moments = lambda rows: factor(rows.mean(0), np.cov(rows.T, bias=True))
    step = lambda e: moments(x[d2(e) <= quantile(d2(e), part)])
    mid = np.array([quantile(x[:, i], 0.5) for i in range(4)])
    mad = [max(1.4826 * quantile(abs(x[:, i] - mid[i]), 0.5), floors[i]) for i in range(4)]
    starts = [(mid, np.diag(mad))] + [moments(x[hashes == s]) for s in (1, 2) if (hashes == s).any()]
    tried = [step(step(e)) for e in starts]
    e = min(tried, key=lambda e: np.prod(np.diag(e[1]) ** 2))
    for _ in range(3):
        e = step(e)
    return d2(e) / max(1.0, quantile(d2(e), 0.5) / quality.CHI_MEDIAN)


def test_robust_distances_equal_brute_force(spark):
    """Groups of 40 rows and more by their own estimate, smaller ones by their language's; ties and repeated rows among them."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9)))
    rows = []
    for lang, source, n in (("en", "a", 150), ("en", "b", 40), ("en", "c", 39), ("fr", "a", 60), ("fr", None, 5), (None, "a", 3)):
        for k in range(n):
            words = [word() for _ in range(60 + rnd.randint(0, 200))]
            if k % 5 == 0:
                words = [w + "&%" * rnd.randint(0, 3) for w in words]
            if k % 7 == 0:
                words += words[:30]
            if k % 11 == 0:
                words = ["same"] + [f"text{i}" for i in range(70)]
            rows.append((len(rows), " ".join(words), lang, source))
    rows += [(1000, "x " * 3, "en", "a"), (1001, "long " + " ".join(f"w{i}" for i in range(200_000)), "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    vectors = written(quality.with_vector(quality.statistics(frame=docs)), "vectors").filter(~quality.base_failed())
    vectors = vectors.select("doc_id", "lang", "source", *quality.X, (1 + F.pmod(F.xxhash64(*quality.X), F.lit(2))).alias("s")).collect()
    sizes = collections.Counter((r.lang, r.source) for r in vectors)
    langs = collections.Counter(r.lang for r in vectors)
    level = lambda r: (0, r.lang, r.source) if sizes[r.lang, r.source] >= 40 else (1, r.lang) if langs[r.lang] >= 40 else (2,)
    member = lambda r, g: g in ((0, r.lang, r.source), (1, r.lang), (2,))
    want = {}
    for g in {level(r) for r in vectors}:
        some = [r for r in vectors if member(r, g)]
        d = robust(np.array([[r[x] for x in quality.X] for r in some]), np.array([r.s for r in some]))
        want |= {r.doc_id: x for r, x in zip(some, d) if level(r) == g}
    out = {r.doc_id: r for r in quality.judge(docs).collect()}
    cut = quality.chi_square_cut(quality.TAIL)
    assert {level(r)[0] for r in vectors} == {0, 1, 2} and len(out) == len(rows)
    for i, x in want.items():
        assert abs(out[i].outlyingness - x) <= 1e-6 * max(1, x), i
        assert out[i].kept == (x <= cut)
    assert not out[1000].kept and any(x > cut for x in want.values())


def test_cut():
    assert abs(quality.chi_square_cut(0.025) - 11.1433) < 1e-4 and abs(quality.chi_square_cut(0.5) - quality.CHI_MEDIAN) < 1e-4
