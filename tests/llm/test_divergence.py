import random
import re
from collections import Counter, defaultdict

import pytest

from payguard.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, p string, n string"


def brute(rows):
    """The contract term by term, without a tree."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 10]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        own = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-f(own[s][t], whole[t]), t.encode(), t) for t in kept if counts[lang, s][t] > 0 and own[s][t] > whole[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out |= {(lang, s, part, item, -value, i + 1) for i, (value, _, item) in enumerate(ranked)}
    return out


def audited(spark, rows):
    df = spark.createDataFrame([(i, *r, "x", "y", "z") for i, r in enumerate(rows)], DOCS)
    got = [(r.lang, r.source, r.part, r["item"], r.value, r.rank) for r in divergence.audit(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some_rows():
    r = random.Random(3)
    words = ["Aa", "aA", "b1c", "é", "É", "dd-ee", "ß", "中文", "x\x85y", "q", "\U0001f600", "ff", "gg", "hh"]
    rows = []
    for lang, source, n in (("en", "s1", 60), ("en", "s2", 25), ("en", None, 20), ("en", "S", 20), ("en", "é", 12), ("de", "s1", 15), (None, "s1", 11), ("fr", "only", 9), ("xx", "empty", 3)):
        for _ in range(n):
            rows.append((" ".join(r.choice(words) for _ in range(r.randrange(0, 12))), lang, source))
    return rows + [(None, "en", "none"), ("", "en", "none"), ("Aa " * 400_000, "en", "s2"), ("!!! 12", "zz", "a"), ("same", "zz", "b")] + [("same same", "en", "s1")] * 10


def test_as_term_by_term(spark):
    rows = some_rows()
    got = audited(spark, rows)
    assert got == brute(rows)
    assert {x[5] for x in got if x[0] == "zz"} == {1} and {x[4] for x in got if x[0] == "zz"} == {0}


def test_empty_table(spark):
    assert audited(spark, []) == set()


@pytest.mark.parametrize("most", [1, 10**6])
def test_tree_sums_shared_paths_once(most):
    r = random.Random(5)
    rows = Counter()
    for _ in range(300):
        rows[tuple((s, r.choice((1, 2))) for s in "abcd" if r.random() < 0.7)] += r.randrange(1, 4)
    p, p0 = (lambda s, n: 1000 * ord(s) + 777 * n), (lambda s: 500 + ord(s))
    tree = divergence.Tree("en", most)
    for path in sorted(rows):
        tree.insert([(s, n, p(s, n), p0(s)) for s, n in path], rows[path])
    got = {(x.a, x.b): x.value for x in tree.told().itertuples()}
    f = lambda x, y: (x - y) ** 2 // (x + y)
    want = Counter()
    for path, m in rows.items():
        for i, (a, x) in enumerate(path):
            for b, y in path[i + 1 :]:
                want[a, b] += m * (f(p(a, x), p(b, y)) - f(p(a, x), p0(b)) - f(p0(a), p(b, y)) + f(p0(a), p0(b)))
    assert got == dict(want)


def test_terms_in_pieces():
    text = ("Ab é1" * 50 + " x" * 3000).encode()
    assert sum(divergence.terms(text, 64), []) == sum(divergence.terms(text), [])
