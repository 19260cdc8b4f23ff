import random

import corpus_pipeline
from payguard.llm import jaccard


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(rows):
    """The least doc_id of each class of texts that are alike to 0.8 or more, by all pairs."""
    sets, of = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                p, q = sorted((root(a), root(b)))
                of[q] = p
    return sorted({root(d) for d in of})


def test_stage_joins_planted_copies_of_similarity_0_8_and_no_others(spark):
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(9000)}"
    rows = []
    for _ in range(12):
        base = [word() for _ in range(184)]  # 180 shingles: 4 words apart is 160 / 200, 5 words 155 / 205
        rows.append(base)
        for edits in (1, 4, 4, 5):
            copy = list(base)
            for i in range(edits):
                copy[10 + 30 * i + rnd.randrange(5)] = word()
            rows.append(copy)
        last = base
        for i in range(5):  # a chain: each is near its neighbour only
            last = list(last)
            for j in range(4):
                last[8 + i + 40 * j] = word()
            rows.append(last)
    rows = [(i, " ".join(w), "en", "s") for i, w in enumerate(rows)] + [(900, "a b", "en", "s"), (901, "A  b", "en", "s"), (902, "", "en", "s"), (903, None, "en", "s")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == brute([(d, t or "") for d, t, _, _ in rows])


def template_rows(n, own, seed=5):
    """Texts of one template of 200 words, each with some words of its own: alike to less than 0.8."""
    rnd = random.Random(seed)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in range(own):
            words[10 + at] = f"own{i}x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


def set_rows(spark, rows, component=lambda i: i):
    each = [(str(i).zfill(16).encode(), len(shingles(t)), str(component(i)).zfill(16).encode(), [x - 2**63 for x in map(int, jaccard.shingles(t))]) for i, t in rows]
    return spark.createDataFrame(each, "u binary, n int, c binary, s array<long>")


def test_texts_of_one_template_do_not_all_meet(spark):
    counts = [jaccard.prefix_pairs(set_rows(spark, template_rows(n, own=40))).count() for n in (60, 120)]
    assert counts == [0, 0]
    rows = template_rows(80, own=40) + [(100 + i, t + " more") for i, t in template_rows(3, own=40)]
    got = {tuple(sorted((int(r.a), int(r.b)))) for r in jaccard.prefix_pairs(set_rows(spark, rows)).collect()}
    assert got == {(0, 100), (1, 101), (2, 102)}


def test_no_pair_of_0_8_is_lost_by_prefixes(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(200):
        base = rows[rnd.randrange(len(rows))][1].split() if rows and rnd.random() < 0.8 else [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 150))]
        words = list(base)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.choice((0, rnd.randrange(len(words) + 1), len(words)))
            words[at : at + rnd.randrange(2)] = [f"w{rnd.randrange(60)}"] * rnd.randrange(2)
        rows.append((i, " ".join(words)))
    sets, seen = {}, set()
    rows = [(i, t) for i, t in rows if not (frozenset(shingles(t)) in seen or seen.add(frozenset(shingles(t))))]
    sets = {i: shingles(t) for i, t in rows}
    component = lambda i: i // 3
    want = {(a, b) for a in sets for b in sets if a < b and component(a) != component(b) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    table = set_rows(spark, rows, component)
    pairs = jaccard.prefix_pairs(table)
    met = {tuple(sorted((int(r.a), int(r.b)))) for r in pairs.collect()}
    assert want <= met and len(want) > 20
    assert {tuple(sorted((int(r.a), int(r.b)))) for r in jaccard.confirmed(pairs, table).collect()} == want


def test_stage_on_a_template_and_its_copies(spark):
    rows = template_rows(90, own=40) + [(200 + i, t + " more words here") for i, t in template_rows(10, own=40)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows] * 2, "doc_id long, text string, lang string, source string")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(90))


def group_rows(n, edits=5, seed=8):
    """One group of near copies: each has some words of a text of 160 words replaced, so many are alike to a few others only."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"g{j}" for j in range(160)]
        for at in rnd.sample(range(160), edits):
            words[at] = f"e{rnd.randrange(40)}"
        rows.append((i, " ".join(words)))
    return rows


def test_stage_on_one_wide_group_of_near_copies(spark, monkeypatch):
    rows, met, prefix = group_rows(120), [], []

    def counting(of, into):
        def inner(*given):
            pairs = of(*given).persist()
            into.append(pairs.count())
            return pairs

        return inner

    monkeypatch.setattr(jaccard, "hub_pairs", counting(jaccard.hub_pairs, met))
    monkeypatch.setattr(jaccard, "prefix_pairs", counting(jaccard.prefix_pairs, prefix))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == brute(rows)
    assert len(met) == len(prefix) == 1 and met[0] <= len(rows) * jaccard.BANDS * (2 + jaccard.CHANCE)


def test_hubs_meet_all_other_components_of_a_bucket_and_no_bucket_of_one(spark):
    buckets = spark.createDataFrame([(k, bytes([u]), 100) for k, us in ((1, range(1, 7)), (2, (1, 2, 3)), (3, (5, 6))) for u in us], "k long, u binary, n int")
    links = spark.createDataFrame([(b"\x01", b"\x02"), (b"\x02", b"\x03")], "a binary, b binary")
    roots = spark.createDataFrame([(bytes([u]), b"\x01") for u in (1, 2, 3)], "node binary, root binary")
    pairs = {(r.a[0], r.b[0]) for r in jaccard.hub_pairs(buckets, roots, links).collect()}
    assert {(2, 4), (2, 5), (2, 6)} <= pairs
    component = lambda u: 1 if u < 4 else u
    assert all(component(a) != component(b) for a, b in pairs)
    assert jaccard.hub_pairs(buckets.limit(0), roots, links).count() == 0
