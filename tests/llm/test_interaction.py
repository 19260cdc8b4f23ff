import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from payguard.llm import interaction

LONG = " ".join(f"w{i}" for i in range(250))
DOCS = "doc_id long, text string, lang string, n string, mask string, part string"
ROWS = [
    (1, None, None), (2, "", "en"), (3, "", "en"), (None, "", "en"), (3, "", "en"), (4, LONG, "en"), (5, LONG, "fr"), (5, LONG, "fr"), (6, LONG.upper(), "fr"),
    (7, LONG + " #", ""), (8, "word " * 300, "en"), (9, "word " * 300, None), (-1, LONG, "de"), (10, "A" * 40, "de"), (11, "\x85 é b " * 200, "de"), (12, "x" * 200_000, "es"),
]
LABELS = [(2, 1, 0), (3, 0, 1), (3, 1, None), (4, 1, 1), (None, 1, 1), (5, None, None), (10, 1, 0), (99, 1, 1)]


def brute(rows, labels):
    """Applies every order to every document, one by one."""
    said = {}
    for i, good, toxic in labels:
        g, t = said.get(i, (False, False))
        said[i] = (g or good == 1, t or toxic == 1)
    said.pop(None, None)
    docs = []
    for i, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (x or "") == t for j, x, _ in rows),
        }
        docs.append((lang or "", fails, *said.get(i, (False, False))))
    out = {}
    for part in {d[0] for d in docs}:
        own, shapley = [d for d in docs if d[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                lost = [d for d in left if d[1][f]]
                before = [d for d in own if not any(d is x for x in left)]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(lost)
                unique = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                out[part, order, k + 1] = [len(left), len(lost), sum(d[1][f] for d in before), unique, sum(d[2] for d in lost), sum(d[3] for d in lost)]
        for (p, order, k), counts in out.items():
            if p == part:
                counts.append(shapley[order[k - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "n", "mask", "part") for r in rows], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = interaction.audit(docs, marks).collect()
    return {(r.part, r.filter_order, r.step): [r[c] for c in interaction.COUNTS] for r in got}, len(got)


def test_every_order_as_if_applied_one_by_one(spark):
    got, n = audited(spark, ROWS, LABELS)
    assert n == len(got) == 600 * 5
    assert got == brute(ROWS, LABELS)


def test_empty_tables(spark):
    assert audited(spark, [], LABELS) == ({}, 0)
    assert audited(spark, ROWS, [])[0] == brute(ROWS, [])


def test_min_plus_is_the_least_position_of_what_fails():
    for order, row in zip(interaction.ORDERS, interaction.STEPS.T):
        for mask, step in enumerate(row):
            places = [order.index(f) + 1 for f in range(5) if mask >> f & 1]
            assert step == (min(places) if places else np.inf)


@pytest.mark.parametrize("mask", [0, 1, 31])
def test_steps_add_up(mask):
    import pandas as pd

    out = interaction.report(pd.DataFrame({"part": [""], "mask": [mask], "n": [7], "good": [2], "toxic": [1]}))
    assert (out[out.step == 5].kept == (0 if mask else 7)).all() and out.removed.sum() == (120 * 7 if mask else 0)
