"""An invoice is one row up to its gates, and a pair of duplicates meets once: what was dealt out again and again isn't any more."""

from datetime import date, timedelta

import payguard.plans.registry  # noqa: F401  the views of all jobs
from payguard.operators.duplicates import hits
from payguard.plans.catalog import JOBS, SPARK_JOBS, _uses, frame

RULES = {"number_similarity_pct": 85, "amount_tolerance_permille": 5, "date_window_days": 7, "same_amount_days": 30}


def test_readings_meet_no_page(spark, sf):
    """A page brings its readings, its date and its vendor's country; only the master is joined."""
    plan = frame(spark, sf, "v_seen_readings")._jdf.queryExecution().optimizedPlan().toString()
    keys = [line.split("Join ", 1)[1] for line in plan.split("\n") if "Join " in line]
    assert keys and not any("invoice_id" in k for k in keys), keys


def test_claims_ask_for_early_gates_only():
    uses = _uses(SPARK_JOBS["wf_number_claims"])
    assert "v_match" not in uses and "v_held_duplicates" not in uses and uses["v_resolved_inv"] > 1


def test_routes_read_invoices_with_their_vendor():
    for name in ("wf_route", "rep_five_numbers"):
        uses = _uses(SPARK_JOBS.get(name) or JOBS[name])
        assert uses["v_inv"] == 1 and uses["v_resolved_inv"] > 1, name


def test_a_pair_meets_once_by_its_first_rule(spark):
    """Against all pairs, with amounts and days about the ends of their buckets; a near number of the same amount is one hit, not two."""
    first = date(1989, 11, 1)
    amounts = (1000, 1004, 1005, 1006, 99_500, 100_000, 100_500, 0, -1000)
    rows = [(i, 1 + i % 2, ("AB1234567" if i % 3 else "ZZ") + str(i % 5), amounts[i * 7 % 9], "USD" if i % 11 else "EUR", first + timedelta(days=i * 13 % 140), i) for i in range(240)]
    entries = spark.createDataFrame(rows, "invoice_id long, vendor long, number_norm string, amount long, currency string, invoice_date date, arrival_seq long")
    got = [(r.me_id, r.other_id, r.rule) for r in hits(entries, RULES).collect()]
    want = []
    for a in rows:
        for b in rows:
            if b[6] >= a[6] or b[1] != a[1]:
                continue
            apart, close = abs((a[5] - b[5]).days), abs(a[3] - b[3]) * 1000 <= max(abs(a[3]), abs(b[3])) * 5
            if a[2] == b[2]:
                want.append((a[0], b[0], "exact_number"))
            elif a[4] == b[4] and close and apart <= 7 and a[2][:2] == b[2][:2] == "AB":
                want.append((a[0], b[0], "near_number"))
            elif a[4] == b[4] and a[3] == b[3] and apart <= 30:
                want.append((a[0], b[0], "same_amount"))
    assert {w[2] for w in want} == {"exact_number", "near_number", "same_amount"}
    assert sorted(got) == sorted(want)
