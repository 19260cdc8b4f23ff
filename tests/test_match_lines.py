"""Lines of a match and the order lines that an invoice leaves out, golden rows."""

import payguard.plans.registry  # noqa: F401  the views of all jobs
from payguard.operators.threeway import match_lines
from payguard.plans.catalog import frame


def test_golden(spark):
    df = spark.createDataFrame
    pairs = [(1, 10, 0, 1, 3, 100, 100, 5), (1, 10, 1, 1, 3, 100, 100, 5), (1, 10, 2, 2, 1, 9000, 100, None), (1, 10, 3, None, 1, 50, None, None), (2, 10, 0, 1, 1, 100, 100, 5), (3, None, 0, None, 1, 1, None, None)]
    lines = df(pairs, "invoice_id long, po long, line_idx long, line_no long, qty long, price long, po_price long, po_received long")
    eligible = df([(1, 10), (4, 11), (5, 12)], "invoice_id long, po long")
    ordered = df([(10, 1, 5), (10, 2, None), (10, 3, 7), (11, 1, None)], "po long, line_no long, received long")
    config = df([(2, 5000, 0)], "price_pct int, price_abs int, qty_over_pct int")
    got = sorted(map(tuple, match_lines(lines, eligible, ordered, config).select("invoice_id", "kind", "line_idx", "line_no", "outcome", "first_idx", "received", "billed", "delta").collect()), key=str)
    want = [
        (1, 0, 0, 1, "qty_over", 0, 5, 6, 0), (1, 0, 1, 1, "qty_over", 0, 5, 6, 0), (1, 0, 2, 2, "qty_over", 2, None, 1, 8900), (1, 1, 3, None, "unmatched", 0, None, None, None),
        (1, 2, None, 3, "unbilled", 0, 7, None, None), (4, 2, None, 1, "unbilled", 0, None, None, None),
    ]
    assert got == sorted(want, key=str)


def test_lines_are_dealt_out_twice(spark, sf):
    """Once by order, to be paired, and once by invoice; no line is joined with another's sums."""
    plan = frame(spark, sf, "v_match_lines")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count("Aggregate") == 0, plan
