"""Replay of decisions under their own version; waiting approvals matched as of two moments."""

import pytest
from payguard.operators.snapshots import refresh, replay

CONFIG = "config_version string, price_pct long, price_abs long, qty_over_pct long, unmatched_abs long, unmatched_pct long, tax_abs long, rounding_abs long, refresh_hours long"
VERSIONS = [("v1", 2, 5000, 0, 5000, 2, 100, 100, 72), ("v0", 1, 2500, 0, 2500, 1, 100, 100, 48), ("v9", 50, 99999999, 50, 99999999, 99, 100, 100, 72)]
INVOICES = "invoice_id long, po_ref long, vendor long, currency string, subtotal long, tax_total long, total long"
LINES = "invoice_id long, line_idx long, description string, po_line_ref string, qty long, price long, extended long, tax_pct long"
ORDER_LINES = "po long, line_no long, item_ref string, description string, price long, qty long, extended long"


@pytest.fixture(scope="module")
def tables(spark):
    bill = lambda i, po, qty, price, more=(): ((i, po, 7, "USD", qty * price + sum(more), 0, qty * price + sum(more)), [(i, 0, "Bolt", None, qty, price, qty * price, 0), *((i, k + 1, "Freight", None, 1, x, x, 0) for k, x in enumerate(more))])
    bills = [bill(1, 100, 10, 100_000), bill(2, 100, 10, 101_500), bill(3, 100, 12, 100_000), bill(4, 100, 10, 100_000, (3000,)), bill(5, None, 1, 1), bill(6, 999, 1, 1), bill(7, 101, 10, 2000)]
    invoices = spark.createDataFrame([b[0] for b in bills], INVOICES)
    lines = spark.createDataFrame([x for b in bills for x in b[1]], LINES)
    ordered = spark.createDataFrame([(100, 1, "A", "Bolt", 100_000, 10, 1_000_000), (101, 1, "A", "Bolt", 2000, 10, 20_000)], ORDER_LINES)
    return invoices, lines, ordered, spark.createDataFrame(VERSIONS, CONFIG)


def test_one_run_judges_each_under_its_own_version(spark, tables):
    invoices, lines, ordered, configs = tables
    orders = spark.createDataFrame([(100, "open", 7, "USD"), (101, "open", 7, "USD")], "po long, status string, vendor long, currency string")
    receipts = spark.createDataFrame([(100, 1, 10), (101, 1, 10)], "po long, line_no long, received long")
    decisions = spark.createDataFrame([(1, "v0"), (2, "v0"), (3, "v9"), (4, "v1"), (5, "v0"), (6, "v0"), (7, "gone")], "invoice_id long, config_version string")
    got = {r.invoice_id: tuple(r)[1:] for r in replay(decisions, invoices, lines, orders, ordered, receipts, configs, "v1").collect()}
    assert got == {
        1: ("v0", False, "", "", "", ""),
        2: ("v0", False, "price_over_tolerance", "", "price_over_tolerance", ""),  # 1.5 % over: beyond v0's 1 %, within v1's 2 %
        3: ("v9", False, "", "quantity_over_tolerance", "", "quantity_over_tolerance"),
        4: ("v1", False, "", "", "", ""),
        5: ("v0", False, "", "", "", ""),
        6: ("v0", False, "po_not_found", "po_not_found", "", ""),
        7: ("gone", True, None, None, None, None),
    }
    again = decisions.filter("invoice_id = 4").selectExpr("invoice_id", "'v0' AS config_version")
    assert [(r.reasons, r.reasons_now) for r in replay(again, invoices, lines, orders, ordered, receipts, configs, "v1").collect()] == [("line_not_on_po", "")]
    assert replay(decisions.limit(0), invoices, lines, orders, ordered, receipts, configs, "v1").count() == 0


HISTORY = [(100, 0, "open", 7, "USD"), (101, 0, "open", 7, "USD")]
# name: order history, receipts (po, line, qty, hour), request (invoice, hours), outcome, before, after, added
CASES = {
    "nothing changed": (HISTORY, [(100, 1, 10, 0)], (1, 10, 82), "refreshed", "", "", ""),
    "an hour too young": (HISTORY, [(100, 1, 10, 0)], (1, 10, 81), "fresh", None, None, ""),
    "goods came meanwhile": (HISTORY, [(100, 1, 10, 50)], (1, 10, 90), "refreshed", "receipt_missing|quantity_over_tolerance", "", ""),
    "goods came after the check": (HISTORY, [(100, 1, 10, 91)], (1, 10, 90), "refreshed", "receipt_missing|quantity_over_tolerance", "receipt_missing|quantity_over_tolerance", ""),
    "goods went back": (HISTORY, [(100, 1, 10, 0), (100, 1, -4, 50)], (1, 10, 90), "cancelled", "", "quantity_over_tolerance", "quantity_over_tolerance"),
    "the order closed": ([*HISTORY, (100, 40, "closed", 7, "USD")], [(100, 1, 10, 0)], (1, 10, 90), "cancelled", "", "po_closed", "po_closed"),
    "the order closed before the request": ([*HISTORY, (100, 5, "closed", 7, "USD")], [(100, 1, 10, 0)], (1, 10, 90), "refreshed", "po_closed", "po_closed", ""),
    "closed and opened again": ([*HISTORY, (100, 20, "closed", 7, "USD"), (100, 30, "open", 7, "USD")], [(100, 1, 10, 0)], (1, 10, 90), "refreshed", "", "", ""),
    "the order vanished": ([*HISTORY, (100, 90, None, None, None)], [(100, 1, 10, 0)], (1, 10, 90), "cancelled", "", "po_not_found", "po_not_found"),
    "the vendor changed": ([*HISTORY, (100, 40, "open", 8, "USD")], [(100, 1, 10, 0)], (1, 10, 90), "cancelled", "", "po_vendor_mismatch", "po_vendor_mismatch"),
    "no order then": ([(100, 11, "open", 7, "USD")], [(100, 1, 10, 0)], (1, 10, 90), "fresh", None, None, ""),
    "no order printed": (HISTORY, [], (5, 0, 500), "fresh", None, None, ""),
    "an unknown order": (HISTORY, [], (6, 0, 500), "fresh", None, None, ""),
    "a code already seen stays": (HISTORY, [(100, 1, 10, 0)], (3, 0, 500), "refreshed", "quantity_over_tolerance", "quantity_over_tolerance", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_refresh_as_of_two_moments(spark, tables, name):
    history, docs, request, *want = CASES[name]
    invoices, lines, ordered, configs = tables
    got = refresh(
        spark.createDataFrame([request], "invoice_id long, requested_at long, checked_at long"), invoices, lines,
        spark.createDataFrame(history, "po long, since long, status string, vendor long, currency string"), ordered,
        spark.createDataFrame(docs, "po long, line_no long, qty long, at long"), configs.filter("config_version = 'v1'"),
    ).collect()
    assert [tuple(r)[1:] for r in got] == [tuple(want)]
