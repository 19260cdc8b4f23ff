"""Steps that are done once where they used to be done again for every version, moment, rule or reader."""

from datetime import date, timedelta

import payguard.plans.registry  # noqa: F401  the views of all jobs
from payguard.operators.duplicates import _dates, _meet
from payguard.operators.posting import bills
from payguard.operators.snapshots import refresh, replay
from payguard.plans.catalog import JOBS, _uses
from pyspark.sql import functions as F

from tests.test_snapshots import HISTORY, ORDER_LINES, tables  # noqa: F401


def test_one_invoice_decided_under_two_versions(spark, tables):  # noqa: F811
    """Lines are paired once an invoice, so that two decisions on it don't bill its lines twice."""
    invoices, lines, ordered, configs = tables
    orders = spark.createDataFrame([(100, "open", 7, "USD")], "po long, status string, vendor long, currency string")
    receipts = spark.createDataFrame([(100, 1, 10)], "po long, line_no long, received long")
    decisions = spark.createDataFrame([(4, "v0"), (4, "v1")], "invoice_id long, config_version string")
    got = {r.config_version: (r.reasons, r.reasons_now) for r in replay(decisions, invoices, lines, orders, ordered, receipts, configs, "v1").collect()}
    assert got == {"v0": ("line_not_on_po", ""), "v1": ("", "")}


def test_order_lines_may_bring_their_receipts(spark, tables):  # noqa: F811
    """Both moments ask one pairing: receipts come with the order line, by the hour."""
    invoices, lines, _, configs = tables
    ordered = spark.createDataFrame([(100, 1, "A", "Bolt", 100_000, 10, 1_000_000, [(0, 6), (50, 4)])], ORDER_LINES + ", received array<struct<at: long, qty: long>>")
    asked = spark.createDataFrame([(1, 10, 90)], "invoice_id long, requested_at long, checked_at long")
    history = spark.createDataFrame(HISTORY, "po long, since long, status string, vendor long, currency string")
    got = refresh(asked, invoices, lines, history, ordered, None, configs.filter("config_version = 'v1'")).collect()
    assert [tuple(r) for r in got] == [(1, "refreshed", "quantity_over_tolerance", "", "")]


def test_bills_of_lines_that_bring_their_item(spark):
    records = spark.createDataFrame([(i, True, 7, 1, 100, "A1", "USD", 5, 0) for i in (1, 2)], "invoice_id long, extracted boolean, vendor long, approval_id long, po_ref long, invoice_number string, currency string, total long, tax_total long")
    paired = spark.createDataFrame([(1, 0, 5, "A"), (2, 0, 2, "A"), (2, 1, 3, None)], "invoice_id long, line_idx long, extended long, item_ref string")
    orders = spark.createDataFrame([(100, "USD")], "po long, currency string")
    assert {tuple(r)[:3] for r in bills(records, paired, orders, None).collect()} == {(1, "bill", None), (2, "unpaired_line", 1)}


def test_two_buckets_hold_what_is_in_reach(spark):
    """Every pair in reach is met once, and an entry is dealt to two buckets at most, also before the first day."""
    entries = spark.createDataFrame([(i, 1, "N", 1, "USD", date(1989, 12, 1) + timedelta(days=i * 3 % 61), i) for i in range(61)], "invoice_id long, vendor long, number_norm string, amount long, currency string, invoice_date date, arrival_seq long")
    met = _meet(entries, (), day=_dates(7)).filter("days <= 7")
    rows = entries.collect()
    want = sorted((a.invoice_id, b.invoice_id) for a in rows for b in rows if b.arrival_seq < a.arrival_seq and abs((a.invoice_date - b.invoice_date).days) <= 7)
    assert sorted((r.me_invoice_id, r.other_invoice_id) for r in met.collect()) == want
    value, reach, width = _dates(7)
    ends = entries.withColumnRenamed("invoice_date", "me_invoice_date").select((F.floor((value("me") + reach) / width) - F.floor((value("me") - reach) / width)).alias("n"))
    assert {r.n for r in ends.collect()} <= {0, 1}


def test_what_only_a_written_view_reads_is_not_written():
    uses = _uses(JOBS["ap_requirement"])
    assert uses["v_inv"] == 1 and uses["v_resolved_inv"] > 1
