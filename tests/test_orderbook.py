from datetime import date, datetime

import payguard.plans.registry  # noqa: F401  the views of all jobs
from payguard.plans.catalog import frame
from payguard.sources.orderbook import order_book


def test_lines_are_dealt_out_once(spark, sf):
    """Invoice lines read the line items once and are dealt out by part and by order only, where sums used to meet again and again."""
    plan = frame(spark, sf, "v_inl")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 0, plan  # of the written book


def test_book_of_odd_orders(spark):
    """A line without a part has no number, an order without lines no row, lines without an order no receipts; repeats are summed."""
    stamp = datetime(2001, 5, 1)
    line = "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string, l_tax double, l_suppkey long"
    rows = [(1, 7, 2.0, "A", "F", 0.02, 5), (1, 7, 3.0, "R", "O", 0.04, 4), (1, 8, 1.0, "A", "F", 0.0, 3), (1, 9, 4.0, "A", "F", 0.01, 6), (2, 7, 1.0, "A", "F", 0.0, 1)]
    part = spark.createDataFrame([(7, "nut", 1.5), (9, "bolt", 2.0)], "p_partkey long, p_name string, p_retailprice double")
    orders = spark.createDataFrame([(1, stamp, "O"), (3, stamp, "O")], "o_orderkey long, o_orderdate timestamp, o_orderstatus string")
    got = {(r.po, r.item): r for r in order_book(spark.createDataFrame(rows, line), part, orders).collect()}
    assert set(got) == {(1, 7), (1, 8), (1, 9), (2, 7)}
    first, lost, last, loose = got[1, 7], got[1, 8], got[1, 9], got[2, 7]
    assert (first.line_no, first.qty, first.price, first.tax_pct, first.rf, first.vendor, first.po_date) == (1, 5, 150, 4, "R", 3, date(2001, 5, 1))
    assert lost.line_no is None and lost.line_idx is None and (last.line_no, last.qty) == (2, 4)
    assert (first.received, last.received, first.line_idx, last.line_idx) == (5, 4, 0, 1)
    # 5 x 150 goes before 4 x 200 cents: the last is the largest, and its price the planted one of variant 1
    assert (first.largest, last.largest, first.bill_price, last.bill_price) == (False, True, 150, 20600)
    assert first.subtotal == first.bill_qty * first.bill_price + last.bill_qty * last.bill_price and last.subtotal is None
    assert not loose.po_known and loose.received is None and loose.nothing and loose.honest_qty == 1
    assert sum(r.head for r in got.values()) == 2


def test_pairs_deal_lines_out_once(spark, sf):
    """Lines and order lines meet in one shuffle by order; the vendors that there are come by broadcast."""
    plan = frame(spark, sf, "v_pairs")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan, plan


def test_keys_of_odd_descriptions(spark):
    """A description's key is made once a part, as ordered and as printed; one without words, or without text, has none."""
    line = "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string, l_tax double, l_suppkey long"
    rows = [(po, item, 1.0, "A", "F", 0.0, 1) for po in (4, 6) for item in (7, 8, 9)]
    part = spark.createDataFrame([(7, "Nut  & Bolt Co", 1.5), (8, "...", 2.0), (9, None, 2.0)], "p_partkey long, p_name string, p_retailprice double")
    orders = spark.createDataFrame([(4, datetime(2001, 5, 1), "O")], "o_orderkey long, o_orderdate timestamp, o_orderstatus string")
    got = {(r.po, r.item): (r.desc_key, r.print_key) for r in order_book(spark.createDataFrame(rows, line), part, orders).collect()}
    assert got == {(po, item): want for po in (4, 6) for item, want in ((7, ("nut bolt", "nut bolt")), (8, (None, None)), (9, (None, None)))}
