"""From an approved invoice to a bill: which bills can be made, and which may be posted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.operators import matching, vendors  # noqa: F401  their views are read here
from payguard.operators.threeway import asking, paired_lines
from payguard.plans.catalog import VIEWS, job, native, view
from payguard.sources.orderbook import BOOKED_TO
from payguard.sources.views import BROUGHT

#: Fixed value: what a ledger takes as a document number.
DOC_NUMBER = "^[0-9A-Z]{1,21}$"


def _first(*reasons: tuple[str, Column]) -> Column:
    """The first reason whose condition holds; null conditions do not."""
    return F.coalesce(*[F.when(F.coalesce(when, F.lit(False)), name) for name, when in reasons])


def bills(records: DataFrame, paired: DataFrame, orders: DataFrame, items: DataFrame | None) -> DataFrame:
    """Why an invoice can't become a bill, by its first reason, or the bill's key.

    records: invoice_id, extracted, vendor (resolved; null: none), approval_id, po_ref, invoice_number,
    currency, total, tax_total. paired: invoice_id, po, line_idx, line_no (null: unpaired), extended.
    orders: po, currency. items: po, line_no, item_ref (null: booked to an account); not met where paired brings item_ref.
    Returns invoice_id, outcome (``bill`` or the reason), line_idx (the first line that stops it), n_lines, bill_key.
    """
    known = paired if "item_ref" in paired.columns else paired.join(items.select("po", "line_no", "item_ref"), ["po", "line_no"], "left")
    lines = known.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("extended").alias("lines"), F.min(F.when(F.col("item_ref").isNull(), F.col("line_idx"))).alias("line_idx")
    )
    order = orders.select(F.col("po").alias("order_po"), F.col("currency").alias("order_currency"))
    r = records.join(lines, "invoice_id", "left").join(order, F.col("po_ref") == F.col("order_po"), "left")
    number = F.upper(F.regexp_replace("invoice_number", "[^0-9A-Za-z]", ""))
    why = _first(
        ("no_extraction", ~F.col("extracted")), ("no_vendor", F.col("vendor").isNull()), ("no_approval", F.col("approval_id").isNull()), ("no_po", F.col("order_po").isNull()), ("tax", F.col("tax_total") != 0),
        ("currency", F.col("currency") != F.col("order_currency")), ("doc_number", ~F.coalesce(number.rlike(DOC_NUMBER), F.lit(False))), ("unpaired_line", F.col("line_idx").isNotNull()),
        ("total", F.col("n_lines").isNull() | (F.col("lines") != F.col("total"))),
    )
    key = F.when(why.isNull(), F.concat(F.lit("bill:"), F.col("vendor").cast("string"), F.lit(":"), number))
    stopped = F.when(why == "unpaired_line", F.col("line_idx"))
    return r.select("invoice_id", F.coalesce(why, F.lit("bill")).alias("outcome"), stopped.alias("line_idx"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), key.alias("bill_key"))


def posting(payloads: DataFrame, records: DataFrame, approvals: DataFrame, held: DataFrame) -> DataFrame:
    """Bills about to be posted -> invoice_id, outcome: ``post`` or the first precondition that fails.

    payloads: invoice_id, vendor, approval_id, total, currency, bill_key. records: invoice_id, state, vendor
    (resolved). approvals: approval_id, of_invoice, status, amount, approved_currency. held: holder, held_key:
    keys that invoices hold already. An invoice without a record is ``unknown_invoice``. Of
    several invoices that ask for one key at once the least may have it.
    """
    key_holder = held.groupBy("held_key").agg(F.min("holder").alias("holder")).withColumnRenamed("held_key", "bill_key")
    own_key = held.groupBy(F.col("holder").alias("invoice_id")).agg(F.max("held_key").alias("own_key"))
    asking = payloads.filter("bill_key is not null").groupBy("bill_key").agg(F.min("invoice_id").alias("asks_first"))
    p = payloads.withColumnRenamed("vendor", "bill_vendor")
    steps = [(records.withColumn("known", F.lit(True)), "invoice_id"), (approvals, "approval_id"), (key_holder, "bill_key"), (own_key, "invoice_id"), (asking, "bill_key")]
    r = reduce(lambda df, step: df.join(step[0], step[1], "left"), steps, p)
    why = _first(
        ("unknown_invoice", F.col("known").isNull()), ("not_approved", F.col("state") != "approved"), ("vendor", ~F.col("bill_vendor").eqNullSafe(F.col("vendor"))),
        ("approval_of_another", ~F.col("of_invoice").eqNullSafe(F.col("invoice_id"))), ("approval_not_approved", F.col("status") != "approved"),
        ("amount", (F.col("amount") != F.col("total")) | (F.col("approved_currency") != F.col("currency"))),
        ("key_held", (F.col("holder") != F.col("invoice_id")) | (F.col("holder").isNull() & (F.col("asks_first") != F.col("invoice_id")))), ("other_key", F.col("own_key") != F.col("bill_key")),
    )
    return r.select("invoice_id", F.coalesce(why, F.lit("post")).alias("outcome"))


# Some invoices have no reading or no approval; approvals differ from the bill in one point or another.
view(
    "v_records",
    """SELECT i.invoice_id, i.source_po, i.source_po % 41 <> 7 AS extracted, r.vendor, CASE WHEN i.source_po % 31 <> 0 THEN i.invoice_id + 7000000000 END AS approval_id, i.po_ref, i.invoice_number, i.currency, i.total, CASE WHEN i.source_po % 2 = 0 THEN CAST(0 AS BIGINT) ELSE i.tax_total END AS tax_total,
    CASE WHEN i.source_po % 2 = 0 THEN i.subtotal ELSE i.total END AS due FROM v_inv AS i JOIN v_resolved AS r ON r.invoice_id = i.invoice_id""",
)
view("v_booked_records", VIEWS["v_records"].replace(*BROUGHT).replace("r.vendor", "i.vendor"))
native("v_records", lambda of: of("v_booked_records"), "v_booked_records")
view("v_untaxed", "SELECT invoice_id, extracted, vendor, approval_id, po_ref, invoice_number, currency, due AS total, tax_total FROM v_records")
view("v_items", f"SELECT po, line_no, {BOOKED_TO} AS item_ref FROM v_pol")
view(
    "v_approvals",
    """SELECT approval_id, CASE WHEN source_po % 38 = 0 THEN invoice_id + 10 ELSE invoice_id END AS of_invoice, CASE WHEN source_po % 15 = 0 THEN 'rejected' WHEN source_po % 16 = 0 THEN 'pending' ELSE 'approved' END AS status,
    due + CASE WHEN source_po % 21 = 0 THEN 1 ELSE 0 END AS amount, CASE WHEN source_po % 44 = 0 THEN 'CHF' ELSE currency END AS approved_currency FROM v_records WHERE approval_id IS NOT NULL""",
)
# Where an invoice stands: as its match and its approval left it.
view(
    "v_states",
    """SELECT r.invoice_id, r.vendor, CASE WHEN NOT coalesce(m.matched, false) THEN 'pending_human' WHEN a.status = 'approved' THEN 'approved' WHEN a.status = 'rejected' THEN 'rejected' ELSE 'pending_approval' END AS state
    FROM v_records AS r JOIN v_match AS m ON m.invoice_id = r.invoice_id LEFT JOIN v_approvals AS a ON a.approval_id = r.approval_id""",
)
view(
    "v_payable",
    """SELECT r.invoice_id, CASE WHEN r.source_po % 46 = 0 THEN r.vendor + 1 ELSE r.vendor END AS vendor, r.approval_id, r.due AS total, r.currency, 'bill:' || CAST(r.vendor AS STRING) || ':' || CASE WHEN r.source_po % 26 = 0 THEN 'SAME' ELSE upper(@sub[r.invoice_number; '[^0-9A-Za-z]'; '']) END AS bill_key FROM v_records AS r WHERE r.vendor IS NOT NULL AND r.approval_id IS NOT NULL""",
)
view("v_held_keys", "SELECT CASE WHEN invoice_id % 3 = 0 THEN invoice_id + 1 ELSE invoice_id END AS holder, CASE WHEN invoice_id % 5 = 0 THEN bill_key || 'X' ELSE bill_key END AS held_key FROM v_payable WHERE invoice_id % 7 = 0")
view(
    "v_bills",
    r"""SELECT x.invoice_id, x.outcome, CASE WHEN x.outcome = 'unpaired_line' THEN x.line_idx END AS line_idx, x.n_lines, CASE WHEN x.outcome = 'bill' THEN 'bill:' || CAST(x.vendor AS VARCHAR) || ':' || x.number END AS bill_key FROM (
      SELECT r.invoice_id, r.vendor, r.number, s.line_idx, coalesce(s.n_lines, 0) AS n_lines, CASE WHEN NOT r.extracted THEN 'no_extraction' WHEN r.vendor IS NULL THEN 'no_vendor' WHEN r.approval_id IS NULL THEN 'no_approval' WHEN p.po IS NULL THEN 'no_po' WHEN r.tax_total <> 0 THEN 'tax'
        WHEN r.currency <> p.currency THEN 'currency' WHEN NOT regexp_matches(r.number, '^[0-9A-Z]{1,21}$') THEN 'doc_number' WHEN s.line_idx IS NOT NULL THEN 'unpaired_line' WHEN s.lines IS DISTINCT FROM r.total THEN 'total' ELSE 'bill' END AS outcome
      FROM (SELECT *, upper(regexp_replace(invoice_number, '[^0-9A-Za-z]', '', 'g')) AS number FROM v_untaxed) AS r LEFT JOIN v_po AS p ON p.po = r.po_ref LEFT JOIN (
        SELECT a.invoice_id, count(*) AS n_lines, CAST(sum(a.extended) AS BIGINT) AS lines, min(CASE WHEN i.item_ref IS NULL THEN a.line_idx END) AS line_idx FROM v_pairs AS a LEFT JOIN v_items AS i ON i.po = a.po AND i.line_no = a.line_no GROUP BY a.invoice_id) AS s ON s.invoice_id = r.invoice_id) AS x""",
)


def v_bills(of: Callable[[str], DataFrame]) -> DataFrame:
    """Lines are paired for what a bill needs of them only; those that name no order are on no order line."""
    lines = asking(of, "line_idx", "extended")
    paired = paired_lines(lines, None, of("v_bookable_pol"), None).select("invoice_id", "line_idx", "extended", F.col("hit.booked_to").alias("item_ref"))
    loose = lines.filter("po_ref is null").select("invoice_id", "line_idx", "extended", F.lit(None).cast("string").alias("item_ref"))
    return bills(of("v_untaxed"), paired.union(loose), of("v_po"), None)


native("v_bills", v_bills, "v_untaxed", "v_asking_inl", "v_asking_inl", "v_bookable_pol", "v_po")
job("po_bill_for", "SELECT * FROM v_bills")
view(
    "v_posting",
    """SELECT p.invoice_id, CASE WHEN s.state <> 'approved' THEN 'not_approved' WHEN p.vendor <> s.vendor THEN 'vendor' WHEN a.of_invoice <> p.invoice_id THEN 'approval_of_another' WHEN a.status <> 'approved' THEN 'approval_not_approved'
      WHEN a.amount <> p.total OR a.approved_currency <> p.currency THEN 'amount' WHEN EXISTS (SELECT 1 FROM (SELECT held_key, min(holder) AS holder FROM v_held_keys GROUP BY held_key) AS h WHERE h.held_key = p.bill_key AND h.holder <> p.invoice_id) THEN 'key_held'
      WHEN NOT EXISTS (SELECT 1 FROM v_held_keys AS h WHERE h.held_key = p.bill_key) AND p.invoice_id > min(p.invoice_id) OVER (PARTITION BY p.bill_key) THEN 'key_held' WHEN (SELECT max(h.held_key) FROM v_held_keys AS h WHERE h.holder = p.invoice_id) <> p.bill_key THEN 'other_key' ELSE 'post' END AS outcome
    FROM v_payable AS p JOIN v_states AS s ON s.invoice_id = p.invoice_id JOIN v_approvals AS a ON a.approval_id = p.approval_id""",
)
native("v_posting", lambda of: posting(of("v_payable"), of("v_states"), of("v_approvals"), of("v_held_keys")), "v_payable", "v_states", "v_approvals", "v_held_keys")
job("po_post_preconditions", "SELECT * FROM v_posting")
