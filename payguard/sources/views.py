"""Accounts-payable views over the star-schema tables; money in whole cents, percents in whole percent.

Every view is integer arithmetic on keys, so that two engines make the same rows.
"""

import re

from payguard.functions.text import norm
from payguard.plans.catalog import VIEWS, native, view
from payguard.sources.orderbook import SUMMED

#: The guardrail numbers, by configuration version.
view(
    "v_cfg",
    """SELECT * FROM (VALUES
    ('v1', 2, 5000, 0, 100, 5000, 2, 365, 100, 100, 72, 0, 2, 85, 5, 7, 30, 26214400, 20),
    ('v0', 1, 2500, 0, 100, 2500, 1, 180, 100, 100, 48, 0, 2, 90, 5, 7, 30, 10485760, 10)) AS t(config_version, price_pct, price_abs,
    qty_over_pct, qty_under_pct, unmatched_abs, unmatched_pct, max_age_days, tax_abs, rounding_abs, refresh_hours,
    auto_approve_max, max_rematches, number_similarity_pct, amount_tolerance_permille, date_window_days, same_amount_days, max_bytes, max_pages)""",
)
view("v_now", "SELECT * FROM v_cfg WHERE config_version = 'v1'")
view(
    "v_tiers",
    """SELECT * FROM (VALUES ('v1', 1, CAST(100000 AS BIGINT), 'ap_clerk', 1), ('v1', 2, CAST(1000000 AS BIGINT), 'controller', 1), ('v1', 3, CAST(NULL AS BIGINT), 'owner', 2))
    AS t(config_version, tier, ceiling, role, approvers)""",
)
view(
    "v_rules",
    """SELECT * FROM (VALUES ('v1', 1, 'new_vendor', 2, false), ('v1', 2, 'first_invoice_from_vendor', 2, false),
    ('v1', 3, 'remit_to_mismatch', 2, true), ('v1', 4, 'match_exception', 1, false)) AS t(config_version, ord, rule, approvers, callback)""",
)
view(
    "v_line",
    """SELECT l_orderkey AS po, l_partkey AS item, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS qty, max(l_returnflag) AS rf,
    max(l_linestatus) AS ls, max(CAST(round(l_tax * 100) AS BIGINT)) AS tax_pct, min(l_suppkey) AS supp FROM lineitem GROUP BY l_orderkey, l_partkey""",
)
view(
    "v_pol",
    """SELECT po, CAST(row_number() OVER (PARTITION BY po ORDER BY item) AS BIGINT) AS line_no, item, CAST(item AS STRING) AS item_ref, p_name AS description,
    qty, CAST(round(p_retailprice * 100) AS BIGINT) AS price, qty * CAST(round(p_retailprice * 100) AS BIGINT) AS extended, rf, ls, tax_pct
    FROM v_line JOIN part ON p_partkey = item""",
)
view(
    "v_po",
    """SELECT o_orderkey AS po, CAST(o_orderdate AS DATE) AS po_date, vendor,
    CASE WHEN o_orderkey % 23 = 0 THEN 'closed' WHEN o_orderkey % 29 = 0 THEN 'cancelled' WHEN o_orderstatus = 'P' THEN 'partially_received' ELSE 'open' END AS status,
    CASE WHEN vendor % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency
    FROM orders JOIN (SELECT po, min(supp) AS vendor FROM v_line GROUP BY po) AS s ON s.po = o_orderkey""",
)
#: Raw receipt documents: a line may be missing, zero, short, or received twice.
view(
    "v_grn",
    """SELECT p.po, p.line_no, p.description AS item_name, CAST(1 AS BIGINT) AS doc, CASE WHEN p.rf = 'N' AND p.po % 3 = 0 THEN 0
      WHEN (p.po * 7 + p.line_no) % 23 = 0 THEN p.qty - 1 ELSE p.qty END AS qty, o.po_date + 10 AS received_on
      FROM v_pol AS p JOIN v_po AS o ON o.po = p.po WHERE (p.po + p.line_no) % 19 <> 0 AND p.po % 14 <> 0
    UNION ALL SELECT p.po, p.line_no, p.description, CAST(2 AS BIGINT), CAST(1 AS BIGINT), o.po_date + 20
      FROM v_pol AS p JOIN v_po AS o ON o.po = p.po WHERE (p.po + p.line_no) % 31 = 0""",
)
view("v_rec", "SELECT po, line_no, CAST(sum(qty) AS BIGINT) AS received, max(received_on) AS received_on FROM v_grn GROUP BY po, line_no")
view(
    "v_vm",
    """SELECT s_suppkey AS vendor, CASE s_suppkey % 4 WHEN 0 THEN name || ' Pvt. Ltd.' WHEN 1 THEN upper(name) || ', Inc' WHEN 2 THEN name || ' GmbH' ELSE name END AS display_name,
    'TX-' || CAST(s_suppkey - CASE WHEN s_suppkey % 40 = 1 THEN 1 ELSE 0 END AS STRING) AS tax_id, CASE s_nationkey % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'IN' ELSE 'SG' END AS country,
    CASE WHEN s_suppkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN s_suppkey % 7 <> 0 THEN @sha['DE89' || CAST(1000000000000 + s_suppkey AS STRING)] END AS remit_sha256 FROM (SELECT *, 'Supplier ' || CAST(s_suppkey AS STRING) AS name FROM supplier) AS s""",
)
view(
    "v_variants",
    """SELECT * FROM (VALUES (0, 'clean', 'CLN'), (1, 'price_plus_3pct', 'P03'), (2, 'qty_over_received', 'QTY'), (3, 'freight_small', 'FRS'), (4, 'freight_large', 'FRL'),
    (5, 'hidden_text', 'HID'), (6, 'instruction_text', 'INS'), (7, 'offpage_text', 'OFF'), (8, 'lookalike_vendor', 'LKA'), (9, 'remit_mismatch', 'RMT')) AS t(variant, name, code)""",
)
#: The honest lines of an order's invoice: what was received, or what was ordered where nothing was.
view(
    "v_honest",
    """SELECT *, row_number() OVER (PARTITION BY po ORDER BY qty * price DESC, line_no) = 1 AS largest FROM (
      SELECT po, line_no, item_ref, description, price, tax_pct, received, nothing, CASE WHEN nothing THEN ordered ELSE coalesce(received, 0) END AS qty FROM (
        SELECT p.po, p.line_no, p.item_ref, p.description, p.price, p.tax_pct, p.qty AS ordered, r.received,
          coalesce(max(r.received) OVER (PARTITION BY p.po), 0) = 0 AS nothing FROM v_pol AS p LEFT JOIN v_rec AS r ON r.po = p.po AND r.line_no = p.line_no) AS a) AS b WHERE qty > 0""",
)
view(
    "v_bill",
    """SELECT po, variant, CAST(row_number() OVER (PARTITION BY po, variant ORDER BY line_no) - 1 AS BIGINT) AS line_idx, description, item_ref, qty, price, qty * price AS extended, tax_pct, nothing FROM (
      SELECT h.po, v.variant, h.line_no, h.description, h.item_ref, h.tax_pct, h.nothing,
        CASE WHEN v.variant = 2 AND h.largest THEN coalesce(h.received, 0) + 2 ELSE h.qty END AS qty,
        CASE WHEN v.variant = 1 AND h.largest THEN @div[h.price * 103 + 50; 100] ELSE h.price END AS price FROM v_honest AS h CROSS JOIN v_variants AS v
      UNION ALL SELECT po, variant, CAST(1000000 AS BIGINT), 'Freight', CAST(NULL AS STRING), CAST(0 AS BIGINT), nothing, CAST(1 AS BIGINT), CASE WHEN variant = 3 THEN CAST(2500 AS BIGINT) ELSE CAST(12000 AS BIGINT) END
        FROM (SELECT DISTINCT po, nothing FROM v_honest) AS d CROSS JOIN (SELECT variant FROM v_variants WHERE variant IN (3, 4)) AS f) AS b""",
)
#: One invoice an order, with one planted variant and some broken arithmetic.
view(
    "v_inl",
    """SELECT po * 10 + variant AS invoice_id, po, variant, line_idx, CASE WHEN po % 4 < 2 THEN upper(description) || '.' ELSE description END AS description,
    CASE WHEN po % 2 = 0 THEN ' ' || item_ref WHEN po % 9 = 0 THEN 'unknown' END AS po_line_ref, qty, price, extended + CASE WHEN po % 41 = 0 AND line_idx = 0 THEN 300 ELSE 0 END AS extended, tax_pct
    FROM v_bill WHERE variant = po % 10""",
)
view(
    "v_inv",
    """SELECT i.invoice_id, i.po AS source_po, i.variant, o.vendor AS true_vendor, 'INV-' || CAST(i.po AS STRING) || '-' || v.code AS invoice_number, o.po_date + 3 AS invoice_date,
    CASE WHEN i.po % 61 = 0 THEN o.po_date ELSE o.po_date + 33 END AS due_date, o.po_date + CASE WHEN i.po % 67 = 0 THEN 500 ELSE 5 END AS received_on,
    CASE WHEN i.po % 34 = 0 THEN 'GBP' WHEN i.po % 71 = 0 THEN 'XYZ' ELSE o.currency END AS currency, i.subtotal + CASE WHEN i.po % 43 = 0 THEN 500 ELSE 0 END AS subtotal,
    i.tax + CASE WHEN i.po % 47 = 0 THEN 250 ELSE 0 END AS tax_total, i.subtotal + i.tax + CASE WHEN i.po % 37 = 0 THEN 150 ELSE 0 END AS total,
    CASE WHEN i.po % 30 = 13 THEN CAST(NULL AS BIGINT) WHEN i.po % 53 = 0 THEN -i.po WHEN i.po % 59 = 0 THEN i.po - 1 ELSE i.po END AS po_ref,
    CASE WHEN i.variant = 8 THEN m.display_name || ' Trading' ELSE lower(m.display_name) END AS vendor_name, CASE WHEN i.variant = 8 THEN 'TX-0' || CAST(o.vendor AS STRING) WHEN i.po % 6 = 5 THEN CAST(NULL AS STRING) ELSE lower(m.tax_id) || ' ' END AS vendor_tax_id,
    CASE WHEN i.po % 5 = 4 THEN CAST(NULL AS STRING) WHEN i.po % 5 = 3 THEN 'pay by cheque' ELSE 'Bank of X, IBAN de89 ' || CAST(1000000000000 + o.vendor + CASE WHEN i.variant = 9 THEN 1 ELSE 0 END AS STRING) || CASE WHEN i.po % 45 = 1 THEN ' or gb29 nwbk 6016 1331 9268 19' ELSE '' END END AS remit_to,
    i.po AS arrival_seq, i.nothing FROM (
      SELECT b.po * 10 + b.variant AS invoice_id, b.po, b.variant, CAST(sum(b.extended) AS BIGINT) AS subtotal, @div[CAST(sum(b.extended * b.tax_pct) AS BIGINT); 100] AS tax, max(b.nothing) AS nothing
      FROM v_bill AS b WHERE b.variant = b.po % 10 GROUP BY b.po, b.variant) AS i
    JOIN v_po AS o ON o.po = i.po JOIN v_vm AS m ON m.vendor = o.vendor JOIN v_variants AS v ON v.variant = i.variant""",
)
# The same columns over the order book's sums, for Spark.
_columns, _joins = VIEWS["v_inv"].split(" FROM (", 1)[0], "JOIN v_vm AS m ON m.vendor = i.vendor JOIN v_variants AS v ON v.variant = i.variant"
view("v_booked_inv", f"{re.sub(r'\bo[.]', 'i.', _columns)} FROM ({SUMMED}) AS i {_joins}")
native("v_inv", lambda of: of("v_booked_inv"), "v_booked_inv")
#: The duplicate index: every invoice under its resolved vendor (null: none), and later copies of some under the same or a nearby number.
view(
    "v_entries",
    """SELECT *, upper(@sub[invoice_number; '[^0-9A-Za-z]'; '']) AS number_norm FROM (
      SELECT i.invoice_id, r.vendor, invoice_number, total AS amount, invoice_date, currency, arrival_seq FROM v_inv AS i JOIN v_resolved AS r ON r.invoice_id = i.invoice_id
      UNION ALL SELECT i.invoice_id + 5000000000, r.vendor, CASE WHEN source_po % 100 = 50 THEN invoice_number || '-A' WHEN source_po % 75 = 0 THEN 'R' || CAST(source_po AS STRING) ELSE lower(invoice_number) || ' ' END, total + CASE WHEN source_po % 100 = 50 THEN @div[total; 400] ELSE 0 END,
        invoice_date + 2, currency, arrival_seq + 1000000000 FROM v_inv AS i JOIN v_resolved AS r ON r.invoice_id = i.invoice_id WHERE source_po % 25 = 0) AS e""",
)
# The same over invoices that bring their vendor, for Spark.
BROUGHT = ("v_inv AS i JOIN v_resolved AS r ON r.invoice_id = i.invoice_id", "v_resolved_inv AS i")
view("v_booked_entries", VIEWS["v_entries"].replace(*BROUGHT).replace("r.vendor", "i.vendor"))
native("v_entries", lambda of: of("v_booked_entries"), "v_booked_entries")
view("v_norm_vendor", f"SELECT vendor, display_name, {norm('display_name')} AS name_norm, nullif(lower(@sub[tax_id; '[^0-9A-Za-z]'; '']), '') AS tax_norm FROM v_vm")
