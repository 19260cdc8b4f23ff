"""Three-way match: invoice lines, order lines and receipts, as joins and grouped sums.

Spark works the match out in one pass (``threeway.py``); the views here are the same rules
written rule by rule, which the parts have as queries and the other engine runs as a whole.
"""

from payguard.functions.text import norm
from payguard.operators import threeway
from payguard.plans.catalog import VIEWS, job, native, view

# A key that names more than one order line identifies nothing, in its tier.
view(
    "v_keys",
    f"""SELECT po, line_no, item_ref, description, price, qty, extended, nullif(lower(trim(item_ref)), '') AS ref_key, nullif({norm("description")}, '') AS desc_key FROM v_pol""",
)
view("v_ref_keys", "SELECT po, ref_key, min(line_no) AS line_no FROM v_keys WHERE ref_key IS NOT NULL GROUP BY po, ref_key HAVING count(*) = 1")
view("v_desc_keys", "SELECT po, desc_key, min(line_no) AS line_no FROM v_keys WHERE desc_key IS NOT NULL GROUP BY po, desc_key HAVING count(*) = 1")
view(
    "v_pairs",
    f"""SELECT l.invoice_id, i.po_ref AS po, l.line_idx, l.qty, l.price, l.extended, l.tax_pct, coalesce(r.line_no, d.line_no) AS line_no,
    CASE WHEN r.line_no IS NOT NULL THEN 'ref' WHEN d.line_no IS NOT NULL THEN 'description' END AS basis
    FROM v_inl AS l JOIN v_inv AS i ON i.invoice_id = l.invoice_id LEFT JOIN v_ref_keys AS r ON r.po = i.po_ref AND r.ref_key = nullif(lower(trim(l.po_line_ref)), '')
    LEFT JOIN v_desc_keys AS d ON d.po = i.po_ref AND d.desc_key = nullif({norm("l.description")}, '')""",
)
# For Spark each pair brings along the price and the receipts of its order line, so that no rule joins them again.
native("v_pairs", threeway.v_pairs, "v_asking_inl", "v_asking_inl", "v_booked_pol")
job("mt_pair_lines", "SELECT invoice_id, line_idx, line_no, basis FROM v_pairs")
# A pair's order line is one of its order's, so for Spark there is nothing to look up.
job("mt_unmatched", "SELECT p.invoice_id, p.line_idx, p.extended FROM v_pairs AS p ANTI JOIN v_keys AS k ON k.po = p.po AND k.line_no = p.line_no", "SELECT invoice_id, line_idx, extended FROM v_pairs WHERE line_no IS NULL")
job(
    "mt_unbilled",
    """SELECT i.invoice_id, k.line_no FROM (SELECT invoice_id, po_ref AS po FROM v_inv) AS i JOIN v_pol AS k ON k.po = i.po
    ANTI JOIN (SELECT invoice_id, line_no FROM v_pairs WHERE line_no IS NOT NULL) AS p ON p.invoice_id = i.invoice_id AND p.line_no = k.line_no""",
)
job(
    "mt_vendor_identity",
    """SELECT i.invoice_id, p.po, r.vendor = p.vendor AS same_vendor, CASE WHEN r.vendor <> p.vendor THEN 'po_vendor_mismatch' END AS reason FROM v_inv AS i JOIN v_po AS p ON p.po = i.po_ref JOIN v_resolved AS r ON r.invoice_id = i.invoice_id""",
)
job(
    "mt_po_selection",
    """SELECT i.invoice_id, p.po, CASE WHEN i.po_ref IS NULL THEN 'non_po' WHEN p.po IS NULL THEN 'po_not_found' ELSE 'match' END AS route FROM v_inv AS i LEFT JOIN v_po AS p ON p.po = i.po_ref""",
)
job("mt_receipt_lookup", "SELECT l.po, l.line_no, l.qty, r.received, r.received_on, r.received IS NULL AS missing FROM v_pol AS l LEFT JOIN v_rec AS r ON r.po = l.po AND r.line_no = l.line_no")
view(
    "v_qty",
    """SELECT b.invoice_id, b.po, b.line_no, b.billed, r.received, b.first_idx, b.billed * 100 > coalesce(r.received, 0) * (100 + c.qty_over_pct) AS over, coalesce(r.received, 0) = 0 AS receipt_missing
    FROM (SELECT invoice_id, po, line_no, CAST(sum(qty) AS BIGINT) AS billed, min(line_idx) AS first_idx FROM v_pairs WHERE line_no IS NOT NULL GROUP BY invoice_id, po, line_no) AS b
    LEFT JOIN v_rec AS r ON r.po = b.po AND r.line_no = b.line_no CROSS JOIN v_now AS c""",
)
view(
    "v_booked_qty",
    """SELECT b.*, b.billed * 100 > coalesce(b.received, 0) * (100 + c.qty_over_pct) AS over, coalesce(b.received, 0) = 0 AS receipt_missing
    FROM (SELECT invoice_id, po, line_no, CAST(sum(qty) AS BIGINT) AS billed, max(po_received) AS received, min(line_idx) AS first_idx FROM v_pairs WHERE line_no IS NOT NULL GROUP BY invoice_id, po, line_no) AS b CROSS JOIN v_now AS c""",
)
native("v_qty", lambda of: of("v_booked_qty"), "v_booked_qty")
job("mt_quantity", "SELECT invoice_id, line_no, billed, received, over, receipt_missing FROM v_qty")
view(
    "v_price",
    """SELECT p.invoice_id, p.po, p.line_idx, p.line_no, p.qty, p.extended, p.price AS invoice_price, k.price AS po_price, p.price - k.price AS delta,
    CASE WHEN k.price <> 0 THEN CAST(round((p.price - k.price) * CAST(100.0 AS DOUBLE) / k.price, 4) AS DOUBLE) END AS delta_pct,
    p.price > k.price AND (p.price - k.price > c.price_abs OR (k.price <> 0 AND (p.price - k.price) * 100 > k.price * c.price_pct)) AS over,
    abs(p.extended - p.qty * p.price) <= c.rounding_abs AS extension_holds
    FROM v_pairs AS p JOIN v_keys AS k ON k.po = p.po AND k.line_no = p.line_no CROSS JOIN v_now AS c""",
)
view("v_booked_price", VIEWS["v_price"].replace("k.price", "p.po_price").replace("JOIN v_keys AS k ON k.po = p.po AND k.line_no = p.line_no CROSS JOIN v_now AS c", "CROSS JOIN v_now AS c WHERE p.line_no IS NOT NULL"))
native("v_price", lambda of: of("v_booked_price"), "v_booked_price")
job("mt_price", "SELECT invoice_id, line_idx, line_no, invoice_price, po_price, delta, delta_pct, over FROM v_price")
job("mt_extension", "SELECT invoice_id, line_idx, extended, qty, invoice_price, extension_holds, CASE WHEN NOT extension_holds THEN 'arithmetic_inconsistent' END AS reason FROM v_price")
# Tested on the sum and on every line, so that a credit cannot hide a charge.
view(
    "v_charges",
    """SELECT u.invoice_id, u.unmatched, u.greatest, o.po_total, (u.unmatched > c.unmatched_abs OR u.unmatched * 100 > o.po_total * c.unmatched_pct OR u.greatest > c.unmatched_abs OR u.greatest * 100 > o.po_total * c.unmatched_pct) AS over
    FROM (SELECT invoice_id, po, CAST(sum(extended) AS BIGINT) AS unmatched, max(extended) AS greatest FROM v_pairs WHERE line_no IS NULL GROUP BY invoice_id, po) AS u
    JOIN (SELECT po, CAST(sum(extended) AS BIGINT) AS po_total FROM v_pol GROUP BY po) AS o ON o.po = u.po CROSS JOIN v_now AS c""",
)
view("v_booked_charges", VIEWS["v_charges"].replace("(SELECT po, CAST(sum(extended) AS BIGINT) AS po_total FROM v_pol GROUP BY po)", "(SELECT po, po_total FROM v_order_book WHERE head AND po_total IS NOT NULL)"))
native("v_charges", lambda of: of("v_booked_charges"), "v_booked_charges")
job("mt_unmatched_charges", "SELECT invoice_id, unmatched, greatest, po_total, over FROM v_charges")
view(
    "v_header",
    """SELECT i.invoice_id, i.subtotal - coalesce(s.lines, 0) AS subtotal_delta, i.tax_total * 100 - coalesce(s.tax_hundredths, 0) AS tax_delta_hundredths, i.total - i.subtotal - i.tax_total AS total_delta,
    abs(i.subtotal - coalesce(s.lines, 0)) > c.rounding_abs AS subtotal_off, abs(i.tax_total * 100 - coalesce(s.tax_hundredths, 0)) > c.tax_abs * 100 AS tax_off, abs(i.total - i.subtotal - i.tax_total) > c.rounding_abs AS total_off
    FROM v_inv AS i LEFT JOIN (SELECT invoice_id, CAST(sum(extended) AS BIGINT) AS lines, CAST(sum(extended * tax_pct) AS BIGINT) AS tax_hundredths FROM v_inl GROUP BY invoice_id) AS s ON s.invoice_id = i.invoice_id CROSS JOIN v_now AS c""",
)
job("mt_header", "SELECT * FROM v_header")
# Identity, currency and status end a match before any tolerance; after the last two, header differences are still reported.
view(
    "v_eligible",
    """SELECT i.invoice_id, p.po, i.total, CASE WHEN i.po_ref IS NULL THEN 'non_po' WHEN p.po IS NULL THEN 'po_not_found' WHEN r.vendor <> p.vendor THEN 'po_vendor_mismatch'
      WHEN i.currency <> p.currency THEN 'currency_mismatch' WHEN p.status NOT IN ('open', 'partially_received') THEN 'po_closed' END AS stop
    FROM v_inv AS i LEFT JOIN v_po AS p ON p.po = i.po_ref JOIN v_resolved AS r ON r.invoice_id = i.invoice_id""",
)
view("v_booked_eligible", VIEWS["v_eligible"].replace("r.vendor", "i.vendor").replace("v_inv AS i", "v_resolved_inv AS i").replace(" JOIN v_resolved AS r ON r.invoice_id = i.invoice_id", ""))
native("v_eligible", lambda of: of("v_booked_eligible"), "v_booked_eligible")
view(
    "v_codes",
    """SELECT invoice_id, CAST(0 AS BIGINT) AS phase, CAST(0 AS BIGINT) AS first_idx, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS line_idx, stop AS code FROM v_eligible WHERE stop <> 'non_po'
    UNION ALL SELECT q.invoice_id, 1, q.first_idx, 0, 0, 'receipt_missing' FROM v_qty AS q JOIN v_eligible AS e ON e.invoice_id = q.invoice_id WHERE e.stop IS NULL AND q.receipt_missing
    UNION ALL SELECT q.invoice_id, 1, q.first_idx, 1, 0, 'quantity_over_tolerance' FROM v_qty AS q JOIN v_eligible AS e ON e.invoice_id = q.invoice_id WHERE e.stop IS NULL AND q.over
    UNION ALL SELECT p.invoice_id, 1, q.first_idx, 2, p.line_idx * 2, 'price_over_tolerance' FROM v_price AS p JOIN v_eligible AS e ON e.invoice_id = p.invoice_id JOIN v_qty AS q ON q.invoice_id = p.invoice_id AND q.line_no = p.line_no WHERE e.stop IS NULL AND p.over
    UNION ALL SELECT p.invoice_id, 1, q.first_idx, 2, p.line_idx * 2 + 1, 'arithmetic_inconsistent' FROM v_price AS p JOIN v_eligible AS e ON e.invoice_id = p.invoice_id JOIN v_qty AS q ON q.invoice_id = p.invoice_id AND q.line_no = p.line_no WHERE e.stop IS NULL AND NOT p.extension_holds
    UNION ALL SELECT c.invoice_id, 2, 0, 0, 0, 'line_not_on_po' FROM v_charges AS c JOIN v_eligible AS e ON e.invoice_id = c.invoice_id WHERE e.stop IS NULL AND c.over
    UNION ALL SELECT h.invoice_id, 3, 0, 0, 0, 'totals_over_tolerance' FROM v_header AS h JOIN v_eligible AS e ON e.invoice_id = h.invoice_id WHERE e.stop IS NULL AND h.subtotal_off
    UNION ALL SELECT h.invoice_id, 3, 0, 1, 0, 'tax_mismatch' FROM v_header AS h JOIN v_eligible AS e ON e.invoice_id = h.invoice_id WHERE e.stop IS NULL AND h.tax_off
    UNION ALL SELECT h.invoice_id, 3, 0, 2, 0, 'totals_over_tolerance' FROM v_header AS h JOIN v_eligible AS e ON e.invoice_id = h.invoice_id WHERE e.stop IS NULL AND h.total_off""",
)
view("v_ordered_codes", "SELECT invoice_id, code, min(phase * 1000000000000 + first_idx * 100000000 + step * 10000000 + line_idx) AS ord FROM v_codes GROUP BY invoice_id, code")
view("v_reasons", "SELECT invoice_id, @list[code; ord] AS reasons, CAST(count(*) AS BIGINT) AS n_reasons FROM v_ordered_codes GROUP BY invoice_id")
view(
    "v_match",
    """SELECT e.invoice_id, e.po, CASE WHEN e.stop IN ('non_po', 'po_not_found') THEN e.stop ELSE 'match' END AS route, CASE WHEN coalesce(e.stop, '') <> 'non_po' THEN r.reasons IS NULL END AS matched, coalesce(r.reasons, '') AS reasons,
    CASE WHEN e.told THEN h.subtotal_delta END AS subtotal_delta, CASE WHEN e.told THEN h.tax_delta_hundredths END AS tax_delta_hundredths, CASE WHEN e.told THEN h.total_delta END AS total_delta, c.config_version
    FROM (SELECT *, coalesce(stop, '') IN ('', 'currency_mismatch', 'po_closed') AS told FROM v_eligible) AS e LEFT JOIN v_reasons AS r ON r.invoice_id = e.invoice_id JOIN v_header AS h ON h.invoice_id = e.invoice_id CROSS JOIN v_now AS c""",
)
native("v_match", threeway.v_match, "v_resolved_inv", "v_asking_inl", "v_booked_po", "v_booked_pol", "v_now")
native("v_ordered_codes", threeway.v_ordered_codes, "v_match")
job("mt_three_way_match", "SELECT * FROM v_match")
view(
    "v_match_lines",
    """SELECT p.invoice_id, CAST(0 AS BIGINT) AS kind, q.first_idx, p.line_idx, p.line_no, CASE WHEN q.over THEN 'qty_over' WHEN p.over THEN 'price_over' ELSE 'ok' END AS outcome, p.qty AS invoice_qty, q.received, q.billed, p.delta, p.po_price
      FROM v_price AS p JOIN v_qty AS q ON q.invoice_id = p.invoice_id AND q.line_no = p.line_no JOIN v_eligible AS e ON e.invoice_id = p.invoice_id AND e.stop IS NULL
    UNION ALL SELECT p.invoice_id, 1, 0, p.line_idx, CAST(NULL AS BIGINT), 'unmatched', p.qty, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM v_pairs AS p JOIN v_eligible AS e ON e.invoice_id = p.invoice_id AND e.stop IS NULL WHERE p.line_no IS NULL
    UNION ALL SELECT e.invoice_id, 2, 0, CAST(NULL AS BIGINT), k.line_no, 'unbilled', CAST(NULL AS BIGINT), r.received, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
      FROM v_eligible AS e JOIN v_pol AS k ON k.po = e.po LEFT JOIN v_qty AS q ON q.invoice_id = e.invoice_id AND q.line_no = k.line_no LEFT JOIN v_rec AS r ON r.po = k.po AND r.line_no = k.line_no WHERE e.stop IS NULL AND q.line_no IS NULL""",
)
native("v_match_lines", threeway.v_match_lines, "v_pairs", "v_eligible", "v_eligible", "v_booked_pol", "v_now")
job("mt_match_lines", "SELECT invoice_id, kind, line_idx, line_no, outcome, invoice_qty, received, delta FROM v_match_lines")


def plain(cents: str) -> str:
    """SQL for an amount in cents without trailing zeros: 5000 is 50, 5050 is 50.5."""
    return f"CAST(@div[{cents}; 100] AS STRING) || CASE WHEN {cents} % 100 = 0 THEN '' WHEN {cents} % 10 = 0 THEN '.' || CAST(@div[{cents} % 100; 10] AS STRING) ELSE '.' || lpad(CAST({cents} % 100 AS STRING), 2, '0') END"


def places(hundredths: str) -> str:
    """SQL for a number in hundredths with two places."""
    return f"CAST(@div[{hundredths}; 100] AS STRING) || '.' || lpad(CAST({hundredths} % 100 AS STRING), 2, '0')"


# Each paired line with the numbers that it was judged by and their limits; lines are named by number, never by a vendor's words.
view(
    "v_line_verdicts",
    f"""SELECT l.*, CASE WHEN kind = 0 THEN CAST(line_no AS STRING) || ':' || outcome || CASE outcome
      WHEN 'price_over' THEN '(' || CASE WHEN po_price = 0 THEN 'n/a' ELSE {places("pct")} || '%' END || ',' || {places("delta")} || ';limit ' || CAST(c.price_pct AS STRING) || '%/' || {plain("c.price_abs")} || ')'
      WHEN 'qty_over' THEN '(' || CAST(billed AS STRING) || '>' || coalesce(CAST(received AS STRING), 'none') || ';limit ' || CAST(c.qty_over_pct AS STRING) || '%)' ELSE '' END END AS verdict
    FROM (SELECT *, CASE WHEN po_price <> 0 THEN @div[2 * delta * 10000 + po_price; 2 * po_price] END AS pct FROM v_match_lines) AS l CROSS JOIN v_now AS c""",
)
job(
    "au_basis_text",
    """SELECT m.invoice_id, substr(CASE WHEN m.po IS NULL THEN concat_ws(', ', 'po_number=none', 'config_version=' || m.config_version, 'route=' || m.route, CASE WHEN m.reasons <> '' THEN 'reasons=' || m.reasons END)
      ELSE concat_ws(', ', 'po_number=' || CAST(m.po AS STRING), 'po_lines=' || CAST(o.n AS STRING), 'receipt_lines=' || CAST(coalesce(r.n, 0) AS STRING), 'status=' || p.status, 'config_version=' || m.config_version,
      'matched=' || CASE WHEN m.matched THEN 'yes' ELSE 'no' END, CASE WHEN m.reasons <> '' THEN 'reasons=' || m.reasons END, 'lines=' || coalesce(replace(l.lines, '|', ','), 'none') || ' ; unmatched=' || CAST(coalesce(l.unmatched, 0) AS STRING) || ' ; unbilled=' || CAST(coalesce(l.unbilled, 0) AS STRING)) END, 1, 1000) AS basis
    FROM v_match AS m LEFT JOIN v_po AS p ON p.po = m.po LEFT JOIN (SELECT po, count(*) AS n FROM v_pol GROUP BY po) AS o ON o.po = m.po LEFT JOIN (SELECT po, count(*) AS n FROM v_rec GROUP BY po) AS r ON r.po = m.po
    LEFT JOIN (SELECT invoice_id, @list[verdict; first_idx * 100000 + coalesce(line_idx, 0)] AS lines,
      sum(CASE WHEN kind = 1 THEN 1 ELSE 0 END) AS unmatched, sum(CASE WHEN kind = 2 THEN 1 ELSE 0 END) AS unbilled FROM v_line_verdicts GROUP BY invoice_id) AS l ON l.invoice_id = m.invoice_id""",
)
# Labels are declared by variant, not derived from the rules that they test.
view(
    "v_labels",
    """SELECT d.po, v.variant, v.name, 'INV-' || CAST(d.po AS STRING) || '-' || v.code AS invoice_number, CASE WHEN d.nothing OR v.variant IN (1, 2, 4) THEN 'EXCEPTION' ELSE 'MATCHED' END AS expected_match,
    concat_ws('|', CASE WHEN d.nothing THEN 'receipt_missing' END, CASE v.variant WHEN 1 THEN 'price_over_tolerance' WHEN 2 THEN 'quantity_over_tolerance' WHEN 4 THEN 'line_not_on_po' WHEN 5 THEN 'suspicious_document_content' WHEN 6 THEN 'suspicious_document_content' WHEN 7 THEN 'suspicious_document_content' WHEN 8 THEN 'vendor_not_found' END) AS expected_codes,
    d.nothing OR v.variant NOT IN (0, 3) AS expected_review,
    CASE WHEN v.variant IN (5, 6, 7) THEN 'needs_human_extraction' WHEN v.variant IN (8, 9) THEN 'new_vendor' WHEN d.nothing OR v.variant IN (1, 2, 4) THEN 'pending_human' END AS halt_state,
    CASE v.variant WHEN 5 THEN 'near_white_text' WHEN 6 THEN 'suspicious_text' WHEN 7 THEN 'offpage_text' WHEN 8 THEN 'vendor_not_found' WHEN 9 THEN 'remit_to_mismatch' END AS flag
    FROM (SELECT DISTINCT po, nothing FROM v_honest) AS d CROSS JOIN v_variants AS v""",
)
job("gen_labelled_variants", "SELECT l.*, b.n_lines, b.subtotal FROM v_labels AS l JOIN (SELECT po, variant, count(*) AS n_lines, CAST(sum(extended) AS BIGINT) AS subtotal FROM v_bill GROUP BY po, variant) AS b ON b.po = l.po AND b.variant = l.variant")
