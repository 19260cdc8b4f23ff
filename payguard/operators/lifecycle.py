"""Audit trail, lifecycle, approvals, posting, routing and reports."""

import re

from payguard.operators import screening, vendors  # noqa: F401  their views are read here
from payguard.plans.catalog import JOBS, SPARK_JOBS, VIEWS, job, native, view
from payguard.sources.views import BROUGHT

#: Every state change that exists: state, event, next state.
EDGES = (
    ("received", "ingest", "ingested"),
    ("received", "input_flagged", "needs_human_extraction"),
    ("ingested", "extract", "extracted"),
    ("ingested", "extraction_failed", "needs_human_extraction"),
    ("ingested", "output_flagged", "needs_human_extraction"),
    ("needs_human_extraction", "human_extraction_provided", "extracted"),
    ("extracted", "validate", "validated"),
    ("extracted", "validation_failed", "needs_human_extraction"),
    ("validated", "resolve_vendor", "vendor_resolved"),
    ("validated", "vendor_not_found", "new_vendor"),
    ("validated", "remit_to_mismatch", "new_vendor"),
    ("new_vendor", "vendor_onboarded", "vendor_resolved"),
    ("new_vendor", "reject", "rejected"),
    ("vendor_resolved", "check_duplicates", "duplicate_checked"),
    ("vendor_resolved", "duplicate_suspected", "on_hold_duplicate"),
    ("on_hold_duplicate", "not_duplicate", "duplicate_checked"),
    ("on_hold_duplicate", "confirm_duplicate", "rejected"),
    ("duplicate_checked", "match", "matched"),
    ("duplicate_checked", "match_exception", "exception"),
    ("duplicate_checked", "no_po_reference", "non_po"),
    ("exception", "classify", "pending_human"),
    ("pending_human", "rematch", "duplicate_checked"),
    ("pending_human", "accept_with_reason", "matched"),
    ("pending_human", "reject", "rejected"),
    ("matched", "code", "coded"),
    ("non_po", "code", "coded"),
    ("non_po", "reject", "rejected"),
    ("coded", "request_approval", "pending_approval"),
    ("pending_approval", "approve", "approved"),
    ("pending_approval", "request_changes", "exception"),
    ("pending_approval", "match_changed", "exception"),
    ("pending_approval", "reject", "rejected"),
    ("approved", "post", "posted"),
    ("approved", "post_failed", "exception"),
    ("posted", "schedule_payment", "scheduled"),
    ("scheduled", "payment_confirmed", "paid"),
    ("scheduled", "payment_failed", "posted"),
    ("paid", "reconcile", "reconciled"),
    ("reconciled", "close", "closed"),
)
#: States from which an invoice can be cancelled.
CANCELLABLE = (
    "received",
    "ingested",
    "needs_human_extraction",
    "extracted",
    "validated",
    "vendor_resolved",
    "new_vendor",
    "duplicate_checked",
    "on_hold_duplicate",
    "matched",
    "pending_human",
    "non_po",
    "coded",
    "pending_approval",
)
#: Edges for steps that have no tool yet.
STUBS = (("non_po", "coded"), ("matched", "coded"), ("posted", "scheduled"), ("scheduled", "paid"), ("paid", "reconciled"), ("reconciled", "closed"))
#: Events that only a person may raise; states that nothing follows.
HUMAN_ONLY = ("rematch", "accept_with_reason", "reject", "cancel", "approve", "confirm_duplicate", "not_duplicate")
TERMINAL = ("closed", "rejected", "cancelled")
#: What a person may do in which waiting state, and what needs a reason.
DOORS = {
    "pending_human": ("rematch", "accept_with_reason", "reject", "cancel"),
    "on_hold_duplicate": ("confirm_duplicate", "not_duplicate", "cancel"),
    "pending_approval": ("approve", "reject", "cancel"),
}
REASON_REQUIRED = ("accept_with_reason", "not_duplicate", "approve")
#: Who can resolve a reason, in the order in which one leads.
RESOLVERS = (
    ("receipt_missing", "receiving"),
    ("quantity_over_tolerance", "receiving"),
    ("price_over_tolerance", "buyer"),
    ("line_not_on_po", "buyer"),
    ("po_closed", "buyer"),
    ("totals_over_tolerance", "vendor"),
    ("tax_mismatch", "vendor"),
    ("arithmetic_inconsistent", "vendor"),
    ("currency_mismatch", "vendor"),
    ("po_not_found", "ap_clerk"),
    ("missing_po_reference", "ap_clerk"),
    ("po_vendor_mismatch", "controller"),
)
#: Forbidden tools and their prefixes.
FORBIDDEN, FORBIDDEN_PREFIXES = ("pay_bill", "update_vendor", "update_bank_details", "delete_invoice", "delete_vendor"), ("delete_", "pay_")


def edges() -> list[tuple[str, str, str]]:
    return [*EDGES, *((s, "cancel", "cancelled") for s in CANCELLABLE), *((a, "stub_ok", b) for a, b in STUBS)]


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


HAPPY = ("ingest", "extract", "validate", "resolve_vendor", "check_duplicates", "match", "code", "request_approval", "approve", "post", "schedule_payment", "payment_confirmed", "reconcile", "close")
quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)

view("v_edges", _values([(i, *e) for i, e in enumerate(edges())], "nth, from_state, event, to_state"))
view("v_happy", _values([(i, x, next(j for j, e in enumerate(edges()) if e[1] == x and e[0] != "non_po")) for i, x in enumerate(HAPPY)], "nth, event, edge"))
view("v_resolvers", _values([(i, *r) for i, r in enumerate(RESOLVERS)], "nth, code, resolver"))
view("v_doors", _values([(s, e) for s, es in DOORS.items() for e in es], "state, event"))
# The audit trail: one invoice a user, some by the book, others with arbitrary moves.
view("v_steps", "SELECT event_id, ts, user_id AS invoice_id, event_type, value, props, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq FROM events")
view(
    "v_ev",
    f"""SELECT s.event_id, s.ts, s.invoice_id, s.seq, s.event_type, s.props, e.from_state, e.event, e.to_state, CASE WHEN e.event IN ({quoted(HUMAN_ONLY)}) AND s.event_id % 7 <> 0 THEN 'human' WHEN s.event_id % 3 = 0 THEN 'model' ELSE 'rule' END AS actor, s.event_id % 4 <> 0 AS has_reason,
    CASE s.event_id % 6 WHEN 0 THEN 'compute_match' WHEN 1 THEN 'lookup_vendor' WHEN 2 THEN CASE WHEN s.event_id % 50 = 2 THEN 'pay_bill' WHEN s.event_id % 50 = 8 THEN 'delete_record' ELSE 'find_duplicates' END ELSE 'none' END AS tool FROM v_steps AS s
    LEFT JOIN v_happy AS h ON h.nth = s.seq - 1 JOIN v_edges AS e ON e.nth = CASE WHEN s.invoice_id % 3 = 0 AND h.edge IS NOT NULL THEN h.edge ELSE s.event_id % {len(edges())} END""",
)
view("v_moves", "SELECT *, lag(to_state) OVER (PARTITION BY invoice_id ORDER BY seq) AS was FROM v_ev")
job(
    "wf_state_current_and_legal",
    f"""SELECT invoice_id, max_by(to_state, seq) AS state, count(*) AS events, CAST(sum(CASE WHEN from_state <> coalesce(was, 'received') THEN 1 ELSE 0 END) AS BIGINT) AS illegal, CAST(sum(CASE WHEN event IN ({quoted(HUMAN_ONLY)}) AND actor <> 'human' THEN 1 ELSE 0 END) AS BIGINT) AS not_human,
    CAST(sum(CASE WHEN was IN ({quoted(TERMINAL)}) THEN 1 ELSE 0 END) AS BIGINT) AS after_end, min(CASE WHEN from_state <> coalesce(was, 'received') THEN seq END) AS first_illegal FROM v_moves GROUP BY invoice_id""",
)
job(
    "wf_gate_bypass",
    """SELECT invoice_id, seq FROM (SELECT invoice_id, seq, to_state, max(CASE WHEN to_state = 'approved' THEN 1 ELSE 0 END) OVER (PARTITION BY invoice_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS approved FROM v_ev) AS x WHERE to_state = 'posted' AND coalesce(approved, 0) = 0""",
)
view("v_runs", "SELECT invoice_id, @div[seq - 1; 10] AS run, min(ts) AS started, max(ts) AS ended, count(*) AS steps, max(seq) AS last_seq, CAST(sum(CASE WHEN event = 'rematch' THEN 1 ELSE 0 END) AS BIGINT) AS rematches, max_by(event_type, seq) = 'error' AS unfinished FROM v_ev GROUP BY invoice_id, @div[seq - 1; 10]")
job(
    "au_run_health",
    """SELECT r.invoice_id, r.run, r.steps, r.unfinished, CASE WHEN r.unfinished THEN CAST(r.started AS TIMESTAMP) END AS open_since, CAST(sum(CASE WHEN r.unfinished THEN 1 ELSE 0 END) OVER (PARTITION BY r.invoice_id) AS BIGINT) > 1 AS several_open, r.last_seq + 1 AS next_seq, r.rematches > c.max_rematches AS too_many_rematches FROM v_runs AS r CROSS JOIN v_now AS c""",
)
# A link depends on the line before only, so no fold is needed: lag, digest, first break.
view(
    "v_chain",
    """SELECT invoice_id, seq, line, CASE WHEN event_id % 97 = 0 THEN @sha['forged'] ELSE coalesce(@sha[lag(line) OVER (PARTITION BY invoice_id ORDER BY seq)], repeat('0', 64)) END AS prev_hash FROM (SELECT invoice_id, seq, event_id, concat_ws('|', CAST(invoice_id AS STRING), CAST(seq AS STRING), event, to_state, props) AS line FROM v_ev) AS x""",
)
job(
    "au_chain_verify",
    """SELECT invoice_id, count(*) AS lines, max(CASE WHEN prev_hash <> want THEN 1 ELSE 0 END) = 0 AS intact, min(CASE WHEN prev_hash <> want THEN seq - 1 END) AS first_break FROM (SELECT *, coalesce(@sha[lag(line) OVER (PARTITION BY invoice_id ORDER BY seq)], repeat('0', 64)) AS want FROM v_chain) AS x GROUP BY invoice_id""",
)
#: Cents per million tokens, in and out: hundredths of a micro-dollar a token. Costs are whole micro-dollars, halves to even.
PRICES = {"large": (200, 1000), "small": (100, 500), "mini": (15, 75)}
view("v_prices", _values([(m, *rates) for m, rates in PRICES.items()], "model, in_rate, out_rate"))
view(
    "v_calls",
    """SELECT event_id, ts, invoice_id, seq, CASE event_id % 5 WHEN 0 THEN 'large' WHEN 1 THEN 'small' WHEN 2 THEN 'unlisted' WHEN 3 THEN 'mini' END AS model, CAST(@json[props; k] AS BIGINT) * 100 + 1 AS in_tokens, CASE WHEN event_id % 13 <> 0 THEN CAST(@json[props; k] AS BIGINT) * 7 END AS out_tokens FROM v_steps""",
)
view("v_exact_costs", "SELECT c.*, c.in_tokens * p.in_rate + c.out_tokens * p.out_rate AS hundredths FROM v_calls AS c LEFT JOIN v_prices AS p ON p.model = c.model")
view("v_costs", "SELECT event_id, ts, invoice_id, seq, model, @div[hundredths; 100] + CASE WHEN hundredths % 100 > 50 OR (hundredths % 100 = 50 AND @div[hundredths; 100] % 2 = 1) THEN 1 ELSE 0 END AS cost_micro FROM v_exact_costs")
job("fn_model_cost", "SELECT event_id, model, cost_micro FROM v_costs WHERE model IS NOT NULL")
job("au_event_cost", "SELECT invoice_id, @div[seq - 1; 10] AS run, model, count(*) AS calls, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM v_costs WHERE model IS NOT NULL GROUP BY invoice_id, @div[seq - 1; 10], model")
job("st_cost_window_batch", "SELECT @hour[ts] AS hour, count(*) AS calls, CAST(sum(cost_micro) AS BIGINT) AS cost_micro FROM v_costs GROUP BY @hour[ts]")
job("val_forbidden_tools", f"SELECT event_id, invoice_id, tool FROM v_ev WHERE tool IN ({quoted(FORBIDDEN)}) OR " + " OR ".join(f"tool LIKE '{p.replace('_', '!_')}%' ESCAPE '!'" for p in FORBIDDEN_PREFIXES))
job(
    "wf_human_decision_check",
    f"""SELECT v.event_id, v.invoice_id, v.event, CASE WHEN d.event IS NULL THEN 'no_such_door' WHEN NOT v.has_reason AND (v.event IN ({quoted(REASON_REQUIRED)}) OR (v.event = 'reject' AND v.from_state = 'pending_approval')) THEN 'reason_required' WHEN v.event = 'not_duplicate' AND v.invoice_id % 4 = 0 THEN 'exact_number' ELSE 'ok' END AS verdict
    FROM v_ev AS v LEFT JOIN v_doors AS d ON d.state = v.from_state AND d.event = v.event WHERE v.actor = 'human'""",
)
# Approvals: one vote a person, the first that completes a request decides it.
view("v_votes", "SELECT user_id AS approval, event_id % 5 AS person, event_type = 'error' AS is_reject, event_id, ts, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS nth FROM events WHERE event_type IN ('error', 'purchase', 'signup')")
view("v_counted", "SELECT approval, person, is_reject, ts, event_id, 1 + approval % 4 AS needed, sum(CASE WHEN is_reject THEN 0 ELSE 1 END) OVER w AS approvals, sum(CASE WHEN is_reject THEN 1 ELSE 0 END) OVER w AS rejects FROM v_votes WHERE nth = 1 WINDOW w AS (PARTITION BY approval ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
view(
    "v_quorum",
    """SELECT approval, CASE WHEN approval % 37 = 0 THEN 'cancelled' WHEN max(CASE WHEN done AND is_reject THEN 1 ELSE 0 END) = 1 THEN 'rejected' WHEN max(CASE WHEN done THEN 1 ELSE 0 END) = 1 THEN 'approved' ELSE 'pending' END AS status, CAST(max(approvals) AS BIGINT) AS approvals, max(needed) AS needed FROM (
      SELECT *, (rejects > 0 OR approvals >= needed) AND row_number() OVER (PARTITION BY approval, rejects > 0 OR approvals >= needed ORDER BY ts, event_id) = 1 AS done, sum(CASE WHEN rejects > 0 OR approvals >= needed THEN 1 ELSE 0 END) OVER (PARTITION BY approval ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over FROM v_counted) AS x WHERE coalesce(over, 0) = 0 GROUP BY approval""",
)
job("ap_quorum", "SELECT approval, status, approvals, needed FROM v_quorum")
job("ap_first_invoice", "SELECT e.invoice_id, e.vendor, coalesce(n.n - 1, 0) AS others, coalesce(n.n = 1, false) AS first_invoice FROM v_entries AS e LEFT JOIN (SELECT vendor, count(*) AS n FROM v_entries WHERE vendor IS NOT NULL GROUP BY vendor) AS n ON n.vendor = e.vendor")
view(
    "v_conditions",
    """SELECT i.invoice_id, i.total, i.currency, i.source_po, r.vendor IS NULL AS new_vendor, coalesce(n.n = 1, false) AS first_invoice, coalesce(NOT t.remit_matches, false) AS mismatch, coalesce(NOT m.matched, true) AS held
    FROM v_inv AS i JOIN v_resolved AS r ON r.invoice_id = i.invoice_id LEFT JOIN (SELECT vendor, count(*) AS n FROM v_resolved WHERE vendor IS NOT NULL GROUP BY vendor) AS n ON n.vendor = r.vendor LEFT JOIN v_remit AS t ON t.invoice_id = i.invoice_id LEFT JOIN v_match AS m ON m.invoice_id = i.invoice_id""",
)
view("v_booked_conditions", VIEWS["v_conditions"].replace(*BROUGHT).replace("r.vendor", "i.vendor"))
native("v_conditions", lambda of: of("v_booked_conditions"), "v_booked_conditions")
# Tiers and rules are rows: a tier reaches from the ceiling below it to its own; the rules of a version are one row of columns.
view("v_tier_bands", "SELECT t.*, lag(ceiling) OVER (PARTITION BY config_version ORDER BY tier) AS above FROM v_tiers AS t")
RULES = ("new_vendor", "first_invoice_from_vendor", "remit_to_mismatch", "match_exception")
view("v_rule_row", f"SELECT r.config_version, {', '.join(f"max(CASE WHEN rule = '{x}' THEN approvers END) AS n_{x}, max(CASE WHEN rule = '{x}' AND callback THEN 1 ELSE 0 END) AS c_{x}" for x in RULES)} FROM v_rules AS r JOIN v_now AS n ON n.config_version = r.config_version GROUP BY r.config_version")
view("v_fired", f"""SELECT *, {', '.join(f"CASE WHEN {cond} THEN '{x}' END AS f_{x}" for x, cond in zip(RULES, ("new_vendor", "first_invoice", "mismatch", "held")))} FROM v_conditions""")
view(
    "v_required",
    f"""SELECT c.invoice_id, c.total, c.currency, t.tier, t.role, t.ceiling, c.currency <> 'USD' AS other_currency, greatest(t.approvers, {', '.join(f"CASE WHEN c.f_{x} IS NOT NULL THEN r.n_{x} ELSE 0 END" for x in RULES)}) AS required,
    {' + '.join(f"CASE WHEN c.f_{x} IS NOT NULL THEN r.c_{x} ELSE 0 END" for x in RULES)} > 0 AS callback, concat_ws('|', {', '.join(f"c.f_{x}" for x in RULES)}) AS rules
    FROM v_fired AS c CROSS JOIN v_now AS n JOIN v_rule_row AS r ON r.config_version = n.config_version JOIN v_tier_bands AS t ON t.config_version = n.config_version
      AND CASE WHEN c.currency <> 'USD' THEN t.ceiling IS NULL ELSE (t.above IS NULL OR c.total > t.above) AND (t.ceiling IS NULL OR c.total <= t.ceiling) END""",
)
job(
    "ap_requirement",
    """SELECT invoice_id, role, CAST(required AS BIGINT) AS required, rules, callback, false AS auto_approve, 'amount=' || CAST(total AS STRING) || ' ' || currency || ', tier' || CASE WHEN other_currency THEN '=top' WHEN ceiling IS NULL THEN '<= unbounded' ELSE '<= ' || CAST(ceiling AS STRING) END || ', role=' || role || ', required=' || CAST(required AS STRING) || ', rules=' || coalesce(nullif(rules, ''), 'none') || ', hold_for_callback=' || CASE WHEN callback THEN 'yes' ELSE 'no' END AS basis FROM v_required""",
)
# Posting.
view("v_ledger", "SELECT vendor, number_norm, amount FROM v_entries WHERE arrival_seq % 6 = 0 UNION ALL SELECT vendor, number_norm, amount + 1 FROM v_entries WHERE arrival_seq % 30 = 0")
job(
    "po_bill_conflict",
    """SELECT e.invoice_id, CASE WHEN coalesce(l.n, 0) = 0 THEN 'create' WHEN l.n = 1 AND l.amount = e.amount THEN 'already_existed' ELSE 'conflict' END AS outcome FROM v_entries AS e LEFT JOIN (SELECT vendor, number_norm, count(*) AS n, min(amount) AS amount FROM v_ledger GROUP BY vendor, number_norm) AS l ON l.vendor = e.vendor AND l.number_norm = e.number_norm""",
)
# A number is claimed by what has got as far as the duplicate check: its vendor is resolved, and no gate before has sent it back.
job(
    "wf_number_claims",
    """SELECT e.vendor, e.number_norm, count(*) AS claims, min(e.invoice_id) AS first_id FROM v_entries AS e LEFT JOIN v_routes AS r ON r.invoice_id = e.invoice_id
    WHERE e.vendor IS NOT NULL AND coalesce(r.gate, 'duplicate') NOT IN ('input', 'output', 'confidence', 'validation', 'vendor', 'remit') GROUP BY e.vendor, e.number_norm HAVING count(*) > 1""",
)
job(
    "wf_resolver",
    """SELECT o.invoice_id, min_by(o.code, r.nth) AS lead_reason, min_by(r.resolver, r.nth) AS resolver FROM v_ordered_codes AS o JOIN v_resolvers AS r ON r.code = o.code GROUP BY o.invoice_id""",
)
# The pipeline as one batch: the first gate that holds an invoice names its state.
view("v_held_duplicates", "SELECT DISTINCT me_id FROM v_duplicate_pairs WHERE a_number = b_number OR (same_currency AND same_amount AND days <= same_amount_days)")
view(
    "v_routes",
    """SELECT i.invoice_id, CASE WHEN i.variant IN (5, 7) THEN 'input' WHEN f.invoice_id IS NOT NULL THEN 'output' WHEN NOT a.auto_ok THEN 'confidence' WHEN p.flags <> '' THEN 'validation' WHEN r.vendor IS NULL THEN 'vendor' WHEN NOT t.remit_matches THEN 'remit' WHEN d.me_id IS NOT NULL THEN 'duplicate' WHEN m.route = 'non_po' THEN 'non_po' WHEN NOT m.matched THEN 'match' ELSE 'approval' END AS gate
    FROM v_inv AS i LEFT JOIN (SELECT DISTINCT invoice_id FROM v_filter) AS f ON f.invoice_id = i.invoice_id JOIN v_auto_ok AS a ON a.invoice_id = i.invoice_id JOIN v_policy AS p ON p.invoice_id = i.invoice_id JOIN v_resolved AS r ON r.invoice_id = i.invoice_id LEFT JOIN v_remit AS t ON t.invoice_id = i.invoice_id
    LEFT JOIN v_held_duplicates AS d ON d.me_id = i.invoice_id JOIN v_match AS m ON m.invoice_id = i.invoice_id""",
)
job("wf_route", "SELECT invoice_id, gate, CASE gate WHEN 'input' THEN 'needs_human_extraction' WHEN 'output' THEN 'needs_human_extraction' WHEN 'confidence' THEN 'needs_human_extraction' WHEN 'validation' THEN 'needs_human_extraction' WHEN 'vendor' THEN 'new_vendor' WHEN 'remit' THEN 'new_vendor' WHEN 'duplicate' THEN 'on_hold_duplicate' WHEN 'non_po' THEN 'non_po' WHEN 'match' THEN 'pending_human' ELSE 'pending_approval' END AS halt_state FROM v_routes")
job(
    "rep_five_numbers",
    """SELECT 'touchless' AS metric, '' AS item, CAST(sum(CASE WHEN gate = 'approval' THEN 1 ELSE 0 END) AS BIGINT) AS numerator, count(*) AS denominator FROM v_routes
    UNION ALL SELECT 'exceptions', o.code, count(*), max(n.n) FROM v_ordered_codes AS o CROSS JOIN (SELECT count(*) AS n FROM v_inv) AS n GROUP BY o.code
    UNION ALL SELECT 'field_accuracy', field, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT), count(b) FROM v_readings GROUP BY field
    UNION ALL SELECT 'cost_micro', '', CAST(sum(cost_micro) AS BIGINT), count(DISTINCT invoice_id) FROM v_costs
    UNION ALL SELECT 'hours_pending', '', CAST(sum(@hours[until; ts]) AS BIGINT), count(*) FROM (SELECT ts, to_state, lead(ts) OVER (PARTITION BY invoice_id ORDER BY seq) AS until FROM v_ev) AS w WHERE to_state = 'pending_approval' AND until IS NOT NULL""",
)
# For Spark an invoice is one row up to the gates before that of duplicates: what it says of itself, then what its lines, its texts and its readings say. Nothing else is dealt out.
_dated = re.findall(r"CASE WHEN (?:coalesce|@days).*? END", VIEWS["v_policy"])
_remit, _ibans = re.search(r"CASE .* END(?= AS remit_matches)", VIEWS["v_remit"])[0], re.search(r"@all.*(?= AS ibans)", VIEWS["v_ibans"])[0]
view("v_said", f"SELECT d.invoice_id, d.variant, d.vendor, d.subtotal, d.tax_total, d.total, {_dated[0]} AS future, {_dated[1]} AS old, {re.sub(r'[im][.]', 'd.', _remit)} AS remit_matches FROM (SELECT *, {_ibans} AS ibans FROM v_booked_dates) AS d CROSS JOIN v_now AS c CROSS JOIN v_clock AS k")
view("v_booked_arithmetic", VIEWS["v_arithmetic"].replace("SELECT i.invoice_id,", "SELECT i.*,").replace(" AS flags, i.total", " AS flags").replace("v_inv AS i", "v_said AS i"))
view("v_booked_policy", VIEWS["v_policy"].replace(_dated[0], "a.future").replace(_dated[1], "a.old").replace("SELECT a.invoice_id,", "SELECT a.invoice_id, a.variant, a.vendor, a.remit_matches,").split("FROM v_arithmetic")[0] + "FROM v_booked_arithmetic AS a")
_gates = re.search(r"CASE .* END(?= AS gate)", VIEWS["v_routes"])[0]
_early, _late = _gates.split(" WHEN d.me_id", 1)
view("v_early_gates", f"SELECT p.invoice_id, {re.sub(r'[irt][.](?=variant|vendor|remit)', 'p.', _early)} END AS gate FROM v_booked_policy AS p LEFT JOIN (SELECT DISTINCT invoice_id FROM v_booked_filter) AS f ON f.invoice_id = p.invoice_id JOIN v_auto_ok AS a ON a.invoice_id = p.invoice_id")
view("v_booked_routes", f"SELECT e.invoice_id, CASE WHEN e.gate IS NOT NULL THEN e.gate WHEN d.me_id{_late} AS gate FROM v_early_gates AS e LEFT JOIN v_held_duplicates AS d ON d.me_id = e.invoice_id JOIN v_match AS m ON m.invoice_id = e.invoice_id")
native("v_routes", lambda of: of("v_booked_routes"), "v_booked_routes")
# Claims ask for the early gates only; the report counts invoices and readings where the vendors are brought along.
SPARK_JOBS["wf_number_claims"] = JOBS["wf_number_claims"].replace("v_routes", "v_early_gates")
SPARK_JOBS["rep_five_numbers"] = JOBS["rep_five_numbers"].replace("v_inv", "v_resolved_inv").replace("v_readings", "v_booked_readings")
