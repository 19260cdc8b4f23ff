"""The match at another time or under another version: replay of decisions, refresh of waiting approvals.

Both put cases in the place of invoices: a case is an invoice under one version, or with the
order and the receipts as they stood at one moment. All cases go through one three-way match,
so the lines are paired and summed once however many versions or moments there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.operators import matching  # noqa: F401  its views are copied here
from payguard.operators.threeway import JUDGED, asking, judged, paired_lines
from payguard.plans.catalog import VIEWS, job, native, variant, view


def _codes(reasons: str | Column) -> Column:
    return F.filter(F.split(reasons, r"\|"), lambda x: x != "")


def replay(decisions: DataFrame, invoices: DataFrame, lines: DataFrame, orders: DataFrame, order_lines: DataFrame, receipts: DataFrame, configs: DataFrame, now: str) -> DataFrame:
    """Decisions (invoice_id, config_version) again under the version they were made under, and under ``now``.

    Returns invoice_id, config_version, refused, reasons, reasons_now, and codes that only one of
    the two gives. A decision under a version that ``configs`` doesn't have is refused: it has no
    reasons at all rather than those of another version. ``now`` must be one of ``configs``.
    """
    unknown = decisions.join(configs.select("config_version"), "config_version", "left_anti").select("invoice_id", "config_version")
    known = decisions.join(configs.select("config_version"), "config_version", "left_semi").select("invoice_id", F.col("config_version").alias("own"))
    versions = F.array_distinct(F.array(F.col("own"), F.lit(now)))
    asked = invoices.join(known.groupBy("invoice_id").agg(F.array_distinct(F.flatten(F.collect_list(versions))).alias("cases")), "invoice_id")
    rows = paired_lines(lines, invoices, order_lines, receipts, asked.filter("po_ref is not null").select(F.col("po_ref").alias("po"), "invoice_id", "cases"))
    case = lambda df: df.withColumn("config_version", F.explode("cases")).drop("cases").withColumn("invoice_id", F.struct("invoice_id", "config_version"))
    matched = judged(case(asked), case(rows), totalled(orders, order_lines), configs)
    matched = matched.select(F.col("invoice_id.invoice_id").alias("invoice_id"), "config_version", "reasons")
    both = known.join(matched, "invoice_id").groupBy("invoice_id", F.col("own").alias("config_version")).agg(
        F.max(F.when(F.col("config_version") == F.col("own"), F.col("reasons"))).alias("reasons"), F.max(F.when(F.col("config_version") == now, F.col("reasons"))).alias("reasons_now")
    )
    only = lambda a, b: F.array_join(F.array_sort(F.array_except(_codes(a), _codes(b))), "|")
    none = F.lit(None).cast("string")
    told = both.select("invoice_id", "config_version", F.lit(False).alias("refused"), "reasons", "reasons_now", only("reasons", "reasons_now").alias("only_then"), only("reasons_now", "reasons").alias("only_now"))
    return told.union(unknown.select("invoice_id", "config_version", F.lit(True), none, none, none, none))


def totalled(orders: DataFrame, order_lines: DataFrame) -> DataFrame:
    """Orders, or their states, with the sum of their lines."""
    return orders if "po_total" in orders.columns else orders.join(order_lines.groupBy("po").agg(F.sum("extended").alias("po_total")), "po", "left")


def orders_as_of(cases: DataFrame, history: DataFrame) -> DataFrame:
    """(case, po, at) and (po, since, status, vendor, currency, po_total) -> the same columns of the latest state by then, with po the case.

    An order that is not there yet, or whose latest state is null (it vanished), has no row.
    """
    met = cases.select("case", "po", "at").join(history, "po").filter("since <= at")
    last = met.groupBy("case").agg(F.max_by(F.struct("status", "vendor", "currency", "po_total"), "since").alias("o"))
    return last.filter("o.status is not null").select(F.col("case").alias("po"), "o.*")


def refresh(requests: DataFrame, invoices: DataFrame, lines: DataFrame, history: DataFrame, order_lines: DataFrame, receipt_docs: DataFrame | None, config: DataFrame) -> DataFrame:
    """Waiting approvals (invoice_id, requested_at, checked_at: hours) matched as of both moments.

    Returns invoice_id, outcome, before, after, added. A request younger than the configured
    hours, or without an order when it was made, stays ``fresh``. The others are matched with order
    and receipts as they stood at the request and at the check: a code that the approvers did
    not see (an order that vanished is ``po_not_found``) makes it ``cancelled``, else it is ``refreshed``.
    history: po, since, status (null: gone), vendor, currency. receipt_docs: po, line_no, qty, at;
    order lines may bring them as ``received``, an array of (at, qty). Lines are paired once for both moments.
    """
    c = config.select("refresh_hours")
    waiting = requests.join(invoices.select("invoice_id", "po_ref"), "invoice_id").crossJoin(F.broadcast(c))
    stale = waiting.filter((F.col("checked_at") - F.col("requested_at") >= F.col("refresh_hours")) & F.col("po_ref").isNotNull())
    moments = F.array(F.struct(F.lit(0).alias("nth"), F.col("requested_at").alias("at")), F.struct(F.lit(1).alias("nth"), F.col("checked_at").alias("at")))
    cases = stale.select("invoice_id", F.col("po_ref").alias("po"), F.inline(moments))
    cases = cases.withColumn("case", F.struct("invoice_id", "nth"))
    orders = orders_as_of(cases, totalled(history, order_lines))
    if "received" not in order_lines.columns:
        docs = receipt_docs.groupBy("po", "line_no").agg(F.collect_list(F.struct("at", "qty")).alias("received"))
        order_lines = order_lines.join(docs, ["po", "line_no"], "left")
    rows = paired_lines(lines.drop("po"), invoices, order_lines, None, stale.select(F.col("po_ref").alias("po"), "invoice_id", moments.alias("cases")))
    rows = rows.withColumn("case", F.explode("cases")).drop("cases")
    by_then = F.aggregate(F.filter("hit.received", lambda d: d["at"] <= F.col("case.at")), F.lit(0).cast("long"), lambda n, d: n + d["qty"])
    rows = rows.withColumns({"hit": F.struct("hit.line_no", "hit.price", by_then.alias("received")), "invoice_id": F.struct("invoice_id", "case.nth")})
    asked = invoices.drop("config_version").join(cases.select("invoice_id", "case"), "invoice_id").withColumns({"invoice_id": F.col("case"), "po_ref": F.col("case")}).drop("case")
    matched = judged(asked, rows, orders, config)
    side = lambda n, x: F.max(F.when(F.col("invoice_id.nth") == n, F.col(x)))
    both = matched.groupBy(F.col("invoice_id.invoice_id").alias("of")).agg(side(0, "reasons").alias("before"), side(1, "reasons").alias("after"), side(0, "route").alias("route"))
    both = both.filter("route = 'match'")
    added = F.array_join(F.array_sort(F.array_except(_codes("after"), _codes("before"))), "|")
    all_ = requests.select("invoice_id").join(both, F.col("invoice_id") == F.col("of"), "left").withColumn("added", F.coalesce(added, F.lit("")))
    outcome = F.when(F.col("of").isNull(), "fresh").when(F.col("added") != "", "cancelled").otherwise("refreshed")
    return all_.select("invoice_id", outcome.alias("outcome"), "before", "after", "added")


# Some decisions were made under an older version, some under one that no table has.
view("v_decisions", "SELECT invoice_id, CASE source_po % 9 WHEN 0 THEN 'v0' WHEN 1 THEN 'v7' ELSE 'v1' END AS config_version FROM v_inv")
# What an order said, from which hour on; some are closed or gone after a while. Receipts by document and hour.
view(
    "v_po_history",
    """SELECT po, since, status, vendor, currency FROM (SELECT po, vendor, currency, status, @days[po_date; DATE '1990-01-01'] * 24 AS since FROM v_po) AS a
    UNION ALL SELECT po, (@days[po_date; DATE '1990-01-01'] + 9) * 24, 'closed', vendor, currency FROM v_po WHERE po % 13 = 0
    UNION ALL SELECT po, (@days[po_date; DATE '1990-01-01'] + 10) * 24, CAST(NULL AS STRING), vendor, currency FROM v_po WHERE po % 17 = 0""",
)
view("v_receipt_docs", "SELECT po, line_no, qty, @days[received_on; DATE '1990-01-01'] * 24 AS at FROM v_grn")
view(
    "v_requests",
    """SELECT i.invoice_id, (@days[o.po_date; DATE '1990-01-01'] + 5 + i.source_po % 8) * 24 AS requested_at, (@days[o.po_date; DATE '1990-01-01'] + 5 + i.source_po % 8) * 24 + i.source_po * 5 % 110 AS checked_at FROM v_inv AS i JOIN v_po AS o ON o.po = i.source_po""",
)


# The same over what the order book holds, for Spark: an order's total comes along, and an invoice's date is three days after its order's.
view("v_booked_history", re.sub(r"\bv_po\b", "v_booked_po", VIEWS["v_po_history"]).replace("currency", "currency, po_total"))
view("v_booked_requests", VIEWS["v_requests"].replace("o.po_date", "i.invoice_date - 3").replace(" JOIN v_po AS o ON o.po = i.source_po", ""))
native("v_requests", lambda of: of("v_booked_requests"), "v_booked_requests")


def v_replayed(of: Callable[[str], DataFrame]) -> DataFrame:
    return replay(of("v_decisions"), of("v_resolved_inv"), asking(of, *JUDGED), of("v_booked_po"), of("v_booked_pol"), None, of("v_cfg"), "v1")


def v_refreshed(of: Callable[[str], DataFrame]) -> DataFrame:
    return refresh(of("v_requests"), of("v_resolved_inv"), asking(of, *JUDGED), of("v_booked_history"), of("v_dated_pol"), None, of("v_now"))


# For the other engine the rules are views over other views: of an older version, or of the tables as of two moments.
RULES = ("v_keys", "v_ref_keys", "v_desc_keys", "v_pairs", "v_qty", "v_price", "v_charges", "v_header", "v_eligible", "v_codes", "v_ordered_codes", "v_reasons", "v_match")
view("v_now_old", "SELECT * FROM v_cfg WHERE config_version = 'v0'")
variant("_old", {"v_now": "v_now_old"}, *RULES)
ONLY = "(SELECT string_agg(x, '|' ORDER BY x) FROM (SELECT unnest(string_split({0}, '|')) AS x) AS t WHERE x <> '' AND NOT list_contains(string_split({1}, '|'), x))"
view(
    "v_replayed",
    f"""SELECT invoice_id, config_version, refused, reasons, reasons_now, CASE WHEN NOT refused THEN coalesce({ONLY.format("reasons", "reasons_now")}, '') END AS only_then, CASE WHEN NOT refused THEN coalesce({ONLY.format("reasons_now", "reasons")}, '') END AS only_now FROM (
      SELECT d.invoice_id, d.config_version, c.config_version IS NULL AS refused, CASE d.config_version WHEN 'v0' THEN o.reasons WHEN 'v1' THEN m.reasons END AS reasons, CASE WHEN c.config_version IS NOT NULL THEN m.reasons END AS reasons_now
      FROM v_decisions AS d LEFT JOIN v_cfg AS c ON c.config_version = d.config_version JOIN v_match AS m ON m.invoice_id = d.invoice_id JOIN v_match_old AS o ON o.invoice_id = d.invoice_id) AS r""",
)
native("v_replayed", v_replayed, "v_decisions", "v_resolved_inv", "v_resolved_inv", "v_asking_inl", "v_booked_po", "v_booked_pol", "v_cfg")
job("mt_replay_versions", "SELECT * FROM v_replayed")

view("v_cases", "SELECT r.invoice_id * 2 + n.nth AS case_id, r.invoice_id, i.po_ref AS po, CASE WHEN n.nth = 0 THEN r.requested_at ELSE r.checked_at END AS at FROM v_requests AS r JOIN v_inv AS i ON i.invoice_id = r.invoice_id CROSS JOIN v_now AS c CROSS JOIN (SELECT * FROM (VALUES (0), (1)) AS t(nth)) AS n WHERE i.po_ref IS NOT NULL AND r.checked_at - r.requested_at >= c.refresh_hours")
view("v_inv_snap", "SELECT c.case_id AS invoice_id, c.case_id AS po_ref, i.currency, i.subtotal, i.tax_total, i.total FROM v_cases AS c JOIN v_inv AS i ON i.invoice_id = c.invoice_id")
view("v_inl_snap", "SELECT c.case_id AS invoice_id, l.line_idx, l.description, l.po_line_ref, l.qty, l.price, l.extended, l.tax_pct FROM v_cases AS c JOIN v_inl AS l ON l.invoice_id = c.invoice_id")
view("v_resolved_snap", "SELECT c.case_id AS invoice_id, r.vendor FROM v_cases AS c JOIN v_resolved AS r ON r.invoice_id = c.invoice_id")
view("v_pol_snap", "SELECT c.case_id AS po, p.line_no, p.item_ref, p.description, p.price, p.qty, p.extended FROM v_cases AS c JOIN v_pol AS p ON p.po = c.po")
view(
    "v_po_snap",
    "SELECT po, status, vendor, currency FROM (SELECT c.case_id AS po, h.status, h.vendor, h.currency, row_number() OVER (PARTITION BY c.case_id ORDER BY h.since DESC) AS nth FROM v_cases AS c JOIN v_po_history AS h ON h.po = c.po AND h.since <= c.at) AS x WHERE nth = 1 AND status IS NOT NULL",
)
view("v_rec_snap", "SELECT c.case_id AS po, d.line_no, CAST(sum(d.qty) AS BIGINT) AS received FROM v_cases AS c JOIN v_receipt_docs AS d ON d.po = c.po AND d.at <= c.at GROUP BY c.case_id, d.line_no")
variant("_snap", {x: x + "_snap" for x in ("v_inv", "v_inl", "v_resolved", "v_pol", "v_po", "v_rec")}, *RULES)
view(
    "v_refreshed",
    f"""SELECT invoice_id, CASE WHEN before IS NULL THEN 'fresh' WHEN added <> '' THEN 'cancelled' ELSE 'refreshed' END AS outcome, before, after, added FROM (
      SELECT r.invoice_id, x.before, x.after, coalesce(CASE WHEN x.before IS NOT NULL THEN {ONLY.format("x.after", "x.before")} END, '') AS added FROM v_requests AS r LEFT JOIN (
        SELECT b.invoice_id // 2 AS of, b.reasons AS before, a.reasons AS after FROM v_match_snap AS b JOIN v_match_snap AS a ON a.invoice_id = b.invoice_id + 1 WHERE b.invoice_id % 2 = 0 AND b.route = 'match') AS x ON x.of = r.invoice_id) AS y""",
)
native("v_refreshed", v_refreshed, "v_requests", "v_resolved_inv", "v_resolved_inv", "v_asking_inl", "v_booked_history", "v_dated_pol", "v_now")
job("ap_refresh", "SELECT * FROM v_refreshed")
