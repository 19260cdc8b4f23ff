"""Vendor resolution and duplicate detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.functions.text import norm, normalised
from payguard.plans.catalog import VIEWS, job, native, view


def bare(x: str | Column) -> Column:
    """A tax id's letters and digits in lower case; null where there are none."""
    return F.nullif(F.lower(F.regexp_replace(x, "[^0-9A-Za-z]", "")), F.lit(""))


def resolve(invoices: DataFrame, vendors: DataFrame, *kept: str) -> DataFrame:
    """invoice_id, vendor_tax_id, vendor_name against vendor, tax_id, display_name -> invoice_id, vendor, basis, candidates and what is kept of invoices.

    The tax id is asked first; hits there, even several, end the search. One hit is the vendor;
    of several the first five by number are candidates. The master is grouped by key before invoices
    meet it, so an invoice is one row throughout.
    """
    # of a key that very many vendors have, five are carried
    least = lambda xs: F.slice(F.array_sort(xs), 1, 5)

    def by(key: Column, name: str) -> DataFrame:
        named = vendors.select(key.alias(name), "vendor").filter(F.col(name).isNotNull())
        part = named.groupBy(name, F.pmod(F.hash("vendor"), F.lit(16)).alias("p")).agg(F.count(F.lit(1)).alias("n"), least(F.collect_list("vendor")).alias("some"))
        whole = part.groupBy(name).agg(F.sum("n").alias("n"), least(F.flatten(F.collect_list("some"))).alias("some"))
        return whole.select(name, F.struct("n", "some").alias(f"{name}_hit"))

    name = lambda x: F.nullif(normalised(F.coalesce(F.col(x), F.lit(""))), F.lit(""))
    asked = invoices.select("invoice_id", *kept, bare("vendor_tax_id").alias("tax"), name("vendor_name").alias("name"))
    both = asked.join(by(bare("tax_id"), "tax"), "tax", "left").join(by(name("display_name"), "name"), "name", "left")
    hit = both.select("invoice_id", *kept, F.coalesce("tax_hit", "name_hit").alias("h"), F.col("tax_hit").isNotNull().alias("by_tax"))
    one = F.coalesce(F.col("h.n") == 1, F.lit(False))
    basis = F.when(one & F.col("by_tax"), "tax_id_exact").when(one, "name_exact").otherwise("unresolved")
    return hit.select("invoice_id", F.when(one, F.col("h.some")[0]).alias("vendor"), basis.alias("basis"), F.coalesce(F.array_join(F.col("h.some").cast("array<string>"), "|"), F.lit("")).alias("candidates"), *kept)


view("v_asked", f"SELECT invoice_id, source_po, nullif(lower(@sub[vendor_tax_id; '[^0-9A-Za-z]'; '']), '') AS tax_norm, nullif({norm('vendor_name')}, '') AS name_norm, remit_to FROM v_inv")
# Tax id first; more than one hit there ends the search. The five first hits in master order are candidates.
view(
    "v_tier_hits",
    """SELECT a.invoice_id, 1 AS tier, m.vendor, CAST(count(*) OVER (PARTITION BY a.invoice_id) AS BIGINT) AS hits, row_number() OVER (PARTITION BY a.invoice_id ORDER BY m.vendor) AS nth FROM v_asked AS a JOIN v_norm_vendor AS m ON m.tax_norm = a.tax_norm
    UNION ALL SELECT a.invoice_id, 2, m.vendor, CAST(count(*) OVER (PARTITION BY a.invoice_id) AS BIGINT), row_number() OVER (PARTITION BY a.invoice_id ORDER BY m.vendor) FROM v_asked AS a JOIN v_norm_vendor AS m ON m.name_norm = a.name_norm""",
)
view("v_hits", "SELECT invoice_id, tier, max(hits) AS hits, min(vendor) AS vendor, @list[CASE WHEN nth <= 5 THEN CAST(vendor AS STRING) END; nth] AS candidates FROM v_tier_hits GROUP BY invoice_id, tier")
# Fixed value: an account number as printed, in fours or run together. Every one on the page counts, so that a second one can't hide behind the first.
view("v_ibans", r"SELECT invoice_id, @all[upper(remit_to); '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b'] AS ibans FROM v_asked WHERE remit_to IS NOT NULL")
view(
    "v_resolved",
    """SELECT a.invoice_id, CASE WHEN h.hits = 1 THEN h.vendor END AS vendor, CASE WHEN h.hits = 1 AND h.tier = 1 THEN 'tax_id_exact' WHEN h.hits = 1 THEN 'name_exact' ELSE 'unresolved' END AS basis, coalesce(h.candidates, '') AS candidates
    FROM v_asked AS a LEFT JOIN (SELECT t.* FROM v_hits AS t JOIN (SELECT invoice_id, min(tier) AS tier FROM v_hits GROUP BY invoice_id) AS f ON f.invoice_id = t.invoice_id AND f.tier = t.tier) AS h ON h.invoice_id = a.invoice_id""",
)
# For Spark the invoices are kept with their vendors, so that no job joins the two.
native("v_resolved_inv", lambda of: resolve(of("v_inv"), of("v_vm"), *[c for c in of("v_inv").columns if c != "invoice_id"]), "v_inv", "v_vm")
native("v_resolved", lambda of: of("v_resolved_inv").select("invoice_id", "vendor", "basis", "candidates"), "v_resolved_inv")
# Three values: no comparison is not a mismatch.
view(
    "v_remit",
    r"""SELECT r.invoice_id, CASE WHEN m.remit_sha256 IS NOT NULL AND @n[i.ibans] > 0 THEN @every[i.ibans; @sha[@sub[x; '\s'; '']] = m.remit_sha256] END AS remit_matches
    FROM v_resolved AS r JOIN v_vm AS m ON m.vendor = r.vendor LEFT JOIN v_ibans AS i ON i.invoice_id = r.invoice_id""",
)
# For Spark the invoices bring their vendors and remittance blocks.
view("v_booked_ibans", VIEWS["v_ibans"].replace("SELECT invoice_id,", "SELECT invoice_id, vendor,").replace("v_asked WHERE remit_to IS NOT NULL", "v_resolved_inv WHERE vendor IS NOT NULL"))
view("v_booked_remit", VIEWS["v_remit"].replace("r.invoice_id", "i.invoice_id", 1).replace("v_resolved AS r JOIN v_vm AS m ON m.vendor = r.vendor LEFT JOIN v_ibans AS i ON i.invoice_id = r.invoice_id", "v_booked_ibans AS i JOIN v_vm AS m ON m.vendor = i.vendor"))
native("v_remit", lambda of: of("v_booked_remit"), "v_booked_remit")
job("vn_resolve", "SELECT r.*, t.remit_matches FROM v_resolved AS r LEFT JOIN v_remit AS t ON t.invoice_id = r.invoice_id")
job("fn_remit_matches", "SELECT * FROM v_remit")
job("fn_remit_fingerprint", "SELECT invoice_id, @sha[upper(@sub[remit_to; '\\s'; ''])] AS fingerprint FROM v_inv")
job("fn_norm_vendor_name", f"SELECT vendor, display_name, {norm('display_name')} AS name_norm FROM v_vm")
job("fn_norm_invoice_number", "SELECT invoice_id, substr(coalesce(nullif(upper(@sub[invoice_number; '[^0-9A-Za-z]'; '']), ''), trim(invoice_number)), 1, 64) AS number_norm FROM v_entries")
job("fn_norm_tax_id", "SELECT invoice_id, lower(@sub[vendor_tax_id; '[^0-9A-Za-z]'; '']) AS tax_norm FROM v_inv")
job("fn_norm_ref", "SELECT invoice_id, line_idx, nullif(lower(trim(po_line_ref)), '') AS ref_norm FROM v_inl")
job("fn_idempotency_key", "SELECT invoice_id, CASE WHEN @like[number_norm; '^[0-9A-Z]{1,21}$'] THEN 'bill:' || CAST(vendor AS STRING) || ':' || number_norm END AS idempotency_key FROM v_entries")
# Dates fall into 30-day buckets; an entry meets its own and both neighbours, so the join is on equal keys.
view(
    "v_candidates",
    """SELECT me_id, other_id FROM (
      SELECT a.invoice_id AS me_id, b.invoice_id AS other_id FROM v_entries AS a JOIN v_entries AS b ON b.vendor = a.vendor AND b.number_norm = a.number_norm AND b.arrival_seq < a.arrival_seq
      UNION SELECT a.invoice_id, b.invoice_id FROM (SELECT e.*, @div[@days[e.invoice_date; DATE '1990-01-01']; 30] + n.d AS bucket FROM v_entries AS e CROSS JOIN (SELECT * FROM (VALUES (-1), (0), (1)) AS t(d)) AS n) AS a
        JOIN (SELECT e.*, @div[@days[e.invoice_date; DATE '1990-01-01']; 30] AS bucket FROM v_entries AS e) AS b ON b.vendor = a.vendor AND b.bucket = a.bucket AND b.arrival_seq < a.arrival_seq AND abs(@days[a.invoice_date; b.invoice_date]) <= 30) AS u""",
)
job("dd_candidates", "SELECT me_id, other_id FROM v_candidates")
view(
    "v_duplicate_pairs",
    """SELECT c.me_id, c.other_id, a.number_norm AS a_number, b.number_norm AS b_number, abs(@days[a.invoice_date; b.invoice_date]) AS days, a.amount = b.amount AS same_amount, a.currency = b.currency AS same_currency,
    abs(a.amount - b.amount) * 1000 <= greatest(abs(a.amount), abs(b.amount)) * g.amount_tolerance_permille AS near_amount, g.date_window_days, g.same_amount_days, g.number_similarity_pct
    FROM v_candidates AS c JOIN v_entries AS a ON a.invoice_id = c.me_id JOIN v_entries AS b ON b.invoice_id = c.other_id CROSS JOIN v_now AS g""",
)
# The rules that need no similarity; the full rule set is a query of its own.
job(
    "dd_exact_and_amount",
    """SELECT me_id, min_by(other_id, rank) AS other_id, min_by(rule, rank) AS rule, max(compared) AS candidates_compared FROM (
      SELECT me_id, other_id, rule, prec * 1000000000000000000 + days * 1000000000000000 + other_id AS rank, compared FROM (
        SELECT me_id, other_id, days, count(*) OVER (PARTITION BY me_id) AS compared, CASE WHEN a_number = b_number THEN 'exact_number' WHEN same_currency AND same_amount AND days <= same_amount_days THEN 'same_amount' END AS rule,
          CASE WHEN a_number = b_number THEN CAST(0 AS BIGINT) ELSE CAST(2 AS BIGINT) END AS prec FROM v_duplicate_pairs) AS x WHERE rule IS NOT NULL) AS y GROUP BY me_id""",
)
