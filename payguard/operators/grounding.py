"""Dates and amounts of a reading on the page that it was read from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payguard.functions.printed import date_runs, occurs, on_page
from payguard.functions.text import norm, normalised
from payguard.operators import screening  # noqa: F401  its views are read here
from payguard.plans.catalog import job, native, view

# A page with several dates: the printed one, the due date in full and cut short, a period, and words that are no month.
view(
    "v_date_pages",
    """SELECT d.invoice_id, d.raw || ', due ' || CAST(i.due_date AS STRING) || ' (' || substr(CAST(i.due_date AS STRING), 3) || '), Floor 6 Building 2026, period ' || CAST(month(i.received_on) AS STRING) || '.' || CAST(day(i.received_on) AS STRING) || '.' || CAST(year(i.received_on) AS STRING)
    || CASE WHEN i.source_po % 3 = 0 THEN ' to ' || CAST(day(i.due_date) AS STRING) || '/' || CAST(month(i.due_date) AS STRING) || '.24' WHEN i.source_po % 3 = 1 THEN ' to Sept. ' || CAST(day(i.due_date) AS STRING) || ' 2031' ELSE ' to 31-02-99' END AS page
    FROM v_raw_dates AS d JOIN v_inv AS i ON i.invoice_id = d.invoice_id""",
)


def v_date_list(of: Callable[[str], DataFrame]) -> DataFrame:
    """invoice_id, nth (from 0), text, kind, day_first, month_first, ambiguous: every date on the page."""
    runs = of("v_date_pages").select("invoice_id", F.posexplode(date_runs(F.col("page"))).alias("nth", "d"))
    return runs.select("invoice_id", F.col("nth").cast("long").alias("nth"), "d.text", "d.kind", "d.day_first", "d.month_first", "d.ambiguous")


_DAY_NAME, _NAME_DAY = r"\b[0-9]{1,2}\s+[A-Za-z]{3,9}\.?,?\s+[0-9]{4}\b", r"\b[A-Za-z]{3,9}\.?\s+[0-9]{1,2},?\s+[0-9]{4}\b"
_same = lambda a, b, c: "|".join(rf"\b[0-9]{{{a}}}{s}[0-9]{{{b}}}{s}[0-9]{{{c}}}\b" for s in ("/", r"\.", "-"))
_MONTH_AT = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], left(lower(regexp_extract(x, '[A-Za-z]+')), 3))"
_made = lambda y, m, d: f"CAST(try_strptime(CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END || '-' || {m} || '-' || {d}, '%Y-%m-%d') AS DATE)"
# The other engine has no back-references: one alternative a separator.
view(
    "v_date_list",
    f"""SELECT invoice_id, nth, x AS text, kind, CASE kind WHEN 'numeric' THEN {_made('n[3]', 'n[2]', 'n[1]')} WHEN 'year_first' THEN {_made('n[1]', 'n[2]', 'n[3]')} ELSE {_made('n[2]', _MONTH_AT, 'n[1]')} END AS day_first,
      CASE kind WHEN 'numeric' THEN {_made('n[3]', 'n[1]', 'n[2]')} WHEN 'year_first' THEN {_made('n[1]', 'n[2]', 'n[3]')} ELSE {_made('n[2]', _MONTH_AT, 'n[1]')} END AS month_first,
      kind = 'numeric' AND NOT contains(x, '-') AND n[1] <= 12 AND n[2] <= 12 AS ambiguous FROM (
      SELECT invoice_id, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY k, i) - 1 AS BIGINT) AS nth, x, kind, list_transform(regexp_extract_all(x, '[0-9]+'), lambda v: CAST(v AS INTEGER)) AS n FROM (
        SELECT invoice_id, sure, k, kind, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (
          SELECT invoice_id, l1 || l2 || l3 AS sure, unnest([1, 2, 3, 4]) AS k, unnest(['day_name', 'name_day', 'year_first', 'numeric']) AS kind, unnest([l1, l2, l3, l4]) AS xs FROM (
            SELECT invoice_id, list_filter(regexp_extract_all(page, '{_DAY_NAME}'), lambda x: {_MONTH_AT} > 0) AS l1, list_filter(regexp_extract_all(page, '{_NAME_DAY}'), lambda x: {_MONTH_AT} > 0) AS l2,
              regexp_extract_all(page, '{_same(4, '1,2', '1,2')}') AS l3, regexp_extract_all(page, '{_same('1,2', '1,2', '2,4')}') AS l4 FROM v_date_pages) AS a) AS b) AS c
        WHERE kind <> 'numeric' OR NOT coalesce(list_bool_or(list_transform(sure, lambda s: contains(s, x))), false)) AS d""",
)
native("v_date_list", v_date_list, "v_date_pages")
job("fn_parse_raw_date", "SELECT * FROM v_date_list")


def v_grounded(of: Callable[[str], DataFrame]) -> DataFrame:
    """invoice_id, field, grounded (the amount is in the text under some grouping), runs (numeric runs of that value)."""
    inv, pages = of("v_inv"), of("v_page_text").select("invoice_id", "page")
    fields = [F.struct(F.lit(f).alias("field"), (F.col(f).cast("decimal(20,0)") / 100).cast("decimal(38,6)").alias("value")) for f in ("subtotal", "tax_total", "total")]
    values = inv.select("invoice_id", F.inline(F.array(*fields)))
    counted = on_page(values, pages, "invoice_id", "page").join(pages, "invoice_id")
    return counted.select("invoice_id", "field", occurs(F.col("value"), F.col("page")).alias("grounded"), "runs")


# Pages separate their numbers by spaces, so the other engine takes words that are wholly numbers.
view(
    "v_grounded",
    r"""SELECT f.invoice_id, f.field, contains(replace(t.page, ',', ''), CASE WHEN f.value % 100 = 0 THEN CAST(f.value // 100 AS VARCHAR) ELSE rtrim(f.value // 100 || '.' || lpad(CAST(f.value % 100 AS VARCHAR), 2, '0'), '0') END) AS grounded, coalesce(r.runs, 0) AS runs
    FROM (SELECT invoice_id, 'subtotal' AS field, subtotal AS value FROM v_inv UNION ALL SELECT invoice_id, 'tax_total', tax_total FROM v_inv UNION ALL SELECT invoice_id, 'total', total FROM v_inv) AS f
    JOIN v_page_text AS t ON t.invoice_id = f.invoice_id
    LEFT JOIN (SELECT invoice_id, CAST(round(CAST(replace(w, ',', '') AS DOUBLE) * 100) AS BIGINT) AS value, count(*) AS runs FROM (SELECT invoice_id, rtrim(unnest(string_split(page, ' ')), ',') AS w FROM v_page_text) AS w
      WHERE regexp_full_match(w, '[0-9]{1,3}(,[0-9]{3})*\.[0-9]{2}|[0-9]+(\.[0-9]{2})?') GROUP BY ALL) AS r ON r.invoice_id = f.invoice_id AND r.value = f.value""",
)
native("v_grounded", v_grounded, "v_inv", "v_page_text")
job("fn_grounded_number", "SELECT * FROM v_grounded")


def v_grounded_name(of: Callable[[str], DataFrame]) -> DataFrame:
    pages = of("v_page_text").join(of("v_inv").select("invoice_id", "vendor_name"), "invoice_id")
    return pages.select("invoice_id", F.coalesce(normalised(F.col("page")).contains(F.nullif(normalised(F.col("vendor_name")), F.lit(""))), F.lit(False)).alias("name_grounded"))


view("v_grounded_name", f"SELECT t.invoice_id, coalesce(position(nullif(t.name_norm, '') IN {norm('t.page')}) > 0, false) AS name_grounded FROM v_page_text AS t")
native("v_grounded_name", v_grounded_name, "v_page_text", "v_inv")
job("fn_grounded_text", "SELECT * FROM v_grounded_name")
