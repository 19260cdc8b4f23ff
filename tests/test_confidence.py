"""Agreement and grounding of readings, golden rows, and what is worked out once a page."""

from payguard.operators.confidence import confidence

READING = "invoice_id long, field string, load_bearing boolean, a string, b string, has_b boolean, blurred boolean"
PAGE = "invoice_id long, page string, raw string, named date, day_first date, month_first date, is_day_first boolean, is_month_first boolean"


def both(spark, readings, pages):
    df = spark.createDataFrame(pages, "invoice_id long, page string, raw string, named string, day_first string, month_first string, is_day_first boolean, is_month_first boolean")
    df = df.withColumns({c: df[c].cast("date") for c in ("named", "day_first", "month_first")})
    return confidence(spark.createDataFrame(readings, READING), df)


def test_golden(spark):
    pages = [(1, "ACME, Ltd. on 03/04/2024 Total 1,234.50", "03/04/2024", None, "2024-04-03", "2024-03-04", None, None), (2, "", "x", None, None, None, None, None), (3, "ACME 4 Mar 2024", None, None, None, None, True, False)]
    readings = [
        (1, "total", True, "1234.50", "1,234.5", True, False), (1, "tax_total", True, "n/a", "n/a", True, False), (1, "invoice_date", True, "2024-04-03", "2024-03-04", True, False),
        (1, "vendor_name", True, "acme ltd", None, False, True), (2, "currency", True, "USD", "USD", True, False), (3, "invoice_date", True, "2024-03-04", "2024-03-04", True, False),
    ]
    got = {(r.invoice_id, r.field): (r.agreed, r.grounded, r.score_thousandths, r.reason) for r in both(spark, readings, pages).collect()}
    assert got == {
        (1, "total"): (True, True, 1000, "agreed_and_grounded"), (1, "tax_total"): (False, False, 100, "readings_disagree"),
        (1, "invoice_date"): (True, True, 400, "ambiguous_date_unknown_locale"), (1, "vendor_name"): (None, True, 360, "single_read, low_sharpness"),
        (2, "currency"): (True, False, 500, "no_text_layer"), (3, "invoice_date"): (True, False, 500, "not_in_text_layer"),
    }


def test_pages_are_normalised_once(spark):
    """Above the join with the readings no pattern runs over a page, where it ran for every field."""
    plan = both(spark, [(1, "total", True, "1", "1", True, False)], [(1, "p", "p", None, None, None, None, None)])._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Join ", 1)
    assert "(page#" not in above and below.count("(page#") >= 2, plan
