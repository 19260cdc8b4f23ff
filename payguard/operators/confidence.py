"""Extraction confidence: do two readings of a field agree, and is the value on the page?"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from payguard.functions.text import ratio_bound, similarity
from payguard.plans.catalog import native

#: Thousandths by agreement (null: one reading only) and grounding; ceilings of dates; a blurred page's share.
AGREED, SINGLE, DISAGREED = (1000, 500), (600, 300), (200, 100)
OPEN_DATE, RESOLVED_DATE, BLURRED_TENTHS = 400, 900, 6
NAMES_ALIKE = 0.9
MONEY = ("subtotal", "tax_total", "total")
#: The columns of an invoice that its readings are made of.
READ = ("source_po", "vendor_name", "invoice_number", "invoice_date", "currency", *MONEY)


def plain_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9 ]+", " "), " +", " "))


def without_grouping(x: Column) -> Column:
    return F.regexp_replace(x, r"(?<=\d)[,    ](?=\d)", "")


def confidence(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds agreed, grounded, score_thousandths and reason to each reading of a field.

    readings: invoice_id, field, load_bearing, a, b (texts), has_b, blurred. pages: invoice_id, page
    (empty: a scan), raw (the date as printed), named, day_first, month_first (its readings), is_day_first,
    is_month_first (the vendor's country; null: unknown). A page's date counts where it is on the page.
    """
    return scored(readings.join(seen(pages), "invoice_id"))


def seen(pages: DataFrame, *kept: str) -> DataFrame:
    """What holds for a page, worked out once a page."""
    return pages.withColumns({
        "has_page": F.col("page") != "", "plain_page": plain_name(F.col("page")), "bare_page": without_grouping(F.col("page")),
        "dates": F.when(F.col("page").contains(F.col("raw")), F.array_compact(F.array("named", "day_first", "month_first"))),
        "open_date": F.col("named").isNull() & F.coalesce(F.col("day_first") != F.col("month_first"), F.lit(False)), "settled": F.coalesce(F.col("is_day_first") | F.col("is_month_first"), F.lit(False)),
    }).select("invoice_id", "has_page", "plain_page", "bare_page", "dates", "open_date", "settled", *kept)


def scored(r: DataFrame) -> DataFrame:
    """Readings that bring what was seen of their page; what several rules ask of a reading is worked out once a reading."""
    money, date, name = F.col("field").isin(*MONEY), F.col("field") == "invoice_date", F.col("field") == "vendor_name"
    amount = lambda x: F.regexp_replace(x, ",", "").try_cast("decimal(38,6)")
    reads_as = lambda x: F.coalesce(F.array_contains("dates", x.try_cast("date")), F.lit(False))
    r = r.withColumns({"left": F.when(~(money | date), plain_name(F.col("a"))), "right": F.when(name & F.col("has_b"), plain_name(F.col("b"))), "a_reads": date & reads_as(F.col("a"))})
    left, right = F.col("left"), F.col("right")
    shortest = F.regexp_replace(F.col("a"), r"(\.\d*?)0+$", "$1")
    shortest = F.regexp_replace(shortest, r"\.$", "")
    on_page = F.when(date, F.col("a_reads")).when(money, F.col("bare_page").contains(shortest)).otherwise((left != "") & F.col("plain_page").contains(left))
    # a page's text is done with here, so that it isn't kept for each reading while names are compared
    r = r.withColumn("grounded", F.col("has_page") & F.coalesce(on_page, F.lit(False))).drop("plain_page", "bare_page")
    worth = name & F.col("has_b") & (left != right) & (ratio_bound(left, right) >= NAMES_ALIKE)
    r = r.withColumn("alike", similarity(F.when(worth, left), F.when(worth, right)))
    same_date = (F.col("a") == F.col("b")) | (F.col("a_reads") & reads_as(F.col("b")))
    agree = F.when(date, same_date).when(name, (left == right) | (F.col("alike") >= NAMES_ALIKE)).when(money, amount(F.col("a")) == amount(F.col("b"))).otherwise(F.col("a") == F.col("b"))
    r = r.withColumns({"agreed": F.when(F.col("has_b"), F.coalesce(agree, F.lit(False))), "two_ways": F.col("a_reads") & F.col("open_date")})
    two_ways, settled = F.col("two_ways"), F.col("settled")
    note = F.when(two_ways, F.when(settled, "date_resolved_from_locale").otherwise("ambiguous_date_unknown_locale"))
    base = lambda s: F.when(F.col("grounded"), s[0]).otherwise(s[1])
    score = F.when(F.col("agreed").isNull(), base(SINGLE)).when(F.col("agreed"), base(AGREED)).otherwise(base(DISAGREED))
    score = F.when(two_ways, F.least(score, F.when(settled, RESOLVED_DATE).otherwise(OPEN_DATE))).otherwise(score)
    score = F.when(F.col("blurred"), (score * BLURRED_TENTHS / 10)).otherwise(score).cast("long")
    why = F.when(~F.coalesce("agreed", F.lit(True)), "readings_disagree").when(~F.col("grounded"), F.when(F.col("has_page"), "not_in_text_layer").otherwise("no_text_layer"))
    why = F.coalesce(why, F.when(F.col("agreed").isNull(), "single_read").otherwise("agreed_and_grounded"))
    why = F.when(note.isNotNull() & (why == "agreed_and_grounded"), note).when(note.isNotNull(), F.concat_ws(", ", why, note)).otherwise(why)
    why = F.concat_ws(", ", why, F.when(F.col("blurred"), "low_sharpness"))
    return r.select("invoice_id", "field", "load_bearing", "agreed", "grounded", score.alias("score_thousandths"), why.alias("reason"))


def v_seen_pages(view: Callable[[str], DataFrame]) -> DataFrame:
    return seen(view("v_booked_pages"), *READ)


def v_confidence(view: Callable[[str], DataFrame]) -> DataFrame:
    """The readings of the accounts-payable views; a page brings its own, so the two are not joined."""
    return scored(view("v_seen_readings"))


native("v_seen_pages", v_seen_pages, "v_booked_pages")
native("v_confidence", v_confidence, "v_seen_readings")
