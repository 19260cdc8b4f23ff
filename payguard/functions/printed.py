"""What a page prints: all date-shaped runs in order, and all numeric runs with the values they may mean.

Array algebra over regular expressions, so that a page is parsed once, in the engine.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names as invoices print them.
MONTHS = (
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"),
    ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
)
#: The shapes of printed dates, in the order in which they are looked for.
DAY_NAME = r"(?U)\b(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})\b"
NAME_DAY = r"(?U)\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
YEAR_FIRST = r"(?U)\b(\d{4})([/.\-])(\d{1,2})\2(\d{1,2})\b"
DAY_MONTH = r"(?U)\b(\d{1,2})([/.\-])(\d{1,2})\2(\d{2,4})\b"
#: Fixed value: separators between which and digits a number is grouped.
GROUPING = r"(?<=\d)[,\x{20}\x{a0}\x{202f}\x{2009}](?=\d)"


def _month(name: Column) -> Column:
    names = [F.lit(x) for i, ms in enumerate(MONTHS) for m in ms for x in (m, i + 1)]
    return F.try_element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in names]), F.lower(name))


def _date(year: Column, month: Column, day: Column) -> Column:
    """The date that three numbers make, null where there is none; no text is made or parsed."""
    possible = year.between(1, 9999) & month.between(1, 12) & (day >= 1)
    return F.when(possible, F.when(day <= F.day(F.last_day(F.make_date(year, month, F.lit(1)))), F.make_date(year, month, day)))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """What a use of x makes, with x worked out once however often it is mentioned."""
    return F.transform(F.array(x), use)[0]


def date_runs(text: Column) -> Column:
    """All date-shaped runs of a text: array of text, kind, separator, day_first, month_first (dates), ambiguous.

    Days before month names come first, then names before days, then leading years, then the
    runs of two small numbers and a year that are no part of a run found before; each in the
    order of the text. A word that is no month makes no date. A run whose numbers are no date in
    an order has null there. Empty for a text without any; null for null.
    """

    def runs(pattern: str, kind: str, first: int, second: int, year: int, month_at: int | None) -> Column:
        def part(x: Column, i: int) -> Column:
            raw = F.regexp_extract(x, pattern, i)
            return _month(raw) if i == month_at else raw.try_cast("int")

        def parts(x: Column) -> Column:
            separator = F.lit("") if month_at else F.regexp_extract(x, pattern, 2)
            return F.struct(x.alias("x"), separator.alias("separator"), part(x, first).alias("a"), part(x, second).alias("b"), part(x, year).alias("y"))

        def full(p: Column) -> Column:
            return p.withField("y", F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"]))

        def run(p: Column) -> Column:
            a, b, y = p["a"], p["b"], p["y"]
            left = _date(y, a, b) if kind == "year_first" else _date(y, b, a)
            right = _date(y, a, b) if kind in ("year_first", "numeric") else left
            two = F.lit(kind == "numeric") & p["separator"].isin("/", ".") & (a <= 12) & (b <= 12)
            return F.struct(p["x"].alias("text"), F.lit(kind).alias("kind"), p["separator"].alias("separator"), left.alias("day_first"), right.alias("month_first"), two.alias("ambiguous"))

        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), parts)
        if month_at:
            found = F.filter(found, lambda p: p["b" if month_at == second else "a"].isNotNull())
        return F.transform(F.transform(found, full), run)

    sure = F.concat(runs(DAY_NAME, "day_name", 1, 2, 3, 2), runs(NAME_DAY, "name_day", 2, 1, 3, 1), runs(YEAR_FIRST, "year_first", 3, 4, 1, None))
    loose = runs(DAY_MONTH, "numeric", 1, 3, 4, None)
    return _bound(sure, lambda s: F.concat(s, F.filter(loose, lambda x: ~F.exists(s, lambda d: d["text"].contains(x["text"])))))


def renderings(value: Column) -> list[Column]:
    """How a decimal(38,6) may be written: without trailing zeros, to the cent, both also in groups of three."""
    cents = F.format_number(value, 2)
    plain = F.regexp_replace(cents, ",", "")
    short = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    same = plain.cast("decimal(38,6)") == value
    return [short, F.when(same, plain), F.when(same, cents)]


def occurs(value: Column, text: Column) -> Column:
    """Whether a value is in a text under some grouping, as written or with separators between digits left out."""
    bare = F.regexp_replace(text, GROUPING, "")
    return reduce(Column.__or__, [F.coalesce(text.contains(r) | bare.contains(r), F.lit(False)) for r in renderings(value)])


#: A run: digits in groups or not, perhaps with decimals, that is no part of a word, a longer run, or a date or number joined by hyphens or slashes.
NUMBER = r"(?<![\p{L}\p{N}]|\p{N}[.,]|[\p{L}\p{N}][-/])(?:\d{1,3}(?:(?:,\d{2,3})*,\d{3}|(?:\.\d{3})+|(?:['\x{20}\x{a0}\x{202f}\x{2009}]\d{3})+)(?!\d)|\d+)(?:[.,]\d+)?(?![\p{L}\p{N}]|[.,]\p{N}|[-/][\p{L}\p{N}])"


def number_values(run: Column) -> Column:
    """The values that a numeric run may mean, as decimal(38,6): one, or two for 1.234 and 1,234.

    The last point or comma separates decimals where it is the only one of its kind and not
    followed by three digits, or follows the other kind; all else is grouping.
    """
    s = F.regexp_replace(run, r"['\x{20}\x{a0}\x{202f}\x{2009}]", "")
    tail = F.regexp_extract(s, r"([.,])\d+$", 1)
    whole = F.regexp_replace(s, r"[.,]", "").try_cast("decimal(38,6)")
    split = F.concat(F.regexp_replace(F.regexp_extract(s, r"^(.*)[.,]\d+$", 1), r"[.,]", ""), F.lit("."), F.regexp_extract(s, r"[.,](\d+)$", 1)).try_cast("decimal(38,6)")
    times = F.length(s) - F.length(F.replace(s, tail, F.lit("")))
    kinds = s.contains(".").cast("int") + s.contains(",").cast("int")
    three = F.regexp_like(s, F.lit(r"[.,]\d{3}$"))
    both = (kinds == 1) & (times == 1) & three & F.regexp_like(s, F.lit(r"^[1-9]\d{0,2}[.,]"))
    decimals = (tail != "") & (times == 1) & ((kinds == 2) | ~three | ~F.regexp_like(s, F.lit(r"^[1-9]\d{0,2}[.,]")))
    return F.array_compact(F.when(both, F.array(split, whole)).when(decimals, F.array(split)).otherwise(F.array(whole)))


def number_index(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Every value that some numeric run of a page may mean: key, value, runs (how many runs)."""
    runs = pages.select(key, F.explode(F.regexp_extract_all(F.col(page), F.lit(NUMBER), F.lit(0))).alias("run"))
    return runs.select(key, F.explode(number_values(F.col("run"))).alias("value")).groupBy(key, "value").agg(F.count(F.lit(1)).alias("runs"))


def on_page(values: DataFrame, pages: DataFrame, key: str, page: str) -> DataFrame:
    """values (key, field, value) with runs: how many numeric runs of the key's page may mean the value, 0 for none.

    Values meet a page's runs by equal value, so no value is looked for in a text.
    """
    exact = values.withColumn("value", F.col("value").cast("decimal(38,6)"))
    found = exact.join(number_index(pages, key, page), [key, "value"], "left")
    return found.withColumn("runs", F.coalesce("runs", F.lit(0)))
