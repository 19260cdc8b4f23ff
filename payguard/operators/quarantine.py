"""The extraction contract: what a reading must hold to, and the parting of good rows from bad ones."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from payguard.functions.text import CURRENCIES
from payguard.operators.lifecycle import quoted
from payguard.plans.catalog import frame, shared_dir, text, view

#: The longest number and name, decimals of an amount, digits of one once it has them.
NUMBER_CHARS, NAME_CHARS, PLACES, MONEY_DIGITS = 64, 200, 2, 18


def _named(names: Column, label: str) -> Column:
    """``label:a,b`` for an array of names, null for an empty one."""
    some = F.array_sort(F.array_distinct(names))
    return F.when(F.size(some) > 0, F.concat(F.lit(f"{label}:"), F.array_join(some, ",")))


def violations() -> Column:
    """An extraction's broken rules, in order; empty where it holds to all.

    Columns: invoice_number, vendor_name, currency, invoice_date, due_date (null: none),
    amounts (array of field, text as printed) and evidence (array of field, snippet). An amount that is no
    finite number, needs rounding to two places, or has too many digits then, is refused rather than
    altered. Evidence may cite a field once.
    """
    amounts, evidence = F.col("amounts"), F.col("evidence")
    exact = lambda a: a["text"].try_cast(f"decimal(36,{PLACES + 12})")
    digits = lambda a: F.coalesce(a["text"].rlike(r"^\s*[+-]?[0-9]+(\.[0-9]*)?\s*$"), F.lit(False))
    fields = F.transform(evidence, lambda e: e["field"])
    twice = F.filter(fields, lambda f: F.size(F.filter(fields, lambda g: g == f)) > 1)
    wrong = lambda when: F.transform(F.filter(amounts, when), lambda a: a["field"])
    rounded = lambda a: exact(a).cast(f"decimal({22 + PLACES},{PLACES})")
    rules = [
        F.when(F.coalesce(~F.upper("currency").isin(*CURRENCIES), F.lit(True)), "currency"),
        F.when(F.col("due_date") < F.col("invoice_date"), "due_before_invoice"),
        F.when(F.coalesce((F.trim("invoice_number") == "") | (F.length("invoice_number") > NUMBER_CHARS), F.lit(True)), "invoice_number"),
        F.when(F.coalesce(F.length("vendor_name") > NAME_CHARS, F.lit(True)), "vendor_name"),
        _named(twice, "cited_twice"),
        _named(wrong(lambda a: exact(a).isNull() & ~digits(a)), "no_amount"),
        _named(wrong(lambda a: exact(a) != rounded(a)), "would_round"),
        _named(wrong(lambda a: F.coalesce((exact(a) == rounded(a)) & (F.abs(exact(a)) >= 10 ** (MONEY_DIGITS - PLACES)), digits(a) & exact(a).isNull())), "too_many_digits"),
    ]
    return F.array_compact(F.array(*rules))


def part(extractions: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Writes good and bad rows below a folder in one pass: (good, quarantined with violations, counts).

    The counts are observed as the rows are written, so nothing is read again for them.
    """
    marked = extractions.withColumn("violations", violations()).withColumn("good", F.size("violations") == 0)
    seen = Observation(f"parted-{uuid.uuid4().hex}")
    counted = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counted.write.mode("overwrite").partitionBy("good").parquet(path)
    rows = extractions.sparkSession.read.schema(marked.schema).parquet(path)
    return rows.filter("good").drop("good", "violations"), rows.filter("not good").drop("good"), seen.get


# Evidence and printed amounts as lists in text; some cite a field twice, some amounts are no amounts.
view(
    "v_contracts",
    """SELECT invoice_id, invoice_number, vendor_name, currency, invoice_date, due_date, 'vendor_name|invoice_number' || CASE WHEN source_po % 73 = 0 THEN '|total|vendor_name' WHEN source_po % 79 = 0 THEN '|total|total|total|invoice_number' ELSE '|total' END AS cited,
    CAST(@div[subtotal; 100] AS STRING) || '.' || lpad(CAST(subtotal % 100 AS STRING), 2, '0') || CASE WHEN source_po % 83 = 0 THEN '5' WHEN source_po % 7 = 0 THEN '00' ELSE '' END AS subtotal_text,
    CASE WHEN source_po % 89 = 0 THEN 'n/a' WHEN source_po % 97 = 0 THEN '10000000000000000.00' ELSE CAST(@div[total; 100] AS STRING) || '.' || lpad(CAST(total % 100 AS STRING), 2, '0') END AS total_text FROM v_inv""",
)


def val_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every extraction with the part that it went to and its broken rules."""
    raw = frame(spark, sf_dir, "v_contracts")
    evidence = F.transform(F.split("cited", r"\|"), lambda f: F.struct(f.alias("field"), F.lit("as printed").alias("snippet")))
    amounts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_text").alias("text")) for f in ("subtotal", "total")])
    rows = raw.select("invoice_id", "invoice_number", "vendor_name", "currency", "invoice_date", "due_date", amounts.alias("amounts"), evidence.alias("evidence"))
    good, bad, _ = part(rows, f"{shared_dir(spark)}/contract-{uuid.uuid4().hex}")
    return good.select("invoice_id", F.lit("good").alias("part"), F.lit("").alias("violations")).union(bad.select("invoice_id", F.lit("quarantine"), F.array_join("violations", "|")))


def oracle_sql() -> dict[str, str]:
    cited = "(SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT f FROM (SELECT unnest(string_split(cited, '|')) AS f) AS a GROUP BY f HAVING count(*) > 1) AS b)"
    rules = f"""concat_ws('|', CASE WHEN currency NOT IN ({quoted(CURRENCIES)}) THEN 'currency' END, CASE WHEN due_date < invoice_date THEN 'due_before_invoice' END, CASE WHEN length(invoice_number) > 64 OR trim(invoice_number) = '' THEN 'invoice_number' END,
        CASE WHEN length(vendor_name) > 200 THEN 'vendor_name' END, 'cited_twice:' || {cited}, CASE WHEN total_text = 'n/a' THEN 'no_amount:total' END, CASE WHEN NOT regexp_full_match(subtotal_text, '-?[0-9]+[.][0-9]{{2}}0*') THEN 'would_round:subtotal' END,
        CASE WHEN length(total_text) > 19 THEN 'too_many_digits:total' END)"""
    return {"val_contract": f"SELECT invoice_id, CASE WHEN v = '' THEN 'good' ELSE 'quarantine' END AS part, v AS violations FROM (SELECT invoice_id, {rules} AS v FROM ({text('v_contracts', 1)}) AS c) AS r"}


QUERIES = {"val_contract": val_contract}
