"""The extraction contract, and the parting of good rows from bad ones."""

import datetime as dt
import uuid
from decimal import Decimal, InvalidOperation

import pytest
from payguard.operators.quarantine import part
from payguard.plans.catalog import shared_dir

SCHEMA = "invoice_id long, invoice_number string, vendor_name string, currency string, invoice_date date, due_date date, amounts array<struct<field:string,text:string>>, evidence array<struct<field:string,snippet:string>>"
DAY = dt.date(2024, 3, 9)
BASE = dict(invoice_number="INV-1", vendor_name="Acme", currency="USD", invoice_date=DAY, due_date=None, amounts=[("total", "12.50")], evidence=[("total", "12.50"), ("currency", "USD")])
# changed facts: broken rules
CASES = [
    ({}, []),
    (dict(currency="usd"), []),
    (dict(currency="XYZ"), ["currency"]),
    (dict(currency=None), ["currency"]),
    (dict(due_date=DAY), []),
    (dict(due_date=DAY - dt.timedelta(1)), ["due_before_invoice"]),
    (dict(invoice_number=" "), ["invoice_number"]),
    (dict(invoice_number="x" * 64), []),
    (dict(invoice_number="x" * 65, vendor_name="y" * 201), ["invoice_number", "vendor_name"]),
    (dict(evidence=[("total", "a"), ("currency", "b"), ("total", "a")]), ["cited_twice:total"]),
    (dict(evidence=[("b", ""), ("a", ""), ("b", ""), ("a", ""), ("a", "")]), ["cited_twice:a,b"]),
    (dict(evidence=[]), []),
    (dict(amounts=[("total", "12.505")]), ["would_round:total"]),
    (dict(amounts=[("total", "12.50000"), ("tax", "-0.00")]), []),
    (dict(amounts=[("total", "NaN"), ("tax", None), ("subtotal", "1e3")]), ["no_amount:tax,total"]),
    (dict(amounts=[("total", "-9999999999999999.99")]), []),
    (dict(amounts=[("total", "10000000000000000.00"), ("tax", "0.001")]), ["would_round:tax", "too_many_digits:total"]),
    (dict(amounts=[("total", "9" * 30), ("tax", "1" * 60)]), ["too_many_digits:tax,total"]),
    (dict(amounts=[]), []),
]


@pytest.fixture(scope="module")
def parted(spark):
    rows = [(i, *{**BASE, **changed}.values()) for i, (changed, _) in enumerate(CASES)]
    return part(spark.createDataFrame(rows, SCHEMA), f"{shared_dir(spark)}/test-{uuid.uuid4().hex}")


def test_parts_add_up_and_are_counted(parted):
    good, bad, counts = parted
    assert sorted(r.invoice_id for r in good.collect()) == [i for i, (_, broken) in enumerate(CASES) if not broken]
    assert {r.invoice_id: r.violations for r in bad.collect()} == {i: broken for i, (_, broken) in enumerate(CASES) if broken}
    assert counts == {"rows": len(CASES), "good": good.count(), "bad": bad.count()}


def test_rows_keep_their_nested_columns(parted):
    good, bad, _ = parted
    assert good.columns == [x.split(" ")[0] for x in SCHEMA.split(", ")] and bad.columns == [*good.columns, "violations"]
    row = good.filter("invoice_id = 0").first()
    assert [tuple(x) for x in row.amounts] == BASE["amounts"] and [tuple(x) for x in row.evidence] == BASE["evidence"]


def test_amounts_as_exact_decimals_say(parted):
    """What would round, by plain decimals."""
    _, bad, _ = parted
    rounding = {r.invoice_id for r in bad.collect() if any(v.startswith("would_round") for v in r.violations)}

    def rounds(text):
        try:
            d = Decimal(text)
        except (InvalidOperation, TypeError):
            return False
        return d.is_finite() and d.normalize().as_tuple().exponent < -2

    assert rounding == {i for i, (changed, _) in enumerate(CASES) if any(rounds(t) for _, t in {**BASE, **changed}["amounts"])}


def test_an_empty_table(spark):
    good, bad, counts = part(spark.createDataFrame([], SCHEMA), f"{shared_dir(spark)}/test-{uuid.uuid4().hex}")
    assert good.count() == bad.count() == 0 and counts == {"rows": 0, "good": 0, "bad": 0}
