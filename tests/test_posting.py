"""Golden rows of billing and posting: one changed fact a case."""

import pytest
from payguard.operators.posting import bills, posting

RECORD = dict(invoice_id=1, extracted=True, vendor=7, approval_id=70, po_ref=100, invoice_number="INV-1", currency="USD", total=3000, tax_total=0)
RECORDS = "invoice_id long, extracted boolean, vendor long, approval_id long, po_ref long, invoice_number string, currency string, total long, tax_total long"
LINES = [(1, 100, 0, 1, 1000), (1, 100, 1, 2, 2000)]
# name: changed facts, lines, outcome, line
BILLS = {
    "all in order": ({}, LINES, "bill", None),
    "no reading": (dict(extracted=False, vendor=None), LINES, "no_extraction", None),
    "no vendor goes before no approval": (dict(vendor=None, approval_id=None), LINES, "no_vendor", None),
    "no approval": (dict(approval_id=None, po_ref=None), LINES, "no_approval", None),
    "no order printed": (dict(po_ref=None), LINES, "no_po", None),
    "an unknown order": (dict(po_ref=5, tax_total=1), LINES, "no_po", None),
    "tax goes before currency": (dict(tax_total=1, currency="EUR"), LINES, "tax", None),
    "negative tax is tax": (dict(tax_total=-1), LINES, "tax", None),
    "another currency": (dict(currency="EUR"), LINES, "currency", None),
    "a number without letters or digits": (dict(invoice_number="--"), LINES, "doc_number", None),
    "a number too long": (dict(invoice_number="A" * 22), LINES, "doc_number", None),
    "a number of 21": (dict(invoice_number="a-" * 21), LINES, "bill", None),
    "an unpaired line": ({}, [*LINES, (1, 100, 2, None, 0)], "unpaired_line", 2),
    "a line without item": ({}, [(1, 100, 0, 3, 1000), (1, 100, 1, 2, 2000)], "unpaired_line", 0),
    "a line off the total": (dict(total=3001), LINES, "total", None),
    "no lines": (dict(total=0), [], "total", None),
}


@pytest.mark.parametrize("name", BILLS)
def test_bills(spark, name):
    changed, lines, outcome, line = BILLS[name]
    record = {**RECORD, **changed}
    got = bills(
        spark.createDataFrame([tuple(record.values())], RECORDS), spark.createDataFrame(lines, "invoice_id long, po long, line_idx long, line_no long, extended long"),
        spark.createDataFrame([(100, "USD")], "po long, currency string"), spark.createDataFrame([(100, 1, "A"), (100, 2, "B"), (100, 3, None)], "po long, line_no long, item_ref string"),
    ).collect()
    assert [(r.outcome, r.line_idx) for r in got] == [(outcome, line)]
    assert got[0].bill_key == (f"bill:7:{record['invoice_number'].upper().replace('-', '')}" if outcome == "bill" else None)


# name: bill, record, approval, held keys, outcome
PAYLOAD, STATE, APPROVAL = dict(vendor=7, approval_id=70, total=3000, currency="USD", bill_key="bill:7:A"), ("approved", 7), (70, 1, "approved", 3000, "USD")
POSTS = {
    "all in order": ({}, STATE, APPROVAL, [], "post"),
    "no such invoice": ({}, None, APPROVAL, [], "unknown_invoice"),
    "not approved yet": ({}, ("coded", 7), APPROVAL, [], "not_approved"),
    "another vendor than the one resolved": (dict(vendor=8), STATE, APPROVAL, [], "vendor"),
    "no vendor was resolved": ({}, ("approved", None), APPROVAL, [], "vendor"),
    "no such approval": (dict(approval_id=71), STATE, APPROVAL, [], "approval_of_another"),
    "another invoice's approval": ({}, STATE, (70, 2, "approved", 3000, "USD"), [], "approval_of_another"),
    "a cancelled approval": ({}, STATE, (70, 1, "cancelled", 1, "USD"), [], "approval_not_approved"),
    "a cent more than approved": (dict(total=3001), STATE, APPROVAL, [], "amount"),
    "another currency than approved": (dict(currency="EUR"), STATE, APPROVAL, [], "amount"),
    "its own key again": ({}, STATE, APPROVAL, [(1, "bill:7:A")], "post"),
    "a key that another holds": ({}, STATE, APPROVAL, [(2, "bill:7:A")], "key_held"),
    "it holds another key": ({}, STATE, APPROVAL, [(1, "bill:7:B")], "other_key"),
}


@pytest.mark.parametrize("name", POSTS)
def test_posting(spark, name):
    changed, state, approval, held, outcome = POSTS[name]
    p = {**PAYLOAD, **changed}
    payloads = spark.createDataFrame([(1, *p.values()), (5, 7, 75, 1, "USD", p["bill_key"])], "invoice_id long, vendor long, approval_id long, total long, currency string, bill_key string")
    records = spark.createDataFrame([(1, *state)] if state else [], "invoice_id long, state string, vendor long")
    approvals = spark.createDataFrame([approval], "approval_id long, of_invoice long, status string, amount long, approved_currency string")
    got = posting(payloads, records, approvals, spark.createDataFrame(held, "holder long, held_key string")).collect()
    assert {r.invoice_id: r.outcome for r in got} == {1: outcome, 5: "unknown_invoice"}


def test_one_of_two_that_ask_for_a_key_has_it(spark):
    payloads = spark.createDataFrame([(i, 7, 70 + i, 1, "USD", "k") for i in (3, 4)], "invoice_id long, vendor long, approval_id long, total long, currency string, bill_key string")
    records = spark.createDataFrame([(i, "approved", 7) for i in (3, 4)], "invoice_id long, state string, vendor long")
    approvals = spark.createDataFrame([(70 + i, i, "approved", 1, "USD") for i in (3, 4)], "approval_id long, of_invoice long, status string, amount long, approved_currency string")
    got = posting(payloads, records, approvals, spark.createDataFrame([], "holder long, held_key string")).collect()
    assert {r.invoice_id: r.outcome for r in got} == {3: "post", 4: "key_held"}
