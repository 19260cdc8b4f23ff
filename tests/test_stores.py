"""Stores that only grow: replays, half-written batches, forged lines, equal payloads of different spelling."""

import hashlib
import json
import uuid
from pathlib import Path

import pytest
from payguard.plans.catalog import shared_dir
from payguard.sources import stores
from pyspark.sql import functions as F

ARRIVALS = "vendor long, number_norm string, invoice_id long, arrival_seq long"


@pytest.fixture
def path(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def local(path):
    return Path(path.removeprefix("file://"))


def arrivals(spark, *rows):
    return spark.createDataFrame(list(rows), ARRIVALS)


def put(spark, store, epoch, *rows):
    stores.insert_new(store, arrivals(spark, *rows), epoch, ("vendor", "number_norm"), "arrival_seq")


def held(store):
    return sorted((r.vendor, r.number_norm, r.invoice_id, r.epoch) for r in store.rows().collect())


def test_first_arrival_stays_and_a_replay_changes_nothing(spark, path):
    store = stores.EpochStore(spark, path, ARRIVALS)
    assert held(store) == [] and store.epochs() == []
    put(spark, store, 0, (1, "A", 11, 5), (1, "A", 12, 3), (2, "A", 13, 9))
    put(spark, store, 1, (1, "A", 14, 1), (3, "B", 15, 2), (None, "B", 16, 2))
    want = [(1, "A", 12, 0), (2, "A", 13, 0), (3, "B", 15, 1)]
    assert [x for x in sorted(held_or_null(store)) if x[0] is not None and x[0] != -1] == want
    put(spark, store, 1, (9, "Z", 99, 1))
    put(spark, store, 2, (None, "B", 17, 0), (3, "B", 18, 0))
    assert [x for x in held_or_null(store) if x[0] not in (None, -1)] == want and store.rows().count() == 4 and store.epochs() == [0, 1, 2]


def held_or_null(store):
    return sorted((-1 if r.vendor is None else r.vendor, r.number_norm, r.invoice_id, r.epoch) for r in store.rows().collect())


def test_a_batch_that_broke_off_is_not_seen_and_is_written_anew(spark, path):
    store = stores.EpochStore(spark, path, ARRIVALS)
    put(spark, store, 0, (1, "A", 11, 1))
    arrivals(spark, (2, "A", 12, 2)).write.parquet(f"{path}/rows/epoch=1")  # half of epoch 1, and no ledger entry
    assert held(store) == [(1, "A", 11, 0)]
    put(spark, store, 1, (2, "A", 12, 2), (3, "A", 13, 3))
    assert held(store) == [(1, "A", 11, 0), (2, "A", 12, 1), (3, "A", 13, 1)]


def test_a_stream_that_fails_after_half_a_write_starts_again(spark, path):
    for n, row in enumerate(((1, "A", 11, 1), (1, "A", 12, 2), (2, "B", 13, 3))):
        arrivals(spark, row).coalesce(1).write.mode("append").parquet(f"{path}/in")
    store, fail = stores.EpochStore(spark, f"{path}/store", ARRIVALS), {1}
    whole = store.put

    def broken(rows, epoch):
        if epoch in fail:
            fail.discard(epoch)
            rows.limit(1).write.mode("overwrite").parquet(f"{path}/store/rows/epoch={epoch}")
            raise RuntimeError("lost")
        whole(rows, epoch)

    store.put = broken
    run = lambda: stores.upsert_stream(spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), store, ("vendor", "number_norm"), "arrival_seq", f"{path}/state")
    with pytest.raises(Exception, match="lost"):
        run()
    assert held(store) == [(1, "A", 11, 0)]
    run()
    assert [x[:3] for x in held(store)] == [(1, "A", 11), (2, "B", 13)] and store.epochs() == [0, 1, 2]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"b":1, "a":2}', '{"a":2,"b":1}'),
        ('{ "a" : {"z":[1, {"y":2,"x":null}], "k":"é\\"\\n"} }', '{"a":{"k":"é\\"\\n","z":[1,{"x":null,"y":2}]}}'),
        ('{"latency_ms":5,"a":{"latency_ms":6},"output_tokens":1,"input_tokens":2}', '{"a":{"latency_ms":6}}'),
        ('{"n":null}', '{"n":null}'),
        ('[{"b":1,"a":[]}, 2]', '[{"a":[],"b":1},2]'),
        ("{}", "{}"),
        ('{"a":1.50,"B":true}', '{"B":true,"a":1.5}'),
        ("plain", None),
        ('{"a":1,"a":2}', None),
    ],
)
def test_canonical_json(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "raw string").select(stores.canonical(F.col("raw")).alias("c")).first().c
    assert got == want
    if want is not None and "1.5" not in raw:  # what a plain writer of sorted keys says
        value = json.loads(raw)
        value = {k: v for k, v in value.items() if k not in stores.VOLATILE} if isinstance(value, dict) else value
        assert got == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_equal_payloads_are_stored_once(spark, path):
    store = stores.payload_store(spark, path)
    first = spark.createDataFrame([('{"b":1,"a":2}', False), ('{"a":2,"b":1,"latency_ms":9}', False), ("note", True), (None, True), ('{"a":2,"b":1}', True)], "raw string, is_text boolean")
    stores.put_payloads(store, first, 0)
    want = {hashlib.sha256(c.encode()).hexdigest(): c for c in ('{"a":2,"b":1}', "note")}
    rows = store.rows().collect()
    assert {r.sha256: r.content for r in rows} == want and len(rows) == 2
    stores.put_payloads(store, first, 1)
    assert store.rows().count() == 2 and store.epochs() == [0, 1]


def events(spark, *places):
    return spark.createDataFrame([(i, run, step, o, json.dumps({"invoice_id": i, "run_id": run, "step_seq": step}, separators=(",", ":"))) for i, run, step, o in places], "invoice_id long, run_id long, step_seq long, ord long, body string")


def chain(*bodies):
    before = stores.GENESIS
    for b in bodies:
        line = b[:-1] + f',"prev_event_hash":"{before}"}}'
        before = hashlib.sha256(line.encode()).hexdigest()
    return before


def test_two_batches_verify_as_one_chain(spark, path):
    store = stores.EpochStore(spark, path, stores.TRAIL)
    one, two = [(1, 0, 0, 1), (2, 0, 0, 1), (1, 0, 1, 2)], [(1, 1, 0, 3), (3, 0, 0, 1), (1, 0, 1, 9), (3, 0, 0, 2)]  # two taken positions
    stores.append_trail(store, events(spark, *one), 0)
    before = {p: p.stat().st_mtime_ns for p in local(path).rglob("*.parquet")}
    stores.append_trail(store, events(spark, *two), 1)
    stores.append_trail(store, events(spark, *two), 1)
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    body = lambda i, run, step: json.dumps({"invoice_id": i, "run_id": run, "step_seq": step}, separators=(",", ":"))
    got = {r.invoice_id: tuple(r)[1:] for r in stores.verify_trail(store.rows()).collect()}
    assert got == {1: (3, True, None, chain(body(1, 0, 0), body(1, 0, 1), body(1, 1, 0))), 2: (1, True, None, chain(body(2, 0, 0))), 3: (1, True, None, chain(body(3, 0, 0)))}
    text = f"{path}/jsonl"
    for epoch in (0, 1):
        stores.write_jsonl(store.rows().filter(F.col("epoch") == epoch), text)
    lines = [x for p in sorted(local(text).rglob("*.txt"), key=lambda p: p.stat().st_mtime_ns) for x in p.read_text().splitlines()]
    ones = [json.loads(x) for x in lines if json.loads(x)["invoice_id"] == 1]
    assert len(lines) == 5 and [(x["run_id"], x["step_seq"]) for x in ones] == [(0, 0), (0, 1), (1, 0)]


@pytest.mark.parametrize("forged", ["line", "head"])
def test_a_forged_line_or_head_is_found(spark, path, forged):
    store = stores.EpochStore(spark, path, stores.TRAIL)
    stores.append_trail(store, events(spark, (1, 0, 0, 1), (1, 0, 1, 2), (2, 0, 0, 1)), 0)
    rows = store.rows().drop("epoch").collect()
    bad = [{**r.asDict(), **({"line": r.line.replace('"step_seq":1', '"step_seq":7')} if forged == "line" else {"hash": "0" * 64} if r.step_seq == 1 else {})} for r in rows]
    other = stores.EpochStore(spark, path + "-forged", stores.TRAIL)
    other.put(spark.createDataFrame(bad, stores.TRAIL), 0)
    stores.append_trail(other, events(spark, (1, 0, 2, 3), (2, 0, 1, 2)), 1)
    got = {r.invoice_id: (r.lines, r.intact, r.first_break) for r in stores.verify_trail(other.rows()).collect()}
    assert got == {1: (3, False, 2), 2: (2, True, None)}


def test_empty_batches(spark, path):
    store = stores.EpochStore(spark, path, stores.TRAIL)
    stores.append_trail(store, events(spark, (1, 0, 0, 1)).limit(0), 0)
    assert store.epochs() == [0] and stores.verify_trail(store.rows()).count() == 0
