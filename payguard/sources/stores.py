"""Stores that only grow: rows by epoch, insert-or-ignore, write-once payloads, hash-chained trails.

A batch goes into a folder of its own epoch, and a ledger names the epochs that are whole. A
batch that is replayed after its ledger entry changes nothing; one that broke off half-way
is written anew over its own folder, and its rows were never seen. So every sink here takes the
same batch any number of times, as ``foreachBatch`` may hand it over. One writer a store.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from payguard.plans.catalog import frame, shared_dir, text, view

#: What a payload's address leaves out; the media types; the hash before the first line.
VOLATILE = ("latency_ms", "input_tokens", "output_tokens")
JSON, TEXT = "application/json", "text/plain; charset=utf-8"
GENESIS = "0" * 64


class EpochStore:
    """Parquet rows of one schema under a folder, by epoch, with a ledger of whole epochs."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, T._parse_datatype_string(schema)
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def epochs(self) -> list[int]:
        """The whole epochs."""
        ledger = self._at("ledger")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(ledger)) if self._fs.exists(ledger) else []

    def rows(self) -> DataFrame:
        """All rows of whole epochs, with their epoch."""
        whole = [f"{self.path}/rows/epoch={n}" for n in self.epochs()]
        schema = T.StructType([*self.schema.fields, T.StructField("epoch", T.LongType())])
        if not whole:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*whole)

    def holds(self, epoch: int) -> bool:
        return self._fs.exists(self._at("ledger", str(epoch)))

    def put(self, rows: DataFrame, epoch: int) -> None:
        """Writes an epoch and enters it in the ledger, in that order."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/rows/epoch={epoch}")
        self._fs.create(self._at("ledger", str(epoch)), False).close()


def insert_new(store: EpochStore, batch: DataFrame, epoch: int, keys: tuple[str, ...], order: str) -> None:
    """Adds the batch's rows whose keys the store does not hold; of several of a key the first by ``order``.

    Keys are grouped before they meet the store, so a key that comes very often is one row there.
    """
    if store.holds(epoch):
        return
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first")).select(*keys, "first.*")
    known = store.rows().select(*[F.col(k).alias(f"known_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys]
    store.put(first.join(known, same, "left_anti"), epoch)


def canonical(raw: Column, volatile: tuple[str, ...] = VOLATILE) -> Column:
    """A JSON text with the keys of every object in order, no white space, and without volatile fields at its top.

    Null for a text that is no JSON, or that has a key twice. Numbers are written by value: 1.50 is 1.5.
    """
    value = F.try_parse_json(raw)
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    return F.coalesce(F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*volatile))), F.to_json(value))


def payload_store(spark: SparkSession, path: str) -> EpochStore:
    return EpochStore(spark, path, "sha256 string, media_type string, content string")


def put_payloads(store: EpochStore, payloads: DataFrame, epoch: int) -> None:
    """Payloads (raw, is_text) under their content's address, once; what is no JSON is kept as text, null not at all."""
    content = F.coalesce(F.when(~F.col("is_text"), canonical(F.col("raw"))), F.col("raw"))
    kind = F.when(~F.col("is_text") & canonical(F.col("raw")).isNotNull(), JSON).otherwise(TEXT)
    rows = payloads.filter("raw is not null").select(F.sha2(content, 256).alias("sha256"), kind.alias("media_type"), content.alias("content"))
    insert_new(store, rows, epoch, ("sha256",), "media_type")


TRAIL = "invoice_id long, run_id long, step_seq long, ord long, line string, hash string"


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by invoice in order, a stored head first: each line with the hash of the one before."""
    invoice, before = None, GENESIS
    for batch in batches:
        lines, hashes = [], []
        for i, body, head in zip(batch["invoice_id"], batch["body"], batch["head"]):
            if i != invoice:
                invoice, before = i, GENESIS
            if head is not None:
                before, line = head, None
            else:
                line = f'{body[:-1]},"prev_event_hash":"{before}"}}'
                before = hashlib.sha256(line.encode("utf-8")).hexdigest()
            lines.append(line)
            hashes.append(before)
        done = batch.assign(line=lines, hash=hashes)
        yield done[done["line"].notna()][["invoice_id", "run_id", "step_seq", "ord", "line", "hash"]]


def append_trail(store: EpochStore, events: DataFrame, epoch: int) -> None:
    """Events (invoice_id, run_id, step_seq, ord, body: a JSON object) at the end of their invoices' chains.

    A line is the body with the hash of the line before, so a chain is made in order: invoices
    are dealt out, and a task goes through its own, holding one hash. The store's last hash of
    an invoice goes first. A position (run_id, step_seq) that is taken is refused, that is left
    out, as is a second event for one in the batch. Earlier files are not touched.
    """
    if store.holds(epoch):
        return
    trail, place = store.rows(), ["invoice_id", "run_id", "step_seq"]
    first = events.groupBy(*place).agg(F.min_by(F.struct("ord", "body"), "ord").alias("e")).select(*place, "e.*")
    fresh = first.join(trail.select(*place), place, "left_anti")
    heads = trail.groupBy("invoice_id").agg(F.max_by("hash", F.struct("epoch", "ord", "run_id", "step_seq")).alias("head"))
    heads = heads.join(fresh.select("invoice_id").distinct(), "invoice_id", "left_semi")
    none, at = F.lit(None).cast("string"), F.lit(-1).cast("long")
    rows = fresh.select(*place, "ord", "body", none.alias("head"))
    rows = rows.union(heads.select("invoice_id", at, at, at, none, "head"))
    ordered = rows.repartition("invoice_id").sortWithinPartitions("invoice_id", F.col("head").isNull(), "ord", "run_id", "step_seq")
    store.put(ordered.mapInPandas(_linked, TRAIL), epoch)


def verify_trail(trail: DataFrame) -> DataFrame:
    """invoice_id, lines, intact, first_break (place of the first line that does not name the one before), head (last line's hash)."""
    place = F.struct("epoch", "ord", "run_id", "step_seq")
    by = Window.partitionBy("invoice_id").orderBy(place)
    want = F.coalesce(F.lag(F.sha2("line", 256)).over(by), F.lit(GENESIS))
    seen = trail.select("invoice_id", "line", place.alias("place"), (F.row_number().over(by) - 1).cast("long").alias("nth"), (F.get_json_object("line", "$.prev_event_hash").eqNullSafe(want)).alias("holds"))
    return seen.groupBy("invoice_id").agg(
        F.count(F.lit(1)).alias("lines"), F.bool_and("holds").alias("intact"), F.min(F.when(~F.col("holds"), F.col("nth"))).alias("first_break"), F.max_by(F.sha2("line", 256), "place").alias("head")
    )


def write_jsonl(trail: DataFrame, path: str, buckets: int = 64) -> None:
    """The lines of one epoch as text, all of an invoice in one bucket's folder and in order; other epochs' files stay."""
    rows = trail.withColumn("bucket", F.pmod(F.hash("invoice_id"), F.lit(buckets)))
    rows.repartition("bucket").sortWithinPartitions("bucket", "invoice_id", "ord").select("bucket", F.col("line").alias("value")).write.mode("append").partitionBy("bucket").text(path)


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# The trail's events as JSON bodies; payloads of two spellings, some with volatile fields, some plain text.
view(
    "v_bodies",
    """SELECT invoice_id, @div[seq - 1; 10] AS run_id, (seq - 1) % 10 AS step_seq, seq AS ord, '{"invoice_id":' || CAST(invoice_id AS STRING) || ',"run_id":' || CAST(@div[seq - 1; 10] AS STRING) || ',"step_seq":' || CAST((seq - 1) % 10 AS STRING) || ',"event":"' || event || '","to_state":"' || to_state || '"}' AS body FROM v_ev""",
)
view(
    "v_payloads",
    """SELECT event_id, event_id % 5 = 0 AS is_text, CASE WHEN event_id % 5 = 0 THEN event_type || ' ' || CAST(user_id AS STRING) WHEN event_id % 2 = 0 THEN '{"user":' || CAST(user_id AS STRING) || ', "type":"' || event_type || '","props":{"k":' || @json[props; k] || ',"a":[{"y":1,"x":null},2]},"latency_ms":' || CAST(event_id AS STRING) || '}'
    ELSE '{"input_tokens":3,"props":{"a":[{"x":null,"y":1},2],"k":' || @json[props; k] || '},"type":"' || event_type || '","output_tokens":1,"user":' || CAST(user_id AS STRING) || '}' END AS raw FROM events""",
)


def snk_payload_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads put in two batches, and the second once more; what is then stored, and by which batch."""
    store, payloads = payload_store(spark, _path(spark, "payloads")), frame(spark, sf_dir, "v_payloads")
    put_payloads(store, payloads.filter("event_id % 3 = 0"), 0)
    put_payloads(store, payloads, 1)
    put_payloads(store, payloads, 1)
    return store.rows().select("sha256", "media_type", F.length("content").cast("long").alias("n_chars"), "epoch")


def snk_audit_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail appended in three batches, one of them twice and the last with taken positions; then verified."""
    store, events = EpochStore(spark, _path(spark, "trail"), TRAIL), frame(spark, sf_dir, "v_bodies")
    append_trail(store, events.filter("ord <= 15"), 0)
    append_trail(store, events.filter("ord > 15 and ord <= 40"), 1)
    append_trail(store, events.filter("ord > 15 and ord <= 40"), 1)
    append_trail(store, events.filter("ord > 30"), 2)
    return verify_trail(store.rows())


def upsert_stream(stream: DataFrame, store: EpochStore, keys: tuple[str, ...], order: str, state: str) -> None:
    """Runs a stream to its end into a store of first arrivals."""
    sink = lambda batch, epoch: insert_new(store, batch, epoch, keys, order)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def st_upsert_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate-index entries as they arrive, four files one after the other: the first of each vendor and number stays."""
    path = _path(spark, "arrivals")
    entries = frame(spark, sf_dir, "v_entries").filter("vendor is not null").select("vendor", "number_norm", "invoice_id", "arrival_seq")
    for n in range(4):  # a file a part of the arrivals, in order
        entries.filter(F.col("arrival_seq").between(*((0, 9_999), (10_000, 99_999), (100_000, 999_999_999), (1_000_000_000, 1 << 62))[n])).coalesce(1).write.mode("append").parquet(f"{path}/in")
    store = EpochStore(spark, f"{path}/store", "vendor long, number_norm string, invoice_id long, arrival_seq long")
    stream = spark.readStream.schema(store.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    upsert_stream(stream, store, ("vendor", "number_norm"), "arrival_seq", f"{path}/state")
    return store.rows().select("vendor", "number_norm", "invoice_id")


QUERIES = {"snk_payload_store": snk_payload_store, "snk_audit_append": snk_audit_append, "st_upsert_fenced": st_upsert_fenced}


def oracle_sql() -> dict[str, str]:
    """What the stores must hold in the end, worked out without them."""
    first = "CASE WHEN bool_or(event_id % 3 = 0) THEN 0 ELSE 1 END"
    content = """CASE WHEN event_id % 5 = 0 THEN event_type || ' ' || user_id ELSE '{"props":{"a":[{"x":null,"y":1},2],"k":' || json_extract_string(props, '$.k') || '},"type":"' || event_type || '","user":' || user_id || '}' END"""
    return {
        "snk_payload_store": f"SELECT sha256(content) AS sha256, CASE WHEN content LIKE '{{%' THEN '{JSON}' ELSE '{TEXT}' END AS media_type, length(content) AS n_chars, CAST({first} AS BIGINT) AS epoch FROM (SELECT event_id, {content} AS content FROM events) AS p GROUP BY content",
        "snk_audit_append": f"""WITH RECURSIVE e AS ({text('v_bodies', 1)}), c AS (
            SELECT invoice_id, ord, left(body, length(body) - 1) || ',"prev_event_hash":"{GENESIS}"}}' AS line FROM e WHERE ord = 1
            UNION ALL SELECT e.invoice_id, e.ord, left(e.body, length(e.body) - 1) || ',"prev_event_hash":"' || sha256(c.line) || '"}}' FROM c JOIN e ON e.invoice_id = c.invoice_id AND e.ord = c.ord + 1)
            SELECT invoice_id, count(*) AS lines, true AS intact, CAST(NULL AS BIGINT) AS first_break, arg_max(sha256(line), ord) AS head FROM c GROUP BY invoice_id""",
        "st_upsert_fenced": f"SELECT vendor, number_norm, arg_min(invoice_id, arrival_seq) AS invoice_id FROM ({text('v_entries', 1)}) AS e WHERE vendor IS NOT NULL GROUP BY vendor, number_norm",
    }
