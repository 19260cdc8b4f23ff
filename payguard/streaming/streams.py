"""Streaming twins of batch jobs. Each takes a streaming frame.

On files in order of time its result equals that of the batch twin over all of them, however
many micro-batches there are: of a key that is updated the last epoch's row counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from payguard.operators.lifecycle import PRICES, edges
from payguard.plans.catalog import shared_dir, text

#: Fixed value: hours after which a waiting request is stale.
STALE_HOURS = 72
MOVES = edges()
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def arrival_dedup(events: DataFrame, horizon: str = "40 days") -> DataFrame:
    """One arrival a content digest, within the watermark."""
    digest = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", "props"), 256)
    return events.withWatermark("ts", horizon).select("event_id", "ts", digest.alias("sha256")).dropDuplicatesWithinWatermark(["sha256"])


def same_amount(events: DataFrame, days: int = 30) -> DataFrame:
    """Pairs of one vendor with the same amount within a window of days, the later arrival first."""
    amount = F.round(F.col("value") * 100).cast("long").alias("amount")
    side = lambda p: events.filter("event_type = 'purchase'").select(F.col("event_id").alias(f"{p}_id"), F.col("ts").alias(f"{p}_ts"), F.col("user_id").alias(f"{p}_vendor"), amount.alias(f"{p}_amount")).withWatermark(f"{p}_ts", f"{days} days")
    me, other = side("me"), side("other")
    near = F.expr(f"me_vendor = other_vendor AND me_amount = other_amount AND other_ts <= me_ts AND other_ts >= me_ts - INTERVAL {days} DAYS AND other_id < me_id")
    return me.join(other, near).select("me_id", "other_id", F.col("me_vendor").alias("vendor"), F.col("me_amount").alias("amount"))


def cost_window(events: DataFrame, horizon: str = "2 hours") -> DataFrame:
    """Calls and their cost in micro-dollars by hour; calls of unlisted models or without counts cost nothing known."""
    k = F.get_json_object("props", "$.k").cast("long")
    model = F.col("event_id") % 5
    rate = lambda i: F.when(model == 0, PRICES["large"][i]).when(model == 1, PRICES["small"][i]).when(model == 3, PRICES["mini"][i])
    exact = (k * 100 + 1) * rate(0) + F.when(F.col("event_id") % 13 != 0, k * 7) * rate(1)
    cost = F.bround(exact.cast("decimal(20,0)") / 100, 0).cast("long")
    by = events.withWatermark("ts", horizon).groupBy(F.window("ts", "1 hour"))
    return by.agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("cost_micro")).select(F.col("window.start").alias("hour"), "calls", "cost_micro")


def _votes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: who voted, approvals so far, status, and when the first vote came.

    Of a batch only each person's first vote is held. A request that is still pending
    ``STALE_HOURS`` after its first vote is stale once the watermark has passed; a later vote
    can still decide it.
    """
    seen, approvals, status, opened = state.get if state.exists else ([], 0, "pending", None)
    needed = 1 + key[0] % 4
    if state.hasTimedOut:
        status = "stale" if status == "pending" else status
    else:
        first: dict[int, tuple] = {}
        for frame in frames:
            for ts, event_id, kind in zip(frame["ts"], frame["event_id"], frame["event_type"]):
                person = int(event_id % 5)
                opened = int(ts.timestamp() * 1000) if opened is None else min(opened, int(ts.timestamp() * 1000))
                if person not in seen:
                    first[person] = min(first.get(person, (ts, event_id, kind)), (ts, event_id, kind))
        for person, (_, _, kind) in sorted(first.items(), key=lambda v: v[1][:2]):
            if status not in ("pending", "stale"):
                break
            seen = [*seen, person]
            if kind == "error":
                status = "rejected"
            else:
                approvals += 1
                status = "approved" if approvals >= needed else "pending"
    state.update((seen, approvals, status, opened))
    if status == "pending":
        state.setTimeoutTimestamp(max(opened + STALE_HOURS * 3_600_000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"approval": [key[0]], "approvals": [approvals], "status": ["cancelled" if key[0] % 37 == 0 else status]})


def approval_quorum(events: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """The status of each request after every batch of votes; later rows of a request replace earlier ones."""
    votes = events.filter("event_type in ('error', 'purchase', 'signup')").withWatermark("ts", horizon)
    return votes.withColumn("approval", F.col("user_id")).groupBy("approval").applyInPandasWithState(
        _votes, "approval long, approvals long, status string", "seen array<int>, approvals long, status string, opened long", "update", GroupStateTimeout.EventTimeTimeout
    )


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[int]:
    """The event ids of a batch by time; of its rows only these two numbers are held."""
    ts, ids = (np.concatenate(x) for x in zip(*[(f["ts"].to_numpy().astype("datetime64[us]"), f["event_id"].to_numpy()) for f in frames]))
    yield from (int(i) for i in ids[np.lexsort((ids, ts))])


def _moves(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the current lifecycle state, how many events and how many illegal moves."""
    current, n, illegal = state.get if state.exists else ("received", 0, 0)
    for event_id in _in_order(frames):
        start, _, end = MOVES[event_id % len(MOVES)]
        illegal += start != current
        current, n = end, n + 1
    state.update((current, n, illegal))
    yield pd.DataFrame({"invoice_id": [key[0]], "state": [current], "events": [n], "illegal": [illegal]})


def lifecycle(events: DataFrame) -> DataFrame:
    """Current state, events and illegal moves by invoice, updated by batch."""
    return events.withColumn("invoice_id", F.col("user_id")).groupBy("invoice_id").applyInPandasWithState(_moves, "invoice_id long, state string, events long, illegal long", "state string, events long, illegal long", "update", GroupStateTimeout.NoTimeout)


def _refused(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the current lifecycle state. A row for every move that does not start there."""
    (current,) = state.get if state.exists else ("received",)
    rows = []
    for event_id in _in_order(frames):
        start, event, end = MOVES[event_id % len(MOVES)]
        if start != current:
            rows.append((key[0], event_id, current, event, start))
        current = end
    state.update((current,))
    yield pd.DataFrame(rows, columns=["invoice_id", "event_id", "was", "event", "from_state"])


def illegal_moves(events: DataFrame) -> DataFrame:
    """The moves that the lifecycle does not have from where the invoice was, one row each."""
    return events.withColumn("invoice_id", F.col("user_id")).groupBy("invoice_id").applyInPandasWithState(_refused, "invoice_id long, event_id long, was string, event string, from_state string", "state string", "append", GroupStateTimeout.NoTimeout)


def drain(spark: SparkSession, source: str, job: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = (), files: int | None = None) -> DataFrame:
    """Runs a streaming job over the event files of a folder to its end; the rows of its Parquet sink.

    With ``keys`` the job updates rows, and the last epoch's row of each key is the result; else it
    appends. ``files`` is how many files a micro-batch takes at most.
    """
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet")
    reader = reader.option("maxFilesPerTrigger", files) if files else reader
    # microsecond files read as plain timestamps
    out = job(reader.parquet(source).withColumn("ts", F.col("ts").cast(T.TimestampType())))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/out/batch-{epoch:06d}")

    query = out.writeStream.foreachBatch(sink).outputMode("update" if keys else "append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("epoch", T.LongType())])).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    if not keys:
        return rows.drop("epoch")
    rest = [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("last")).select(*keys, "last.*")


def _events(sf_dir: str) -> str:
    return f"{sf_dir}/events*.parquet"


def _quorum_sql() -> str:
    stale = f"q.status = 'pending' AND v.opened + INTERVAL {STALE_HOURS} HOUR < (SELECT max(ts) FROM events WHERE event_type IN ('error', 'purchase', 'signup')) - INTERVAL 1 HOUR"
    return f"""SELECT q.approval, q.approvals, CASE WHEN {stale} THEN 'stale' ELSE q.status END AS status FROM ({text('ap_quorum', 1)}) AS q
    JOIN (SELECT user_id, min(ts) AS opened FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY user_id) AS v ON v.user_id = q.approval"""


def _moves_sql() -> str:
    table = ", ".join(f"({i}, '{a}', '{e}', '{b}')" for i, (a, e, b) in enumerate(MOVES))
    return f"SELECT e.user_id AS invoice_id, e.ts, e.event_id, t.a, t.e, t.b, lag(t.b) OVER (PARTITION BY e.user_id ORDER BY e.ts, e.event_id) AS was FROM events AS e JOIN (VALUES {table}) AS t(i, a, e, b) ON t.i = e.event_id % {len(MOVES)}"


QUERIES = {
    "st_arrival_dedup": lambda s, d: drain(s, _events(d), arrival_dedup).select("sha256"),
    "st_same_amount": lambda s, d: drain(s, _events(d), same_amount),
    "st_cost_window": lambda s, d: drain(s, _events(d), cost_window, ("hour",)),
    "st_approval_quorum": lambda s, d: drain(s, _events(d), approval_quorum, ("approval",)),
    "st_lifecycle": lambda s, d: drain(s, _events(d), lifecycle, ("invoice_id",)),
    "st_illegal_moves": lambda s, d: drain(s, _events(d), illegal_moves),
}
ORACLE_SQL = {
    "st_arrival_dedup": "SELECT DISTINCT sha256(concat_ws('|', CAST(user_id AS VARCHAR), event_type, props)) AS sha256 FROM events",
    "st_same_amount": """SELECT a.event_id AS me_id, b.event_id AS other_id, a.user_id AS vendor, CAST(round(a.value * 100) AS BIGINT) AS amount FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND CAST(round(a.value * 100) AS BIGINT) = CAST(round(b.value * 100) AS BIGINT)
        AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 30 DAY AND b.event_id < a.event_id WHERE a.event_type = 'purchase' AND b.event_type = 'purchase'""",
    "st_approval_quorum": _quorum_sql(),
    "st_lifecycle": f"SELECT invoice_id, arg_max(b, (ts, event_id)) AS state, count(*) AS events, CAST(sum(CASE WHEN a <> coalesce(was, 'received') THEN 1 ELSE 0 END) AS BIGINT) AS illegal FROM ({_moves_sql()}) AS m GROUP BY invoice_id",
    "st_illegal_moves": f"SELECT invoice_id, event_id, coalesce(was, 'received') AS was, e AS event, a AS from_state FROM ({_moves_sql()}) AS m WHERE a <> coalesce(was, 'received')",
    "st_cost_window": text("st_cost_window_batch", 1),
}
