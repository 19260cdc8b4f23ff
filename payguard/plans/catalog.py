"""Named SQL jobs over named views, for Spark and, in its own dialect, for DuckDB.

A job's text names views (``v_...``). For Spark each one is a DataFrame under a name of its own,
for DuckDB a common table expression before the text, so that either sees one plan and prunes, pushes
and reuses within it. A few spellings that differ between the two engines are written ``@name[a; b]``.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")

VIEWS: dict[str, str] = {}
JOBS: dict[str, str] = {}
#: Jobs that Spark has in words of their own; those in JOBS are for the other engine then.
SPARK_JOBS: dict[str, str] = {}
#: Views that Spark works out with a function of DataFrames, by the views they read; their SQL is for the other engine.
NATIVE: dict[str, tuple[Callable[[Callable[[str], DataFrame]], DataFrame], tuple[str, ...]]] = {}

SPELLINGS: dict[str, tuple[str, str]] = {
    "sha": ("sha2({0}, 256)", "sha256({0})"),
    "list": ("listagg({0}, '|') WITHIN GROUP (ORDER BY {1})", "string_agg({0}, '|' ORDER BY {1})"),
    "days": ("CAST(datediff({0}, {1}) AS BIGINT)", "datediff('day', {1}, {0})"),
    "sub": ("regexp_replace({0}, r{1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "like": ("regexp_like({0}, r{1})", "regexp_matches({0}, {1})"),
    "get": ("regexp_extract({0}, r{1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "all": ("regexp_extract_all({0}, r{1}, 0)", "regexp_extract_all({0}, {1})"),
    "n": ("CAST(size({0}) AS BIGINT)", "CAST(len({0}) AS BIGINT)"),
    "div": ("({0} div {1})", "CAST(({0} // {1}) AS BIGINT)"),
    "json": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "every": ("forall({0}, x -> {1})", "list_bool_and(list_transform({0}, lambda x: {1}))"),
    "each": ("explode(split({0}, '[|]'))", "unnest(string_split({0}, '|'))"),
    "hours": ("CAST(timestampdiff(HOUR, {1}, {0}) AS BIGINT)", "datesub('hour', {1}, {0})"),
    "day": ("CAST(try_to_date({0}, '{1}') AS DATE)", "CAST(try_strptime({0}, '{2}') AS DATE)"),
    "glue": ("regexp_replace({0}, r'([0-9])[, ]([0-9])', '$1$2')", "regexp_replace({0}, '([0-9])[, ]([0-9])', '\\1\\2', 'g')"),
    "hour": ("date_trunc('HOUR', {0})", "date_trunc('hour', {0})"),
}


def _spelled(text: str, engine: int) -> str:
    """``@name[a; b]`` in the engine's spelling; arguments may hold further ones and brackets."""
    out, at = [], 0
    for m in re.finditer(r"@(\w+)\[", text):
        if m.start() < at:
            continue
        depth, i, args, start, quoted = 1, m.end(), [], m.end(), False
        while depth:
            c = text[i]
            if c == "'":
                quoted = not quoted
            elif not quoted:
                depth += (c in "[(") - (c in "])")
                if c == ";" and depth == 1:
                    args.append(text[start:i].strip())
                    start = i + 1
            i += 1
        args.append(text[start : i - 1].strip())
        args = [_spelled(a, engine) for a in args]
        out += [text[at : m.start()], SPELLINGS[m[1]][engine].format(*args)]
        at = i
    return "".join([*out, text[at:]])


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def variant(suffix: str, changed: dict[str, str], *names: str) -> None:
    """Copies of views for the other engine, which read other views in place of some; a copied name gets the suffix."""
    for name in names:
        VIEWS[name + suffix] = re.sub(r"\bv_\w+", lambda m: changed.get(m[0], m[0] + suffix if m[0] in names else m[0]), VIEWS[name])


def native(name: str, make: Callable[[Callable[[str], DataFrame]], DataFrame], *reads: str) -> None:
    NATIVE[name] = (make, reads)
    VIEWS.setdefault(name, "")  # without SQL, where only Spark has it


def job(name: str, sql: str, spark: str | None = None) -> None:
    JOBS[name] = sql
    if spark:
        SPARK_JOBS[name] = spark


def _behind(name: str, engine: int) -> str:
    """What a view reads, in words."""
    return " ".join(NATIVE[name][1]) if engine == 0 and name in NATIVE else VIEWS[name]


def _needs(sql: str, seen: dict[str, None], engine: int = 0) -> dict[str, None]:
    for name in re.findall(r"\bv_\w+", sql):
        if name not in seen and name in VIEWS:
            _needs(_behind(name, engine), seen, engine)
            seen[name] = None
    return seen


def text(name: str, engine: int) -> str:
    """The job with all views before it."""
    sql = JOBS[name] if name in JOBS else f"SELECT * FROM {name}"
    parts = [f"{v} AS ({VIEWS[v]})" for v in _needs(sql, {}, 1)]
    return _spelled((f"WITH {', '.join(parts)} " if parts else "") + sql, engine)


def _uses(sql: str) -> dict[str, int]:
    """How often each view is worked out: by every mention, but once only behind a view that is written."""
    counts: dict[str, int] = {}

    def mention(text: str, times: int) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS:
                counts[name] = counts.get(name, 0) + times

    mention(sql, 1)
    for v in reversed(_needs(sql, {})):  # what reads a view goes before it
        mention(_behind(v, 0), 1 if v in SHARED and counts[v] >= OFTEN else counts[v])
    return counts


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; where none is set a local run takes one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Views that are costly and used in many places: where a job mentions one twice, all told, it is written once.
SHARED, OFTEN = ("v_order_book", "v_inv", "v_pairs", "v_qty", "v_price", "v_eligible", "v_resolved_inv", "v_ev", "v_match", "v_confidence"), 2


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frame(spark: SparkSession, sf_dir: str, name: str, written: bool = False) -> DataFrame:
    """A job or view as a DataFrame over the tables of a folder; ``written`` where it is read several times.

    Views that several parts of the job use are written as Parquet in the shared folder, in
    order, and read from there; all others are parts of one plan, each put into it where it is
    named. They are no common table expressions, as Spark's inlining of nested ones takes two columns of a
    union for each other, depending on the numbers that the session has given out.
    """
    sql = SPARK_JOBS.get(name) or JOBS.get(name) or f"SELECT * FROM {name}"
    for table in TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    counts, done = _uses(sql), {}

    def ready(text: str) -> DataFrame:
        for v in _reach(text, done):
            put(v)
        return spark.sql(_spelled(re.sub(r"\bv_\w+", lambda m: done.get(m[0], m[0]), text), 0))

    def put(v: str) -> None:
        """A view under a name of its own, made of those before it."""
        if v not in done:
            often = v in SHARED and counts[v] >= OFTEN
            df = NATIVE[v][0](lambda x: ready(f"SELECT * FROM {x}")) if v in NATIVE else ready(VIEWS[v])
            df = _written(df, v) if often else df
            done[v] = f"shared_{v}_{uuid.uuid4().hex[:8]}"
            df.createOrReplaceTempView(done[v])

    out = ready(sql)
    for own in done.values():  # the plan holds what they say
        spark.catalog.dropTempView(own)
    return _written(out, name) if written else out


def _reach(sql: str, done: dict[str, str], seen: dict[str, None] | None = None) -> dict[str, None]:
    """The views a text needs, not looking behind those that are written; in order."""
    seen = {} if seen is None else seen
    for name in re.findall(r"\bv_\w+", sql):
        if name in VIEWS and name not in seen:
            if name not in done:
                _reach(_behind(name, 0), done, seen)
            seen[name] = None
    return seen


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(spark, sf_dir, name)

    run.__name__ = name
    return run
