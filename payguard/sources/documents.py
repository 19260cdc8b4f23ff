"""Nested JSON in and out, as explicit schemas and generators over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from payguard.plans.catalog import frame, shared_dir, text

#: An order as an ERP sends it; numbers stay text until they are cast, never floats.
ORDER = "DocNumber string, VendorRef string, Currency string, POStatus string, Line array<struct<DetailType:string, LineNum:string, Description:string, ItemRef:string, Qty:string, UnitPrice:string, Amount:string>>"
#: Which line kinds are order lines; statuses and what they mean.
LINE_KINDS = ("ItemBasedExpenseLineDetail", "AccountBasedExpenseLineDetail")
STATUSES = {"Open": "open", "Closed": "closed"}


def flatten_orders(raw: DataFrame) -> DataFrame:
    """(json) -> one row an order line. An order without lines has none; text that is no order is dropped.

    line_no is the printed number or the 1-based place among all lines of the document.
    """
    order = raw.select(F.from_json("json", ORDER).alias("o")).select("o.*").filter("DocNumber is not null")
    lines = order.select("*", F.posexplode("Line").alias("pos", "l")).filter(F.col("l.DetailType").isin(*LINE_KINDS))
    status = F.coalesce(*[F.when(F.col("POStatus") == k, F.lit(v)) for k, v in STATUSES.items()], F.lit("open"))
    number = lambda c: F.col(f"l.{c}").try_cast("decimal(18,6)")
    return lines.select(
        F.col("DocNumber").alias("po_number"), F.col("VendorRef").alias("vendor"), F.coalesce("Currency", F.lit("USD")).alias("currency"), status.alias("status"),
        F.coalesce(F.col("l.LineNum").try_cast("bigint"), F.col("pos") + 1).alias("line_no"), F.nullif(F.trim("l.Description"), F.lit("")).alias("description"),
        number("Qty").alias("qty"), number("UnitPrice").alias("unit_price"), number("Amount").alias("extended"),
    )


def orders_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order documents made of the order views, with subtotal rows and unnumbered lines among them."""
    lines = frame(spark, sf_dir, "v_pol").join(frame(spark, sf_dir, "v_po"), "po")
    line = F.struct(
        F.when(F.col("line_no") % 5 == 4, "AccountBasedExpenseLineDetail").otherwise("ItemBasedExpenseLineDetail").alias("DetailType"),
        F.when(F.col("po") % 3 != 0, F.col("line_no").cast("string")).alias("LineNum"), F.when(F.col("line_no") % 7 == 0, " ").otherwise(F.col("description")).alias("Description"),
        F.col("item_ref").alias("ItemRef"), F.col("qty").cast("string").alias("Qty"), (F.col("price") / 100).cast("decimal(18,2)").cast("string").alias("UnitPrice"), (F.col("extended") / 100).cast("decimal(18,2)").cast("string").alias("Amount"),
    )
    total = F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(("SubTotalLineDetail", *[None] * 6), ("DetailType", "LineNum", "Description", "ItemRef", "Qty", "UnitPrice", "Amount"))])
    head = [F.col("po").cast("string").alias("DocNumber"), F.col("vendor").cast("string").alias("VendorRef"), F.when(F.col("currency") != "USD", F.col("currency")).alias("Currency"), F.when(F.col("status") == "closed", "Closed").when(F.col("status") == "open", "Open").alias("POStatus")]
    docs = lines.groupBy(*head).agg(F.array_sort(F.collect_list(F.struct("line_no", line.alias("l")))).alias("l"))
    docs = docs.withColumn("Line", F.concat(F.col("l.l"), F.array(total))).drop("l")
    return docs.select(F.to_json(F.struct("*")).alias("json"))


def src_po_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened orders; the exact decimals are shown as doubles, for engines that compare them so."""
    lines = flatten_orders(orders_as_json(spark, sf_dir))
    return lines.withColumns({c: F.col(c).cast("double") for c in ("qty", "unit_price", "extended")})


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def src_readings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved readings, written as JSON lines and read with their schema."""
    readings = frame(spark, sf_dir, "v_readings").select("invoice_id", "field", F.col("a").alias("primary"), F.col("b").alias("secondary"))
    path = _scratch(spark, "readings")
    readings.write.json(path)
    return spark.read.schema("invoice_id long, field string, primary string, secondary string").json(path)


def snk_audit_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail as JSON lines, in order within each invoice; read again with its place in the file."""
    trail = frame(spark, sf_dir, "v_chain")
    path = _scratch(spark, "trail")
    trail.repartition("invoice_id").sortWithinPartitions("invoice_id", "seq").write.json(path)
    return spark.read.schema("invoice_id long, seq long, line string, prev_hash string").json(path)


#: First bytes, in hex, and the media types that they mean.
MAGIC = (("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("49492A00", "image/tiff"), ("4D4D002A", "image/tiff"))


def index_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below a folder, by its first bytes: file, source, kind, media_type, n_bytes, sha256, duplicate_of, error.

    ``file`` and ``source`` (its folder) are relative to the root. A file that begins like no known one stays
    as a row with an error and nothing else; one without a byte has no row, as Spark's reader passes over it. A PDF that names a font has a text layer and is
    ``born_digital``; pictures and other PDFs are a ``scan``. Of files with one content the first by
    name has no ``duplicate_of``. A file is read by one task, so it must fit there.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    head = F.hex(F.substring("content", 1, 8))
    media = F.coalesce(*[F.when(head.startswith(magic), kind) for magic, kind in MAGIC])
    fonts = F.coalesce(F.position(F.lit(b"/Font"), F.col("content")) > 0, F.lit(False))
    error = F.when(media.isNull(), F.concat(F.lit("unrecognised header: "), head))
    above = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = above.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(above).toString().rstrip("/")
    name = F.expr(f"substring(path, instr(path, '{base.split(':', 1)[-1].lstrip('/')}') + {len(base.split(':', 1)[-1].lstrip('/')) + 1})")
    slim = files.select(name.alias("file"), media.alias("media"), fonts.alias("fonts"), "length", F.sha2("content", 256).alias("digest"), error.alias("error"))
    slim = slim.withColumn("source", F.coalesce(F.nullif(F.regexp_extract("file", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("(root)")))
    good = F.col("error").isNull()
    first = slim.filter(good).groupBy("digest").agg(F.min("file").alias("first_file"))
    rows = slim.join(first, "digest", "left")
    kind = F.when((F.col("media") == "application/pdf") & F.col("fonts"), "born_digital").otherwise("scan")
    told = lambda x: F.when(good, x)
    return rows.select(
        "file", "source", told(kind).alias("kind"), told(F.col("media")).alias("media_type"), told(F.col("length")).alias("n_bytes"), told(F.col("digest")).alias("sha256"),
        told(F.when(F.col("file") != F.col("first_file"), F.col("first_file"))).alias("duplicate_of"), "error",
    )


def index_summary(index: DataFrame) -> DataFrame:
    """(what, item, n): files by source and by kind, unreadable ones, extra copies, and contents that have any."""
    one = lambda what, n: index.agg(n.alias("n")).select(F.lit(what).alias("what"), F.lit("").alias("item"), "n")
    by = lambda c: index.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("what"), "item", "n")
    copies = F.col("duplicate_of").isNotNull()
    return by("source").union(by("kind")).union(one("unreadable", F.count("error"))).union(one("extra_copies", F.count_if(copies))).union(one("duplicated", F.count_distinct(F.when(copies, F.col("sha256")))))


def oracle_sql() -> dict[str, str]:
    """What the round trips through JSON must give back, from the views alone."""
    order = f"""SELECT CAST(o.po AS VARCHAR) AS po_number, CAST(o.vendor AS VARCHAR) AS vendor, o.currency, CASE WHEN o.status = 'closed' THEN 'closed' ELSE 'open' END AS status, l.line_no, CASE WHEN l.line_no % 7 <> 0 THEN l.description END AS description,
    CAST(l.qty AS DOUBLE) AS qty, CAST(l.price / 100.0 AS DOUBLE) AS unit_price, CAST(l.extended / 100.0 AS DOUBLE) AS extended FROM ({text("v_pol", 1)}) AS l JOIN ({text("v_po", 1)}) AS o ON o.po = l.po"""
    return {
        "src_po_json": order,
        "src_readings_json": f'SELECT invoice_id, field, a AS "primary", b AS secondary FROM ({text("v_readings", 1)}) AS r',
        "snk_audit_jsonl": f"SELECT invoice_id, seq, line, prev_hash FROM ({text('v_chain', 1)}) AS c",
    }


QUERIES = {"src_po_json": src_po_json, "src_readings_json": src_readings_json, "snk_audit_jsonl": snk_audit_jsonl}
