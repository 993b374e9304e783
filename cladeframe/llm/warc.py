"""WARC as a content-addressed archive.

A payload's bytes are stored once, under their SHA-256; the exact header block of every record is
stored apart, with that key. Records are put together again by joining the two tables: payloads are
bucketed by their key, so their bytes stay where they are and only the headers of responses, one for
each payload, move. The digest is
verified: payloads that share a key must agree in a second digest (SHA-1) and in length when they
are written, and a payload must still hash to its key, and to the digest in its record's header,
when it is read; otherwise the job fails.

Of records with equal payloads of at least MIN_BYTES bytes, that with the largest page_id is a
response and the others are revisits of it; smaller payloads are responses all.

Defined results: a null page is an empty payload; a null url leaves out its header line; line ends in
a url are written as %0D and %0A. Rows that
repeat the response's page_id with the same payload are responses too. A row without page_id is a
revisit where its payload has a response with one. Only page_id, url and html are read, so other
columns can't clash. An empty table gives an empty archive.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
#: The alphabet of base32 and the digits that conv() writes, both in order of value.
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def base32(hexed: Column) -> Column:
    """Base32 of 160 bits given as 40 hexadecimal digits: five digits are four characters."""
    parts = [F.lpad(F.conv(F.substring(hexed, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def header_block(owner: Column, min_bytes: int) -> Column:
    """The header block of a record, with the blank line that ends it."""
    revisit = (F.col("length") >= min_bytes) & owner.isNotNull() & ~F.col("page_id").eqNullSafe(owner)

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def page(id_: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))

    common = [
        line("WARC-Record-ID", page(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
    ]
    refers = F.when(revisit, F.concat(line("WARC-Refers-To", page(owner)), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise("")
    kind = line("WARC-Type", F.when(revisit, "revisit").otherwise("response"))
    size = line("Content-Length", F.when(revisit, 0).otherwise(F.col("length")).cast("string"))
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), kind, *common, refers, line("Content-Type", F.lit("text/html")), size, F.lit(CRLF))


def bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The stored payloads (key, payload) with what is known of their placement."""
    name = f"payloads_{uuid.uuid4().hex}"
    at = path.replace("'", "\\'")
    spark.sql(f"create table {name} (key binary, payload binary) using parquet clustered by (key) into {buckets} buckets location '{at}'")
    found = spark.table(name)
    found.schema  # noqa: B018  the plan is made before the name goes
    spark.sql(f"drop table {name}")  # an external table: files stay
    return found


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Writes the archive: path/payloads (key, payload; bucketed), path/headers (page_id, key, header) and path/buckets (their number)."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload")).withColumn("key", F.unhex(F.sha2("payload", 256)))
    # equal payloads meet inside each task first, so a payload that is everywhere is shuffled once a task
    once = full.select("key", "payload", F.sha1("payload").alias("second"), F.octet_length("payload").alias("length")).groupBy("key").agg(
        F.first("payload").alias("payload"), F.min("second").alias("a"), F.max("second").alias("b"), F.min("length").alias("c"), F.max("length").alias("d")
    )
    checked = F.when((F.col("a") == F.col("b")) & (F.col("c") == F.col("d")), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary"))
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"payloads_{uuid.uuid4().hex}"
    # rows are already dealt by key to as many partitions as there are buckets, so each bucket is one file
    once.select("key", checked.alias("payload")).write.option("path", f"{path}/payloads").option("compression", "zstd").bucketBy(buckets, "key").saveAsTable(name)
    spark.sql(f"drop table {name}")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/buckets")
    slim = full.select("page_id", "url", "key", base32(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    owners = slim.groupBy("key").agg(F.max("page_id").alias("owner"))
    slim.join(owners, "key").select("page_id", "key", header_block(F.col("owner"), min_bytes).alias("header")).write.parquet(f"{path}/headers")


def revisit() -> Column:
    return F.col("header").contains(f"{CRLF}WARC-Type: revisit{CRLF}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The payloads (key, payload, length, digest); each must hash to its key."""
    rows = bucketed(spark, f"{path}/payloads", spark.read.parquet(f"{path}/buckets").first().buckets)
    good = F.when(F.unhex(F.sha2("payload", 256)) == F.col("key"), F.sha1("payload")).otherwise(F.raise_error(F.lit("a payload doesn't match its digest")).cast("string"))
    return rows.select("key", "payload", F.octet_length("payload").cast("long").alias("length"), base32(good).alias("digest"))


def matching() -> Column:
    """The digest of a payload, which must be that in the header beside it."""
    same = F.regexp_extract("header", r"WARC-Payload-Digest: sha1:([A-Z2-7]+)", 1) == F.col("digest")
    return F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("a record's header doesn't match its payload")).cast("string"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The archive's records: page_id, header, and payload with its length and digest, verified.

    Without the column payload, payload bytes are hashed where they are scanned and never shuffled.
    """
    rows = spark.read.parquet(f"{path}/headers").join(stored(spark, path), "key")
    return rows.select("page_id", "header", "payload", "length", matching().alias("digest"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id and the bytes of each original record: header block, and the payload unless it is a revisit."""
    headers = spark.read.parquet(f"{path}/headers")
    responses = headers.where(~revisit()).join(stored(spark, path), "key")
    whole = F.when(matching().isNotNull(), F.concat(F.encode("header", "UTF-8"), F.col("payload")))
    return responses.select("page_id", whole.alias("record")).unionByName(headers.where(revisit()).select("page_id", F.encode("header", "UTF-8").alias("record")))


def split(rows: DataFrame) -> DataFrame:
    """page_id, header and body of records (page_id, record): the body starts behind the first blank line.

    Bytes are looked through as characters of one byte each."""
    at = F.instr(F.decode("record", "ISO-8859-1"), F.lit(CRLF * 2)) + 3
    cut = rows.select("page_id", "record", at.alias("at"))
    return cut.select("page_id", F.decode(F.substring("record", F.lit(1), F.col("at")), "UTF-8").alias("header"), F.substring("record", F.col("at") + 1, F.greatest(F.octet_length("record") - F.col("at"), F.lit(0))).alias("body"))


def said() -> list[Column]:
    """record_type and refers_to of a header."""
    refers = F.nullif(F.regexp_extract("header", r"WARC-Refers-To: <urn:page:(-?[0-9]+)>", 1), F.lit(""))
    return [F.regexp_extract("header", r"WARC-Type: ([a-z]+)", 1).alias("record_type"), refers.cast("long").alias("refers_to")]


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """What the archive's records say: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's payload is measured in its record, as rebuilt and split again; a revisit's is the
    stored payload that its header stands beside.
    """
    own = split(records(spark, path)).where(~revisit())
    size = F.regexp_extract("header", r"Content-Length: ([0-9]+)", 1).cast("long")
    whole = F.when(size == F.octet_length("body"), size).otherwise(F.raise_error(F.lit("a record is cut")).cast("long"))
    own = own.select("page_id", whole.alias("payload_bytes"), base32(F.sha1("body")).alias("payload_digest"), *said())
    others = read(spark, path).where(revisit()).select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), *said())
    return own.unionByName(others)


def export(spark: SparkSession, path: str, to: str) -> None:
    """Writes the records as plain WARC files; each record ends with two line ends."""
    text = records(spark, path).select(F.decode("record", "UTF-8").alias("value"))
    text.write.option("lineSep", CRLF * 2).text(to)
