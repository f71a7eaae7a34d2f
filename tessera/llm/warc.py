"""WARC archives written and read with Spark's own text reader and writer; records found by boundary-chain verification.

Writing: one record per page; the text sink ends every row with CRLF CRLF, which is the end of a WARC record.

Reading: the text source splits files at the bytes that end one record and begin the next. Every piece so found is only
a *candidate* record, since a payload may hold the same bytes. Tasks emit, for each candidate, its offset and the
offset its Content-Length says the successor has. Pointer jumping from the start of each file (offset 0) doubles the
hop in each round and keeps just the candidates the chain from there reaches; pieces in between belong to the payload
of the record before them and are put back.

Files can be split over tasks: a piece's offset is the sum of the bytes before it, built from one total per split. The
offsets come from one read, saved; a second read, for records with boundary bytes in their payload, knows pieces again by
a digest of their bytes, so it doesn't matter if the reader deals files to tasks in another way by then.

Defined results: a null html is an empty payload; a null or odd url is percent-encoded where it has blanks or control
characters; a null page_id is written without an id and read back as null. Rows that repeat a page are records of their
own; several rows of the largest page_id of a group are all responses. Extra columns are not read. An empty table gives
an empty archive and an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import forget, fresh_path, load, saved

CRLF = "\r\n"
END = CRLF + CRLF
MAGIC = "WARC/1.1" + CRLF
SEP = END + MAGIC
#: Payloads of fewer bytes are always stored in full.
LEAST_SHARED = 1000
#: Records in a file; the chain of a file is found in log2 of this many rounds.
RECORDS_A_FILE = 2048
#: At most so many groups of equal payloads are broadcast (about 80 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def write_warc(pages: DataFrame, path: str) -> None:
    """Write page_id, url, html as WARC files under path."""
    p = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    groups = p.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1 and leader is not null").select("digest", "leader"), "warc")
    small = groups.count() <= BROADCAST_ROWS
    p = p.join(F.broadcast(groups) if small else groups, "digest", "left")
    revisit = F.col("leader").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("leader")) & (F.col("bytes") >= LEAST_SHARED)
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes"), F.lit(END))
    start = [F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{CRLF}WARC-Record-ID: "), name, F.lit(f"{CRLF}WARC-Date: 1970-01-01T00:00:00Z{CRLF}WARC-Target-URI: "), F.col("url"), F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest")]
    again = F.concat(F.lit(f"{CRLF}WARC-Profile: {_PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), F.col("leader").cast("string"), F.lit(f">{CRLF}Content-Length: 0{END}"))
    full = F.concat(F.lit(f"{CRLF}Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(http) + F.col("bytes"), F.lit(END), http, F.col("html"))
    record = F.concat(*start, F.when(revisit, again).otherwise(full))
    p.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_A_FILE).text(path)
    forget(groups)


def pieces(spark, path: str) -> DataFrame:
    """file, block, m (order within a block), body: what lies between two record boundaries, as bytes came."""
    return spark.read.option("lineSep", SEP).option("pathGlobFilter", "*.txt").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("m"), F.col("value").alias("body")
    )


def _header(body, name: str):
    return F.regexp_extract(F.concat(F.lit(CRLF), body), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)


def parsed(p: DataFrame) -> DataFrame:
    """Adds what each piece's header says, and the payload's digest as far as the piece holds it whole.

    Slices are taken from bytes, as Content-Length counts bytes.
    """
    p = p.withColumn("head", F.substring_index("body", END, 1)).withColumn("raw", F.col("body").cast("binary"))
    p = p.withColumn("len", F.octet_length("raw").cast("long")).withColumn("head_len", F.octet_length("head").cast("long") + 4)
    p = p.withColumn("size", _header(F.col("head"), "Content-Length").try_cast("long"))
    p = p.withColumn("type", _header(F.col("head"), "WARC-Type"))
    p = p.withColumn("block_head", F.when(_header(F.col("head"), "Content-Type").startswith("application/http"), F.octet_length(F.substring_index(F.expr("substring(body, length(head) + 5, length(body))"), END, 1)).cast("long") + 4).otherwise(F.lit(0).cast("long")))
    p = p.withColumn("payload_bytes", F.col("size") - F.col("block_head"))
    p = p.withColumn("payload", F.expr("substring(raw, cast(head_len + block_head + 1 AS int), cast(payload_bytes AS int))"))
    return p.withColumn("whole", (F.col("head_len") + F.col("size") <= F.col("len")) & (F.octet_length("payload") == F.col("payload_bytes")))


def candidates(spark, path: str) -> DataFrame:
    """One slim row per candidate record: file, off, next_off and what its header says. No payloads."""
    p = parsed(pieces(spark, path))
    page = lambda name: F.regexp_extract(_header(F.col("head"), name), "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    slim = saved(
        p.select(
            "file", "block", "m", "len", (F.col("head_len") + F.col("size")).alias("span"), "type", "whole", "payload_bytes", F.sha1("payload").alias("digest"),
            page("WARC-Record-ID").alias("page_id"), page("WARC-Refers-To").alias("refers_to"), F.md5("raw").alias("piece"), F.regexp_extract(_header(F.col("head"), "WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("said_digest"),
        ),
        "warc",
    )
    # Offsets: bytes of earlier splits of the file (one row a split), then of earlier pieces of the split.
    step = F.col("len") + len(SEP)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = slim.groupBy("file", "block").agg(F.sum(step).alias("_t")).withColumn("_base", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    within = Window.partitionBy("file", "block").orderBy("m").rowsBetween(Window.unboundedPreceding, -1)
    c = slim.join(totals.select("file", "block", "_base"), ["file", "block"]).withColumn("at", F.col("_base") + F.coalesce(F.sum(step).over(within), F.lit(0)))
    # Only the first piece of a file still has its magic: later ones lost it to the separator.
    first = F.col("at") == 0
    c = c.withColumn("off", F.when(first, F.lit(0)).otherwise(F.col("at") - len(MAGIC)).cast("long"))
    return c.withColumn("next_off", F.col("off") + F.when(first, F.lit(0)).otherwise(len(MAGIC)) + F.col("span") + len(END)).drop("_base")


def reachable(chain: DataFrame) -> DataFrame:
    """(file, off) of the nodes of chain(file, off, next_off) that a walk from offset 0 of the file meets.

    Round k knows the first 2^k records of each file and every candidate's 2^k-th successor.
    """
    nodes = chain.select("file", "off")
    jump = saved(chain.join(nodes.withColumnRenamed("off", "next_off"), ["file", "next_off"]).select("file", "off", "next_off"), "jump")
    seen = saved(nodes.where("off = 0").distinct(), "seen")
    for _ in range(64):
        if jump.isEmpty():
            break
        ahead = seen.join(jump, ["file", "off"]).select("file", F.col("next_off").alias("off"))
        more = saved(seen.union(ahead), "seen")
        twice = saved(jump.join(jump.select("file", F.col("off").alias("next_off"), F.col("next_off").alias("_n")), ["file", "next_off"]).select("file", "off", F.col("_n").alias("next_off")), "jump")
        forget(seen)
        forget(jump)
        seen, jump = more, twice
    return seen


def read_warc(spark, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, digest_ok of the records under path.

    Revisits get the length of the payload they refer to. payload_digest is computed from the stored payload for
    responses; digest_ok says whether the header agrees.
    """
    c = saved(candidates(spark, path), "warc")
    # A record's span is a positive number of bytes, so the chain can't turn back.
    live = reachable(c.where("span >= 0").select("file", "off", "next_off"))
    r = c.join(live, ["file", "off"])
    fields = ["page_id", "type", "refers_to", "payload_bytes", "digest", "said_digest"]
    good = r.where("whole").select(*fields)
    cut = r.where("not whole")
    if not cut.isEmpty():
        good = good.unionByName(_joined(spark, path, c, live, cut).select(*fields))
    full = good.where("type <> 'revisit'")
    again = good.where("type = 'revisit'")
    # Pages may share an id, so a revisit finds its response by id and payload.
    known = full.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("digest").alias("said_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    back = again.drop("payload_bytes", "digest").join(known, ["refers_to", "said_digest"], "left")
    out = full.select("page_id", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "payload_bytes", F.col("digest").alias("payload_digest"), (F.col("digest") == F.col("said_digest")).alias("digest_ok"))
    return out.unionByName(back.select("page_id", F.lit("revisit").alias("record_type"), "refers_to", F.col("_bytes").alias("payload_bytes"), F.col("said_digest").alias("payload_digest"), F.col("_bytes").isNotNull().alias("digest_ok")))


def _joined(spark, path: str, c: DataFrame, live: DataFrame, cut: DataFrame) -> DataFrame:
    """Records whose payload holds boundary bytes, put together from their pieces. Only the files concerned are read again."""
    # Each piece belongs to the last record at or before it; slim rows of one file at a time.
    order = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    marked = c.join(live.withColumn("_live", F.lit(True)), ["file", "off"], "left").withColumn("rec", F.last(F.when(F.col("_live"), F.col("off")), ignorenulls=True).over(order))
    parts = marked.join(cut.select("file", F.col("off").alias("rec")), ["file", "rec"], "left_semi").select("file", "piece", "rec", "off")
    # Pieces are known again by their bytes: where splits begin, and so any place in them, may differ from read to read.
    again = pieces(spark, path).withColumn("piece", F.md5(F.col("body").cast("binary")))
    again = again.join(parts.select("file", "piece").distinct(), ["file", "piece"], "left_semi").groupBy("file", "piece").agg(F.first("body").alias("body"))
    bodies = parts.join(again, ["file", "piece"], "left")
    lost = F.raise_error(F.concat(F.lit("bytes of a record changed while they were read: "), F.col("file")))
    bodies = bodies.withColumn("body", F.when(F.col("body").isNull(), lost).otherwise(F.col("body")))
    whole = bodies.groupBy("file", "rec").agg(F.array_sort(F.collect_list(F.struct("off", "body"))).alias("_b")).withColumn("body", F.expr("array_join(transform(_b, x -> x.body), :s)".replace(":s", "'" + SEP.replace("\r", "\\r").replace("\n", "\\n") + "'")))
    done = parsed(whole.select("file", F.col("rec").alias("off"), "body")).select("file", "off", "payload_bytes", F.sha1("payload").alias("digest"))
    return cut.drop("payload_bytes", "digest").join(done, ["file", "off"], "left")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(load(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS leader FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT p.page_id, strlen(p.html)::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN g.leader IS NULL OR g.leader = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.leader <> p.page_id THEN g.leader END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""
