"""WARC archives: writing, and reading back with boundary-chain verification.

An archive is plain text records that end in two line breaks, so Spark's text sink writes it with
that as its line separator, to any file system that Spark knows. Reading splits files in parallel
at the record magic: tasks emit, for every place that looks like the start of a record, its offset
and the offset of its successor, which the record's length field gives. The magic may stand in a
payload too, so a candidate counts only if a chain of successors leads to it from the start of the
file. Pointer jumping finds those: in each round every candidate's pointer skips twice as far, and
what reached candidates point at becomes reached, so a file of n records takes log2(n) rounds.
Every round is written, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from treelace.llm.common import BUCKETS, materialize, read_tables, release, shared_path

#: Payload bytes from which equal payloads are written once.
REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreservecommons.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
MAGIC = "WARC/1."
ID = "urn:page:"


def _one_line(c: Column) -> Column:
    return F.regexp_replace(c, "[\r\n]+", " ")


def _bucket(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for each row. A null payload is empty, a null url has no Target-URI, a null id no number.

    Of rows with equal payloads of REVISIT_BYTES or more, those of the smallest id are responses
    with the payload, the others revisits of it without; so are rows with a null id if another has one.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).alias("n"))
    groups = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null")
    firsts = materialize(groups.select("digest", "first"), "warc-groups")
    near = F.broadcast(firsts.select(_bucket("digest").alias("near")).distinct())  # at most BUCKETS rows
    tagged = rows.withColumn("near", _bucket("digest"))
    alone = tagged.join(near, "near", "left_anti").withColumn("first", F.lit(None).cast(firsts.schema["first"].dataType))
    shared = tagged.join(near, "near", "left_semi").join(firsts, "digest", "left")  # only these may be shuffled
    joined = alone.unionByName(shared).withColumn("revisit", F.col("first").isNotNull() & (F.col("key").isNull() | (F.col("key") != F.col("first"))))
    body = F.when(F.col("revisit"), "").otherwise(F.col("text"))
    field = lambda name, value: F.concat(F.lit(name + ": "), value)  # noqa: E731  null if the value is
    head = F.concat_ws(
        "\r\n",
        F.lit(MAGIC + "1"),
        field("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        field("WARC-Record-ID", F.concat(F.lit(f"<{ID}"), F.coalesce("id", F.lit("")), F.lit(">"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", _one_line(F.col("url"))),
        F.when(F.col("revisit"), field("WARC-Profile", F.lit(PROFILE))),
        F.when(F.col("revisit"), field("WARC-Refers-To", F.concat(F.lit(f"<{ID}"), F.col("first").cast("string"), F.lit(">")))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("Content-Type", F.lit("text/html")),
        field("Content-Length", F.octet_length(body).cast("string")),
    )
    joined.select(F.concat(head, F.lit(END), body).alias("value")).write.option("lineSep", END).text(path)
    release(firsts)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files' bytes, cut at END + MAGIC: what stands between two places that look like the start of a record."""
    src = spark.read.option("lineSep", END + MAGIC).text(path)
    return src.select("value", F.sha2("value", 256).alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, piece, offset, succ, ...) of every place that looks like the start of a record.

    succ is where the next record starts if this one is real; null for a header without a length.
    Payload columns are filled where the payload has no magic, which the length shows. piece is a
    digest of the bytes up to the next candidate, by which they are found again.
    """
    head = F.substring_index("value", END, 1)
    raw = F.col("value").cast("binary")
    get = lambda name: F.regexp_extract("head", rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    size = F.octet_length("value").cast("long")
    p = _pieces(spark, path).withColumn("head", head).withColumn("size", size).withColumn("body_at", F.octet_length("head").cast("long") + 4)
    p = p.withColumn("length", F.regexp_extract("head", r"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|$)", 1).try_cast("long"))
    whole = (F.col("size") - F.col("body_at") - F.col("length")).isin(0, 4)  # the file's last piece keeps its END
    p = p.select(
        "file", "block", "seq", "piece", "size", "body_at", "length",
        F.coalesce(whole, F.lit(False)).alias("whole"),
        F.when(whole, F.sha2(F.substr(raw, F.col("body_at").cast("int") + 1, F.col("length").cast("int")), 256)).alias("payload_sha256"),
        get("WARC-Type").alias("type"), get("WARC-Record-ID").alias("record_id"), get("WARC-Target-URI").alias("target_uri"), get("WARC-Refers-To").alias("refers_to"), get("WARC-Payload-Digest").alias("payload_digest"),
    )
    step = F.col("size") + len(END + MAGIC)
    p = materialize(p.withColumn("step", step), "warc-cand")
    # offsets: a piece's place in its block, and the bytes of the file's earlier blocks
    blocks = p.groupBy("file", "block").agg(F.sum("step").alias("bytes"))
    before = blocks.select("file", "block", (F.sum("bytes").over(W.partitionBy("file").orderBy("block")) - F.col("bytes")).alias("base"))
    inside = F.sum("step").over(W.partitionBy("file", "block").orderBy("seq")) - F.col("step")
    at = p.withColumn("inside", inside).join(before, ["file", "block"]).withColumn("start", F.col("base") + F.col("inside"))
    return at.select(
        "file", "block", "piece", "size", "body_at", "length", "whole", "payload_sha256", "type", "record_id", "target_uri", "refers_to", "payload_digest",
        F.when(F.col("start") == 0, 0).otherwise(F.col("start") - len(MAGIC)).alias("offset"),
        (F.col("start") + F.col("body_at") + F.col("length") + 4).alias("succ"),
    )


def reachable(links: DataFrame) -> DataFrame:
    """(file, offset) of the candidates that a chain of successors joins to the start of their file.

    links(file, offset, succ) with one row for each offset. A cycle can't arise, since successors lie ahead.
    """
    state = materialize(links.select("file", "offset", F.col("succ").alias("to"), (F.col("offset") == 0).alias("reached")), "warc-jump")
    n, now = -1, state.where("reached").count()
    while now != n:
        n = now
        hit = state.where("reached and to is not null").select("file", F.col("to").alias("offset"), F.lit(True).alias("hit")).distinct()
        skip = state.select("file", F.col("offset").alias("to"), F.col("to").alias("next"))
        step = state.join(hit, ["file", "offset"], "left").join(skip, ["file", "to"], "left")
        new = materialize(step.select("file", "offset", F.col("next").alias("to"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "warc-jump")
        release(state)
        state, now = new, new.where("reached").count()
    return state.where("reached").select("file", "offset")


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """(file, offset, type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload_sha256[, payload]) of every record.

    payload_digest is what the record says of its full payload, payload_bytes and payload_sha256 are
    those of the payload that it holds. Only records on the chain from their file's start are given.
    A payload that holds the magic is put together from its pieces, which are found by their digest;
    no other payload leaves the task that read it, unless asked for.
    """
    cand = materialize(candidates(spark, path), "warc-cand")
    real = materialize(cand.join(reachable(cand.where("length is not null").select("file", "offset", "succ")), ["file", "offset"]), "warc-real")
    names = ["file", "offset", "type", "record_id", "target_uri", "refers_to", "payload_digest", F.col("length").alias("payload_bytes"), "payload_sha256"]
    body = lambda v: F.substr(v, F.col("body_at").cast("int") + 1, F.col("length").cast("int"))
    raw = _pieces(spark, path).select("file", "piece", F.col("value").cast("binary").alias("value"))
    whole = real.where("whole")
    if payload:
        whole = whole.join(raw.dropDuplicates(["file", "piece"]), ["file", "piece"]).withColumn("payload", body(F.col("value")))
        names = [*names, "payload"]
    whole = whole.select(*names)
    split = real.where("not whole").select("file", F.col("offset").alias("owner"))
    if split.isEmpty():
        return whole
    # pieces up to the next real record belong to the last real one before them, in their block of the file or an earlier one
    marked = cand.join(real.select("file", "offset", F.col("offset").alias("own")), ["file", "offset"], "left")
    latest = marked.groupBy("file", "block").agg(F.max("own").alias("own"))
    carried = latest.select("file", "block", F.max("own").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    upto = W.partitionBy("file", "block").orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    owned = marked.withColumn("own", F.max("own").over(upto)).join(carried, ["file", "block"])
    parts = owned.select("file", "piece", "offset", F.coalesce("own", "carry").alias("owner")).join(split, ["file", "owner"])
    asked = raw.join(parts.select("file", "piece").distinct(), ["file", "piece"], "left_semi").dropDuplicates(["file", "piece"])
    text = parts.join(asked, ["file", "piece"]).groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("value").alias("h")))).alias("p"))
    joined = F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), (END + MAGIC).encode().hex().upper()))
    made = real.where("not whole").join(text.select("file", F.col("owner").alias("offset"), joined.alias("value")), ["file", "offset"])
    made = made.withColumn("payload", body(F.col("value"))).withColumn("payload_sha256", F.sha2("payload", 256))
    return whole.unionByName(made.select(*names))


def op5_warc(spark, sf_dir: str) -> DataFrame:
    (pages,) = read_tables(spark, sf_dir, "pages")
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    r = read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, rf"^<{ID}(-?[0-9]+)>$", 1).try_cast("long")
    said = F.regexp_extract("payload_digest", r"^sha256:([0-9a-f]{64})$", 1)  # of the full payload: a revisit holds none
    r = r.select(number("record_id").alias("page_id"), F.col("payload_bytes").cast("long").alias("payload_bytes"), F.col("payload_sha256").alias("held"), said.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    r = materialize(r, "warc-records")
    first = r.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("held").alias("payload_digest")).agg(F.min("payload_bytes").alias("payload_bytes"))
    revisit = r.where("record_type = 'revisit'").drop("payload_bytes", "held").join(first, ["refers_to", "payload_digest"])
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    response = r.where("record_type = 'response'").drop("payload_digest").withColumnRenamed("held", "payload_digest").withColumn("refers_to", F.lit(None).cast("long"))
    return response.select(*names).unionByName(revisit.select(*names))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
d AS (SELECT page_id, n, sha256(body) AS digest FROM p),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest, n >= 100) END AS first FROM d)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
