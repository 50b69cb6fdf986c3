"""Web archives: records written by Spark, found again by verified boundary chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from frameprobe.llm.tables import settled, small

MAGIC = "WARC/1.0\r\n"
STOP = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Payloads from this many bytes on are stored once.
LEAST_SHARED = 100


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each row.

    Of the rows with equal payloads of 100 bytes or more, those with the smallest page_id are
    responses and the others revisit them. Null html is an empty payload. A null page_id is
    never the smallest unless no row of the group has one; then all its rows are responses.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = (rows.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
            .withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)))
    shared = (rows.where(F.col("payload_bytes") >= LEAST_SHARED).groupBy("payload_digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("rows"))
              .where("rows > 1 AND first_id IS NOT NULL").drop("rows"))
    joined = rows.join(small(shared), "payload_digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return (joined.withColumn("refers_to", F.when(F.col("first_id").isNotNull(), refers))
            .withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
            .drop("first_id"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """One archive file per partition at ``path``; the two line breaks that end a record are the
    text writer's row separator. Line breaks in a url are percent-encoded."""
    rows = described(pages)

    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))

    def line(key: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))

    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(HTTP), F.when(revisit, "").otherwise(F.col("payload")))
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Refers-To", F.when(revisit, name("refers_to"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block)
    rows.select(record.alias("value")).write.option("lineSep", STOP).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at every magic, in any split: file, block, seq, value."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"), "value"))


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds ``at``, the byte offset of each piece's magic, from the lengths of the pieces before.

    ``pieces`` has file, block, seq and size. Sorting stays within one split; over a file only
    the sums of its splits are added up.
    """
    length = F.col("size") + len(MAGIC)
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = pieces.groupBy("file", "block").agg(F.sum(length).alias("total"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = small(blocks.select("file", "block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base")))
    return (pieces.withColumn("inner", F.coalesce(F.sum(length).over(inside), F.lit(0)))
            .join(starts, ["file", "block"])
            .withColumn("at", F.col("base") + F.col("inner") - len(MAGIC)).drop("inner", "base"))


def _field(header: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?i)(?:^|\r\n){key}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _parsed(value: Column) -> dict[str, Column]:
    """What a piece says of itself, if a record starts with it."""
    header = F.substring_index(value, STOP, 1)
    return {"size": F.octet_length(value).cast("long"),
            "head": F.octet_length(header).cast("long"),
            "content": F.expr("try_cast(__length AS BIGINT)"),
            "type": _field(header, "WARC-Type"), "id": _field(header, "WARC-Record-ID"),
            "refers": _field(header, "WARC-Refers-To"), "uri": _field(header, "WARC-Target-URI"),
            "stated": _field(header, "WARC-Payload-Digest")}


def _payload(block: Column) -> Column:
    """Body of an HTTP message; both are bytes."""
    head = F.octet_length(F.substring_index(block.cast("string"), STOP, 1)) + len(STOP)
    return F.substr(block, (head + 1).cast("int"), F.octet_length(block))


def _block(text: Column) -> Column:
    """Content block of a record that follows its magic in ``text``, as bytes."""
    return F.substr(text.cast("binary"), (F.col("head") + len(STOP) + 1).cast("int"),
                    F.col("content").cast("int"))


def reachable(edges: DataFrame) -> DataFrame:
    """file, at of the records that a chain of successors from offset 0 of their file meets.

    ``edges`` has file, at and next. Each round doubles the length of every jump and lets the
    records reached so far reach one jump further, so n records take log2(n) rounds.
    """
    state = settled(edges.select("file", "at", F.col("next").alias("jump"),
                                 (F.col("at") == 0).alias("reached")))
    known = state.where("reached").count()
    while True:
        landed = (state.where("reached AND jump IS NOT NULL").select("file", F.col("jump").alias("at"))
                  .distinct().withColumn("landed", F.lit(True)))
        further = state.select("file", F.col("at").alias("jump"), F.col("jump").alias("then"))
        state = settled(state.join(landed, ["file", "at"], "left").join(further, ["file", "jump"], "left")
                        .select("file", "at", F.col("then").alias("jump"),
                                (F.col("reached") | F.coalesce("landed", F.lit(False))).alias("reached")))
        now = state.where("reached").count()
        if now == known:
            return state.where("reached").select("file", "at")
        known = now


def read_archive(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The true records: file, at, type, id, refers, uri, stated, payload_bytes, payload_digest
    and, if asked for, payload (binary).

    Every magic makes a candidate with the successor that its Content-Length gives. Inside a
    split, candidates that follow one another without a gap form a run; runs that start where
    such a chain breaks, or where a jump over other candidates lands, are joined by pointer
    jumping from offset 0. A magic in a payload is never reached. Records that span several
    pieces are put together in a second scan of their files only.
    """
    pieces = _pieces(spark, path)
    value = F.col("value")
    length = _field(F.substring_index(value, STOP, 1), "Content-Length")
    rows = pieces.withColumn("__length", length)
    for name, column in _parsed(value).items():
        rows = rows.withColumn(name, column)
    rows = rows.withColumn("whole", F.col("head") + len(STOP) + F.col("content") + len(STOP) == F.col("size"))
    rows = (rows.withColumn("body", F.when(F.col("whole"), _payload(_block(value)))).withColumn("payload_bytes", F.octet_length("body").cast("long"))
            .withColumn("payload_digest", F.sha2("body", 256)))
    kept = ["file", "block", "seq", "size", "head", "content", "whole", "type", "id", "refers", "uri",
            "stated", "payload_bytes", "payload_digest"] + ["body"] * with_payload
    marked = settled(_placed(rows.select(*kept)).where("at >= 0"))
    succ = F.col("at") + len(MAGIC) + F.col("head") + len(STOP) + F.col("content") + len(STOP)
    marked = marked.withColumn("next", succ)

    in_split = Window.partitionBy("file", "block").orderBy("at")
    far = (marked.where("next IS NOT NULL AND NOT whole").select("file", F.col("next").alias("at"))
           .distinct().withColumn("target", F.lit(True)))
    linked = F.lag("next").over(in_split) == F.col("at")
    run = (marked.join(small(far), ["file", "at"], "left")
           .withColumn("head_of_run", F.coalesce("target", F.lit(False)) | ~F.coalesce(linked, F.lit(False)))
           .withColumn("run", F.max(F.when(F.col("head_of_run"), F.col("at"))).over(
               in_split.rowsBetween(Window.unboundedPreceding, 0))).drop("target", "head_of_run"))
    run = settled(run)
    ends = run.groupBy("file", "run").agg(F.max_by("next", "at").alias("next"))
    good = small(reachable(ends.withColumnRenamed("run", "at")).withColumnRenamed("at", "run"))
    records = run.join(good, ["file", "run"], "left_semi")
    split = records.where("NOT coalesce(whole, false)")
    result = ["file", "at", "type", "id", "refers", "uri", "stated", "payload_bytes", "payload_digest"]
    result += ["body"] * with_payload
    plain = records.where("whole").select(*result)
    broken = settled(split.where("content IS NOT NULL").select("file", "at", "head", "content", "next",
                                                               "type", "id", "refers", "uri", "stated"))
    if broken.isEmpty():
        return _named(plain)
    files = small(broken.select("file").distinct())
    again = _placed(_pieces(spark, path).join(files, "file", "left_semi")
                    .withColumn("size", F.octet_length("value").cast("long"))).where("at >= 0")
    owners = broken.select("file", "at", F.col("next").alias("until"))
    by_file = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    owned = (again.join(owners, ["file", "at"], "left")
             .withColumn("owner", F.last(F.when(F.col("until").isNotNull(), F.struct("at", "until")),
                                         ignorenulls=True).over(by_file))
             .where("owner IS NOT NULL AND at < owner.until"))
    joined = owned.groupBy("file", F.col("owner.at").alias("at")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))),
                                 lambda x: x["value"]), MAGIC).alias("text"))
    rebuilt = (broken.join(joined, ["file", "at"]).withColumn("body", _payload(_block(F.col("text"))))
               .withColumn("payload_bytes", F.octet_length("body").cast("long"))
               .withColumn("payload_digest", F.sha2("body", 256)).select(*result))
    return _named(plain.unionByName(rebuilt))


def _named(records: DataFrame) -> DataFrame:
    return records.withColumnRenamed("body", "payload") if "body" in records.columns else records


def resolved(records: DataFrame) -> DataFrame:
    """Records with revisits given the bytes and digest of the response that they refer to."""
    answers = (records.where("type = 'response'")
               .groupBy(F.col("id").alias("refers"), F.concat(F.lit("sha256:"), "payload_digest").alias("stated"))
               .agg(F.max("payload_bytes").alias("__bytes"), F.max("payload_digest").alias("__digest")))
    revisits = (records.where("type = 'revisit'").drop("payload_bytes", "payload_digest")
                .join(answers, ["refers", "stated"], "left")
                .withColumnsRenamed({"__bytes": "payload_bytes", "__digest": "payload_digest"}))
    return records.where("type = 'response'").unionByName(revisits)


def page_of(name: str) -> Column:
    """The page_id in a record id."""
    return F.expr(f"try_cast(regexp_extract({name}, '<urn:page:(-?[0-9]+)>', 1) AS BIGINT)")
