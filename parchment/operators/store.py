"""The document store: listing and search, versions, current state, de-duplication, and the correction overlay."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from .staging import staged

SUMMARY_HIDES = ("storage_uri", "content_type", "error_message")


def upload_error(filename: Column, content_type: Column, size: Column, head: Column, limit: int = v.MAX_UPLOAD_BYTES) -> Column:
    """The first check that an upload fails, in order: extension, content type, empty, size, PDF header; null if none.

    Encrypted and broken files can only be told by a PDF library, which the engine does not hold.
    """
    return (
        F.when(~F.lower(filename).endswith(".pdf"), "unsupported_extension")
        .when(~F.lower(content_type).isin("application/pdf", "application/x-pdf"), "unsupported_content_type")
        .when(size == 0, "empty_file")
        .when(size > limit, "file_too_large")
        .when(head != "%PDF-", "invalid_pdf")
    )


def object_path(checksum: Column) -> Column:
    """Content-addressed place of an original."""
    return F.concat_ws("/", F.substring(checksum, 1, 2), F.substring(checksum, 3, 2), F.concat(checksum, F.lit(".bin")))


def put_once(batch: DataFrame, root: str, batch_id: str) -> DataFrame:
    """Write the contents of a batch (``uri, content``) that are not stored yet; one row per row of the batch.

    Adds ``checksum`` and ``outcome``: ``stored``, ``already_stored`` (the same bytes are there: nothing is written) or
    ``clash`` (other bytes stand there, or the batch itself has several: nothing is written, nothing is overwritten).
    A batch is committed as one folder that is named by its id, so that a repeated or retried batch writes the same folder
    again and a lost one leaves nothing that counts. Rows without uri or content are ``empty``.

    Batches must come one after another, as two at a time do not see each other. Read what is stored with ``stored``.
    """
    spark = batch.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
        raise ValueError("a batch id has letters, digits, _ and - only")
    rows = batch.select("uri", "content", F.sha2("content", 256).alias("checksum"))
    usable = rows.where("uri is not null and content is not null")
    before = stored(spark, root)
    before = None if before is None else before.where(F.col("batch") != batch_id).select("uri", F.col("checksum").alias("_stored"))
    own = usable.groupBy("uri").agg(F.min("checksum").alias("_least"), F.max("checksum").alias("_most"))
    own = own.withColumn("_stored", F.lit(None).cast("string")) if before is None else own.join(before, "uri", "left")
    outcome = F.when(F.col("_least") != F.col("_most"), "clash").when(F.col("_stored").isNull(), "stored").when(F.col("_stored") == F.col("_least"), "already_stored").otherwise("clash")
    told = staged(own.select("uri", outcome.alias("outcome")), "outcomes")
    fresh = usable.join(told.where("outcome = 'stored'").select("uri"), "uri", "left_semi")
    once = fresh.groupBy("uri", "checksum").agg(F.first("content").alias("content"))
    once.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    return rows.drop("content").join(told, "uri", "left").withColumn("outcome", F.coalesce("outcome", F.lit("empty")))


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    """``uri, checksum, content, batch`` of all that ``put_once`` wrote; null if nothing was."""
    try:
        return spark.read.schema("uri string, checksum string, content binary, batch string").parquet(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def is_safe_path(path: Column) -> Column:
    """Local scheme, relative, and without a step upwards."""
    rest = F.regexp_replace(path, "^local://", "")
    return path.startswith("local://") & ~rest.startswith("/") & ~rest.rlike(r"(^|/)\.\.(/|$)")


def search(documents: DataFrame, status: str | None = None, query: str | None = None, kind: str | None = None, issuer: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """All given conditions together; ``query`` looks into title, number and file name. % and _ are live, as in ILIKE."""
    rows = documents
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if query is not None:
        like = [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in ("title", "document_number", "filename")]
        rows = rows.where(like[0] | like[1] | like[2])
    if kind is not None:
        rows = rows.where(F.col("document_type") == kind)
    if issuer is not None:
        rows = rows.where(F.col("issuer").ilike(f"%{issuer}%"))
    if since is not None:
        rows = rows.where(F.col("issued_date") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.where(F.col("issued_date") <= F.lit(until).cast("date"))
    return rows


def list_documents(documents: DataFrame, limit: int = 20, offset: int = 0, **conditions) -> tuple[DataFrame, DataFrame]:
    """A page of matches, newest first, and a one-row table with the number of all matches."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset is not negative")
    rows = search(documents, **conditions)
    page = rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
    return page.drop(*SUMMARY_HIDES), rows.agg(F.count("*").alias("total"))


def detail(documents: DataFrame, runs: DataFrame, document_id: str) -> DataFrame:
    """A document with its runs, latest version first."""
    own = documents.where(F.col("id") == document_id)
    return own.join(runs.withColumnRenamed("id", "run_id").drop("created_at"), own["id"] == runs["document_id"], "left").orderBy(F.desc("version"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key; ties go by the further columns."""
    columns = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(key, "_r.*")


def status_view(documents: DataFrame, jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Each document with its latest job and its current run."""
    job = latest(jobs, "document_id", "created_at", "id").select(F.col("document_id").alias("_d"), F.col("id").alias("job_id"), F.col("status").alias("job_status"))
    run = runs.where("is_current").select(F.col("document_id").alias("_e"), F.col("id").alias("run_id"), "version")
    return documents.join(job, documents["id"] == job["_d"], "left").join(run, documents["id"] == run["_e"], "left").drop("_d", "_e")


def versions(runs: DataFrame, *order: str) -> DataFrame:
    """Adds ``version`` (1, 2, ... by document) and ``is_current`` (the last one)."""
    by = Window.partitionBy("document_id").orderBy(*order)
    return runs.withColumn("version", F.row_number().over(by)).withColumn("is_current", F.lead("version").over(by).isNull())


def next_version(documents: DataFrame, runs: DataFrame) -> DataFrame:
    top = runs.groupBy("document_id").agg(F.max("version").alias("top"))
    return documents.join(top, "document_id", "left").select("document_id", (F.coalesce("top", F.lit(0)) + 1).alias("next_version"))


def deduplicate(uploads: DataFrame, stored: DataFrame | None, content: str, *order: str) -> DataFrame:
    """Adds ``checksum``, ``is_new`` and ``first_id``: the stored or first upload with the same bytes.

    The first upload is a minimum, not a sorted window, so that many copies of one file do not gather in a task.
    """
    rows = uploads.withColumn("checksum", F.sha2(content, 256))
    firsts = rows.groupBy(F.col("checksum").alias("_c")).agg(F.min(F.struct(*order, F.col("id").alias("_id")))["_id"].alias("_first"))
    rows = rows.join(firsts, rows["checksum"] == firsts["_c"])
    if stored is not None:
        known = stored.select(F.col("checksum_sha256").alias("_k"), F.col("id").alias("_stored"))
        rows = rows.join(known, rows["checksum"] == known["_k"], "left")
    else:
        rows = rows.withColumn("_stored", F.lit(None).cast(rows.schema["id"].dataType))
    first = F.coalesce("_stored", "_first")
    return rows.withColumns({"first_id": first, "is_new": F.col("_stored").isNull() & (F.col("id") == F.col("_first"))}).drop("_c", "_k", "_first", "_stored")


# ---- corrections ---------------------------------------------------------------------------


def feedback_errors(events: DataFrame, runs: DataFrame, fields: DataFrame) -> DataFrame:
    """Adds ``error_code``; only critical field corrections are checked."""
    current = runs.where("is_current").select(F.col("document_id").alias("_d")).distinct().withColumn("_run", F.lit(True))
    known = fields.select(F.col("document_id").alias("_e"), F.col("field_id").alias("_f")).distinct().withColumn("_field", F.lit(True))
    rows = events.join(current, events["document_id"] == current["_d"], "left").join(known, (events["document_id"] == known["_e"]) & (events["field_id"] == known["_f"]), "left")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    code = F.when(blank("field_id"), "field_id_required").when(blank("corrected_value"), "corrected_value_required").when(F.col("_run").isNull(), "no_current_run").when(F.col("_field").isNull(), "unknown_field")
    return rows.select(*events.columns, F.when(F.col("feedback_type") == "critical_field_correction", code).alias("error_code"))


def latest_corrections(events: DataFrame) -> DataFrame:
    """The last correction of each document's field, by time and then by event id."""
    rows = events.where((F.col("feedback_type") == "critical_field_correction") & F.col("field_id").isNotNull())
    return rows.groupBy("document_id", "field_id").agg(F.max_by("corrected_value", F.struct("created_at", "id")).alias("corrected_value"))


def overlay(fields: DataFrame, events: DataFrame) -> DataFrame:
    """Fields with corrections laid over; raw and normalized values stay."""
    last = latest_corrections(events)
    rows = fields.join(last, ["document_id", "field_id"], "left")
    return rows.withColumn("review_status", F.when(F.col("corrected_value").isNotNull(), "corrected").otherwise(F.col("review_status")))
